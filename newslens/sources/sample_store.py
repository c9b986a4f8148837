"""Articles stored in the order of their samples, so that a sample reads little more than its own rows.

``pool`` holds every article once, ordered by sample key: the first n rows are the sample of n articles. ``days`` holds
them by date and slice, for samples that are even in time. Beside each are the counts that tell where
a rank lies: at most 65,536 rows for the pool, and one for each date and slice. Row groups are small, and
readers push what they ask for down to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newslens.operators import feed

_GROUP_ROWS = 20_000


def _write(df: DataFrame, path: str, *order: str) -> None:
    (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .write.mode("overwrite").option("compression", "snappy").option("parquet.block.row.count.limit", _GROUP_ROWS).parquet(path)
    )


class SampleStore:
    """The store in ``path``, for articles with the columns ``schema``; ``key`` tells articles apart."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "DocumentIdentifier", date: str = "date"):
        self.spark, self.path, self.schema, self.key, self.date = spark, path.rstrip("/"), schema, key, date

    def write(self, df: DataFrame) -> None:
        """De-duplicate the articles once, and store them and their counts."""
        single = feed.dedupe_articles(df.filter(F.col(self.key).isNotNull() & F.col(self.date).isNotNull()), self.key)
        _write(single.withColumn("_key", feed.sample_key(self.key, seed=feed.SEED)), f"{self.path}/pool", "_key")
        stored = self._rows("pool", "_key string")
        prefix = F.substring("_key", 1, feed.PREFIX).alias("prefix")
        stored.groupBy(prefix).agg(F.count("*").alias("articles")).write.mode("overwrite").parquet(f"{self.path}/pool-counts")
        _write(feed.sliced(stored.drop("_key"), self.key), f"{self.path}/days", self.date, "_slice")
        cells = self._rows("days", "_key string, _slice int").groupBy(self.date, "_slice").agg(F.count("*").alias("_rows"))
        cells.write.mode("overwrite").parquet(f"{self.path}/days-counts")

    def _rows(self, name: str, more: str) -> DataFrame:
        schema = T.StructType([*self.schema.fields, *T.StructType.fromDDL(more).fields])
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def pool(self, n: int = feed.POOL) -> DataFrame:
        """What :func:`feed.pool_sample` gives of the articles, from about n rows."""
        counts = self.spark.read.schema("prefix string, articles long").parquet(f"{self.path}/pool-counts")
        cutoff = feed.cutoff(counts, n, "prefix", "articles").first()[0]
        # After every key of the last prefix; hexadecimal digits end at f.
        rows = self._rows("pool", "_key string").filter(F.col("_key") < f"{cutoff}g")
        return rows.orderBy("_key", self.key).limit(n).drop("_key")

    def even(self, final: int = feed.FEED_ROWS) -> DataFrame:
        """What :func:`feed.even_sample` gives of the articles: only the days and slices that hold a pick are read.

        Brings the at most ``final`` picked slices to the driver.
        """
        kinds = dict(zip(self.schema.fieldNames(), self.schema.fields, strict=True))
        cells = self.spark.read.schema(
            T.StructType([T.StructField(self.date, kinds[self.date].dataType), *T.StructType.fromDDL("_slice int, _rows long").fields])
        ).parquet(f"{self.path}/days-counts")
        wanted = feed.slice_picks(cells, final, self.date)
        picks = wanted.collect()
        asked = self.spark.createDataFrame(picks, wanted.schema)
        rows = self._rows("days", "_key string, _slice int").filter(
            F.col(self.date).isin(sorted({p[self.date] for p in picks})) & F.col("_slice").isin(sorted({p["_slice"] for p in picks}))
        )
        return feed.picked(rows, asked, self.date).select(*self.schema.fieldNames())
