"""The article table: topic scans, stored scans and CSV extracts."""

import datetime as dt
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from newslens import schemas
from newslens.operators.filters import keyword_match, month_bounds, partition_range, topic_match
from newslens.sources import storage
from newslens.sources.versions import Part, VersionedTable, partition_files

SCAN_VERSION = "v1"  # raise it when the scanned columns change


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The article table, stored as Parquet partitioned by ``partition_date``."""
    return spark.read.schema(schemas.ARTICLES).parquet(path)


def write_articles_table(df: DataFrame, path: str) -> None:
    """Store an article table by day, so topic scans can prune partitions.

    Days are dealt to tasks by their measured size: adaptive execution splits a day that is larger
    than a partition ought to be, and puts small ones together.
    """
    dealt = df.hint("rebalance", "partition_date")
    dealt.write.mode("overwrite").partitionBy("partition_date").parquet(path)


def topic_scan(
    articles: DataFrame, keywords, start: str, end: str, regex: bool = False, keep=()
) -> DataFrame:
    """Articles of a topic in whole months ``YYYY-MM``, projected to the scan columns and those to ``keep``."""
    in_range = partition_range(articles, start, end)
    return keyword_match(in_range, keywords, regex).select(*schemas.SCAN_COLUMNS, *keep)


def scan_path(folder: str, topic: str, keywords, start: str, end: str, snapshot: str = "") -> str:
    """Where a scan is stored: readable slug plus a digest of all parameters.

    ``snapshot`` names the state of the article table, such as its path and version.
    """
    words = sorted(k.lower().strip() for k in keywords)
    digest = hashlib.sha256(json.dumps([words, start, end, SCAN_VERSION, *filter(None, [snapshot])]).encode()).hexdigest()
    return f"{folder.rstrip('/')}/{storage.slug(topic)}-{start}-{end}-{digest[:32]}.parquet"


def materialize_scan(
    articles: DataFrame, folder: str, topic: str, keywords, start: str, end: str, snapshot: str = ""
) -> DataFrame:
    """Read the stored result of this scan, or run the scan, store and read it.

    A half-written result is not reused, and an empty one is not kept. Rows are counted while
    they are written. Give another ``snapshot`` when the article table has changed: a stored scan
    is found by its parameters alone.
    """
    spark = articles.sparkSession
    path = scan_path(folder, topic, keywords, start, end, snapshot)
    scan = topic_scan(articles, keywords, start, end)
    if not storage.is_complete(spark, path):
        written = Observation()
        counted = scan.observe(written, F.count(F.lit(1)).alias("records"))
        counted.write.mode("overwrite").option("compression", "snappy").parquet(path)
        if written.get["records"] == 0:
            storage.remove(spark, path)
            return scan.limit(0)
    return spark.read.schema(scan.schema).parquet(path)


def materialize_scans(
    articles: DataFrame, folder: str, topics: dict[str, list[str]], start: str, end: str, snapshot: str = ""
) -> dict[str, DataFrame]:
    """The stored scans of many topics from one scan of the articles, by topic.

    Each is what :func:`materialize_scan` would read. The scans of a batch of topics are stored together, partitioned by topic, under a
    digest of all their keywords; a topic without articles has an empty scan.
    """
    spark = articles.sparkSession
    every = sorted(json.dumps([name, sorted({k.lower().strip() for k in words})]) for name, words in topics.items())
    path = scan_path(folder, "topics", every, start, end, snapshot)
    names = sorted(topics)
    if not storage.is_complete(spark, path):
        found = topic_match(partition_range(articles, start, end), topics, "_topic")
        number = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("_topic")).alias("topic_no")
        rows = found.select(*schemas.SCAN_COLUMNS, number)
        rows.hint("rebalance", "topic_no").write.mode("overwrite").partitionBy("topic_no").option("compression", "snappy").parquet(path)
    stored = spark.read.schema(T.StructType([*schemas.SCAN.fields, T.StructField("topic_no", T.LongType())])).parquet(path)
    return {n: stored.filter(F.col("topic_no") == i + 1).select(*schemas.SCAN_COLUMNS) for i, n in enumerate(names)}


@dataclass(frozen=True)
class GrowingScan:
    """A stored scan by day. ``changed``: the days that the last refresh scanned anew, or whose articles are gone."""

    table: VersionedTable
    parts: tuple[Part, ...]
    changed: tuple[dt.date, ...]

    def rows(self, days=None) -> DataFrame:
        """The scan columns of all days, or of the given ones; files of other days are not opened."""
        wanted = None if days is None else {d.isoformat() for d in days}
        chosen = [p for p in self.parts if wanted is None or p.value in wanted]
        return self.table.read(chosen, schemas.SCAN).select(*schemas.SCAN_COLUMNS)


def refresh_scan(
    spark: SparkSession, path: str, folder: str, topic: str, keywords, start: str, end: str, regex: bool = False
) -> GrowingScan:
    """The scan of a table that grows: only days whose files have changed since the last refresh are read.

    ``path`` is the article table by day. Every stored day carries a digest of its files' names, sizes and times; days with another digest,
    new ones and ones that are gone are found from the listing alone. They are scanned and replaced in one
    step. ``end`` may move on from call to call; the stored scan is found by the other parameters.
    """
    first, last = (d.isoformat() for d in month_bounds(start, end))
    table = VersionedTable(spark, f"{scan_path(folder, topic, [*keywords, *(['(pattern)'] if regex else [])], start, '')}", "day")
    listing = partition_files(spark, path, "partition_date").filter(F.col("value").between(first, last))
    files = {r["value"]: r["note"] for r in listing.collect()}
    stored = {p.value: p for p in table.parts()}
    in_range = {v for v in stored if first <= v <= last}
    fresh = sorted(v for v, note in files.items() if v not in stored or stored[v].note != note)
    gone = sorted(in_range - set(files))
    if fresh or gone:
        days = [dt.date.fromisoformat(v) for v in fresh]
        articles = read_articles(spark, path).filter(F.col("partition_date").isin(days))
        found = topic_scan(articles, keywords, start, end, regex, keep=["partition_date"])
        by_day = found.withColumn("day", F.col("partition_date").cast("string")).drop("partition_date")
        version, written = table.stage(by_day.hint("rebalance", "day"))
        for value in fresh:
            stored[value] = Part(value, version if value in written else None, files[value])
        for value in gone:
            del stored[value]
        table.publish(version, list(stored.values()))
    parts = tuple(p for _, p in sorted(stored.items()) if first <= p.value <= last)
    return GrowingScan(table, parts, tuple(dt.date.fromisoformat(v) for v in sorted([*fresh, *gone])))


_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_csv_extract(spark: SparkSession, path: str) -> DataFrame:
    """Six-field CSV extract of the article table; the header decides the column order."""
    return spark.read.schema(schemas.CSV_EXTRACT).options(**_CSV, enforceSchema=False).csv(path)


def write_csv_extract(df: DataFrame, path: str) -> None:
    columns = schemas.CSV_EXTRACT.fieldNames()
    df.select(*columns).write.mode("overwrite").options(**_CSV).csv(path)
