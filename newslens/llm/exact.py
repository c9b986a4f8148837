"""Exact de-duplication against a persistent digest index.

The index is a table bucketed and sorted by digest. New data is reduced to one entry per digest; a sort-merge anti-join
with the index, whose side needs no shuffle, tells which digests are new. What a batch adds is appended last and under
the batch's name: an owner where the digest is new, else a further count. A batch that is run again is judged without its own
entries and adds nothing twice, so a run that broke off anywhere can be repeated. Texts are equal when
their SHA-256 after lower-casing A-Z is.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslens.llm.stored import stored
from newslens.sources import storage


def normalised(text: Column) -> Column:
    """``text`` with A-Z in lower case; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


_ENTRY = "digest STRING, keep_id BIGINT, group_size BIGINT, owner BOOLEAN, batch STRING"


class DigestIndex:
    """An index in ``folder``. The number of its buckets is noted beside it, so that any session opens it alike;
    ``buckets`` (default: the session's shuffle partitions) holds for a new one. :meth:`close` it after use."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        note = f"{folder.rstrip('/')}-buckets"
        if storage.is_complete(spark, note):
            self.buckets = spark.read.schema("buckets int").json(note).first()["buckets"]
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1, numPartitions=1).select(F.lit(self.buckets).alias("buckets")).write.json(note)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({_ENTRY}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )

    def close(self) -> None:
        """Take the table's name out of the catalog; the index stays in its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def entries(self, without: str | None = None) -> DataFrame:
        """``digest, keep_id, group_size`` of every digest: the owner's id and the number of all rows so far, ``without``
        those of a batch. A batch that was appended twice counts once."""
        table = self.spark.table(self.name)
        if without is not None:
            table = table.filter(F.col("batch") != without)
        once = table.groupBy("digest", "batch").agg(
            F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("owner").alias("owner")
        )
        added = once.groupBy("digest").agg(
            F.max(F.when(F.col("owner"), F.col("keep_id"))).alias("keep_id"), F.sum("group_size").alias("group_size"),
            F.max("owner").alias("owned"),
        )
        return added.filter("owned").drop("owned")

    def append(self, entries: DataFrame, batch: str) -> None:
        """Add one row per digest of ``digest, keep_id, group_size, owner``."""
        named = entries.select("digest", "keep_id", "group_size", "owner", F.lit(batch).alias("batch"))
        named.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(
            self.buckets, "digest"
        ).sortBy("digest").saveAsTable(self.name)

    def compacted(self, folder: str) -> DigestIndex:
        """A new index of the same entries with one row per digest. Batches in it can no longer be told apart, so only run
        new ones on it."""
        new = DigestIndex(self.spark, folder, self.buckets)
        new.append(self.entries().withColumn("owner", F.lit(True)), "compacted")
        return new


def digested(docs: DataFrame) -> DataFrame:
    return docs.withColumn("digest", F.sha2(normalised(F.col("text")), 256))


def open_index(spark: SparkSession, folder: str | None = None) -> DigestIndex:
    return DigestIndex(spark, folder or storage.scratch_folder(spark, "digests"))


def classify(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Add documents to the index; one row per document with its decision.

    Gives ``doc_id, digest, keep_id, group_size, kept``; ``group_size`` counts the rows of earlier batches too. Of equal texts the largest
    ``doc_id`` stays; an entry that was in the index before wins over new rows. Of rows equal in id and text one stays. A
    null id loses to any other; if all are null, one row stays and ``keep_id`` is null. Empty input
    gives no rows. Only digests and ids are shuffled, and equal rows are counted on the map side.

    ``batch`` names these documents, so that the same call can be repeated, whether or not it had come to its end, with
    the same result; by default every call is a batch of its own.
    """
    batch = batch or uuid.uuid4().hex
    # Stored, so that the joins below read plain tables, which adaptive execution can split.
    rows = stored(digested(docs.select("doc_id", "text")).groupBy("digest", "doc_id").agg(F.count("*").alias("copies")), "digested")
    # Stored too: the optimizer would move the anti-join below this sum, where a digest has a row for each of its ids.
    own = stored(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("copies")), "own")
    known = index.entries(without=batch)
    fresh = own.join(known.select("digest").hint("merge"), "digest", "left_anti").select(
        "digest", "keep_id", "copies", F.col("copies").alias("group_size"), F.lit(True).alias("owner")
    )
    earlier = known.select("digest", F.col("keep_id").alias("first"), F.col("group_size").alias("before")).hint("merge")
    later = own.join(earlier, "digest").select(
        "digest", F.col("first").alias("keep_id"), "copies", (F.col("before") + F.col("copies")).alias("group_size"), F.lit(False).alias("owner")
    )
    judged = stored(fresh.unionByName(later), "judged")
    index.append(judged.select("digest", F.when(F.col("owner"), F.col("keep_id")).alias("keep_id"), F.col("copies").alias("group_size"), "owner"), batch)
    joined = rows.join(judged.drop("copies"), "digest")
    return joined.select(
        "doc_id", "digest", "keep_id", "group_size", "owner", F.explode(_copies(F.col("copies"))).alias("from"), "copies",
    ).select(
        "doc_id", "digest", "keep_id", "group_size", "owner", "from",
        F.explode(F.sequence(F.lit(1), F.least(F.lit(_STEP), F.col("copies") - F.col("from")))).alias("copy"),
    ).select(
        "doc_id", "digest", "keep_id", "group_size",
        (F.col("owner") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("from") + F.col("copy") == 1)).alias("kept"),
    )


_STEP = 4096


def _copies(n: Column) -> Column:
    """Where each run of copies begins, so that no row holds an array of all of them."""
    return F.sequence(F.lit(0).cast("bigint"), n - 1, F.lit(_STEP).cast("bigint"))


def keep_first(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = classify(docs, index).filter("kept").select("digest", "doc_id")
    # Packed, so that columns of any name pass through.
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(F.col("text")), 256).alias("own")
    )
    chosen = rows.join(kept, (rows["own"] == kept["digest"]) & rows["id"].eqNullSafe(kept["doc_id"]), "left_semi")
    return chosen.dropDuplicates(["own"]).select("row.*")
