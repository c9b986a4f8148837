"""A corpus from raw documents to tokens, as stages that are stored one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newslens.llm import bpe, exact, langid, mixing, queries, simhash
from newslens.llm.stored import stored

BROADCAST_FILES = 50_000  # about 5 MB of names and counts
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; null texts, texts without letters and rejected ones go."""
    held = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    model = langid.fit(docs, ~held, held)
    found = langid.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return found.filter(~F.col("rejected")).select(*COLUMNS)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest id; null texts count as empty, null ids lose."""
    return exact.keep_first(docs, exact.open_index(spark)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; null texts count as empty."""
    return simhash.keep_one(docs, queries.SHINGLE, queries.DISTANCE).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which their sources are mixed; the files they are written to keep it."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of ids and decoded text, and ``position``: every document's place in the mixture, from 0.

    The place is read from the stored order: the rows of the part files before, and those before it in its own. Null
    texts count as empty.
    """
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("int")
    placed = docs.select("doc_id", "text", F.struct(part.alias("part"), F.col("_metadata.file_name").alias("name")).alias("file"), F.col("_metadata.row_index").alias("row"))
    # A row for each file of the mixture; sent to all tasks while there are not too many, so that no text is shuffled.
    sizes = placed.groupBy("file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("file").alias("of"), before.alias("before"))
    if len(docs.inputFiles()) <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    numbered = placed.join(starts, placed["file"] == starts["of"]).select("doc_id", "text", (F.col("before") + F.col("row")).alias("position"))
    return bpe.encode(numbered, bpe.tokenizer_file(spark, queries.TOKENIZER), ids=False, keep=["position"])


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("mixing", mixture),
    ("bpe", tokens),
]

# Character models, SimHash and BPE are beyond SQL; tests compare the result with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
