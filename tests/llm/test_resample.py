"""Importance resampling against plain counting and sorting."""

import collections
import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newslens.llm import resample
from newslens.llm.stored import stored

SCHEMA = "doc_id long, text string, score long, seq long, segment int, n_words string"
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
pick = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(200)] + ["café", "日本", "ÀB", "x" * 63, "x" * 64, "y" * 65, "z" * 5000, "9"]
TEXTS = [None, "", " ", "!!", "A b-C", "a\x00b", "é" * 70_000, "word " * 40_000] + [
    pick.choice([" ", ", ", "\n"]).join(pick.choices(VOCABULARY, k=pick.randint(1, 60))) for _ in range(120)
]


def found(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode("utf-8", "surrogatepass")) % buckets for r in runs]


def expected(rows, target, longest=1, buckets=10_000, percent=10, least=20, seed="2024"):
    """(doc_id, n_features, weight, score, rank) of all rows, by plain sorting."""
    held = [found(t, longest, buckets) for _, t in rows]
    s, t = (collections.Counter(b for _, own in side for b in own) for side in (held, [found(x, longest, buckets) for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, ((doc_id, _), (_, own)) in enumerate(zip(rows, held, strict=True)):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    order = sorted((i for i in range(len(rows)) if held[i][0] >= least), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0] or 0))
    for rank, i in enumerate(order[:percent * len(order) // 100]):
        out[i][4] = rank + 1
    return [tuple(r) for r in out]


def same(df, rows):
    def order(r):
        return [(v is None, v or 0) for v in r]
    return sorted((tuple(r) for r in df.collect()), key=order) == sorted(rows, key=order)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[-1]), (None, TEXTS[-1]), (7, TEXTS[20])]
    target = [TEXTS[30], TEXTS[31], None, "café café"]
    return (
        rows, target, spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA),
        spark.createDataFrame([(t,) for t in target], "text string"),
    )


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (1, 7, 100, 0), (2, 10_000, 50, 5), (3, 500, 33, 1)])
def test_against_plain_counts(tables, longest, buckets, percent, least):
    rows, target, docs, wanted = tables
    got = resample.resample(docs, wanted, percent, least, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert same(got, expected(rows, target, longest, buckets, percent, least))


def test_empty_tables(spark, tables):
    rows, target, docs, wanted = tables
    none = spark.createDataFrame([], SCHEMA)
    assert resample.resample(none, wanted).collect() == []
    assert same(resample.resample(docs, none), expected(rows, []))


def test_frequent_features_are_favoured(spark):
    rows = [(i, ("good " if i % 2 else "bad ") * 30) for i in range(400)]
    wanted = spark.createDataFrame([("good " * 50,)], "text string")
    scored = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), wanted, buckets=10)
    drawn = scored.filter("rank is not null").collect()
    assert len(drawn) == 40 and sum(r.doc_id % 2 for r in drawn) > 35


@pytest.mark.parametrize("segments", [1, 7, 300])
def test_ranks_by_regular_sampling(spark, segments):
    """A third of the rows share score and id; null ids; few scores."""
    n = 30_000
    base = spark.range(n, numPartitions=90).select(
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.pmod(F.xxhash64("id"), F.lit(40)) - 20).cast("long").alias("score"),
        F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 7 == 0, None).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2**62))).alias("doc_id"),
        F.col("id").alias("seq"),
    )
    rows = stored(base, "rows")
    placed, total = resample.ranked(rows, segments, samples=16)
    assert total == n
    got = {r.seq: r.rank for r in placed.collect()}
    order = sorted(rows.collect(), key=lambda r: (-r.score, r.doc_id is None, r.doc_id or 0, r.seq))
    assert got == {r.seq: i + 1 for i, r in enumerate(order)}


def test_segments_are_even(spark):
    """Also when samples are merged level by level, and for ids that doubles cannot hold."""
    big = 2**60
    rows = stored(spark.range(40_000, numPartitions=100).select(
        F.lit(1).cast("long").alias("score"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + big).alias("doc_id"), F.col("id").alias("seq")
    ), "rows")
    samples = resample.regular_samples(rows.sortWithinPartitions("doc_id", "seq"), 32)
    assert samples.groupBy("run").count().agg(F.max("count")).first()[0] <= 64
    cut = resample.splitters(samples, 20, 32, fan_in=8)
    sizes = rows.withColumn("segment", resample._segment(cut)).groupBy("segment").count().collect()
    assert len(sizes) == 20 and max(r["count"] for r in sizes) < 3 * 40_000 / 20
    assert cut["id"].dtype == np.int64 and (cut["id"] >= big).all()
