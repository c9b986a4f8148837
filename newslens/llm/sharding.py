"""Sharding by a Feistel permutation of global row numbers.

Rows get gapless numbers from a hash of their own content, so the numbers do not depend on files or
tasks. A Feistel network permutes the smallest square power of two that holds them, and is applied
again while it leads outside (cycle walking). Position p of the shuffle is slot ``p // shards`` of shard
``p % shards``: shards hold counts that are at most one apart, and both can be computed for any row
number, and back, without the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from newslens.llm.ranks import ranked

ROUNDS = 6


def _round(half: np.ndarray, key: int) -> np.ndarray:
    z = half + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _walk(values: np.ndarray, n: int, seed: int, forward: bool) -> np.ndarray:
    bits = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = [((seed + 1) * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64) for r in range(ROUNDS)]
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> width, out[todo] & mask
        for key in keys if forward else keys[::-1]:
            if forward:
                left, right = right, left ^ (_round(right, key) & mask)
            else:
                left, right = right ^ (_round(left, key) & mask), left
        out[todo] = (left << width) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permuted(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Positions of row numbers in the shuffle of ``n`` rows."""
    return _walk(rows, n, seed, True)


def origin(positions: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers of positions: what :func:`permuted` was given."""
    return _walk(positions, n, seed, False)


def shard(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Put every row into a shard: ``doc_id, size, text_crc32, row, position, shard, slot``.

    ``size`` is the UTF-8 length of the text plus 8; a null text has no bytes and CRC 0. Rows are numbered
    in the order of a hash of id, size and checksum. Rows equal in all three are interchangeable: they are
    counted, numbered together and written out again, so no task gets them all. Null ids are values like
    others, further columns are not read, and empty input gives no rows.
    """
    thin = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    counted = thin.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    # One group for all: its buckets are what is distributed.
    one = counted.withColumn("all", F.lit(0))
    numbered = ranked(one, ["all"], ["doc_id", "size", "text_crc32"], "first", "n", copies="copies")
    rows = numbered.select(
        "doc_id", "size", "text_crc32", "n",
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)).alias("row"),
    )

    @F.pandas_udf("bigint")
    def position(row: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(permuted(row.to_numpy(), int(n.iloc[0]), seed) if len(row) else row)

    placed = rows.withColumn("position", position("row", "n"))
    return placed.select(
        "doc_id", "size", "text_crc32", "row", "position",
        (F.col("position") % shards).cast("int").alias("shard"),
        F.expr(f"position div {int(shards)}").alias("slot"),
    )
