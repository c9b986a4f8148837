"""Removal of passages that occur more than once, by level-wise doubling of the window length.

Level 1 are windows of a quarter of the wanted length. One in about fifteen of them is looked at: in every
window of the wanted length, the short one with the smallest hash, its anchor. Equal long windows have
equal anchors at the same place, so a long window whose anchor is alone cannot repeat. Level 2 are windows
of twice that length: every anchor that repeats is extended to the right or to the left, where the long
windows around it reach, and those alone on both sides are dropped. Level 3, twice as long again and
overlapping to fit, is the wanted length. What is left is extended to it: first the whole stretch of long
windows that share an anchor is compared at once, and stretches that are alone there, with those that share
their anchor, are taken apart into single windows. Nothing longer is asked for, so no candidate survives that.

Equal texts are one text with a weight, so a group of copies is looked at once; equal stretches are one kind
with a weight, so they are extended once. Hashes are polynomials modulo 2**64 of 64-bit word hashes, and always
compared together with the anchor's own hash, so equality rests on 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from newslens.llm.stored import stored

RUN = 1 << 18  # words hashed at a time
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
# An anchor's place in 64 bits: first window (a text has fewer than 2**30 words), windows, two doubled hashes.
_FIRST, _COUNT, _SIDE = 34, 26, 13
MOST_WORDS = 300  # so that an anchor's windows, three quarters of a window's words, are counted in eight bits


class Hashes:
    """Window hashes of the words of several texts, at most ``RUN`` + a window of them."""

    def __init__(self, words: list[bytes]):
        found = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)
        n = len(found)
        self.up = np.cumprod(np.full(n + 1, _BASE, np.uint64)) if n else np.ones(1, np.uint64)
        down = np.cumprod(np.full(n, _INVERSE, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found * down, dtype=np.uint64)])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the words from each start to before each end, wherever they are."""
        z = (self.sums[ends] - self.sums[starts]) * self.up[starts]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def smallest(values: np.ndarray, reach: int) -> np.ndarray:
    """Place of the smallest of ``reach`` values from each place on, the leftmost of equal ones."""
    keyed = (values & ~np.uint64(0xFFFFF)) | np.arange(len(values), dtype=np.uint64)
    done = 1
    while done * 2 <= reach:
        keyed = np.minimum(keyed[: len(keyed) - done], keyed[done:])
        done *= 2
    if done < reach:
        keyed = np.minimum(keyed[: len(keyed) - (reach - done)], keyed[reach - done:])
    return (keyed & np.uint64(0xFFFFF)).astype(np.int64)


def anchors(words: list[bytes], sizes: list[int], length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text, first long window, their number, anchor hash, stretch hash, doubled hashes."""
    base, total = -(-length // 4), len(words)
    if total < length:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    hashes = Hashes(words)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.arange(total - length + 1)
    short = np.arange(total - base + 1)
    short_hash = hashes.at(short, short + base)
    place = smallest(short_hash, length - base + 1)
    inside = starts + length <= bounds[owner[starts] + 1]
    starts, place = starts[inside], place[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    first, anchor = starts[new], place[new]
    count = np.diff(np.append(new, len(starts)))
    last = first + count - 1
    twice = 2 * base
    # To the right where some long window reaches so far, else to the left.
    right_ok, left_ok = anchor + twice <= last + length, anchor + base - twice >= first
    right = np.where(right_ok, hashes.at(anchor, np.minimum(anchor + twice, total)), np.uint64(0))
    left = np.where(left_ok, hashes.at(np.maximum(anchor + base - twice, 0), anchor + base), np.uint64(0))
    text = owner[first]
    return text, first - bounds[text], count, short_hash[anchor], hashes.at(first, last + length), right, left


def _runs(texts: Iterator[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes], list[int]]]:
    """Texts, offsets, words and sizes in runs; a text longer than a run comes in pieces that overlap."""
    rows, offsets, words, sizes = [], [], [], []
    for i, text in enumerate(texts):
        own = text.split()  # at the white space of ASCII
        for a in range(0, max(1, len(own) - length + 1), RUN):
            piece = own[a:a + RUN + length - 1]
            rows.append(i)
            offsets.append(a)
            words += piece
            sizes.append(len(piece))
            if len(words) >= RUN:
                yield rows, offsets, words, sizes
                rows, offsets, words, sizes = [], [], [], []
    if rows:
        yield rows, offsets, words, sizes


def _digested(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.sha2(text, 256).alias("digest"), text.alias("text"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``tid, digest, weight, small``: every text once, compressed, with weight 2 if it has copies."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            small = [press.compress((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(small, pa.binary())], names=["digest", "small"])

    packed = _digested(docs).select("digest", "text").mapInArrow(run, "digest string, small binary")
    texts = packed.groupBy("digest").agg(F.first("small").alias("small"), F.count("*").alias("copies"))
    return stored(texts.select(
        F.monotonically_increasing_id().alias("tid"), "digest", F.least("copies", F.lit(2)).cast("int").alias("weight"), "small"
    ), "texts")


def find_anchors(texts: DataFrame, length: int) -> DataFrame:
    """``tid, weight, spot, h, s`` per anchor; ``spot`` packs first window, their number and doubled hashes.

    Thirteen bits of each doubled hash suffice to leave candidates out; what they let through is compared
    at the wanted length.
    """

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            tid, weight = batch.column(0), batch.column(1)
            for rows, offsets, words, sizes in _runs((plain.decompress(t.as_py()) for t in batch.column(2)), length):
                text, first, count, h, s, right, left = anchors(words, sizes, length)
                if not len(text):
                    continue
                row = pa.array(np.array(rows, np.int64)[text])
                spot = (first + np.array(offsets, np.int64)[text]).astype(np.uint64) << np.uint64(_FIRST)
                spot |= count.astype(np.uint64) << np.uint64(_COUNT)
                spot |= (right >> np.uint64(64 - _SIDE)) << np.uint64(_SIDE) | left >> np.uint64(64 - _SIDE)
                yield pa.RecordBatch.from_arrays(
                    [tid.take(row), weight.take(row), *(pa.array(x.view(np.int64)) for x in (spot, h, s))],
                    names=["tid", "weight", "spot", "h", "s"],
                )

    return texts.select("tid", "weight", "small").mapInArrow(run, "tid bigint, weight int, spot bigint, h bigint, s bigint")


def _first(spot: Column) -> Column:
    return F.shiftrightunsigned(spot, _FIRST)


def _count(spot: Column) -> Column:
    return F.shiftright(spot, _COUNT).bitwiseAND(F.lit(255))


def repeated_anchors(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level 1: the anchors that repeat, and ``h, s, same, tid, spot``, one row per kind of stretch among them.

    Counts are added up on the map side and stored, here and below, so that the joins with them have two
    plain shuffles and adaptive execution can split an anchor of very many places.
    """
    again = found.groupBy(F.col("h").alias("again")).agg(F.sum("weight").alias("n")).filter("n >= 2")
    again = stored(again.select("again"), "anchor-hashes")
    rows = stored(found.join(again, found["h"] == again["again"], "left_semi"), "repeated-anchors")
    kinds = stored(rows.groupBy("h", "s").agg(
        F.sum("weight").alias("same"), F.first("tid").alias("tid"), F.first("spot").alias("spot")
    ), "kinds")
    return rows, kinds


def doubled(kinds: DataFrame) -> DataFrame:
    """Level 2: the kinds whose anchor, at twice its length, is not alone to the right or to the left."""
    sides = {"right": F.shiftright("spot", _SIDE).bitwiseAND(F.lit((1 << _SIDE) - 1)), "left": F.col("spot").bitwiseAND(F.lit((1 << _SIDE) - 1))}
    rows = kinds.withColumns(sides)
    for side in sides:
        again = rows.groupBy(F.col("h").alias("of_h"), F.col(side).alias("of_side")).agg(F.sum("same").alias("n")).filter("n >= 2")
        again = stored(again.select("of_h", "of_side"), f"doubled-{side}").withColumn(f"again_{side}", F.lit(True))
        rows = rows.join(again, (rows["h"] == again["of_h"]) & (rows[side] == again["of_side"]), "left").drop("of_h", "of_side")
    return stored(rows.filter("again_right or again_left").select(*kinds.columns), "doubled")


def stretches(rows: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Anchors whose whole stretch repeats, and of each other kind of stretch that may repeat in part, one.

    ``kinds`` are those left by :func:`doubled`. Among the latter is one of every repeated kind that shares its
    anchor with a kind that is alone, as windows of the two may be equal.
    """
    whole = kinds.filter("same >= 2").select(F.col("h").alias("of_h"), F.col("s").alias("of_s"))
    settled = rows.join(whole, (rows["h"] == whole["of_h"]) & (rows["s"] == whole["of_s"]), "left_semi")
    partly = kinds.groupBy(F.col("h").alias("of")).agg(
        F.min("same").alias("least"), F.count("*").alias("n")
    ).filter("least = 1 and n >= 2")
    partly = stored(partly.select("of"), "partly")
    loose = kinds.join(partly, kinds["h"] == partly["of"], "left_semi")
    return settled.select("tid", "spot"), loose.select("tid", "spot", "h")


def windows(texts: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """``tid, weight, at, h, w``: the single long windows of open stretches."""
    wanted = open_.groupBy(F.col("tid").alias("of")).agg(F.collect_set(F.struct("spot", "h")).alias("spots"))
    rows = texts.join(wanted, texts["tid"] == wanted["of"]).select("tid", "weight", "small", "spots.spot", "spots.h")

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                words = plain.decompress(batch.column(2)[i].as_py()).split()
                spots, h = (np.array(batch.column(c)[i].as_py(), np.int64) for c in (3, 4))
                first, count = (spots.view(np.uint64) >> np.uint64(_FIRST)).astype(np.int64), spots >> _COUNT & 255
                for a in range(0, max(1, len(words) - length + 1), RUN):
                    piece = words[a:a + RUN + length - 1]
                    starts = np.repeat(first - a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                    anchor = np.repeat(h, count)
                    here = (starts >= 0) & (starts < RUN)
                    starts, anchor = starts[here], anchor[here]
                    if len(starts):
                        w = Hashes(piece).at(starts, starts + length)
                        row = pa.array(np.full(len(starts), i))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(row), batch.column(1).take(row), pa.array(starts + a), pa.array(anchor), pa.array(w.view(np.int64))],
                            names=["tid", "weight", "at", "h", "w"],
                        )

    return rows.mapInArrow(run, "tid bigint, weight int, at bigint, h bigint, w bigint")


def repeated_windows(texts: DataFrame, length: int = 35) -> DataFrame:
    """``tid, first, count``: runs of windows of ``length`` words that start more than once in ``distinct_texts``."""
    if not 4 <= length <= MOST_WORDS:
        raise ValueError(f"windows have 4 to {MOST_WORDS} words")
    rows, kinds = repeated_anchors(stored(find_anchors(texts, length), "anchors"))
    settled, open_ = stretches(rows, doubled(kinds))
    single = stored(windows(texts, open_, length), "windows")
    twice = single.groupBy(F.col("h").alias("of_h"), F.col("w").alias("of_w")).agg(F.sum("weight").alias("n")).filter("n >= 2")
    twice = stored(twice.select("of_h", "of_w"), "repeated-windows")
    again = single.join(twice, (single["h"] == twice["of_h"]) & (single["w"] == twice["of_w"]), "left_semi")
    return settled.select("tid", _first(F.col("spot")).alias("first"), _count(F.col("spot")).alias("count")).unionByName(
        again.select("tid", F.col("at").alias("first"), F.lit(1).cast("long").alias("count"))
    )


def remove_repeats(docs: DataFrame, length: int = 35, result: Column | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: every text without the words of windows that occur again.

    Words are what lies between ASCII white space, unchanged; ``kept`` joins what stays by one space, or is
    ``result``, an expression of that ``kept``, taken before it is handed to all rows of its text. All
    windows are judged on the input. Texts shorter than a window keep all words; null texts have none.
    Rows equal in text repeat each other. Null ids are values like others, further columns are not read,
    empty input gives no rows.
    """
    texts = distinct_texts(docs)
    found = repeated_windows(texts, length).select(
        F.col("tid").alias("of"), F.shiftleft("first", 8).bitwiseOR(F.col("count")).alias("run")
    )
    runs = found.groupBy("of").agg(F.collect_set("run").alias("runs"))
    rows = texts.join(runs, texts["tid"] == runs["of"], "left").select("digest", "small", "runs")

    def run(batches):
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, kept = [], [], []
            for small, runs in zip(batch.column(1), batch.column(2), strict=True):
                words = plain.decompress(small.as_py()).split()
                marks = np.zeros(len(words) + 1, np.int64)
                found = np.array(runs.as_py() or [], np.int64)
                np.add.at(marks, found >> 8, 1)
                np.add.at(marks, (found >> 8) + (found & 255) - 1 + length, -1)
                gone = np.cumsum(marks[:-1]) > 0
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words
                kept.append(b" ".join(left).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                names=["of", "n_words", "n_removed", "kept"],
            )

    judged = rows.mapInArrow(run, "of string, n_words bigint, n_removed bigint, kept string")
    judged = judged.select("of", "n_words", "n_removed", (F.col("kept") if result is None else result).alias("kept"))
    ids = _digested(docs).select("doc_id", "digest")
    return ids.join(judged, ids["digest"] == judged["of"]).select("doc_id", "n_words", "n_removed", "kept")
