"""Importance resampling towards a target distribution.

Features are runs of words, hashed into a fixed number of buckets. An array of gains, one per bucket, says how much
likelier a feature is in the target than in the corpus; a document's weight is the mean gain of its
features, and Gumbel noise from its id turns the best scores into a draw without replacement.

The draw needs exact ranks over all documents: parallel sorting by regular sampling. Every task sorts its own rows
and gives evenly spaced ones as samples; those give splitters; rows go to the segment between their splitters,
are merged there, and prefix counts of the segments make their places ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from newslens.llm.stored import stored

BUCKETS = 10_000
SAMPLES = 1024  # regular samples that a run gives at least, if it has so many rows; twice as many at most
FAN_IN = 64     # runs whose samples are merged in one place
_PIECE = 1 << 22  # bytes of text that are tokenised at a time, but always whole texts
_LONG = 64        # words longer than this are hashed one by one
_ALL = 0xFFFFFFFF


def _lowered() -> np.ndarray:
    """Every byte of a word in lower case, and 0 for bytes between words."""
    table = np.zeros(256, np.uint8)
    for b in [*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
        table[b] = b
    for b in range(ord("A"), ord("Z") + 1):
        table[b] = b + 32
    return table


def _crc_table() -> np.ndarray:
    states = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        states = np.where(states & 1, (states >> 1) ^ np.uint32(0xEDB88320), states >> 1)
    return states


_LOWERED, _CRC = _lowered(), _crc_table()


def _step(states: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(states ^ byte) & 0xFF] ^ (states >> 8)


def _hashed(states: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Go on with the CRC-32 of every row through its word: one pass per byte over all words that are as long."""
    out = states.copy()
    order = np.argsort(-lengths, kind="stable")
    falling = lengths[order]
    long = int(np.searchsorted(-falling, -_LONG, side="left"))
    for i in order[:long]:
        word = data[starts[i]:starts[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(word, int(out[i]) ^ _ALL) ^ _ALL
    order, falling = order[long:], falling[long:]
    for at in range(int(falling[0]) if len(falling) else 0):
        rows = order[:int(np.searchsorted(-falling, -at, side="left"))]
        out[rows] = _step(out[rows], data[starts[rows] + at])
    return out


def features(text: np.ndarray, ends: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text, and the text and bucket of every feature. ``ends``: where texts begin in ``text``, and the end."""
    low = _LOWERED[text]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = ends[(ends > 0) & (ends < len(text))]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    words_before = np.searchsorted(starts, ends)
    counts = np.diff(words_before)
    of = np.repeat(np.arange(len(counts)), counts)
    left = words_before[1:][of] - np.arange(len(starts))
    states = _hashed(np.full(len(starts), _ALL, np.uint32), low, starts, lengths)
    rows, found = [of], [(states ^ _ALL) % buckets]
    for n in range(2, longest + 1):
        keep = np.flatnonzero(left >= n)
        states[keep] = _hashed(_step(states[keep], 0x20), low, starts[keep + n - 1], lengths[keep + n - 1])
        rows.append(of[keep])
        found.append((states[keep] ^ _ALL) % buckets)
    return counts, np.concatenate(rows), np.concatenate(found).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a column: its rows ``a`` to ``b``, their bytes one after another, and where each begins."""
    raw = column.cast(pa.large_binary())
    if raw.null_count:
        raw = raw.fill_null(b"")
    _, offsets, data = raw.buffers()
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    a = 0
    while a < len(raw):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + _PIECE, side="right")) - 1)
        yield a, b, data[ends[a]:ends[b]], ends[a:b + 1] - ends[a]
        a = b


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Features in every bucket, ``bucket, n``, over all ``text``; buckets without any are absent.

    Every task adds up an array of its own, so a frequent word costs no more than a rare one, and at most ``buckets``
    rows of each task are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, text, ends in _texts(batch.column(0)):
                total += np.bincount(features(text, ends, longest, buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousand times the log likelihood ratio of every bucket, add-one smoothed, as whole numbers.

    Brings the two tables of at most ``buckets`` rows to the driver.
    """
    def held(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for row in counts.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = held(corpus), held(target)
    s_all, t_all = int(s.sum()), int(t.sum())
    return np.array([
        math.floor(1000 * math.log(float(b + 1) * (s_all + buckets) / (float(a + 1) * (t_all + buckets))))
        for a, b in zip(s.tolist(), t.tolist(), strict=True)
    ], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean gain of a document's features, 0 without any."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for a, b, text, ends in _texts(batch.column(1)):
                words, of, bucket = features(text, ends, longest, len(gain))
                n = np.bincount(of, minlength=len(words))
                total = np.zeros(len(words), np.int64)
                np.add.at(total, of, gain[bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(words.astype(np.int64)), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    names=["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def noise(seed: str) -> Column:
    """Thousand times a Gumbel variate from the SHA-256 of ``seed`` and ``doc_id``, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def _order() -> list[Column]:
    """How rows are ranked; ``seq`` tells equal rows apart."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("seq")]


def _keys() -> list[Column]:
    """The same as four columns without nulls, which pandas keeps as whole numbers."""
    return [F.col("score"), F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("seq")]


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.iloc[np.lexsort((frame["seq"], frame["id"], frame["missing"], -frame["score"]))]


def _thinned(frame: pd.DataFrame, samples: int) -> pd.DataFrame:
    """Of weighted samples about as many that stand for equal numbers of rows."""
    frame = _sorted(frame)
    if len(frame) <= samples:
        return frame
    upto = np.cumsum(frame["stands_for"].to_numpy())
    marks = np.arange(samples) * (upto[-1] / samples)
    picked = np.unique(np.searchsorted(upto, marks, side="right"))
    shares = np.diff(np.append(0, upto[picked]))
    return frame.iloc[picked].assign(stands_for=shares)


_SAMPLE = "run bigint, score bigint, missing boolean, id bigint, seq bigint, stands_for bigint"


def regular_samples(runs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Evenly spaced rows of every task's sorted run; a task holds at most twice ``samples`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, every, seen = None, 1, 0
        for batch in batches:
            rows = pa.Table.from_batches([batch]).take(pa.array(np.arange((-seen) % every, batch.num_rows, every)))
            kept = pa.concat_tables([kept, rows]) if kept else rows
            seen += batch.num_rows
            while kept.num_rows > 2 * samples:
                kept, every = kept.take(pa.array(np.arange(0, kept.num_rows, 2))), 2 * every
        if kept:
            own = TaskContext.get().partitionId()
            whole = kept.append_column("stands_for", pa.array(np.full(kept.num_rows, every)))
            yield from whole.add_column(0, "run", pa.array(np.full(kept.num_rows, own))).combine_chunks().to_batches()

    return runs.select(*_keys()).mapInArrow(run, _SAMPLE)


def splitters(samples: DataFrame, segments: int, per_run: int = SAMPLES, fan_in: int = FAN_IN) -> pd.DataFrame:
    """``segments - 1`` samples at most that part all rows about evenly.

    Samples of ``fan_in`` runs are merged and thinned in a task, level by level, until the driver gets those of at
    most ``fan_in`` runs. A segment holds ``1 / segments + 2 * levels / per_run`` of the rows at most.
    """
    samples = stored(samples, "samples")
    runs = (samples.agg(F.max("run")).first()[0] or 0) + 1
    while runs > fan_in:
        grouped = samples.withColumn("run", F.floor(F.col("run") / fan_in)).groupBy("run")
        samples = stored(grouped.applyInPandas(lambda frame: _thinned(frame, 2 * per_run), _SAMPLE), "samples")
        runs = -(-runs // fan_in)
    found = _sorted(samples.toPandas())
    upto = np.cumsum(found["stands_for"].to_numpy())
    if not len(upto):
        return found
    marks = np.arange(1, segments) * (upto[-1] / segments)
    return found.iloc[np.unique(np.searchsorted(upto, marks, side="left"))]


def _segment(cut: pd.DataFrame) -> Column:
    """Number of splitters up to a row, in the order of the ranks."""
    own = [cut[c].to_numpy() for c in ("seq", "id", "missing", "score")]

    def run(score: pa.Array, missing: pa.Array, ids: pa.Array, seq: pa.Array) -> pa.Array:
        rows = [c.to_numpy(zero_copy_only=False) for c in (seq, ids, missing, score)]
        *least, score = [np.concatenate(pair) for pair in zip(own, rows, strict=True)]
        at = np.lexsort((*least, -score))
        out = np.empty(len(at), np.int32)
        out[at] = np.cumsum(at < len(own[0]))
        return pa.array(out[len(own[0]):])

    return F.arrow_udf(run, "int")(*_keys())


def ranked(rows: DataFrame, segments: int | None = None, samples: int = SAMPLES) -> tuple[DataFrame, int]:
    """Add ``rank``: 1, 2, 3, ... by falling ``score``, then ``doc_id`` (null last), then ``seq``; and the number of rows.

    ``rows`` is a stored table and ``seq`` differs in all rows, so many rows of one score and id part over segments as
    others do. Collects at most ``2 * samples * FAN_IN`` sample rows and a count per segment.
    """
    spark = rows.sparkSession
    segments = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = splitters(regular_samples(rows.sortWithinPartitions(*_order()), samples), segments, samples)
    dealt = rows.withColumn("segment", _segment(cut))
    counts = {r["segment"]: r["n"] for r in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before, table = 0, []
    for s in range(segments):
        table.append((s, before))
        before += counts.get(s, 0)
    starts = F.broadcast(spark.createDataFrame(table, "_segment int, _before bigint"))  # a row per segment
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*_order())).cast("bigint")
    merged = dealt.repartitionById(segments, "segment").withColumn("rank", place)
    numbered = merged.join(starts, merged["segment"] == starts["_segment"], "left")
    return numbered.withColumn("rank", F.col("rank") + F.col("_before")).drop("segment", "_segment", "_before"), before


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, longest: int = 1,
    buckets: int = BUCKETS, seed: str = "2024", samples: int = SAMPLES,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null for those not drawn.

    Of the N documents with ``min_words`` words or more the ``percent * N // 100`` best scores are drawn, ties to the smaller
    ``doc_id``. Features are all runs of 1 to ``longest`` words; the texts of ``target`` say what is wanted.

    Null and empty texts, and texts without a word, have no features and weight 0. A null id is hashed as an empty text
    and loses ties. Repeated rows are rows of their own; of rows equal in score and id, which are drawn is open where the last
    rank falls among them. Long texts are read whole, one at a time. Empty tables of either kind are well
    defined (empty ``docs`` give no rows). Further columns are not read, whatever their names.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets)
    scored = weighted(docs, gain, longest).withColumns({
        "score": F.col("weight") + noise(seed), "seq": F.monotonically_increasing_id(),
    })
    scored = stored(scored, "scored")
    wanted = F.col("n_words") >= min_words
    placed, n = ranked(scored.filter(wanted), samples=samples)
    drawn = placed.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = scored.filter(~wanted).withColumn("rank", F.lit(None).cast("bigint"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")
