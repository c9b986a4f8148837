"""SimHash near-duplicates by the generalised pigeonhole principle.

Bits that vary together go to one part of the fingerprint. A distance of at most ``t`` over all parts
means a distance of at most ``t_i`` in some part i whenever the ``t_i + 1`` add up to ``t + 1``; a part
with ``t_i = -1`` is not probed. Dynamic programming spreads the thresholds so that estimated candidates
and probes cost least. Fingerprints that share a probed part are compared bit by bit, and what is
linked is reduced to a spanning forest on the way, so copies never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from newslens.llm.components import components, unite
from newslens.llm.stored import stored

BITS = 64
BUCKET = 2048  # larger buckets are divided by further parts
WORDS = 1 << 16  # shingles hashed at a time
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, words: int) -> int:
    """64 bits: those set in over half of the shingles' hashes; zero without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # the white space of ASCII
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1:]
    counts = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for a in range(0, n, WORDS):
        spans = zip(starts[a:a + WORDS].tolist(), last[a:a + WORDS].tolist()[: n - a], strict=False)
        found = np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in spans]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(found, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fingerprint`` of every whole text, as a signed 64-bit integer; nothing is shuffled.

    Null and wordless texts have fingerprint zero, texts of fewer words than a shingle one shingle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=[key, "fingerprint"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fingerprint bigint")


# --- Plan of the parts ----------------------------------------------------------------------------

def correlated_parts(correlation: np.ndarray, n: int) -> list[list[int]]:
    """Bits in ``n`` parts of nearly equal size: each part takes the bits that vary most with its own."""
    free = set(range(len(correlation)))
    strength = np.abs(correlation)
    parts = []
    for i in range(n):
        size = (len(free) + n - i - 1) // (n - i)
        part = [max(free, key=lambda b: (strength[b, sorted(free)].sum(), -b))]
        free.discard(part[0])
        while len(part) < size:
            bit = max(free, key=lambda b: (strength[b, part].sum(), -b))
            part.append(bit)
            free.discard(bit)
        parts.append(sorted(part))
    return parts


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds of least cost: ``costs[i][e + 1]`` for part i at threshold e from -1 on."""
    need = distance + 1  # the sum of all t_i + 1
    best: list[tuple[float, list[int]] | None] = [(0.0, []), *[None] * need]
    for own in costs:
        reached: list[tuple[float, list[int]] | None] = [None] * (need + 1)
        for done, state in enumerate(best):
            for step in range(need - done + 1) if state else ():
                new = (state[0] + own[step], [*state[1], step - 1])
                if reached[done + step] is None or new < reached[done + step]:
                    reached[done + step] = new
        best = reached
    return best[need][1]


def plan(sample: np.ndarray, rows: int, distance: int, most_parts: int = 8) -> tuple[list[list[int]], list[int]]:
    """Parts and thresholds for ``rows`` fingerprints, estimated from a sample of them.

    A candidate's cost counts as one, a probe's as eight. Candidates at each threshold are estimated from
    the sample's pairs; where those are too few, from the parts' bits as if these were independent.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8)[:, ::-1], axis=1).astype(np.float64)  # most significant first
    share = bits.mean(axis=0) if len(bits) else np.full(BITS, 0.5)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    centred = (bits - share) / spread
    correlation = centred.T @ centred / max(len(bits), 1)
    pairs = rows * (rows - 1) / 2
    few = sample[:1024]
    apart = few[:, None] ^ few[None, :]
    upper = np.triu_indices(len(few), 1)
    choices = []
    for n in range(1, most_parts + 1):
        parts = correlated_parts(correlation, n)
        costs = []
        for part in parts:
            mask = np.uint64(sum(1 << (BITS - 1 - b) for b in part))
            seen = np.bitwise_count(apart & mask)[upper]
            chance = np.array([1.0])
            for b in part:
                differs = 2 * share[b] * (1 - share[b])
                chance = np.convolve(chance, [1 - differs, differs])
            own = [0.0]
            for e in range(distance + 1):
                near = max(float((seen <= e).mean()) if len(seen) else 0.0, float(chance[: e + 1].sum()))
                probes = sum(comb(len(part), k) for k in range(e + 1))
                own.append(rows * probes * 8.0 + pairs * near * probes)
            costs.append(own)
        thresholds = allocate(costs, distance)
        choices.append((sum(c[t + 1] for c, t in zip(costs, thresholds, strict=True)), n, parts, thresholds))
    _, _, parts, thresholds = min(choices, key=lambda x: x[:2])
    return parts, thresholds


# --- Candidates -----------------------------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    z = x + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _masks(part: list[int], threshold: int) -> list[int]:
    """What to flip to reach everything within the threshold in a part."""
    single = [1 << (BITS - 1 - b) for b in part]
    return [sum(c) for e in range(threshold + 1) for c in combinations(single, e)]


def probes(distinct: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """``bucket, fp, parts_used``: every fingerprint at the value of each probed part and those near it."""
    masks = [sum(1 << (BITS - 1 - b) for b in p) for p in parts]
    flips = [(i, np.uint64(masks[i]), np.uint64(f)) for i, t in enumerate(thresholds) if t >= 0 for f in _masks(parts[i], t)]

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, mask, flip in flips:
                bucket = _mix((fp & mask) ^ flip, i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), i, np.int32))],
                    names=["bucket", "fp", "part"],
                )

    return distinct.select("fp").mapInArrow(run, "bucket bigint, fp bigint, part int").withColumn("used", F.lit(0).cast("bigint"))


def divide(hot: DataFrame, parts: list[list[int]], distance: int) -> DataFrame:
    """Members of too large buckets dealt to smaller ones, exactly.

    Members of a bucket that are linked differ in at most ``distance`` of the bits outside the parts used so
    far, so of ``distance + 1`` groups of those bits one is equal in both. The buckets of
    ``hot`` have more than ``distance`` bits left.
    """
    order = [b for p in parts for b in p]

    def run(batches):
        for batch in batches:
            bucket, fp, part, used = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            # Bits used: the part of the first probe, then those marked in ``used``.
            first = np.array([sum(1 << (BITS - 1 - b) for b in p) for p in parts], np.uint64)
            taken = first[part] | used.view(np.uint64)
            for value in np.unique(taken):
                own = taken == value
                free = [b for b in order if not int(value) >> (BITS - 1 - b) & 1]
                for k, group in enumerate(np.array_split(free, distance + 1)):
                    mask = np.uint64(sum(1 << (BITS - 1 - b) for b in group.tolist()))
                    inner = _mix(_mix(bucket[own].view(np.uint64), 91 + k) ^ _mix(fp[own].view(np.uint64) & mask, 17), k)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(inner.view(np.int64)), pa.array(fp[own]), pa.array(part[own]), pa.array((used[own].view(np.uint64) | mask).view(np.int64))],
                        names=["bucket", "fp", "part", "used"],
                    )

    return hot.select("bucket", "fp", "part", "used").mapInArrow(run, "bucket bigint, fp bigint, part int, used bigint")


def link(bucket: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within buckets; equal buckets are neighbours.

    Compares each row with the next one, the next but one, and so on, as far as buckets reach; pairs
    that are connected by then are passed over.
    """
    values, index = np.unique(fp, return_inverse=True)
    labels = np.arange(len(values))
    rows, step = np.arange(len(fp)), 1
    while True:
        rows = rows[rows + step < len(fp)]
        rows = rows[bucket[rows] == bucket[rows + step]]
        if not len(rows):
            break
        a, b = index[rows], index[rows + step]
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
        near = np.bitwise_count(values[a] ^ values[b]) <= distance
        if near.any():
            labels = unite(labels, a[near], b[near])
        step += 1
    moved = np.flatnonzero(labels != np.arange(len(values)))
    return values[moved], values[labels[moved]]


def links(members: DataFrame, distance: int) -> DataFrame:
    """``a, b``: a spanning forest of the links in every task's buckets, whose sizes are bounded."""

    def run(frames):
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            bucket = frame["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1], "left")) if len(bucket) else 0
            rest = frame.iloc[cut:]
            a, b = link(bucket[:cut], frame["fp"].to_numpy()[:cut].view(np.uint64), distance)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})
        if rest is not None and len(rest):
            a, b = link(rest["bucket"].to_numpy(), rest["fp"].to_numpy().view(np.uint64), distance)
            yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = members.select("bucket", "fp").distinct().repartition("bucket").sortWithinPartitions("bucket", "fp")
    return dealt.mapInPandas(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, distance: int = 3, sample_rows: int = 8192, bucket_rows: int = BUCKET) -> DataFrame:
    """``a, b`` over the distinct fingerprints ``fp``: edges that connect what is linked, and nothing else.

    The plan is estimated from ``sample_rows`` fingerprints, the smallest by a hash; it decides costs only.
    Buckets of more than ``bucket_rows`` members are divided while more than ``distance`` of their bits are
    unused; what is left then differs in few bits and is compared whatever its size.
    """
    rows = distinct.count()
    chosen = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()
    parts, thresholds = plan(np.array([r["fp"] for r in chosen], np.int64).view(np.uint64), rows, distance)
    members = stored(probes(distinct, parts, thresholds), "probes")
    edges = None
    sizes = F.array(*[F.lit(len(p)) for p in parts])
    unused = F.lit(BITS) - F.get(sizes, F.col("part")) - F.bit_count("used")
    for _ in range(BITS):
        counted = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(unused).alias("unused"))
        hot = counted.filter((F.col("n") > bucket_rows) & (F.col("unused") > distance))
        hot = stored(hot.select(F.col("bucket").alias("hot")), "hot")
        large = hot.take(1)
        usual = members.join(hot, members["bucket"] == hot["hot"], "left_anti") if large else members
        found = links(usual, distance)
        edges = found if edges is None else edges.unionByName(found)
        if not large:
            return edges
        divided = members.join(hot, members["bucket"] == hot["hot"], "left_semi")
        members = stored(divide(divided, parts, distance).distinct(), "probes")
    raise RuntimeError("buckets have not become small")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, key: str = "doc_id") -> DataFrame:
    """``key, fingerprint, component_id`` for every row: fingerprints at ``distance`` or fewer bits are linked.

    ``component_id`` is the smallest key that links reach. Equal fingerprints are one node, whatever the
    number of their rows. A null key keeps its row and counts for no minimum; its component is null only
    if all keys in it are. Empty input gives no rows.
    """
    rows = stored(fingerprints(docs, words, key), "fingerprints")
    distinct = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least")), "distinct")
    grouped = components(near_links(distinct, distance))
    labelled = distinct.join(grouped, distinct["fp"] == grouped["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    classes = labelled.join(least, labelled["root"] == least["of"]).select("fp", "component_id")
    return rows.join(classes, rows["fingerprint"] == classes["fp"]).select(key, "fingerprint", "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3, key: str = "doc_id") -> DataFrame:
    """The document with the smallest key of each component, with all its columns.

    A null key comes after all others. Texts that share a key are told apart by their hash, the smaller one
    first; rows equal in key and text stay or go together. Empty input gives no rows.
    """
    mark = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64("text").alias("own"))
    found = near_duplicates(docs.select(mark.alias("mark"), "text"), words, distance, "mark")
    gone = found.filter(F.col("mark") != F.col("component_id")).select(F.col("mark").alias("gone")).distinct()
    # Packed, so that columns of any name pass through.
    rows = docs.select(F.struct("*").alias("row"), mark.alias("mark"))
    return rows.join(gone, rows["mark"] == gone["gone"], "left_anti").select("row.*")
