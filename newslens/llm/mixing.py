"""Mixing sources to target weights by Pfair scheduling.

A source of weight w out of W has its i-th block (from 1) released at slot ``(i - 1) W / w`` and due by
``i W / w``; in every slot the released block with the earliest deadline is next. Up to any slot every
source is less than one block away from its share. The slots are cut into legs; from the number of blocks
that each source has before a cut, its leg is planned by itself, in a Spark task. When a source ends, the others
go on in the proportion of their weights.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newslens.llm.ranks import ranked

REST = "(rest)"


def scaled(wanted: list[float] | list[Fraction], most: int) -> list[int]:
    """Whole weights in the same proportion, at least 1 each, with a sum of about ``most``."""
    total = sum(wanted)
    return [max(1, round(w * most / total)) for w in wanted]


def whole(wanted: list[float], blocks: int) -> list[int]:
    """Whole weights in exactly the same proportion; if 64 bits do not hold their products with ``blocks``, the
    nearest that do, which after all blocks differ by far less than a block."""
    exact = [Fraction(w) for w in wanted]
    low = lcm(*[f.denominator for f in exact])
    weights = [int(f * low) for f in exact]
    common = gcd(*weights)
    weights = [w // common for w in weights]
    most = (1 << 62) // (blocks + 1)
    return weights if sum(weights) <= most else scaled(exact, most - len(exact))


def states(weights: list[int], blocks: list[int], every: int) -> Iterator[tuple[int, list[int]]]:
    """A phase, earliest deadline first among released blocks: after every so many slots and at its end the number of
    slots and of each source's blocks in them. It ends before the slot in which a source is due that has no block left."""
    total, done, slot = sum(weights), [0] * len(weights), 0
    later = [(0, -(-total // w), s) for s, w in enumerate(weights)]
    heapq.heapify(later)
    ready: list[tuple[int, int]] = []
    while True:
        while later and later[0][0] <= slot:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        s = heapq.heappop(ready)[1]
        if done[s] == blocks[s]:
            yield slot, done
            return
        done[s] += 1
        heapq.heappush(later, (done[s] * total // weights[s], -(-(done[s] + 1) * total // weights[s]), s))
        slot += 1
        if slot % every == 0:
            yield slot, list(done)


def legs(blocks: list[int], weights: list[int], length: int, most: int = 1024) -> list[tuple[int, ...]]:
    """``phase, cut, slots, source, weight, total, done, until, first, begins`` for each source of each leg.

    A phase runs by the weights as given until a source that is due has no block left; then the others begin anew by
    theirs. Phases are cut into legs of ``length`` slots; where those would be more than ``most``, of up to 16 times as many.
    """
    left, first, begins, out, phase = list(blocks), [0] * len(blocks), 0, [], 0
    leg = length * min(16, -(-sum(blocks) // (length * most)))
    while any(left):
        own = [s for s, n in enumerate(left) if n]
        shares = [weights[s] for s in own]
        total, cut, done = sum(shares), 0, [0] * len(own)
        for end, until in states(shares, [left[s] for s in own], leg):
            out += [
                (phase, cut, end - cut, s, w, total, a, b, first[s], begins)
                for s, w, a, b in zip(own, shares, done, until, strict=True) if b > a
            ]
            cut, done = end, until
        for s, n in zip(own, done, strict=True):
            left[s] -= n
            first[s] += n
        begins, phase = begins + cut, phase + 1
    return out


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 8,
    max_period: int = 1024, seed: str = "mix", max_legs: int = 1024,
) -> DataFrame:
    """All rows with their place in the mixture: the columns of ``docs`` as ``row``, and ``stream, block, slot, place``.

    ``weights`` gives the target weights by source; without it every source is weighted by the square root of its
    rows. Sources without a weight, null ones included, form one stream ``(rest)`` weighted as if it were a
    source. Order by ``slot, place``: slots are gapless from 0, a slot is one block of ``block_rows`` rows (the
    last of a stream may be shorter), and ``place`` numbers its rows. Within a stream rows are in the order of a
    hash of their content. No row is dropped or repeated; empty input gives no rows.

    At every slot each source is less than a block away from its share by the weights as given, until a source is due
    that has no block left; then the same holds for the others from there on. Inputs of any size follow this one rule. The
    sources' row counts reach the driver. It goes through the slots once, keeps each source's blocks at the cuts between legs (about
    ``max_legs`` legs of ``max_period`` slots, up to 16 million blocks, more beyond) and no slot; the slots of the
    legs are planned in tasks.
    """
    spark = docs.sparkSession
    named = None if weights is None else sorted(w for w in weights if weights[w] > 0)
    stream = _stream(F.col("source"), named)
    sizes = {r["stream"]: r["n"] for r in docs.groupBy(stream.alias("stream")).agg(F.count("*").alias("n")).collect()}
    streams = sorted(sizes)
    wanted = [(weights or {}).get(s) or sizes[s] ** 0.5 for s in streams]
    blocks = [-(-sizes[s] // block_rows) for s in streams]
    planned = legs(blocks, whole(wanted, sum(blocks)), max_period, max_legs) if streams else []
    slots = _slots(spark, streams, planned)

    def dealt(buckets: DataFrame) -> DataFrame:
        """The slots of the blocks that a bucket's rows are in."""
        each = buckets.withColumn("block", F.explode(F.expr(f"sequence(_start div {int(block_rows)}, (_start + _rows - 1) div {int(block_rows)})")))
        joined = each.join(slots, (each["_stream"] == slots["of"]) & (each["block"] == slots["at_block"]))
        own = F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"])
        return joined.groupBy(*buckets.columns).agg(own.alias("slots")).withColumn("first_block", F.expr(f"_start div {int(block_rows)}"))

    rows = docs.select(F.struct("*").alias("row"), stream.alias("stream"), F.xxhash64("*").alias("content"))
    ordered = ranked(rows, ["stream"], ["content"], "at", "stream_rows", salt=seed, dealt=dealt).withColumn(
        "block", F.expr(f"at div {int(block_rows)}")
    )
    return ordered.select(
        "row", "stream", "block",
        F.expr("slots[cast(block - first_block as int)]").alias("slot"),
        (F.col("at") % block_rows).alias("place"),
    )


def _stream(source: Column, named: list[str] | None) -> Column:
    if named is None:
        return F.coalesce(source, F.lit(REST))
    return F.when(source.isin(named), source).otherwise(F.lit(REST)) if named else F.lit(REST)


def _slots(spark: SparkSession, streams: list[str], planned: list[tuple[int, ...]]) -> DataFrame:
    """``of, at_block, slot`` of every block."""
    names = "phase long, cut long, slots long, of string, weight long, total long, done long, until long, first long, begins long"
    parts = spark.createDataFrame([(*x[:3], streams[x[3]], *x[4:]) for x in planned], names)
    # By number, so that adaptive execution does not put small but slow legs into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    jobs = parts.repartition(tasks, "phase", "cut").select(
        "phase", "cut", "slots", "first", "begins", "of", "weight", "total",
        F.explode(F.expr("sequence(done, until - 1)")).alias("i"),
    ).select(
        "phase", "cut", "slots", "begins",
        F.expr("greatest(0, i * total div weight - cut)").alias("release"),
        F.expr("named_struct('due', ((i + 1) * total + weight - 1) div weight, 'of', of, 'at', first + i)").alias("job"),
    )
    period = ["phase", "cut", "slots", "begins"]
    released = jobs.groupBy(*period, "release").agg(F.collect_list("job").alias("jobs"))
    turns = released.groupBy(*period).agg(F.map_from_entries(F.collect_list(F.struct("release", "jobs"))).alias("by"))
    none = "cast(array() as array<struct<due: bigint, of: string, at: bigint>>)"
    ready = f"concat(x.ready, coalesce(by[t], {none}))"
    taken = F.expr(f"""aggregate(
        sequence(0L, slots - 1), named_struct('ready', {none}, 'out', {none}),
        (x, t) -> named_struct(
            'ready', array_remove({ready}, array_min({ready})), 'out', concat(x.out, array(array_min({ready})))),
        x -> x.out)""")
    return turns.select(F.expr("begins + cut").alias("from"), F.posexplode(taken).alias("offset", "job")).select(
        F.col("job.of").alias("of"), F.col("job.at").alias("at_block"), (F.col("from") + F.col("offset")).alias("slot")
    )


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, in the order of the mixture."""
    return mix(docs, weights, **options).orderBy("slot", "place").select("row.*")
