"""Reproducible sampling and the article feed.

Samples are ordered by the MD5 of a seed and the row's key: the same rows on every run, on any
number of tasks, and in any engine.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

SEED = 7
POOL = 80_000
FEED_ROWS = 320
EXTRACT_ROWS = 10_000

PREFIX = 4       # hex digits of the sample key that name a bucket: 65,536 buckets
_SLICE_BITS = 12  # a date is cut into 4,096 slices in the even sample
_PLACE_DIGITS = 12   # hex digits of the sample key that place an article
_MARGIN, _SPARE = 1.25, 100  # a first guess keeps this factor and these many articles more
_ESTIMATE_ERROR = 0.02
_BEYOND = "g"  # after every hex digit


def sample_key(*keys, seed: int = SEED) -> Column:
    """MD5 of the seed and the keys; a NULL key counts as an empty one."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def _below_cutoff(hashed: DataFrame, n: int, size: Column) -> DataFrame:
    """Drop the rows that cannot be among the first n sample keys.

    ``size`` counts what a bucket contributes. The histogram has 65,536 rows at most, so the
    running sum over it is small whatever the input; what survives is about n plus one bucket.
    """
    bucket = F.substring("_key", 1, PREFIX)
    histogram = hashed.groupBy(bucket.alias("bucket")).agg(size.alias("n"))
    return hashed.filter(bucket <= cutoff(histogram, n, "bucket", "n").scalar())


def cutoff(histogram: DataFrame, n: int, bucket: str, size: str) -> DataFrame:
    """The bucket up to which a histogram of sample keys holds n, in one row; beyond every bucket if it never does."""
    reached = F.sum(size).over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0))
    return (
        histogram.withColumn("reached", reached)
        .filter(F.col("reached") >= n)
        .select(F.coalesce(F.min(bucket), F.lit("g")).alias("cutoff"))
    )


def _near_the_first(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """Drop the rows that cannot be among the first n distinct keys in sample order.

    A sketch of the number of distinct keys, merged from one small state per task, gives a place up to
    which about ``n * _MARGIN + _SPARE`` keys lie; those alone are then counted exactly, and if they
    are fewer than n, or the place is the end, every row is kept. Places are compared as hex digits, and the
    sketch hashes no key for the order.
    """
    space = 16**_PLACE_DIGITS
    keys = F.greatest(F.lit(1), F.approx_count_distinct(key, _ESTIMATE_ERROR))
    reach = F.ceil(F.least(F.lit(float(space)), F.lit(space * (n * _MARGIN + _SPARE)) / keys)).cast("bigint")
    digits = F.lpad(F.lower(F.hex(reach)), _PLACE_DIGITS, "0")
    guess = df.agg(F.when(reach >= space, _BEYOND).otherwise(digits).alias("guess")).scalar()
    place = F.substring(sample_key(key, seed=seed), 1, _PLACE_DIGITS)
    # Where all articles are wanted the hash is not even computed: the cheap test comes first.
    enough = (
        df.filter((guess < F.lit(_BEYOND)) & (place < guess))
        .agg((F.count_distinct(F.xxhash64(key)) >= n).alias("enough"))
        .scalar()
    )
    cut = F.when(enough, guess).otherwise(_BEYOND)
    return df.filter((cut >= F.lit(_BEYOND)) | (place < cut))


def dedupe_articles(
    df: DataFrame, key: str = "DocumentIdentifier", order=("date", "SourceCommonName")
) -> DataFrame:
    """One row per article: the earliest, then the smallest source and the remaining columns.

    Each task keeps one row per article before the shuffle, so a hot article stays small.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order, *rest))
    return df.withColumn("_first", first).filter(F.col("_first") == 1).drop("_first")


def pool_sample(
    df: DataFrame,
    n: int = POOL,
    key: str = "DocumentIdentifier",
    seed: int = SEED,
    order=("date", "SourceCommonName"),
    derive: dict[str, Column] | None = None,
) -> DataFrame:
    """A fixed-size random sample of distinct articles.

    ``derive`` adds columns to the sample. They are computed on the few rows near the cutoff while
    these are still spread over tasks; the last cut gathers the sample in one.

    The sample key depends on the article alone, so rows beyond the cutoff are dropped before
    the de-duplication: only about n articles are ever shuffled, whole or as a hash. Distinct keys
    are counted by a 64-bit hash; a collision could only move the cutoff up.
    """
    return (
        dedupe_articles(_near_the_first(df, n, key, seed), key, order)
        .withColumns({**(derive or {}), "_key": sample_key(key, seed=seed)})
        .orderBy("_key", key)
        .limit(n)
        .drop("_key")
    )


def random_extract(df: DataFrame, n: int = EXTRACT_ROWS, seed: int = SEED) -> DataFrame:
    """A fixed-size random sample of rows; equal rows count as often as they occur.

    Equal rows are collapsed into one with a multiplicity, so a row that makes up a large part
    of the table costs one row per task.
    """
    columns = df.columns
    hashed = df.withColumn("_key", sample_key(*columns, seed=seed))
    near = _below_cutoff(hashed, n, F.count("*"))
    first = (
        near.groupBy("_key", *columns)
        .agg(F.count("*").alias("_copies"))
        .orderBy("_key", *columns)
        .limit(n)
    )
    before = F.sum("_copies").over(
        Window.orderBy("_key", *columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    wanted = F.least(F.col("_copies"), F.lit(n) - F.coalesce(before, F.lit(0)))
    return (
        first.withColumn("_wanted", wanted)
        .filter(F.col("_wanted") > 0)
        .select(*columns, F.explode(F.sequence(F.lit(1), F.col("_wanted"))).alias("_copy"))
        .drop("_copy")
    )


def _pick_range(start: Column, count: Column, total: Column, final: int) -> Column:
    """The picks ``floor(i * total / final)`` that fall in ``start .. start + count - 1``."""
    step = F.greatest(F.lit(1.0), total / F.lit(float(final)))
    # One index of slack on each side absorbs the rounding of the division; then test exactly.
    low = F.greatest(F.lit(0), F.ceil(start / step) - 1)
    high = F.least(F.lit(final - 1), F.ceil((start + count) / step) + 1)
    candidates = F.when(low <= high, F.sequence(low.cast("bigint"), high.cast("bigint")))
    picks = F.transform(candidates, lambda i: F.floor(i * step).cast("bigint"))
    return F.filter(picks, lambda p: (p >= start) & (p < start + count))


def even_sample(
    df: DataFrame, final: int = FEED_ROWS, date: str = "date", key: str = "DocumentIdentifier"
) -> DataFrame:
    """At most ``final`` rows, evenly spaced in date order (rows of a date by sample key).

    Row numbers are found without sorting the table: count the rows of each date and slice, add
    the counts up, locate the picked positions, and number only the rows of the slices that hold
    one. A date with a large part of all rows is spread over its slices. Rows need a date and a
    distinct key.
    """
    keyed = sliced(df, key)
    picks = slice_picks(keyed.groupBy(date, "_slice").agg(F.count("*").alias("_rows")), final, date)
    return picked(keyed, picks, date).select(*df.columns)


def sliced(df: DataFrame, key: str) -> DataFrame:
    """Add the sample key ``_key`` and the ``_slice`` of its date that it falls in."""
    slice_no = F.conv(F.substring("_key", 1, 4), 16, 10).cast("int")
    return df.withColumn("_key", sample_key(key)).withColumn("_slice", F.shiftright(slice_no, 16 - _SLICE_BITS))


def slice_picks(cells: DataFrame, final: int, date: str) -> DataFrame:
    """From ``_rows`` by ``date`` and ``_slice``: the slices that hold a pick, with the rank they start at and their picks."""
    days = cells.groupBy(date).agg(F.sum("_rows").alias("_day_rows"))
    running = Window.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(
        date,
        F.coalesce(F.sum("_day_rows").over(running), F.lit(0)).alias("_day_start"),
        F.sum("_day_rows").over(Window.partitionBy()).alias("_total"),
    )
    in_day = Window.partitionBy(date).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_day_start") + F.coalesce(F.sum("_rows").over(in_day), F.lit(0))
    return (
        cells.join(days, date)
        .select(date, "_slice", "_rows", "_total", start.alias("_start"))
        .select(
            date,
            "_slice",
            "_start",
            _pick_range(F.col("_start"), F.col("_rows"), F.col("_total"), final).alias("_picks"),
        )
        .filter(F.size("_picks") > 0)
    )


def picked(keyed: DataFrame, picks: DataFrame, date: str) -> DataFrame:
    """The rows at the picks: only those of slices that hold one are numbered."""
    number = F.row_number().over(Window.partitionBy(date, "_slice").orderBy("_key"))
    return (
        keyed.join(F.broadcast(picks), [date, "_slice"])
        .withColumn("_index", F.col("_start") + number - 1)
        .filter(F.array_contains("_picks", F.col("_index")))
    )


def even_pick_join(df: DataFrame, final: int, order) -> DataFrame:
    """The same even picks on a frame already bounded by a pool: number all rows, keep the picks."""
    index = F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
    total = F.count("*").over(Window.partitionBy())
    return (
        df.withColumns({"_index": index, "_total": total})
        .filter(F.size(_pick_range(F.col("_index"), F.lit(1), F.col("_total"), final)) > 0)
        .drop("_index", "_total")
    )
