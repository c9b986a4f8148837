"""Series over the cube.

Windows without a partition key run in one task. They appear here only on frames of at most one
row per day (about 4,100 rows for eleven years), never on articles or on the cube.
"""

from pyspark.sql import DataFrame, Window, functions as F

from newslens.dims import ERA_BOUNDARIES
from newslens.functions import eras, tone
from newslens.functions.fields import js_round


def everything():
    """The whole frame as one window."""
    return Window.partitionBy()


def global_timeline(cube: DataFrame) -> DataFrame:
    """Volume-weighted tone and articles per day; days without coverage are absent."""
    return (
        cube.filter(tone.covered())
        .groupBy("date")
        .agg(tone.weighted_tone().alias("avg_tone"), tone.volume().alias("article_count"))
    )


def smooth_timeline(series: DataFrame, window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Centred moving average over rows: ``window // 2`` before, the rest from the row itself on.

    Tone is volume-weighted (0 without weight); the count is the rounded mean. ``by`` smooths
    several series at once, such as one per country.
    """
    frame = Window.partitionBy(*by).orderBy("date").rowsBetween(
        -(window // 2), window - window // 2 - 1
    )
    mass = F.sum(F.col("avg_tone") * F.col("article_count")).over(frame)
    weight = F.sum("article_count").over(frame)
    return series.select(
        *by,
        "date",
        F.when(weight > 0, mass / weight).otherwise(F.lit(0.0)).alias("avg_tone"),
        js_round(weight / F.count("*").over(frame)).alias("article_count"),
    )


def rolling_mean(series: DataFrame, days: int = 30, by: tuple[str, ...] = ()) -> DataFrame:
    """Daily tone next to its mean over the trailing calendar days."""
    frame = Window.partitionBy(*by).orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    return series.withColumn("rolling_tone", F.avg("avg_tone").over(frame))


def downsample(series: DataFrame, target: int = 500) -> DataFrame:
    """Every k-th row in date order, where k is the row count over the target, at least 1."""
    position = F.row_number().over(Window.orderBy("date")) - 1
    step = F.greatest(F.lit(1), F.floor(F.count("*").over(everything()) / target))
    return (
        series.withColumns({"_position": position, "_step": step})
        .filter(F.col("_position") % F.col("_step") == 0)
        .drop("_position", "_step")
    )


def tone_trend(series: DataFrame) -> DataFrame:
    """Least-squares line of tone over the row index: slope, intercept and fitted value per row.

    With a single row the slope is 0 and the intercept its tone.
    """
    indexed = series.withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))
    x, y = F.col("i").cast("double"), F.col("avg_tone")
    return indexed.withColumns({
        "slope": F.coalesce(F.regr_slope(y, x).over(everything()), F.lit(0.0)),
        "intercept": F.coalesce(F.regr_intercept(y, x).over(everything()), F.avg(y).over(everything())),
    }).withColumn("trend", F.col("intercept") + F.col("slope") * F.col("i"))


def axis_stats(series: DataFrame, margin: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """Tone range widened to hold ``-margin..margin``, and the share of it above zero."""
    low = F.least(F.min("avg_tone"), F.lit(-margin))
    high = F.greatest(F.max("avg_tone"), F.lit(margin))
    return series.groupBy(*by).agg(low.alias("low"), high.alias("high")).withColumn(
        "zero_offset",
        F.col("high") / F.when(F.col("high") != F.col("low"), F.col("high") - F.col("low")).otherwise(1.0),
    )


def era_spans(dates: DataFrame, boundaries=ERA_BOUNDARIES) -> DataFrame:
    """Where each era starts among the sorted dates (0 if no date reaches it) and its share."""
    n = len(boundaries) - 1
    cut = [F.lit(b).cast("date") for b in boundaries[:n]]
    counts = dates.select("date").distinct().agg(
        F.count("*").alias("total"),
        F.max("date").alias("last"),
        *[F.count_if(F.col("date") < cut[e]).alias(f"before{e}") for e in range(n)],
    )
    starts = [F.when(F.col("last") >= cut[e], F.col(f"before{e}")).otherwise(F.lit(0)) for e in range(n)]
    ends = starts[1:] + [F.col("total")]
    rows = F.array(*[
        F.struct(F.lit(e).alias("era"), s.alias("start_index"), (end - s).alias("days"))
        for e, (s, end) in enumerate(zip(starts, ends))
    ])
    return counts.select("total", F.inline(rows)).select(
        "era",
        "start_index",
        F.try_divide("start_index", "total").alias("start_share"),
        F.try_divide("days", "total").alias("width_share"),
    )


def sparkline_points(series: DataFrame, boundaries=ERA_BOUNDARIES) -> DataFrame:
    """Per era, x in 0..1 by row and y as the share of the tone range above the row.

    Dates outside all eras and eras with fewer than two rows give no points.
    """
    dated = series.select("date", "avg_tone", F.inline(eras.era_rows(boundaries))).filter(
        (F.col("date") >= F.col("start")) & (F.col("date") < F.col("end"))
    )
    era = Window.partitionBy("era")
    high = F.greatest(F.max("avg_tone").over(era), F.lit(0.5))
    low = F.least(F.min("avg_tone").over(era), F.lit(-0.5))
    return (
        dated.select(
            "era",
            "date",
            "avg_tone",
            (F.row_number().over(era.orderBy("date")) - 1).alias("i"),
            F.count("*").over(era).alias("n"),
            high.alias("high"),
            low.alias("low"),
        )
        .filter(F.col("n") >= 2)
        .select(
            "era",
            "date",
            (F.col("i") / (F.col("n") - 1)).alias("x"),
            ((F.col("high") - F.col("avg_tone")) / (F.col("high") - F.col("low"))).alias("y"),
        )
    )
