"""Map frames: the trailing average a playback shows on one date."""

from pyspark.sql import DataFrame, Window, functions as F

from newslens.functions import tone
from newslens.functions.fields import js_round

WINDOW_DAYS = 45        # normal playback
FAST_WINDOW_DAYS = 300  # fast playback


def rolling_country_frame(
    cube: DataFrame, size: int = WINDOW_DAYS, start_date: str | None = None, step: int = 1
) -> DataFrame:
    """All map frames at once: per country and date the weighted tone of the trailing frame days.

    A playback starts at ``start_date`` (default: the cube's first day), as after a jump, and shows
    every ``step``-th day. A frame averages the last ``size`` shown days, fewer at the start; its
    count is the rounded mean per shown day. Countries without coverage in a frame are absent from
    it. The cube must be gap-filled: one row per country and day.
    """
    country = Window.partitionBy("country_iso3")
    if start_date is None:
        begin = F.min("date").over(country)
    else:
        begin = F.lit(start_date).cast("date")
        cube = cube.filter(F.col("date") >= begin)
    shown = cube.withColumn("_day", F.datediff("date", begin)).filter(F.col("_day") % step == 0)
    order = country.orderBy("_day")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    # Sums since the start, and what they were a frame ago: the same cost for any size. As decimals, so that nothing is
    # left over when the two are subtracted.
    mass = (F.col("avg_tone") * F.col("article_count")).cast("decimal(32,18)")
    running = shown.select(
        "date",
        "country_iso3",
        "_day",
        F.coalesce(F.sum(F.when(tone.covered(), mass)).over(so_far), F.lit(0)).alias("_mass"),
        F.coalesce(F.sum(F.when(tone.covered(), F.col("article_count"))).over(so_far), F.lit(0)).alias("_total"),
    )

    def in_frame(name: str):
        return F.col(name) - F.coalesce(F.lag(name, size).over(order), F.lit(0))

    framed = running.select(
        "date",
        "country_iso3",
        in_frame("_mass").cast("double").alias("mass"),
        in_frame("_total").alias("total"),
        F.least(F.lit(size), F.floor(F.col("_day") / step) + 1).alias("frame_days"),
    )
    return framed.filter(F.col("total") > 0).select(
        "date",
        "country_iso3",
        (F.col("mass") / F.col("total")).alias("avg_tone"),
        js_round(F.col("total") / F.col("frame_days")).alias("article_count"),
    )


def frame_average(frame: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One volume-weighted tone per frame (``by='date'`` for many); NULL without weight."""
    return frame.groupBy(*by).agg(tone.weighted_tone().alias("avg_tone"))
