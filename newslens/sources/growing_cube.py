"""A stored cube that takes new and corrected days without reading older articles.

The cube is stored by month. Since it has no gaps, its rows on the day before a change hold all that the
days before have to say: every country seen so far and its last known tone. So a change needs the daily
aggregate of the changed days, that one day of the cube, and the observations that the cube itself holds from
there on. The result is the cube that all articles together would give.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from newslens import schemas
from newslens.operators.coverage import CUBE_KEYS
from newslens.sources import storage
from newslens.sources.articles import GrowingScan
from newslens.sources.versions import Part, VersionedTable

_ONE_DAY = dt.timedelta(days=1)
_COLUMNS = schemas.GROWING_COVERAGE.fieldNames()


@dataclass(frozen=True)
class _Month:
    """A part of the cube and the days it covers; ``seen`` is the last of them with articles."""

    part: Part
    first: dt.date
    last: dt.date
    seen: dt.date | None


@dataclass(frozen=True)
class Change:
    """What an update read and wrote."""

    first: dt.date | None
    months_read: tuple[str, ...]
    months_written: tuple[str, ...]


def _month(day: dt.date) -> str:
    return f"{day:%Y-%m}"


def _described(part: Part) -> _Month:
    note = {k: v and dt.date.fromisoformat(v) for k, v in json.loads(part.note).items()}
    return _Month(part, note["first"], note["last"], note["seen"])


class GrowingCube:
    """The cube in ``path``: months, each in the versions that its parts name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, path, "month")

    def read(self, first: str | None = None, last: str | None = None) -> DataFrame:
        """The cube (columns as of ``write_coverage``), or its months ``first`` to ``last``."""
        parts = [p for p in self._parts() if (first or p.value) <= p.value <= (last or p.value)]
        return self.table.read(parts, schemas.GROWING_COVERAGE).select(*schemas.COVERAGE.fieldNames())

    def _parts(self) -> list[Part]:
        """The months. Days are parts without rows: what their articles were when the cube took them."""
        return [p for p in self.table.parts() if p.version is not None]

    def _taken(self) -> dict[str, str]:
        return {p.value: p.note for p in self.table.parts() if p.version is None}

    def pending(self, scan: GrowingScan) -> list[dt.date]:
        """The days on which the scan has other articles than the cube has taken, also after a broken update."""
        taken, there = self._taken(), {p.value: p.note for p in scan.parts}
        differ = {day for day in taken.keys() | there.keys() if taken.get(day) != there.get(day)}
        return [dt.date.fromisoformat(day) for day in sorted(differ)]

    def update(self, daily: DataFrame, days: Iterable[dt.date], source: GrowingScan | None = None) -> Change:
        """Let the cube's ``days`` be what ``daily`` says: the daily aggregate of all articles of these days and no others.

        Days after the last one so far are appended; days that the cube has are replaced, and the tones carried on
        from them are filled anew up to each country's next observation. Days without rows lose their articles. A day of
        ``daily`` that is not among ``days`` is an error. With ``source`` the cube notes that it has taken these days of that scan.
        """
        days = sorted(set(days))
        if not days:
            return Change(None, (), ())
        scratch = storage.scratch_folder(self.spark, "daily")
        try:
            daily.filter(F.col("date").isNotNull()).select(
                *CUBE_KEYS, F.col("avg_tone").alias("own_tone"), F.col("article_count").cast("bigint")
            ).write.parquet(scratch)
            return self._update(self.spark.read.parquet(scratch), days, source)
        finally:
            storage.remove(self.spark, scratch)

    def _update(self, daily: DataFrame, days: list[dt.date], source: GrowingScan | None) -> Change:
        stray = daily.filter(~F.col("date").isin(days)).agg(F.min("date")).first()[0]
        if stray:
            raise ValueError(f"articles of {stray} among those of other days")
        months = [_described(p) for p in self._parts()]
        first = min((m.first for m in months), default=None)
        # Days between the cube's end and the first new one are filled too.
        begin = min([days[0], *[m.last + _ONE_DAY for m in months if m.last == max(x.last for x in months)]])
        observed = self._observed(months, begin, days)
        if first and first < begin and self._loses_a_country(months, daily, observed, begin, days):
            # Its rows have to go from every month, so all observations are taken from the cube and filled again.
            begin = first
            observed = self._observed(months, begin, days)
        points = daily.unionByName(observed)
        span = points.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
        head = first is not None and first < begin
        if span["last"] is None and head:
            # Nothing from here on: the cube ends where it last saw an article.
            begin = min(begin, self._last_seen(months, begin) + _ONE_DAY)
        at = _month(begin)
        window = [m for m in months if m.part.value >= at]
        kept = self._rows(window, at).filter(F.col("date") < F.lit(begin)) if head else None
        rows = kept
        if span["last"]:
            carried = self._rows(months, _month(begin - _ONE_DAY)).filter(F.col("date") == F.lit(begin - _ONE_DAY)) if head else None
            filled = _filled(points, carried, first if head else span["first"], span["last"])
            rows = filled if kept is None else kept.unionByName(filled)
        kept_parts = [m.part for m in months if m.part.value < at]
        if rows is None:
            rows = self.spark.createDataFrame([], schemas.GROWING_COVERAGE)
        placed = rows.select(*_COLUMNS, F.date_format("date", "yyyy-MM").alias("month"))
        version, written = self.table.stage(placed.repartition("month").sortWithinPartitions("month", "country_iso3", "date"))
        self.table.publish(version, kept_parts + self._noted(version, written) + self._days(days, source))
        read = {m.part.value for m in window} | ({_month(begin - _ONE_DAY)} if head else set())
        return Change(begin, tuple(sorted(read)), tuple(written))

    def _rows(self, months: list[_Month], value: str | None = None) -> DataFrame:
        parts = [m.part for m in months if value is None or m.part.value == value]
        return self.table.read(parts, schemas.GROWING_COVERAGE).select(*_COLUMNS)

    def _observed(self, months: list[_Month], begin: dt.date, days: list[dt.date], replaced: bool = False) -> DataFrame:
        """The cube's own observations from ``begin`` on, without those of ``days`` (or, if ``replaced``, only those)."""
        rows = self._rows([m for m in months if m.part.value >= _month(begin)])
        asked = F.col("date").isin(days)
        return rows.filter(
            (F.col("date") >= F.lit(begin)) & (F.col("article_count") > 0) & (asked if replaced else ~asked)
        ).select(*CUBE_KEYS, "own_tone", "article_count")

    def _loses_a_country(self, months, daily, observed, begin, days) -> bool:
        """True if a country had articles on ``days`` and has none from ``begin`` on any more."""
        before = self._observed(months, begin, days, replaced=True).select("country_iso3").distinct()
        after = daily.unionByName(observed).select("country_iso3")
        return not before.join(after, "country_iso3", "left_anti").isEmpty()

    def _last_seen(self, months: list[_Month], begin: dt.date) -> dt.date:
        here = self._rows(months, _month(begin)).filter((F.col("date") < F.lit(begin)) & (F.col("article_count") > 0))
        found = here.agg(F.max("date")).first()[0]
        return found or max(m.seen for m in months if m.seen and m.part.value < _month(begin))

    def _days(self, days: list[dt.date], source: GrowingScan | None) -> list[Part]:
        taken = self._taken()
        there = {p.value: p.note for p in source.parts} if source else {}
        for day in (d.isoformat() for d in days):
            taken.pop(day, None)
            if day in there:
                taken[day] = there[day]
        return [Part(day, None, note) for day, note in taken.items()]

    def _noted(self, version: int, written: list[str]) -> list[Part]:
        """The written months with what later updates need to know of them."""
        parts = [Part(value, version) for value in written]
        rows = self.table.read(parts, schemas.GROWING_COVERAGE).groupBy("month").agg(
            F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"),
            F.max(F.when(F.col("article_count") > 0, F.col("date"))).cast("string").alias("seen"),
        )
        notes = {r["month"]: json.dumps({k: r[k] for k in ("first", "last", "seen")}) for r in rows.collect()}
        return [Part(p.value, version, notes[p.value]) for p in parts]


def _filled(points: DataFrame, carried: DataFrame | None, first: dt.date, last: dt.date) -> DataFrame:
    """Observations expanded up to the country's next one, from what is ``carried`` or, for other countries, from ``first``.

    Carried rows, all of one day, are where their country goes on; they are not part of the result.
    """
    seen = points.withColumn("carried", F.lit(False))
    if carried is not None:
        known = carried.select(*CUBE_KEYS, F.col("avg_tone").alias("own_tone"), F.lit(0).cast("bigint").alias("article_count"))
        seen = seen.unionByName(known.withColumn("carried", F.lit(True)))
    by_date = Window.partitionBy("country_iso3").orderBy("date")
    so_far = by_date.rowsBetween(Window.unboundedPreceding, 0)
    start = (
        F.when(F.col("carried"), F.date_add("date", 1))
        .when(F.row_number().over(by_date) == 1, F.lit(first))
        .otherwise(F.col("date"))
    )
    runs = seen.select(
        "country_iso3", "carried", "own_tone", "article_count", F.col("date").alias("seen"),
        F.last("own_tone", ignorenulls=True).over(so_far).alias("known"), start.alias("start"),
        F.coalesce(F.date_sub(F.lead("date").over(by_date), 1), F.lit(last)).alias("end"),
    ).filter("start <= end")
    on_day = (F.col("date") == F.col("seen")) & ~F.col("carried")
    return runs.select("*", F.explode(F.sequence("start", "end")).alias("date")).select(
        *CUBE_KEYS,
        F.when(F.col("date") >= F.col("seen"), F.col("known")).alias("avg_tone"),
        F.when(on_day, F.col("article_count")).otherwise(F.lit(0)).cast("bigint").alias("article_count"),
        F.when(on_day, F.col("own_tone")).alias("own_tone"),
    )
