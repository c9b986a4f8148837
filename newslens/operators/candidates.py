"""Exact top topics from candidates: mergeable summaries name them, and only they are counted everywhere.

A ranking needs 30 keys of a bucket, of which there may be millions. The first pass keeps a frequency summary of
bounded size per signal, country and era; summaries merge, so those of all grains come from the finest. The second
pass counts exactly the keys that some bucket proposes. A bucket is proven if its last ranked count is above what a
key that was not proposed can have; the buckets that are not, as those of nearly equal counts, are counted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from newslens.functions import fields
from newslens.operators import topics
from newslens.sources import storage

TRACKED = 10_000  # keys that a summary holds; it is exact up to so many mentions
SPARE = 4  # candidates per wanted rank
PLACE = ["scope", "country_iso3", "bucket", "signal"]
FINEST = ["signal", "country_iso3", "era"]


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = storage.scratch_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Equality with the columns of the same names behind an underscore, nulls included."""
    met = F.lit(True)
    for c in columns:
        met = met & left[c].eqNullSafe(right[f"_{c}"])
    return met


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in columns])


def summaries(df: DataFrame, signals: list[topics.Signal], tracked: int = TRACKED) -> DataFrame:
    """``signal, country_iso3, era, state, mentions``: a mergeable summary of the keys of every finest bucket.

    Summaries may be stored by day and added up later; those that are merged have the same ``tracked``.
    """
    kept = topics.mention_keys(df, signals, "country_iso3", "era").filter(F.col("key").isNotNull())
    return kept.groupBy(*FINEST).agg(
        F.expr(f"approx_top_k_accumulate(key, {int(tracked)})").alias("state"), F.count("*").alias("mentions")
    )


def merged(states: DataFrame) -> DataFrame:
    """The summaries at all grains: overall, per era, per country, per country and era."""
    def place(scope: str, country, bucket) -> Column:
        return F.struct(F.lit(scope).alias("scope"), country.alias("country_iso3"), bucket.alias("bucket"))

    nowhere, always = F.lit(None).cast("string"), F.lit("all")
    country, era = F.col("_country"), F.col("era").cast("string")
    grains = F.array(
        place("global", nowhere, always), place("global", nowhere, era), place("country", country, always), place("country", country, era)
    )
    placed = states.withColumnRenamed("country_iso3", "_country").select("signal", "state", "mentions", F.inline(grains))
    placed = placed.filter((F.col("scope") == "global") | fields.valid_country(F.col("country_iso3")))
    return placed.groupBy(*PLACE).agg(F.expr("approx_top_k_combine(state)").alias("state"), F.sum("mentions").alias("mentions"))


def candidates(placed: DataFrame, n: int, tracked: int = TRACKED, spare: int = SPARE) -> DataFrame:
    """``keys`` of every bucket to be counted, and ``unseen``, the most mentions that any other key can have.

    A summary's counts are at most 3.5 times the mentions, divided by the keys it tracks, above the truth, and it
    gives the keys whose least count is above that error; so others have at most twice the error. Up to ``tracked``
    mentions it holds all keys without any. Where it gives as many as asked for, the last one bounds the rest.
    """
    asked = n * spare
    found = placed.select(*PLACE, "mentions", F.expr(f"approx_top_k_estimate(state, {asked})").alias("found"))
    blurred = F.when(F.col("mentions") <= tracked, 0).otherwise(F.ceil(7 * F.col("mentions") / tracked)).cast("long")
    last = F.when(F.size("found") >= asked, F.try_element_at("found", F.lit(asked))["count"]).otherwise(0)
    return found.select(
        *PLACE, F.transform("found", lambda x: x["item"]).alias("keys"), F.greatest(blurred, last).alias("unseen")
    )


def counted(mentions: DataFrame, signals: list[topics.Signal]) -> DataFrame:
    """Mentions per (signal, country, era, key) with the smallest spelling's name.

    Spellings are counted first, by hashing; the smallest of a key's is sought among the distinct ones.
    """
    spelt = mentions.groupBy(*FINEST, "key", "raw").agg(F.count("*").alias("count"))
    sums = spelt.groupBy(*FINEST, "key").agg(F.min("raw").alias("raw"), F.sum("count").alias("count"))
    return sums.select(*FINEST, "key", topics.shown_names(signals).alias("name"), "count")


def unproven(found: DataFrame, rolled: DataFrame, n: int) -> DataFrame:
    """The buckets in which a key that is no candidate may belong to the first ``n``."""
    least = topics.top_n_per_group(rolled, n).filter(F.col("rank") == n)
    least = least.select(*[F.col(c).alias(f"_{c}") for c in PLACE], F.col("count").alias("least"))
    met = found.filter("unseen > 0").join(least, _same(found, least, PLACE), "left")
    return met.filter(F.coalesce("least", F.lit(0)) <= F.col("unseen")).select(*PLACE)


def top_topics(
    df: DataFrame, signals: list[topics.Signal] | None = None, n: int = topics.TOP_N,
    threshold: int = topics.MIN_COUNTRY_MENTIONS, tracked: int = TRACKED, spare: int = SPARE,
) -> DataFrame:
    """The rows of ``topics.ranked_topics(topics.entry_counts(df))``, ties included, without shuffling every key.

    Needs ``country_iso3`` and ``era``. Reads the articles twice, and once more where buckets are not proven.
    Summaries, candidates and counts are stored below the session's checkpoint folder, so Spark knows their sizes and
    sends only small ones to all tasks. The threshold is on mentions of the first signal. A signal whose column is
    missing is skipped.
    """
    if tracked < n * spare:
        raise ValueError("a summary tracks fewer keys than are asked of it")
    signals = [s for s in signals or topics.default_signals() if s.column in df.columns]
    if not signals:
        return topics.ranked_topics(topics.entry_counts(df, signals), n, threshold)
    states = _stored(summaries(df, signals, tracked), "summaries")
    found = _stored(candidates(merged(states), n, tracked, spare), "candidates")
    mentions = topics.mention_keys(df, signals, "country_iso3", "era")

    keys = _stored(found.select("signal", F.explode("keys").alias("key")).distinct(), "candidate-keys")
    rolled = _stored(topics.topic_rollup(counted(mentions.join(keys, ["signal", "key"], "left_semi"), signals)), "counted")
    open_ = _stored(unproven(found, rolled, n), "unproven")
    other = _renamed(open_, PLACE)

    # The finest buckets that unproven ones are made of, counted in full.
    at = states.select(*FINEST)
    inside = (at["signal"] == other["_signal"]) & (
        (other["_scope"] == "global") | at["country_iso3"].eqNullSafe(other["_country_iso3"])
    ) & (other["_bucket"].eqNullSafe(F.lit("all")) | at["era"].cast("string").eqNullSafe(other["_bucket"]))
    wanted = _renamed(_stored(at.join(other, inside, "left_semi"), "unproven-parts"), FINEST)
    whole = mentions.filter(F.col("key").isNotNull()).join(wanted, _same(mentions, wanted, FINEST), "left_semi")
    rest = topics.topic_rollup(counted(whole, signals))

    proven = rolled.join(other, _same(rolled, other, PLACE), "left_anti")
    ranked = topics.top_n_per_group(proven.unionByName(rest.join(other, _same(rest, other, PLACE), "left_semi")), n)
    enough = states.filter((F.col("signal") == signals[0].name) & fields.valid_country(F.col("country_iso3"))).groupBy(
        F.col("country_iso3").alias("_country_iso3")
    ).agg(F.sum("mentions").alias("_total")).filter(F.col("_total") >= threshold)
    kept = ranked.join(enough, ranked["country_iso3"] == enough["_country_iso3"], "left")
    return kept.filter((F.col("scope") == "global") | F.col("_total").isNotNull()).drop("_country_iso3", "_total")
