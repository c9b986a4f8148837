"""Organisation and theme mentions, their rankings and word lists."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from newslens import dims
from newslens.functions import fields, labels

TOP_N = 30
MIN_COUNTRY_MENTIONS = 50
BROADCAST_STOPS = 10_000

# Word list: how many entries of each list, their weight, and the text size range.
BLEND_THEMES, BLEND_ORGS, BLEND_TOTAL = 18, 8, 26
THEME_WEIGHT, ORG_WEIGHT = 1.0, 0.9
BASE_SIZE, SIZE_RANGE = 10, 22


@dataclass(frozen=True)
class Signal:
    """A ``name,offset;name,offset`` column and how its entries are cleaned.

    ``key`` turns a trimmed raw entry into its grouping key, or NULL to drop it. ``display`` makes
    the shown name from the key; without it the smallest raw spelling is shown. ``keep`` is a
    cheap test on the untrimmed entry that runs before anything is counted; it may let entries
    pass that ``key`` drops.
    """

    name: str
    column: str
    key: Callable[[Column], Column]
    display: Callable[[Column], Column] | None = None
    keep: Callable[[Column], Column] = lambda entry: F.lit(True)

    def shown(self, key: Column, spelling: Column) -> Column:
        return self.display(key) if self.display else F.when(key.isNotNull(), spelling)


def default_signals(keywords=(), org_stops=None) -> list[Signal]:
    stops = dims.org_stops(keywords) if org_stops is None else list(org_stops)
    return [
        Signal("orgs", "V2Organizations", lambda raw: labels.org_key(raw, stops)),
        Signal("themes", "V2Themes", labels.theme_key, fields.title_case, labels.theme_family_kept),
    ]


def _per_signal(signals, expression) -> Column:
    chosen = F.when(F.col("signal") == signals[0].name, expression(signals[0]))
    for s in signals[1:]:
        chosen = chosen.when(F.col("signal") == s.name, expression(s))
    return chosen


def _entries(df: DataFrame, signals: list[Signal], *carry: str) -> DataFrame:
    """One row per raw entry of any signal, from a single pass over the articles."""
    packed = F.inline(F.array(*[
        F.struct(F.lit(s.name).alias("signal"), F.col(s.column).alias("packed")) for s in signals
    ]))
    return (
        df.select(*carry, packed)
        .filter(F.col("packed").isNotNull())
        .select(*carry, "signal", F.explode(F.split("packed", ";")).alias("entry"))
        .filter(_per_signal(signals, lambda s: s.keep(F.col("entry"))))
        .select(*carry, "signal", fields.trimmed(F.substring_index("entry", ",", 1)).alias("raw"))
    )


def _with_key(entries: DataFrame, signals: list[Signal]) -> DataFrame:
    key = _per_signal(signals, lambda s: s.key(F.col("raw")))
    return entries.withColumn("key", F.when(F.col("raw") != "", key))


def mention_keys(df: DataFrame, signals: list[Signal], *carry: str) -> DataFrame:
    """One row per mention with its ``raw`` spelling and ``key``, which is NULL for entries to be dropped.

    Entries are cleaned inside their article's array, so that each is cleaned once: a filter on the key of exploded
    entries would move below the cleaning and repeat it, with the spelling derived anew at every use.
    """
    def cleaned(s: Signal) -> Column:
        entries = F.filter(F.split(s.column, ";"), lambda entry: s.keep(entry))
        spelt = F.transform(entries, lambda entry: fields.trimmed(F.substring_index(entry, ",", 1)))
        return F.transform(spelt, lambda raw: F.struct(raw.alias("raw"), F.when(raw != "", s.key(raw)).alias("key")))

    found = F.array(*[F.struct(F.lit(s.name).alias("signal"), cleaned(s).alias("_entries")) for s in signals])
    return df.select(*carry, F.inline(found)).select(*carry, "signal", F.inline("_entries"))


def shown_names(signals: list[Signal]) -> Column:
    """The name of a ``key`` whose smallest spelling is ``raw``."""
    return _per_signal(signals, lambda s: s.shown(F.col("key"), F.col("raw")))


def entry_counts(df: DataFrame, signals: list[Signal] | None = None) -> DataFrame:
    """Mentions per raw entry, with its key and name. Needs ``country_iso3`` and ``era``.

    Raw entries are counted first (with map-side partial sums, so a hot entry does not burden one
    task) and only the distinct ones are cleaned, so the regexes run once per distinct entry
    instead of once per mention. Spellings of one key are still apart. A dropped entry has NULLs
    as key, name and count: a filter here would be moved below the count, and the regexes with it.
    """
    signals = [s for s in signals or default_signals() if s.column in df.columns]
    if not signals:
        return _no_mentions(df)
    keys = ["signal", "country_iso3", "era"]
    counted = (
        _entries(df, signals, "country_iso3", "era").groupBy(*keys, "raw").agg(F.count("*").alias("n"))
    )
    return _with_key(counted, signals).select(
        *keys,
        "key",
        _per_signal(signals, lambda s: s.shown(F.col("key"), F.col("raw"))).alias("name"),
        F.when(F.col("key").isNotNull(), F.col("n")).alias("count"),
    )


def distinct_rollup(df: DataFrame, signals: list[Signal], measured: str, eras: int) -> DataFrame:
    """What :func:`topic_rollup` gives ``with_totals``, without names and with articles counted instead of mentions.

    An article counts once per bucket, however many eras, countries or spellings hold it. The records are shuffled by
    article, texts unsplit; all that is grouped by article is then grouped where it lies, and only the sums are shuffled
    again. Every grain comes of one pass: a pair of key and article carries its eras as the bits of one number, which are
    merged by ``or``, and every bucket's count is a sum of bits. All buffers are numbers, so Spark aggregates by hashing.
    Totals count the articles of a country that hold any kept entry of ``measured``. An article without an identifier
    counts for none.
    """
    here = df.filter(F.col("DocumentIdentifier").isNotNull()).select(
        "DocumentIdentifier", "country_iso3", "era", *[s.column for s in signals]
    ).repartition("DocumentIdentifier")
    entries = _entries(here, signals, "DocumentIdentifier", "country_iso3", "era")
    spelt = entries.groupBy("DocumentIdentifier", "country_iso3", "signal", "raw").agg(F.expr("bit_or(shiftleft(1L, era))").alias("eras"))
    # Cleaned after repeated mentions have collapsed. Dropped entries keep a null key, and no eras below: a filter on the key
    # would move below the sums, and the cleaning with it.
    pairs = _with_key(spelt, signals)

    def grain(scope: str, country: Column, key: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), country.alias("country_iso3"), key.alias("key"))

    nothing, country, key = F.lit(None).cast("string"), F.col("_country"), F.col("_key")
    everywhere, there = grain("global", nothing, key), grain("country", country, key)
    grains = (
        F.when(~F.coalesce(fields.valid_country(country), F.lit(False)), F.array(everywhere))
        .when(F.col("signal") == measured, F.array(everywhere, there, grain("total", country, nothing)))
        .otherwise(F.array(everywhere, there))
    )
    kept = F.when(key.isNotNull(), F.col("eras")).otherwise(0).alias("eras")
    placed = pairs.withColumnsRenamed({"country_iso3": "_country", "key": "_key"}).select("DocumentIdentifier", "signal", kept, F.inline(grains))
    held = placed.groupBy("DocumentIdentifier", "scope", "country_iso3", "signal", "key").agg(F.bit_or("eras").alias("eras"))
    in_era = [F.sum(F.shiftright("eras", e).bitwiseAND(F.lit(1))).alias(f"_{e}") for e in range(eras)]
    sums = held.groupBy("scope", "country_iso3", "signal", "key").agg(F.count_if(F.col("eras") != 0).alias("_all"), *in_era)
    buckets = [F.struct(F.lit(str(b)).alias("bucket"), F.col(f"_{b}").alias("count")) for b in ("all", *range(eras))]
    counted = sums.select("scope", "country_iso3", "signal", "key", F.inline(F.array(*buckets)))
    return counted.filter((F.col("count") > 0) & ((F.col("scope") != "total") | (F.col("bucket") == "all")))


def with_names(listed: DataFrame, df: DataFrame, signals: list[Signal]) -> DataFrame:
    """Add the names of a listing: made from the key, or the smallest spelling of the bucket.

    Spellings are counted with map-side partial sums, for signals that show them alone.
    """
    made = _per_signal(signals, lambda s: s.display(F.col("key")) if s.display else F.lit(None).cast("string"))
    spelt = [s for s in signals if not s.display]
    if not spelt:
        return listed.withColumn("name", made)
    place = ["scope", "country_iso3", "bucket", "signal", "key"]
    found = topic_rollup(entry_counts(df, spelt)).select(*[F.col(c).alias(f"_{c}") for c in place], F.col("name").alias("_name"))
    same = F.lit(True)
    for c in place:
        same = same & (listed[c].eqNullSafe(found[f"_{c}"]) if c == "country_iso3" else listed[c] == found[f"_{c}"])
    return listed.join(found, same, "left").withColumn("name", F.coalesce("_name", made)).drop(*[f"_{c}" for c in place], "_name")


def mention_counts(
    df: DataFrame, signals: list[Signal] | None = None, distinct_articles: bool = False
) -> DataFrame:
    """Mentions per (signal, country, era, key). Needs ``country_iso3`` and ``era``.

    A signal whose column is missing is skipped. The display name is the smallest spelling.
    ``distinct_articles`` counts articles instead of mentions.
    """
    keys = ["signal", "country_iso3", "era", "key"]
    signals = [s for s in signals or default_signals() if s.column in df.columns]
    if not (distinct_articles and signals):
        counted = entry_counts(df, signals).groupBy(*keys)
        merged = counted.agg(F.min("name").alias("name"), F.sum("count").alias("count"))
        return merged.filter(F.col("count").isNotNull())
    # A caller that drops the name is counted by hashing: a smallest text would have every mention sorted.
    return (
        mention_keys(df, signals, "country_iso3", "era", "DocumentIdentifier")
        .filter(F.col("key").isNotNull())
        .groupBy(*keys)
        .agg(F.min("raw").alias("_raw"), F.count_distinct("DocumentIdentifier").alias("count"))
        .select(
            *keys,
            _per_signal(signals, lambda s: s.shown(F.col("key"), F.col("_raw"))).alias("name"),
            "count",
        )
    )


def _no_mentions(df: DataFrame) -> DataFrame:
    return df.sparkSession.sql(
        "SELECT '' AS signal, '' AS country_iso3, 0 AS era, '' AS key, '' AS name, 0L AS count"
        " WHERE false"
    )


def stop_anti_join(df: DataFrame, stops, key: str = "key") -> DataFrame:
    """Remove rows whose key is on the stop list.

    A list of up to ``BROADCAST_STOPS`` words is broadcast; beyond that Spark chooses the join.
    """
    words = sorted(set(stops))
    listed = df.sparkSession.createDataFrame([(s,) for s in words], f"{key} string")
    return df.join(F.broadcast(listed) if len(words) <= BROADCAST_STOPS else listed, key, "left_anti")


def kept_countries(
    mentions: DataFrame, threshold: int = MIN_COUNTRY_MENTIONS, signal: str = "orgs"
) -> DataFrame:
    """Countries with enough mentions in one signal."""
    return (
        mentions.filter((F.col("signal") == signal) & fields.valid_country(F.col("country_iso3")))
        .groupBy("country_iso3")
        .agg(F.sum("count").alias("mentions"))
        .filter(F.col("mentions") >= threshold)
    )


def kept_country_semi_join(mentions: DataFrame, kept: DataFrame) -> DataFrame:
    return mentions.join(kept, "country_iso3", "left_semi")


def topic_rollup(
    mentions: DataFrame, with_totals: bool = False, count: Column | None = None
) -> DataFrame:
    """Counts at four grains: overall, per era, per country, per country and era.

    ``scope`` is ``global`` or ``country`` and ``bucket`` is ``all`` or the era. Mentions without
    a country count in the global scope only. ``with_totals`` adds one row per country and signal
    with scope ``total``, which serves the country threshold without a second pass. ``count`` is
    the aggregate to take at each grain (default: the sum of ``count``); rows without one are dropped.
    """
    grains = [
        ["signal", "key"], ["signal", "era", "key"],
        ["signal", "country_iso3", "key"], ["signal", "country_iso3", "era", "key"],
    ]
    if with_totals:
        grains.append(["signal", "country_iso3"])
    # Entry counts hold their dropped entries in NULL groups, which end here without a count.
    scope = (
        F.when(F.grouping("key") == 1, "total")
        .when(F.grouping("country_iso3") == 1, "global")
        .otherwise("country")
    )
    return (
        mentions.groupingSets(
            [[F.col(c) for c in g] for g in grains], "signal", "country_iso3", "era", "key"
        )
        .agg(
            (F.sum("count") if count is None else count).alias("count"),
            F.min("name").alias("name"),
            scope.alias("scope"),
            F.when(F.grouping("era") == 1, "all").otherwise(F.col("era").cast("string")).alias("bucket"),
        )
        .filter(
            (F.col("count") > 0)
            & ((F.col("scope") == "global") | fields.valid_country(F.col("country_iso3")))
        )
        .select("scope", "country_iso3", "bucket", "signal", "key", "name", "count")
    )


def top_n_per_group(
    ranked: DataFrame, n: int = TOP_N, by=("scope", "country_iso3", "bucket", "signal")
) -> DataFrame:
    """The n largest counts per group, ties by key. Spark cuts each task's rows to n per group
    before the shuffle, so a hot group stays small."""
    order = Window.partitionBy(*by).orderBy(F.desc("count"), "key")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def ranked_topics(
    mentions: DataFrame,
    n: int = TOP_N,
    threshold: int = MIN_COUNTRY_MENTIONS,
    signal: str = "orgs",
    count: Column | None = None,
) -> DataFrame:
    """Rollup, top n and country threshold in one pass over mentions, entry counts or articles."""
    return listed_topics(topic_rollup(mentions, with_totals=True, count=count), n, threshold, signal)


def listed_topics(
    rolled: DataFrame, n: int = TOP_N, threshold: int = MIN_COUNTRY_MENTIONS, signal: str = "orgs"
) -> DataFrame:
    """Top n of a rollup with totals; countries whose total of ``signal`` misses the threshold are left out."""
    top = top_n_per_group(rolled, n)
    is_total = (F.col("scope") == "total") & (F.col("signal") == signal)
    country_total = F.max(F.when(is_total, F.col("count"))).over(Window.partitionBy("country_iso3"))
    return (
        top.withColumn("_total", country_total)
        .filter(
            (F.col("scope") == "global")
            | ((F.col("scope") == "country") & (F.col("_total") >= threshold))
        )
        .drop("_total")
    )


def theme_keyword_counts(mentions: DataFrame, signal: str = "themes") -> DataFrame:
    """Frequency of every theme over all countries and eras."""
    return (
        mentions.filter(F.col("signal") == signal)
        .groupBy("key")
        .agg(F.min("name").alias("name"), F.sum("count").alias("count"))
    )


def topic_volume_rank(topics: DataFrame, k: int = 6) -> DataFrame:
    """Countries by the sum of their listed organisation counts."""
    return (
        topics.filter(
            (F.col("scope") == "country") & (F.col("bucket") == "all") & (F.col("signal") == "orgs")
        )
        .groupBy("country_iso3")
        .agg(F.sum("count").alias("mentions"))
        .orderBy(F.desc("mentions"), "country_iso3")
        .limit(k)
    )


def _text_size(count: Column, largest: Column, weight: Column) -> Column:
    largest = F.when(largest == 0, F.lit(1)).otherwise(largest)
    return fields.js_round(BASE_SIZE + F.sqrt(count / largest) * SIZE_RANGE * weight)


def ranked_words(
    topics: DataFrame, limit: int = 18, by=("scope", "country_iso3", "bucket", "signal")
) -> DataFrame:
    """A single list as sized words, largest first."""
    group = Window.partitionBy(*by)
    return topics.filter(F.col("rank") <= limit).select(
        *by,
        F.col("rank").alias("position"),
        F.col("name").alias("text"),
        _text_size(F.col("count"), F.max("count").over(group), F.lit(1.0)).alias("size"),
    )


def word_blend(
    topics: DataFrame,
    themes: int = BLEND_THEMES,
    orgs: int = BLEND_ORGS,
    total: int = BLEND_TOTAL,
    by=("scope", "country_iso3", "bucket"),
) -> DataFrame:
    """Themes and organisations of each bucket as one list of sized words.

    Each list is scaled to its own largest count. A word that occurs in both lists counts as a
    theme, whatever its case. Words of equal size keep the list order.
    """
    is_theme = F.col("signal") == "themes"
    lists = topics.filter(
        (is_theme & (F.col("rank") <= themes))
        | ((F.col("signal") == "orgs") & (F.col("rank") <= orgs))
    )
    largest = F.max("count").over(Window.partitionBy(*by, "signal"))
    weight = F.when(is_theme, F.lit(THEME_WEIGHT)).otherwise(F.lit(ORG_WEIGHT))
    priority = F.when(is_theme, 0).otherwise(1)
    sized = lists.select(
        *by,
        F.col("name").alias("text"),
        _text_size(F.col("count"), largest, weight).alias("size"),
        priority.alias("_list"),
        F.col("rank").alias("_rank"),
    )
    repeat = F.row_number().over(
        Window.partitionBy(*by, F.lower("text")).orderBy("_list", "_rank")
    )
    position = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("size"), "_list", "_rank"))
    return (
        sized.withColumn("_repeat", repeat)
        .filter(F.col("_repeat") == 1)
        .withColumn("position", position)
        .filter(F.col("position") <= total)
        .select(*by, "position", "text", "size")
    )


def narrative_affinity(topics: DataFrame, top: int = TOP_N, min_shared: int = 1) -> DataFrame:
    """Weighted edges between countries that share dominant themes.

    The input is each country's top list: at most 250 countries of ``top`` themes, so the edges
    are bounded by the number of country pairs whatever the size of the article table.
    """
    dominant = topics.filter(
        (F.col("scope") == "country")
        & (F.col("bucket") == "all")
        & (F.col("signal") == "themes")
        & (F.col("rank") <= top)
    ).select(
        "key", "country_iso3", F.count("*").over(Window.partitionBy("country_iso3")).alias("n")
    )
    a = dominant.select("key", F.col("country_iso3").alias("country_a"), F.col("n").alias("n_a"))
    b = dominant.select("key", F.col("country_iso3").alias("country_b"), F.col("n").alias("n_b"))
    return (
        a.join(b, "key")
        .filter(F.col("country_a") < F.col("country_b"))
        .groupBy("country_a", "country_b")
        .agg(F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
        .filter(F.col("shared") >= min_shared)
        .select(
            "country_a",
            "country_b",
            "shared",
            (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("affinity"),
        )
    )


def topics_document(topics: DataFrame, era_labels=dims.ERA_LABELS) -> DataFrame:
    """The ranked lists as one nested row: eras, global buckets, buckets by country.

    Its size is bounded by countries x buckets x ``TOP_N``.
    """
    item = F.struct("rank", F.struct("name", "count").alias("item"))

    def listed(signal):
        ordered = F.array_sort(F.collect_list(F.when(F.col("signal") == signal, item)))
        return F.transform(ordered, lambda x: x["item"])

    buckets = topics.groupBy("scope", "country_iso3", "bucket").agg(
        F.struct(listed("orgs").alias("orgs"), listed("themes").alias("themes")).alias("lists")
    )
    found = buckets.groupBy("scope", "country_iso3").agg(
        F.map_from_entries(F.collect_list(F.struct("bucket", "lists"))).alias("found")
    )
    # Every place has every bucket, if need be with empty lists.
    names = ["all", *map(str, range(len(era_labels)))]
    nothing = F.array().cast("array<struct<name:string,count:bigint>>")
    empty = F.struct(nothing.alias("orgs"), nothing.alias("themes"))
    places = found.withColumn("buckets", F.map_from_entries(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.coalesce(F.try_element_at("found", F.lit(b)), empty).alias("lists"))
        for b in names
    ])))
    country = F.when(F.col("scope") == "country", F.struct("country_iso3", "buckets"))
    return places.agg(
        F.array(*[F.lit(label) for label in era_labels]).alias("eras"),
        F.max_by("buckets", F.col("scope") == "global").alias("global"),
        F.map_from_entries(F.collect_list(country)).alias("byCountry"),
    )
