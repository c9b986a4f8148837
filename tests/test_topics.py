import math
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st

from newslens import schemas
from newslens.operators import topics
from newslens.plans import jobs, views

RAW = "DATE long, SourceCommonName string, DocumentIdentifier string, V2Organizations string, V2Themes string"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def small(spark):
    return raw(spark, [
        (20160101000000, "a.fr", "1", "Tesla,1;tesla,9; Reuters,3;,4;X,1", "ECON_LAYOFFS,3;TAX_CEO,2;PROTEST,8;PROTEST,9"),
        (20190101000000, "b.fr", "2", "TESLA,2;SEC,5", None),
        (20230601000000, "msn.com", "3", "Tesla,2", "PROTEST,1;"),
        (20230601000000, None, "3", "Tesla,2", "WB_1_X,1"),
    ])


def test_mentions(spark, small, rows):
    counts = topics.mention_counts(jobs.topic_articles(small))
    assert rows(counts.select("signal", "country_iso3", "era", "key", "name", "count")) == sorted([
        ("orgs", None, 4, "tesla", "Tesla", 2), ("orgs", "FRA", 0, "tesla", "Tesla", 2),
        ("orgs", "FRA", 1, "sec", "SEC", 1), ("orgs", "FRA", 1, "tesla", "TESLA", 1),
        ("themes", None, 4, "protest", "Protest", 1), ("themes", "FRA", 0, "layoffs", "Layoffs", 1),
        ("themes", "FRA", 0, "protest", "Protest", 2),
    ], key=lambda t: [(v is not None, str(v)) for v in t])


def test_distinct_articles(spark, small):
    counts = topics.mention_counts(jobs.topic_articles(small), distinct_articles=True)
    found = {(r.signal, r.country_iso3, r.era, r.key): r["count"] for r in counts.collect()}
    assert found["orgs", "FRA", 0, "tesla"] == 1 and found["themes", "FRA", 0, "protest"] == 1
    assert found["orgs", None, 4, "tesla"] == 1
    assert len(found) == 7


def test_distinct_articles_count_once_at_every_grain(spark):
    frame = spark.createDataFrame([
        (20150301000000, "a.fr", "u", "Tesla,1;TESLA,9"), (20250301000000, "a.de", "u", "Tesla,1"),
        (20250301000000, "a.de", "v", "Tesla,1;x,2"), (20250301000000, "a.de", None, "Tesla,1;Acme,3"),
    ], "DATE long, SourceCommonName string, DocumentIdentifier string, V2Organizations string")
    made = jobs.build_topics(frame, threshold=2, distinct_articles=True).filter("key = 'tesla'").collect()
    found = {(r.scope, r.country_iso3, r.bucket): r["count"] for r in made}
    assert found["global", None, "all"] == 2 and found["country", "DEU", "all"] == 2
    assert sorted(v for (scope, _, bucket), v in found.items() if scope == "global" and bucket != "all") == [1, 2]
    assert ("country", "FRA", "all") not in found
    # An article without an identifier counts for none.
    assert jobs.build_topics(frame, threshold=2, distinct_articles=True).filter("key = 'acme'").count() == 0


def test_long_stop_list_is_not_broadcast_by_hint(spark, monkeypatch, rows):
    frame = spark.createDataFrame([("a",), ("b",)], "key string")
    monkeypatch.setattr(topics, "BROADCAST_STOPS", 1)
    assert rows(topics.stop_anti_join(frame, ["b", "c", "b"])) == [("a",)]


def test_missing_columns(spark, small):
    only_themes = jobs.topic_articles(small.drop("V2Organizations"))
    assert {r.signal for r in topics.mention_counts(only_themes).collect()} == {"themes"}
    neither = jobs.topic_articles(small.drop("V2Organizations", "V2Themes"))
    assert topics.mention_counts(neither).collect() == []
    assert jobs.build_topics(small.drop("V2Organizations", "V2Themes")).collect() == []
    # Themes take over the threshold when there are no organisations.
    ranked = jobs.build_topics(small.drop("V2Organizations"), threshold=3)
    assert {r.country_iso3 for r in ranked.collect()} == {None, "FRA"}


def test_build_topics(spark, small, rows):
    ranked = jobs.build_topics(small, threshold=4)
    everywhere = ranked.filter("scope = 'global' AND bucket = 'all' AND signal = 'orgs'")
    assert rows(everywhere.select("rank", "name", "count")) == [(1, "TESLA", 5), (2, "SEC", 1)]
    assert ranked.filter("scope = 'country'").select("country_iso3").distinct().count() == 1
    assert jobs.build_topics(small, threshold=5).filter("scope = 'country'").count() == 0
    stopped = jobs.build_topics(small, keywords=["Tesla"], threshold=1)
    assert {r.key for r in stopped.filter("signal = 'orgs'").collect()} == {"sec"}


mentions = st.lists(
    st.tuples(
        st.sampled_from(["orgs", "themes"]), st.sampled_from([None, "FRA", "DEU"]), st.integers(0, 2),
        st.sampled_from("abcdef"), st.integers(1, 40),
    ),
    min_size=1, max_size=40, unique_by=lambda t: t[:4],
)


@settings(max_examples=10, deadline=None)
@given(mentions)
def test_ranking_equals_plain_python(spark, found):
    frame = spark.createDataFrame(
        [(s, c, e, k, k.upper(), n) for s, c, e, k, n in found], schemas.MENTIONS
    )
    totals, per_country = Counter(), Counter()
    for s, c, e, k, n in found:
        for bucket in ("all", str(e)):
            totals["global", None, bucket, s, k] += n
            if c:
                totals["country", c, bucket, s, k] += n
        if s == "orgs":
            per_country[c] += n
    groups = defaultdict(list)
    for (scope, c, bucket, s, k), n in totals.items():
        if scope == "global" or per_country[c] >= 50:
            groups[scope, c, bucket, s].append((-n, k))
    expected = {
        (*g, k, rank): -n
        for g, items in groups.items()
        for rank, (n, k) in enumerate(sorted(items)[:3], start=1)
    }
    got = {
        (r.scope, r.country_iso3, r.bucket, r.signal, r.key, r["rank"]): r["count"]
        for r in topics.ranked_topics(frame, n=3).collect()
    }
    assert got == expected
    # The parts used on their own give the same.
    kept = topics.kept_countries(frame)
    assert {r.country_iso3 for r in kept.collect()} == {c for c, n in per_country.items() if c and n >= 50}
    semi = topics.kept_country_semi_join(frame, kept).count()
    assert semi == sum(1 for _, c, *_ in found if c and per_country[c] >= 50)


def ranked_list(spark, themes, orgs):
    rows = [("global", None, "0", s, n.lower(), n, c, i + 1)
            for s, items in (("themes", themes), ("orgs", orgs)) for i, (n, c) in enumerate(items)]
    return spark.createDataFrame(
        rows, "scope string, country_iso3 string, bucket string, signal string, key string, name string, count long, rank int"
    )


def size(relative, weight):
    return math.floor(10 + math.sqrt(relative) * 22 * weight + 0.5)


def test_word_blend(spark, rows):
    lists = ranked_list(spark, [("Protest", 100), ("Tesla", 25), ("Layoffs", 25)], [("TESLA", 9), ("SEC", 9), ("NASA", 1)])
    words = topics.word_blend(lists).orderBy("position").collect()
    assert [(w.text, w.size) for w in words] == [
        ("Protest", 32), ("SEC", size(1, 0.9)), ("Tesla", 21), ("Layoffs", 21), ("NASA", size(1 / 9, 0.9)),
    ]
    assert topics.word_blend(lists, total=2).count() == 2
    assert topics.word_blend(lists, themes=1, orgs=1).count() == 2


def test_ranked_words(spark):
    lists = ranked_list(spark, [("Protest", 100), ("Layoffs", 25)], [])
    assert [(w.text, w.size) for w in topics.ranked_words(lists).orderBy("position").collect()] == [("Protest", 32), ("Layoffs", 21)]


def test_topic_words_and_fallback(spark, small):
    ranked = jobs.build_topics(small, threshold=1)
    assert [w.text for w in views.topic_words(ranked, "fra", 1).collect()] == ["SEC", "TESLA"]
    spare = [("Cars", 30), ("Rockets", 20)]
    assert [w.text for w in views.topic_words(ranked, "USA", 1, fallback=spare).collect()] == ["Cars", "Rockets"]
    assert [w.text for w in views.topic_words(ranked, "FRA", 1, fallback=spare).collect()] == ["SEC", "TESLA"]
    with pytest.raises(ValueError):
        views.topic_words(ranked, "FRANCE")


def test_affinity(spark, rows):
    lists = [("FRA", "a"), ("FRA", "b"), ("DEU", "a"), ("DEU", "b"), ("DEU", "c"), ("USA", "c")]
    ranked = spark.createDataFrame(
        [("country", c, "all", "themes", k, k, 1, 1) for c, k in lists],
        "scope string, country_iso3 string, bucket string, signal string, key string, name string, count long, rank int",
    )
    assert rows(topics.narrative_affinity(ranked)) == [("DEU", "FRA", 2, 2 / 3), ("DEU", "USA", 1, 1 / 3)]
    assert topics.narrative_affinity(ranked, min_shared=2).count() == 1


def test_volume_rank(spark, small, rows):
    ranked = jobs.build_topics(small, threshold=1)
    assert rows(topics.topic_volume_rank(ranked)) == [("FRA", 4)]


def test_stop_anti_join(spark, small):
    counts = topics.theme_keyword_counts(topics.mention_counts(jobs.topic_articles(small)))
    assert {r.key for r in topics.stop_anti_join(counts, ["protest"]).collect()} == {"layoffs"}


def test_hot_entry(spark):
    """One entry with a third of all mentions is counted whole."""
    rows = spark.range(30000).selectExpr(
        "20200101000000 AS DATE", "'a.fr' AS SourceCommonName", "cast(id AS string) AS DocumentIdentifier",
        "concat('Hot,1;Org', id, ',2;Org', id % 100, 'x,3') AS V2Organizations", "cast(null AS string) AS V2Themes",
    )
    ranked = jobs.build_topics(rows, n=5).filter("scope = 'country' AND bucket = 'all'").orderBy("rank").collect()
    assert [(r.key, r["count"]) for r in ranked][0] == ("hot", 30000)
    assert {r["count"] for r in ranked[1:]} == {300}
