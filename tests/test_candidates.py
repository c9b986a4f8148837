"""Rankings from candidates against plain counts, with buckets that are proven and buckets that are not."""

import random
from collections import Counter, defaultdict

import pytest

from newslens.operators import candidates, topics
from newslens.plans import jobs

RAW = "DATE long, SourceCommonName string, DocumentIdentifier string, V2Organizations string, V2Themes string"
SOURCES = ["a.fr", "b.de", "c.it", "msn.com", None]
DATES = [20150301000000, 20180301000000, 20230601000000]


def _articles(spark, seed, hot, tail, mentions=12, size=400):
    """Articles that mention a few hot names by rank and many names of a tail evenly."""
    pick = random.Random(seed)
    weights = [1 / (i + 1) for i in range(hot)]

    def names(prefix):
        own = pick.choices([f"{prefix}{i:03}" for i in range(hot)], weights, k=mentions)
        own += [f"{prefix}T{pick.randrange(tail):05}" for _ in range(mentions // 4)]
        return ";".join(f"{n.upper() if pick.random() < 0.2 else n},{i}" for i, n in enumerate(own))

    rows = [(pick.choice(DATES), pick.choice(SOURCES), str(i), names("Org "), names("NAME_")) for i in range(size)]
    rows += [(DATES[0], "a.fr", "n", None, ""), (DATES[0], None, None, ";;,1;", "TAX_CEO,1"), (None, "a.fr", "z", "Org 000,1", None)]
    return jobs.topic_articles(spark.createDataFrame(rows, RAW))


def _tuples(df):
    columns = ["scope", "country_iso3", "bucket", "signal", "key", "name", "count", "rank"]
    return Counter(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("hot, tail, tracked, n", [(40, 4000, 64, 4), (40, 4000, 256, 10), (5, 30, 12, 3), (300, 2000, 10_000, 30), (1, 1, 200, 30)])
def test_same_ranking_as_all_counts(spark, hot, tail, tracked, n):
    articles, signals = _articles(spark, hot, hot, tail), topics.default_signals()
    want = topics.ranked_topics(topics.entry_counts(articles, signals), n, 50)
    got = candidates.top_topics(articles, signals, n, 50, tracked)
    assert _tuples(got) == _tuples(want) and got.count() > 0
    assert [f.name for f in got.schema] == [f.name for f in want.schema]


@pytest.mark.parametrize("tracked", [64, 256, 2048])
def test_no_other_key_has_more_than_the_bound(spark, tracked):
    articles, signals = _articles(spark, 7, 60, 3000), topics.default_signals()
    found = candidates.candidates(candidates.merged(candidates.summaries(articles.repartition(7), signals, tracked)), 4, tracked).collect()
    rolled = defaultdict(dict)
    for r in topics.topic_rollup(topics.entry_counts(articles, signals)).collect():
        rolled[r.scope, r.country_iso3, r.bucket, r.signal][r.key] = r["count"]
    assert {(r.scope, r.country_iso3, r.bucket, r.signal) for r in found} == set(rolled)
    for r in found:
        counts = rolled[r.scope, r.country_iso3, r.bucket, r.signal]
        assert len(r["keys"]) <= 16 and set(r["keys"]) <= set(counts)
        assert max((c for k, c in counts.items() if k not in r["keys"]), default=0) <= r.unseen


def test_even_counts_are_not_proven_and_steep_ones_are(spark):
    signals = topics.default_signals()

    def open_buckets(articles, tracked, n):
        found = candidates.candidates(candidates.merged(candidates.summaries(articles, signals, tracked)), n, tracked)
        keys = found.selectExpr("signal", "explode(keys) AS key").distinct()
        rows = topics.mention_keys(articles, signals, "country_iso3", "era").join(keys, ["signal", "key"], "left_semi")
        rolled = topics.topic_rollup(candidates.counted(rows, signals))
        assert rolled.select("signal", "key").distinct().count() == keys.count()  # nothing else is counted
        return candidates.unproven(found, rolled, n).count(), found.count()

    even, all_ = open_buckets(_articles(spark, 1, 1000, 4000, size=200), 64, 10)
    steep, _ = open_buckets(_articles(spark, 1, 30, 4000), 10_000, 3)
    assert even > 0 and all_ > 10 and steep == 0


def test_ties_go_by_key(spark):
    rows = [(DATES[0], "a.fr", str(i), ";".join(f"Org {chr(97 + (i * 7 + j) % 26)}{chr(97 + j)}x,{j}" for j in range(26)), None) for i in range(60)]
    articles = jobs.topic_articles(spark.createDataFrame(rows, RAW))
    for tracked in (12, 5000):
        got = candidates.top_topics(articles, None, 3, 1, tracked)
        assert _tuples(got) == _tuples(topics.ranked_topics(topics.entry_counts(articles), 3, 1))


def test_stored_summaries_add_up(spark):
    """Summaries of two halves, merged, are those of all; empty articles have none, a missing column is skipped."""
    articles, signals = _articles(spark, 3, 20, 50), topics.default_signals()
    halves = [candidates.summaries(articles.filter(f"{sign} coalesce(DocumentIdentifier, '') < '2'"), signals, 5000) for sign in ("", "NOT")]
    both = candidates.candidates(candidates.merged(halves[0].unionByName(halves[1])), 5, 5000).collect()
    whole = candidates.candidates(candidates.merged(candidates.summaries(articles, signals, 5000)), 5, 5000).collect()
    key = lambda r: (r.scope, r.country_iso3, r.bucket, r.signal)
    assert {key(r): r.unseen for r in both} == {key(r): r.unseen for r in whole}
    assert candidates.top_topics(articles.limit(0), signals).count() == 0
    alone = candidates.top_topics(articles.drop("V2Themes"), signals, 5)
    assert {r.signal for r in alone.select("signal").collect()} == {"orgs"}
    with pytest.raises(ValueError):
        candidates.top_topics(articles, signals, 30, tracked=50)
