import re

from hypothesis import given, settings, strategies as st

import pytest

from newslens.operators.filters import keyword_match, topic_match

SCHEMA = "i int, Themes string, V2Persons string, DocumentIdentifier string"
text = st.one_of(st.none(), st.text(alphabet="keyKEY _-é;1", max_size=8))


def matches(keyword, themes, persons, url):
    """Word match in themes or persons, plain match in the URL, where a space may be a hyphen."""
    keyword = keyword.lower().strip()
    word = re.compile(rf"\b{re.escape(keyword)}\b", re.ASCII)
    in_url = re.compile(re.escape(keyword).replace(r"\ ", "[- ]"))
    return bool(
        word.search((themes or "").lower()) or word.search((persons or "").lower()) or in_url.search((url or "").lower())
    )


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(text, text, text), min_size=1, max_size=40),
    st.lists(st.text(alphabet="keyKEY -_.", min_size=1, max_size=4).filter(str.strip), min_size=1, max_size=2),
)
def test_keywords_equal_plain_python(spark, rows, keywords):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = {r.i for r in keyword_match(frame, keywords).collect()}
    assert got == {i for i, r in enumerate(rows) if all(matches(k, *r) for k in keywords)}


def test_pattern_keywords(spark):
    frame = spark.createDataFrame(
        [(0, "SOLAR_FLARE", None, None), (1, "A;SOLAR", None, None), (2, None, None, "x/so-lar")], SCHEMA
    )
    assert {r.i for r in keyword_match(frame, ["so.?lar"], regex=True).collect()} == {1, 2}


@settings(max_examples=12, deadline=None)
@given(
    st.lists(st.tuples(text, text, text), min_size=1, max_size=40),
    st.lists(st.lists(st.text(alphabet="keyKEY -_.", min_size=1, max_size=4).filter(str.strip), min_size=1, max_size=2), min_size=1, max_size=6),
)
def test_topics_equal_their_keywords(spark, rows, topics):
    """Nested and overlapping keywords, hyphens for spaces, letters that mean something in a pattern."""
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    named = {f"t{n}": words for n, words in enumerate(topics)}
    got = [(r.i, r.topic) for r in topic_match(frame, named).collect()]
    want = {(i, name) for name, words in named.items() for i, r in enumerate(rows) if all(matches(k, *r) for k in words)}
    assert len(got) == len(want) and set(got) == want


def test_topics_are_one_pass(spark, plan):
    """The plan of a hundred topics holds one scan, and one pattern for all of them before any is tested."""
    frame = spark.range(1).selectExpr("cast(id as int) i", "'SOLAR FLARE;X' Themes", "'Ann' V2Persons", "'u/solar-flare7' DocumentIdentifier")
    named = {f"t{n}": [f"flare{n}", "solar"] for n in range(100)} | {"both": ["solar", "solar flare", "flare"]}
    got = topic_match(frame, named)
    assert {r.topic for r in got.collect()} == {"both", "t7"}
    assert plan(got).count("Range") == 1
    for bad in ({}, {"x": [" "]}):
        with pytest.raises(ValueError):
            topic_match(frame, bad)
