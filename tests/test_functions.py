import datetime as dt
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from newslens import dims
from newslens.functions import eras, fields, labels, titles, tone


def values(spark, inputs, expression, dtype="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {dtype}")
    return [r[0] for r in frame.select(expression(F.col("v")).alias("r"), "i").orderBy("i").select("r").collect()]


def test_packed_date(spark):
    got = values(spark, [20150225133000, 20260520235959, 20240229000000, 20240229, None], fields.packed_date, "long")
    assert got == [dt.date(2015, 2, 25), dt.date(2026, 5, 20), dt.date(2024, 2, 29), dt.date(2024, 2, 29), None]


def test_impossible_date_raises(spark):
    with pytest.raises(PySparkException):
        values(spark, [20230229000000], fields.packed_date, "long")


def test_packed_instant_is_utc(spark):
    got = values(spark, [20240301010203], lambda c: F.unix_seconds(fields.packed_instant(c)), "long")
    assert got == [int(dt.datetime(2024, 3, 1, 1, 2, 3, tzinfo=dt.timezone.utc).timestamp())]


def test_first_tone(spark):
    assert values(spark, ["-2.5,1,2", "3", None], fields.first_tone) == [-2.5, 3.0, None]
    lenient = values(spark, ["", "x,1", "1.5,y"], lambda c: fields.first_tone(c, strict=False))
    assert lenient == [None, None, 1.5]


def test_empty_tone_raises_when_strict(spark):
    with pytest.raises(PySparkException):
        values(spark, [""], fields.first_tone)


def test_slugify(spark):
    assert values(spark, ["Elections 2024!", "--A  b--"], fields.slugify) == ["elections-2024", "a-b"]


def test_rounding(spark):
    assert values(spark, [0.5, -0.5, 2.5, 1.4999], fields.js_round, "double") == [1, 0, 3, 1]
    assert values(spark, [2.345, -1.2, 0.125], fields.round2, "double") == [2.34, -1.2, 0.12]


def test_title_case(spark):
    assert values(spark, ["don't 44th élan", "HARD-wired ßa"], fields.title_case) == ["Don'T 44Th Élan", "Hard-Wired Ssa"]


URLS = {
    "https://x.com/a/tesla-cuts-prices-in-europe.html": "Tesla Cuts Prices In Europe",
    "https://x.com/a/tesla_cuts.prices-in-europe/?p=1": "Tesla Cuts Prices In Europe",
    "https://x.com/tesla-cuts-prices-in-2024-123456789": "Tesla Cuts Prices In 2024",
    "https://x.com/deadbeef01-tesla-cuts-prices-now": "Tesla Cuts Prices Now",
    "https://x.com/the-44th-prime-minister-speaks": "The 44Th Prime Minister Speaks",
    "https://x.com/caf%C3%A9-owners-cut-prices-now": "Café Owners Cut Prices Now",
    "https://x.com/a-b-c-d": None,
    "https://x.com/tesla-cuts-prices": None,
    "https://x.com/a+b-cut-prices-again-%zz-now": "A+B Cut Prices Again %Zz Now",
    "https://x.com/": None,
    None: None,
    "": None,
    "no-scheme-but-a-good-slug.PHP": "No Scheme But A Good Slug",
    "https://x.com/one-two-three-four;v=1#five-six": "One Two Three Four",
    "https://x.com/" + "-".join(["word"] * 20): None,
}


def test_url_title(spark):
    assert values(spark, list(URLS), titles.url_title) == list(URLS.values())


THEMES = {
    "ECON_STOCKMARKET": "Stockmarket",
    "SECURITY_SERVICES": None,
    "TAX_FNCACT_CEO": None,
    "WB_678_DIGITAL": None,
    "EPU_POLICY": None,
    "NATURAL_DISASTER_2020": None,
    "PROTEST": "Protest",
    "A_B_C_D_E": None,
    "ENV_UV": None,
    "econ_bubble": "Econ Bubble",
    "SOC_ECON_UNREST": "Econ Unrest",
    "MEDICAL": None,
}


def test_theme_label(spark):
    assert values(spark, list(THEMES), labels.theme_label) == list(THEMES.values())


def test_org_key(spark):
    stops = dims.org_stops(["Space X"])
    got = values(spark, [" Tesla ", "REUTERS", "space", "x", "space x", "SEC"], lambda c: labels.org_key(c, stops))
    assert got == ["tesla", None, None, None, None, "sec"]


def test_era_of(spark):
    dates = [dt.date(2014, 1, 1), dt.date(2018, 1, 1), dt.date(2021, 12, 31), dt.date(2030, 1, 1), None]
    assert values(spark, dates, eras.era_of, "date") == [0, 1, 2, 4, 4]
    assert values(spark, dates, lambda c: eras.in_era(c, 4), "date") == [False, False, False, False, None]


def expected_intensity(t):
    mag = min(10.0, abs(t))
    return 0.75 * min(1.0, mag) ** 0.7 + 0.25 * min(1.0, max(0.0, (mag - 1) / 4))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-20, 20), min_size=1, max_size=30))
def test_tone_intensity(spark, tones):
    got = values(spark, tones, lambda c: tone.tone_intensity(c, F.lit(3)), "double")
    assert all(math.isclose(a, expected_intensity(t), abs_tol=1e-12) for a, t in zip(got, tones))


def test_no_coverage_has_no_intensity(spark):
    assert values(spark, [None, 2.0], lambda c: tone.tone_intensity(c, F.lit(0)), "double") == [0.0, 0.0]


def test_volume_ratio(spark):
    assert values(spark, [0, 5, 10, 20], lambda c: tone.volume_ratio(c, F.lit(10)), "long") == [0.0, 0.5, 1.0, 1.0]
