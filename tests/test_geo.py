import pytest

from newslens import dims
from newslens.operators import geo

OUTLETS = {
    "lemonde.fr": "FRA",
    " CNN.com ": "USA",
    "\tfaz.net\n": "DEU",
    "telegraph.co.uk": "GBR",
    "geo.tv": "TUV",
    "politico.eu": "BEL",
    "uk": "GBR",
    "island.ac": "SHN",
    "taipei.tw": None,
    "msn.com": None,
    "": None,
    "abc": None,
    None: None,
}


@pytest.fixture
def outlets(spark):
    return spark.createDataFrame([(o,) for o in OUTLETS], "SourceCommonName string")


def test_outlet_country(outlets):
    mapped = {r.SourceCommonName: r.country_iso3 for r in geo.outlet_country(outlets).collect()}
    assert mapped == OUTLETS


def test_table_sizes(spark):
    assert len(dims.country_tlds()) == 207
    assert not set(dims.country_tlds()) & set(dims.GENERIC_TLDS)
    assert all(len(iso3) == 3 for iso3 in dims.country_tlds().values())
    assert len(dims.curated_outlets()) == 238
    assert all(len(iso3) == 3 for iso3 in dims.curated_outlets().values())


def test_own_tables(spark, outlets):
    own = spark.createDataFrame([("msn.com", "USA"), ("msn.com", "USA")], "domain string, iso3 string")
    tlds = spark.createDataFrame([("fr", "XXX"), ("com", "YYY")], "tld string, iso3 string")
    mapped = {
        r.SourceCommonName: r.country_iso3
        for r in geo.outlet_country(outlets, tlds=tlds, outlets=own).collect()
    }
    assert mapped["msn.com"] == "USA" and mapped["lemonde.fr"] == "XXX" and mapped[" CNN.com "] is None
    assert len(mapped) == len(OUTLETS)


def test_no_row_is_lost_or_doubled(outlets):
    assert geo.outlet_country(outlets).count() == len(OUTLETS)


def test_distinct_outlets(outlets):
    assert geo.distinct_outlets(outlets).count() == len(OUTLETS) - 1


def test_location_counts(spark, rows):
    raw = spark.createDataFrame([
        ("d1", "1#France#FR#FR#46#2#FR;4#Paris#FR#A8#48#2#-1"),
        ("d2", "1#France#FR#FR#46#2#FR;;1#Spain#SP"),
        ("d2", "1#Spain#SP"),
        ("d3", None),
        ("d4", "1#Nowhere"),
    ], "DocumentIdentifier string, V2Locations string")
    assert rows(geo.location_counts(raw)) == [("FR", 3, 2), ("SP", 2, 1)]


def test_labels_and_map(spark, rows):
    names = spark.createDataFrame([("FRA", "France"), ("DEU", "Germany")], "iso3 string, name string")
    frame = spark.createDataFrame(
        [("FRA", 2.0, 8), ("XKX", -1.0, 16)], "country_iso3 string, avg_tone double, article_count long"
    )
    labelled = geo.country_label_join(frame, names).select("country_iso3", "country_name")
    assert rows(labelled) == [("FRA", "France"), ("XKX", "XKX")]
    drawn = {r.iso3: r for r in geo.map_frame_join(names, frame).collect()}
    assert drawn["DEU"].article_count == 0 and drawn["DEU"].tone_intensity == 0
    assert drawn["FRA"].volume_ratio == 0.5 and set(drawn) == {"FRA", "DEU"}
    empty = geo.map_frame_join(names, frame.limit(0)).collect()
    assert [r.volume_ratio for r in empty] == [0.0, 0.0]
