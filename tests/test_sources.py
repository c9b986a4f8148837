import datetime as dt
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from newslens import dims, schemas
from newslens.operators import coverage
from newslens.plans import batch, catalog, jobs, views
from newslens.session import case_sensitive
from newslens.sources import articles, datasets, storage


def article(date, doc, themes="PROTEST", persons="Ann Lee", source="a.fr"):
    day = dt.date.fromisoformat(date)
    packed = int(f"{day:%Y%m%d}120000")
    return (packed, source, doc, "1,2", "Tesla,1", "PROTEST,1", themes, persons, day)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("articles"))
    rows = [
        article("2024-01-31", "https://x.fr/solar-flare-speaks", "TAX_CEO"),
        article("2024-02-01", "https://x.fr/a", "SOLAR FLARE;B"),
        article("2024-02-29", "https://x.fr/b", None, "Solar Flare,12"),
        article("2024-02-29", "https://x.fr/solar_flare", "MSOLAR FLAREY", "Solar Flarerat"),
        article("2024-02-15", None, "SOLAR FLARE"),
        article("2024-03-01", "https://x.fr/solar%20flare", "TAX_SOLAR FLARE"),
    ]
    articles.write_articles_table(spark.createDataFrame(rows, schemas.ARTICLES), path)
    return articles.read_articles(spark, path)


def docs(df):
    return sorted(str(r.DocumentIdentifier) for r in df.collect())


def test_topic_scan(table):
    january = articles.topic_scan(table, ["solar flare"], "2024-01", "2024-01")
    assert docs(january) == ["https://x.fr/solar-flare-speaks"]
    february = articles.topic_scan(table, ["Solar Flare "], "2024-02", "2024-02")
    assert docs(february) == ["None", "https://x.fr/a", "https://x.fr/b"]
    assert february.columns == schemas.SCAN_COLUMNS
    both = articles.topic_scan(table, ["solar flare", "b"], "2024-01", "2024-03")
    assert docs(both) == ["https://x.fr/a", "https://x.fr/b"]


def test_keywords_are_literal_unless_asked(table):
    assert docs(articles.topic_scan(table, ["so.ar"], "2024-01", "2024-03")) == []
    assert len(docs(articles.topic_scan(table, ["so.ar"], "2024-01", "2024-03", regex=True))) > 0
    with pytest.raises(ValueError):
        articles.topic_scan(table, [" "], "2024-01", "2024-01")


def test_underscore_is_part_of_a_word(table):
    assert docs(articles.topic_scan(table, ["ceo"], "2024-01", "2024-03")) == []


def test_scan_prunes_partitions_and_columns(table, plan):
    text = plan(articles.topic_scan(table, ["x"], "2024-02", "2024-02"))
    assert "PartitionFilters: [isnotnull(partition_date" in text
    assert "GreaterThanOrEqual(DATE,20240201000000)" in text
    assert "V2Locations" not in text


def test_materialize(spark, table, tmp_path):
    folder = str(tmp_path)
    request = ("Solar Flare!", ["flare", "solar"], "2024-02", "2024-02")
    first = articles.materialize_scan(table, folder, *request)
    path = articles.scan_path(folder, *request)
    assert path == articles.scan_path(folder, "solar flare", ["SOLAR", "flare "], "2024-02", "2024-02")
    found = docs(first)
    assert storage.is_complete(spark, path) and found == ["None", "https://x.fr/a", "https://x.fr/b", "https://x.fr/solar_flare"]
    # The second call reads the stored result: an empty source makes no difference.
    assert docs(articles.materialize_scan(table.limit(0), folder, *request)) == found
    # A half-written result is replaced.
    os.remove(f"{path}/_SUCCESS")
    assert docs(articles.materialize_scan(table, folder, *request)) == found


def test_many_scans_from_one(spark, table, tmp_path):
    topics = {"Solar": ["solar", "flare"], "flare": ["flare"], "None/such": ["nowhere"], "CEO 2": ["tax_ceo"]}
    scans = articles.materialize_scans(table, str(tmp_path), topics, "2024-01", "2024-02")
    for name, words in topics.items():
        alone = articles.topic_scan(table, words, "2024-01", "2024-02")
        assert docs(scans[name]) == docs(alone) and scans[name].columns == alone.columns
    assert docs(scans["None/such"]) == [] and len(docs(scans["Solar"])) == 5
    # Read from the store the next time, and only the topic's part of it.
    again = articles.materialize_scans(table.limit(0), str(tmp_path), topics, "2024-01", "2024-02")
    assert docs(again["flare"]) == docs(scans["flare"])
    assert all("topic_no=" in f for f in again["flare"].inputFiles())


def rows_read(df):
    """Rows that the scans of a query gave."""
    df.collect()
    found = []

    def walk(node):
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    walk(plan.executedPlan() if "Adaptive" in plan.nodeName() else plan)
    return sum(found)


def test_cube_layout_serves_days_and_countries(spark, tmp_path):
    names = [a + b + c for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "AEIO" for c in "NR"]
    days = spark.range(1500).select(F.date_add(F.lit("2015-02-20").cast("date"), F.col("id").cast("int")).alias("date"))
    cube = days.select("date", F.explode(F.array(*[F.lit(n) for n in names])).alias("country_iso3")).select(
        "date", "country_iso3", F.rand(1).alias("avg_tone"), F.lit(1).cast("bigint").alias("article_count"))
    datasets.write_coverage(cube, str(tmp_path), "x", "a", "b")
    stored = datasets.read_coverage(spark, str(tmp_path), "x-a-b")
    total = 1500 * len(names)
    assert stored.count() == total
    day = views.sentiment_by_date(stored, "2017-03-03")
    assert day.count() == len(names) and rows_read(day) < total / 3
    series = stored.filter((F.col("country_iso3") == names[90]) & F.col("avg_tone").isNotNull())
    assert series.count() == 1500 and rows_read(series) < total / 3
    dates = [r.date for r in views.country_timeline(stored, names[90]).collect()]
    assert len(dates) == 1500 and dates == sorted(dates)


def test_curve_takes_any_key(spark, tmp_path):
    rows = [(dt.date(1950, 1, 1), "zz", 1.0, 1), (dt.date(2400, 1, 1), None, 1.0, 1), (None, "FRA", None, 0), (dt.date(2024, 1, 1), "ÀÉ", 1.0, 1)]
    cube = spark.createDataFrame(rows, schemas.COVERAGE)
    datasets.write_coverage(cube, str(tmp_path), "odd", "a", "b")
    assert sorted(map(str, datasets.read_coverage(spark, str(tmp_path), "odd-a-b").collect())) == sorted(map(str, cube.collect()))


def test_empty_scan_is_not_kept(spark, table, tmp_path):
    request = ("none", ["nowhere"], "2024-02", "2024-02")
    assert articles.materialize_scan(table, str(tmp_path), *request).collect() == []
    assert not os.path.exists(articles.scan_path(str(tmp_path), *request))


def test_csv_extract(spark, tmp_path):
    rows = [
        (20240101000000, "1,2", '1#a "quoted", text#FR;2#b#DE', "a.fr", "https://x.fr/a,b", "A,1;B,2"),
        (20240102000000, None, None, None, "line\\", "B"),
    ]
    frame = spark.createDataFrame(rows, schemas.CSV_EXTRACT)
    articles.write_csv_extract(frame, str(tmp_path / "csv"))
    assert sorted(articles.read_csv_extract(spark, str(tmp_path / "csv")).collect()) == sorted(frame.collect())


def test_coverage_file(spark, tmp_path, plan):
    cube = spark.createDataFrame(
        [(dt.date(2024, 1, 1), "FRA", None, 0), (dt.date(2024, 1, 2), "FRA", 1.5, 3)], schemas.COVERAGE
    )
    path = datasets.write_coverage(cube, str(tmp_path), "Élan & Co", "2024-01", "2024-02")
    assert os.path.basename(path) == "lan-co-2024-01-2024-02.parquet"
    assert any("snappy" in name for name in os.listdir(path))
    back = datasets.read_coverage(spark, str(tmp_path), "lan-co-2024-01-2024-02")
    assert back.schema == schemas.COVERAGE and sorted(back.collect(), key=str) == sorted(cube.collect(), key=str)
    for bad in ("../secret", "a/b", "", "a.b"):
        with pytest.raises(ValueError):
            datasets.read_coverage(spark, str(tmp_path), bad)


def test_topics_document(spark, table, tmp_path, rows):
    ranked = jobs.build_topics(table, threshold=1)
    path = datasets.write_topics(ranked, str(tmp_path), "Solar Flare")
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    lines = [line for f in files for line in open(f"{path}/{f}", encoding="utf-8")]
    assert len(lines) == 1
    document = json.loads(lines[0])
    assert document["eras"] == list(dims.ERA_LABELS)
    assert document["global"]["all"]["orgs"] == [{"name": "Tesla", "count": 6}]
    assert document["byCountry"]["FRA"]["4"]["themes"] == [{"name": "Protest", "count": 6}]
    # Buckets without mentions are there, with empty lists.
    assert document["byCountry"]["FRA"]["0"] == document["global"]["3"] == {"orgs": [], "themes": []}
    columns = ["scope", "country_iso3", "bucket", "signal", "key", "name", "count", "rank"]
    assert rows(datasets.read_topics(spark, path).select(*columns)) == rows(ranked.select(*columns))


def test_feed_file(spark, tmp_path):
    frame = spark.createDataFrame([("T", "a.fr", None, "2024-01-01", None)], schemas.FEED)
    path = datasets.write_articles(frame, str(tmp_path), "x")
    parts = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    lines = [line for part in parts for line in open(part, encoding="utf-8")]
    assert [json.loads(line) for line in lines] == [{"title": "T", "source": "a.fr", "iso": None, "date": "2024-01-01", "tone": None}]


def test_json_array(spark, tmp_path):
    file = tmp_path / "feed.json"
    file.write_text('[\n {"title": "A",\n "source": "s", "date": "2024-01-01", "tone": 1.5},\n {"title": "B", "iso": "FRA"}\n]')
    got = datasets.read_json_artifact(spark, str(file), schemas.FEED).collect()
    assert [(r.title, r.iso, r.tone) for r in got] == [("A", None, 1.5), ("B", "FRA", None)]
    assert datasets.read_json_artifact(spark, str(file)).count() == 2


def test_country_names(spark, tmp_path, rows):
    file = tmp_path / "world.geojson"
    features = [
        {"type": "Feature", "properties": {"ADM0_A3": "FRA", "NAME": "France"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"properties": {"ADM0_A3": "", "NAME": "Nowhere"}}, {"properties": {"NAME": "Nameless"}}, {"properties": {"ADM0_A3": "XXX"}}, {},
    ]
    file.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    assert rows(datasets.country_names(spark, str(file))) == [("FRA", "France")]


def session_stub(context_folder=None, **conf):
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: context_folder))


def test_scratch_folder_follows_the_session(spark):
    key = "spark.checkpoint.dir"
    configured = session_stub(**{key: "/shared/folder/"})
    assert storage.scratch_folder(configured, "x").startswith("/shared/folder/newslens/x-")
    assert storage.scratch_folder(session_stub("/context"), "x").startswith("/context/newslens/x-")
    assert storage.scratch_folder(session_stub(), "x", "/given").startswith("/given/newslens/x-")
    with pytest.raises(ValueError):  # whatever the master, no folder is made up
        storage.scratch_folder(session_stub(), "x")


def test_json_profile_of_stored_cube(spark, table):
    cube = jobs.build_coverage(table)
    assert coverage.cube_profile(cube).first().total_rows == 31


def test_run_topic(spark, table, tmp_path):
    paths = batch.run_topic(table, "Solar Flare", ["flare"], "2024-01", "2024-03", str(tmp_path / "out"), str(tmp_path / "scans"))
    assert sorted(os.path.basename(p) for p in paths.values()) == [
        "solar-flare-2024-01-2024-03.parquet", "solar-flare-articles.json", "solar-flare-summary.json",
        "solar-flare-timeline.json", "solar-flare-topics.json",
    ]
    summary = datasets.read_json_artifact(spark, paths["summary"], schemas.SUMMARY_DOCUMENT, lines=True).first()
    assert summary.headline.total_articles == 6 and summary.headline.date_range == "2024-01-31 to 2024-03-01"
    assert summary.opinion_changers == [] and summary.pos_neg.most_positive == []
    assert datasets.read_topics(spark, paths["topics"]).count() > 0
    timeline = datasets.read_json_artifact(spark, paths["timeline"], "date date, avg_tone double, article_count long", lines=True)
    assert timeline.count() == 5


def test_names_that_differ_by_case_can_be_stored(spark, tmp_path):
    """A session that ignores case refuses to store ``DATE`` beside ``date``; the given one is left as it is."""
    line = spark.sql("SELECT 0L l_partkey, 0L l_suppkey, 1 l_linenumber, 5e4D l_extendedprice, 0.1D l_discount, DATE '1996-02-03' l_shipdate")
    part = spark.sql("SELECT 0L p_partkey, 'hot rod' p_name, 'Brand#1' p_brand, 'PROMO' p_type, 3 p_size")
    supplier = spark.sql("SELECT 0L s_suppkey, 'Supplier#1' s_name, 7 s_nationkey")
    for name, table in (("lineitem", line), ("part", part), ("supplier", supplier)):
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    made, stored = catalog.parse_packed_date(spark, str(tmp_path)), str(tmp_path / "stored")
    assert made.columns == ["DATE", "date", "date_text"]
    made.write.parquet(stored)
    back = case_sensitive(spark).read.parquet(stored).select("date_text", "date", "DATE").collect()
    assert [tuple(r) for r in back] == [("1996-02-03", dt.date(1996, 2, 3), 19960203013015)]
    assert spark.conf.get("spark.sql.caseSensitive") == "false" and spark.range(1).selectExpr("ID").columns == ["ID"]
