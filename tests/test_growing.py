"""Stored scans and cubes that grow: equal to a rebuild, reading and writing what has changed."""

import datetime as dt
import glob
import os
import random

import pytest

from newslens import schemas
from newslens.operators import coverage
from newslens.plans import batch, jobs
from newslens.sources import articles, storage
from newslens.sources.growing_cube import GrowingCube
from newslens.sources.versions import Part, VersionedTable

DAILY = "date date, country_iso3 string, avg_tone double, article_count long"


def day(text):
    return dt.date.fromisoformat(text)


def article(date, doc, tone="1,2", source="a.fr", themes="SOLAR"):
    d = day(date)
    return (int(f"{d:%Y%m%d}120000"), source, doc, tone, "Tesla,1", "PROTEST,1", themes, None, d)


def deliver(spark, path, *rows):
    """Whole days: those that are there are replaced."""
    frame = spark.createDataFrame(rows, schemas.ARTICLES)
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("partition_date").parquet(path)


def shown(df):
    return sorted(tuple(r) for r in df.select("date", "country_iso3", "avg_tone", "article_count").collect())


def files(path):
    return {f: (os.path.getsize(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


# --- Versions ---------------------------------------------------------------------------

def test_versions(spark, tmp_path):
    schema = schemas._schema(("x", schemas.T.LongType()))
    table = VersionedTable(spark, str(tmp_path / "t"), "part")
    assert table.latest() is None and table.parts() == [] and table.read([], schema).collect() == []
    version, written = table.stage(spark.createDataFrame([(1, "a"), (2, "b")], "x long, part string"))
    assert (version, written) == (1, ["a", "b"]) and table.parts() == []
    table.publish(version, [Part("a", 1, "n"), Part("b", 1), Part("c", None, "nothing")])
    assert table.parts() == [Part("a", 1, "n"), Part("b", 1, ""), Part("c", None, "nothing")]
    # A change that breaks off before its manifest leaves the table as it was, and the next one is not in its way.
    table.stage(spark.createDataFrame([(9, "a")], "x long, part string"))
    assert sorted(table.read(table.parts(), schema).collect()) == [(1, "a"), (2, "b")]
    version, _ = table.stage(spark.createDataFrame([(3, "a")], "x long, part string"))
    assert version == 3
    table.publish(version, [Part("a", 3), Part("b", 1), Part("a", 1)])
    assert sorted(table.read(table.parts(), schema).collect()) == [(1, "a"), (2, "b"), (3, "a")]
    os.remove(f"{table._manifest(3)}/_SUCCESS")  # half a manifest
    assert table.latest() == 1
    with pytest.raises(Exception):
        table.publish(3, [])
    assert sorted(table.vacuum()) == [2, 3]
    assert sorted(table.read(table.parts(), schema).collect()) == [(1, "a"), (2, "b")]


# --- Scans ------------------------------------------------------------------------------

def request(spark, path, folder, end="2024-03"):
    return articles.refresh_scan(spark, path, folder, "Solar", ["solar"], "2024-01", end)


def test_only_changed_days_are_scanned(spark, tmp_path):
    path, folder = str(tmp_path / "days"), str(tmp_path / "scans")
    deliver(spark, path, article("2024-01-05", "a"), article("2024-01-06", "b"), article("2024-01-07", "c", themes="X"), article("2024-04-01", "d"))
    first = request(spark, path, folder)
    assert first.changed == (day("2024-01-05"), day("2024-01-06"), day("2024-01-07"))
    assert {r.DocumentIdentifier for r in first.rows().collect()} == {"a", "b"} and first.rows().columns == schemas.SCAN_COLUMNS
    assert request(spark, path, folder).changed == ()
    before = files(f"{folder}")
    deliver(spark, path, article("2024-01-06", "b2"), article("2024-02-01", "e"))
    # Files of other days cannot be read any more, and need not be.
    for broken in glob.glob(f"{path}/partition_date=2024-01-05/*.parquet"):
        size, stat = os.path.getsize(broken), os.stat(broken)
        with open(broken, "wb") as f:
            f.write(b"x" * size)
        os.utime(broken, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    second = request(spark, path, folder)
    assert second.changed == (day("2024-01-06"), day("2024-02-01"))
    assert {r.DocumentIdentifier for r in second.rows().collect()} == {"a", "b2", "e"}
    assert {r.DocumentIdentifier for r in second.rows([day("2024-02-01")]).collect()} == {"e"}
    assert before.items() <= files(f"{folder}").items()
    third = request(spark, path, folder, "2024-04")
    assert third.changed == (day("2024-04-01"),) and third.rows().count() == 4
    # An earlier end shows fewer days and forgets none.
    assert request(spark, path, folder, "2024-01").rows().count() == 2
    assert request(spark, path, folder, "2024-04").changed == ()


def test_days_that_go(spark, tmp_path):
    path, folder = str(tmp_path / "days"), str(tmp_path / "scans")
    deliver(spark, path, article("2024-01-05", "a"), article("2024-01-06", "b"))
    request(spark, path, folder)
    storage.remove(spark, f"{path}/partition_date=2024-01-05")
    deliver(spark, path, article("2024-01-06", "b", themes="no match"))
    scan = request(spark, path, folder)
    assert scan.changed == (day("2024-01-05"), day("2024-01-06")) and scan.rows().collect() == []
    assert request(spark, path, folder).changed == ()


def test_scan_equals_the_stored_one(spark, tmp_path):
    path = str(tmp_path / "days")
    deliver(spark, path, *[article(f"2024-0{1 + i % 3}-1{i % 7}", f"d{i}", themes="SOLAR" if i % 2 else "X") for i in range(60)])
    scan = request(spark, path, str(tmp_path / "a"))
    stored = articles.materialize_scan(articles.read_articles(spark, path), str(tmp_path / "b"), "Solar", ["solar"], "2024-01", "2024-03")
    assert sorted(scan.rows().collect()) == sorted(stored.collect())


# --- Cubes ------------------------------------------------------------------------------

def daily_of(spark, held):
    """Daily aggregate of ``{(date, country): (tone, count)}``."""
    return spark.createDataFrame([(d, c, t, n) for (d, c), (t, n) in held.items()], DAILY)


def rebuilt(spark, held):
    return shown(coverage.fill_gaps(daily_of(spark, held)))


def change(spark, cube, held, days, news):
    """Replace ``days`` in cube and in ``held`` by ``news``."""
    for key in [k for k in held if k[0] in days]:
        del held[key]
    held.update(news)
    return cube.update(daily_of(spark, news), days)


def test_append_reads_one_old_day_and_writes_new_months(spark, tmp_path):
    cube, held = GrowingCube(spark, str(tmp_path / "cube")), {}
    january = [day("2024-01-01") + dt.timedelta(i) for i in range(31)]
    change(spark, cube, held, january, {(january[0], "FRA"): (1.0, 2), (january[4], "DEU"): (None, 1), (january[29], "FRA"): (3.0, 1)})
    assert shown(cube.read()) == rebuilt(spark, held)
    before = files(tmp_path)
    # A month later, another country: silent days in between, and rows without tone in all months before.
    march = [day("2024-03-01") + dt.timedelta(i) for i in range(31)]
    done = change(spark, cube, held, march, {(march[3], "ITA"): (5.0, 7), (march[9], "DEU"): (2.0, 1)})
    assert shown(cube.read()) == rebuilt(spark, held)
    assert done.months_read == ("2024-01",) and done.months_written == ("2024-01", "2024-02", "2024-03")
    assert before.items() <= files(tmp_path).items()
    april = [day("2024-04-01")]
    done = change(spark, cube, held, april, {(april[0], "FRA"): (0.5, 1)})
    assert done.months_read == ("2024-03",) and done.months_written == ("2024-03", "2024-04")
    assert shown(cube.read()) == rebuilt(spark, held)
    assert shown(cube.read("2024-03", "2024-03")) == [r for r in rebuilt(spark, held) if r[0].month == 3]
    cube.table.vacuum()
    assert shown(cube.read()) == rebuilt(spark, held)


def test_corrections_run_on_to_the_next_observation(spark, tmp_path):
    cube, held = GrowingCube(spark, str(tmp_path / "cube")), {}
    days = [day("2024-01-01") + dt.timedelta(i) for i in range(120)]
    change(spark, cube, held, days, {(days[i], c): (float(i), 1) for i in range(0, 120, 17) for c in ("FRA", "DEU")})
    done = change(spark, cube, held, [days[51]], {(days[51], "FRA"): (None, 3)})
    assert done.months_read == ("2024-02", "2024-03", "2024-04")
    assert shown(cube.read()) == rebuilt(spark, held)


@pytest.mark.parametrize("name", ["only day", "first day", "last days", "country", "all", "earlier", "nothing"])
def test_edges(spark, tmp_path, name):
    cube, held = GrowingCube(spark, str(tmp_path / "cube")), {}
    days = [day("2024-01-20") + dt.timedelta(i) for i in range(40)]
    news = {(days[0], "FRA"): (1.0, 1), (days[5], "DEU"): (2.0, 2), (days[12], "FRA"): (4.0, 1), (days[39], "ITA"): (3.0, 1)}
    change(spark, cube, held, days, news)
    if name == "only day":
        change(spark, cube, held, [days[7]], {(days[7], "ESP"): (1.0, 1)})
    elif name == "first day":  # the cube begins later
        change(spark, cube, held, days[:3], {})
    elif name == "last days":  # and ends earlier, in another month
        change(spark, cube, held, days[20:], {})
        assert max(r[0] for r in shown(cube.read())) == days[12]
    elif name == "country":  # Germany is in no month any more
        change(spark, cube, held, [days[5]], {})
        assert "DEU" not in {r[1] for r in shown(cube.read())}
    elif name == "all":
        change(spark, cube, held, days, {})
        assert cube.read().collect() == []
        change(spark, cube, held, [days[3]], {(days[3], "FRA"): (1.0, 1)})
    elif name == "earlier":
        old = day("2023-11-30")
        change(spark, cube, held, [old], {(old, "ESP"): (9.0, 1)})
    elif name == "nothing":
        cube.update(daily_of(spark, {(days[0], "FRA"): (1.0, 1)}).limit(0), [])
        later = day("2024-06-01")
        change(spark, cube, held, [later], {})
    assert shown(cube.read()) == rebuilt(spark, held)


def test_rows_of_other_days_are_refused(spark, tmp_path):
    cube = GrowingCube(spark, str(tmp_path / "cube"))
    with pytest.raises(ValueError):
        cube.update(daily_of(spark, {(day("2024-01-02"), "FRA"): (1.0, 1)}), [day("2024-01-01")])
    assert cube.read().collect() == []


def test_random_changes(spark, tmp_path):
    pick = random.Random(2)
    cube, held = GrowingCube(spark, str(tmp_path / "cube")), {}
    start = day("2023-12-10")
    for _ in range(9):
        first = pick.randrange(100)
        days = [start + dt.timedelta(first + i) for i in range(pick.choice([1, 3, 40]))]
        days = pick.sample(days, pick.randint(1, len(days)))
        news = {(d, c): (pick.choice([None, 1.0, 2.5]), pick.randint(1, 4)) for d in days for c in ("FRA", "DEU", "ITA") if pick.random() < 0.2}
        change(spark, cube, held, days, news)
        assert shown(cube.read()) == rebuilt(spark, held)


def test_topic_is_kept_up_to_date(spark, tmp_path):
    path, out = str(tmp_path / "days"), str(tmp_path / "out")

    def refreshed(end):
        return batch.refresh_topic(spark, path, "Solar", ["solar"], "2024-01", end, out, f"{out}/scans")

    def whole(end):
        scan = articles.topic_scan(articles.read_articles(spark, path), ["solar"], "2024-01", end)
        return shown(jobs.build_coverage(scan))

    deliver(spark, path, article("2024-01-05", "a"), article("2024-01-09", "b", "3", "x.de"), article("2024-01-09", "b", "4", "y.de"))
    cube, _, done = refreshed("2024-01")
    assert done.first == day("2024-01-05") and shown(cube.read()) == whole("2024-01")
    deliver(spark, path, article("2024-01-09", "c", "-3", "x.de"), article("2024-02-02", "d", "2", "z.it"))
    # The scan is stored but the cube's update breaks off: the next run takes it up.
    articles.refresh_scan(spark, path, f"{out}/scans", "Solar", ["solar"], "2024-01", "2024-02")
    cube, scan, done = refreshed("2024-02")
    assert scan.changed == () and done.first == day("2024-01-09") and shown(cube.read()) == whole("2024-02")
    cube, _, done = refreshed("2024-02")
    assert done.months_written == () and shown(cube.read()) == whole("2024-02")


def test_update_plan_reads_changed_days_alone(spark, tmp_path, plan):
    path = str(tmp_path / "days")
    deliver(spark, path, *[article(f"2024-01-{i:02}", f"d{i}") for i in range(1, 29)])
    scan = request(spark, path, str(tmp_path / "scans"))
    rows = scan.rows([day("2024-01-03"), day("2024-01-04")])
    assert len(rows.inputFiles()) == 2 and all("day=2024-01-0" in f for f in rows.inputFiles())
    text = plan(coverage.daily_country_sentiment(jobs.located_articles(rows)))
    assert "CartesianProduct" not in text and text.count("FileScan") == 1
