"""The whole batch for one topic: scan, then store every data set the views need."""

from pyspark.sql import DataFrame, SparkSession

from newslens.operators import coverage, timeline
from newslens.plans import jobs
from newslens.sources import articles as article_store, datasets, storage
from newslens.sources.articles import GrowingScan
from newslens.sources.growing_cube import Change, GrowingCube


def run_topic(
    articles: DataFrame, topic: str, keywords, start: str, end: str, folder: str, scans: str,
    snapshot: str = "",
) -> dict[str, str]:
    """Store cube, timeline, summary, topics and feed of a topic; the paths by name.

    ``scans`` is the folder of stored scans: a repeated run on the same ``snapshot`` of the article
    table reads the scan instead of the articles.
    The timeline and the summary are computed from the stored cube.
    """
    raw = article_store.materialize_scan(articles, scans, topic, keywords, start, end, snapshot)
    paths = {"coverage": datasets.write_coverage(jobs.build_coverage(raw), folder, topic, start, end)}
    cube = articles.sparkSession.read.parquet(paths["coverage"])
    paths["timeline"] = datasets.write_timeline(timeline.global_timeline(cube), folder, topic)
    paths["summary"] = datasets.write_summary(cube, folder, topic)
    paths["topics"] = datasets.write_topics(jobs.build_topics(raw, keywords), folder, topic)
    paths["articles"] = datasets.write_articles(jobs.build_feed(raw), folder, topic)
    return paths


def grow_cube(cube: GrowingCube, scan: GrowingScan, outlets: DataFrame | None = None) -> Change:
    """Bring the cube up to date with a stored scan; only days that differ from what the cube has taken are read."""
    days = cube.pending(scan)
    daily = coverage.daily_country_sentiment(jobs.located_articles(scan.rows(days), outlets))
    return cube.update(daily, days, scan)


def refresh_topic(
    spark: SparkSession, path: str, topic: str, keywords, start: str, end: str, folder: str, scans: str
) -> tuple[GrowingCube, GrowingScan, Change]:
    """Cube and scan of a topic, kept up to date with the article table in ``path`` at the cost of its changes.

    Run it again whenever days have arrived or were corrected, with a later ``end`` if need be. A run that breaks
    off anywhere is made up for by the next one.
    """
    scan = article_store.refresh_scan(spark, path, scans, topic, keywords, start, end)
    cube = GrowingCube(spark, f"{folder.rstrip('/')}/{storage.slug(topic)}-{start}.cube")
    return cube, scan, grow_cube(cube, scan)
