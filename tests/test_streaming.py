from newslens.operators import coverage
from newslens.plans import jobs
from newslens.streaming import daily

RAW = "DATE long, SourceCommonName string, DocumentIdentifier string, V2Tone string"


def write(spark, path, rows):
    spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(path)


def test_days_close_once_and_the_query_resumes(spark, tmp_path, rows):
    source, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], RAW).schema

    def run():
        return rows(daily.run_available(spark, source, schema, sink, checkpoint, strict=False).selectExpr(
            "cast(date AS string)", "country_iso3", "avg_tone", "article_count"
        ))

    write(spark, source, [
        (20240101100000, "a.fr", "1", "2,0"), (20240101110000, "b.fr", "1", "2,0"),
        (20240101235959, "a.fr", "2", "4,0"), (20240101120000, "msn.com", "3", "9"),
        (20240102000000, "a.fr", "4", ""),
    ])
    assert run() == []
    # Two days later the first day is closed; its late article comes too late for it.
    write(spark, source, [(20240103120000, "a.de", "5", "1")])
    # Every record's tone counts, a repeated article once.
    first = [("2024-01-01", "FRA", 8 / 3, 2)]
    assert run() == first
    write(spark, source, [(20240101130000, "a.fr", "6", "90"), (20240106000000, "a.fr", "7", "1")])
    assert run() == sorted(
        first + [("2024-01-02", "FRA", None, 1), ("2024-01-03", "DEU", 1.0, 1)],
        key=lambda t: [(v is not None, str(v)) for v in t],
    )


def test_closed_and_open_days_equal_the_batch(spark, tmp_path, rows):
    source, sink, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], RAW).schema
    # Repeated, in two countries, and without identifiers.
    write(spark, source, [
        (20240101100000, "a.fr", "1", "1"), (20240101110000, "b.fr", "1", "2"), (20240101120000, "a.de", "1", "4"),
        (20240101130000, "a.fr", None, "4"), (20240101140000, "a.de", None, "1"), (20240101150000, "a.de", None, "1"),
        (20240102100000, "a.fr", "1", None), (20240104100000, "a.fr", "2", "5"), (20240104110000, "a.fr", "2", "6"),
    ])
    closed = daily.run_available(spark, source, schema, sink, checkpoint)
    arrived = spark.read.schema(schema).parquet(source)
    batch = rows(coverage.daily_country_sentiment(jobs.located_articles(arrived)).select(*closed.columns))
    assert len(batch) == 4 and 0 < closed.count() < 4
    assert rows(daily.with_open_days(closed, arrived)) == batch
    assert rows(daily.with_open_days(closed.limit(0), arrived)) == batch
