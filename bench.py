"""Headline timings: prints one JSON line. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS.

The article table is stored once, as the jobs would find it; each job then reads it from Parquet
and is timed to its last row. ``value`` is the sum of the median warm times.
"""

import json
import os
import re
import statistics
import time

from newslens.operators import frames, topics
from newslens.plans import jobs, warehouse as w
from newslens.session import local_session
from newslens.sources import storage

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))
STOPS = ["brand#7"]


def stored(spark, df, name):
    path = storage.scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def main():
    spark = local_session("bench")
    raw = stored(spark, w.articles(spark, FOLDER).repartition(spark.sparkContext.defaultParallelism), "articles")
    cube = stored(spark, jobs.build_coverage(raw), "cube")
    mentions = stored(
        spark, topics.mention_counts(jobs.topic_articles(raw, w.BOUNDARIES), topics.default_signals(STOPS)), "mentions"
    )
    cases = {
        "build_coverage": lambda: jobs.build_coverage(raw),
        "build_topics": lambda: jobs.build_topics(raw, STOPS, w.BOUNDARIES),
        "build_feed": lambda: jobs.build_feed(raw),
        "overview_series": lambda: jobs.overview_series(cube),
        "rolling_country_frame": lambda: frames.rolling_country_frame(cube),
        "topic_rollup_top_n": lambda: topics.top_n_per_group(topics.topic_rollup(mentions)),
    }
    seconds = {}
    for name, job in cases.items():
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            job().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(json.dumps({
        "metric": "sum of median warm seconds of the headline jobs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale.group(1)) if scale else None,
        "articles": raw.count(),
    }))


if __name__ == "__main__":
    main()
