"""Session settings for local runs; a cluster brings its own."""

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def temporary_folder() -> str:
    """A folder of this machine that goes when the process ends; for sessions on this machine alone."""
    folder = tempfile.mkdtemp(prefix="newslens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def case_sensitive(spark: SparkSession) -> SparkSession:
    """A second session of the same application that tells column names apart by case; ``spark`` stays as it is.

    All other settings are those of ``spark``. Temporary views are not shared.
    """
    other = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            other.conf.set(name, value)
    other.conf.set("spark.sql.caseSensitive", "true")
    return other


def local_session(name: str = "newslens", cpus: int | None = None) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", temporary_folder())
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
