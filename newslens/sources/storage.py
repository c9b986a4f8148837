"""Paths in shared storage."""

import re
import uuid

from pyspark.sql import SparkSession

_DATASET = re.compile(r"^[A-Za-z0-9-]+$")


def scratch_base(spark: SparkSession) -> str | None:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession, name: str, base: str | None = None) -> str:
    """A new folder below ``base``, or below the session's checkpoint folder; without either an error."""
    base = base or scratch_base(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/newslens/{name}-{uuid.uuid4().hex}"


def dataset_path(folder: str, dataset: str, suffix: str = ".parquet") -> str:
    """Path of a named dataset; the name may hold letters, digits and hyphens only."""
    if not _DATASET.match(dataset):
        raise ValueError(f"invalid dataset name: {dataset!r}")
    return f"{folder.rstrip('/')}/{dataset}{suffix}"


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def is_complete(spark: SparkSession, path: str) -> bool:
    """True if a Spark job has written and committed this folder."""
    fs, jpath = _filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(jpath)


def remove(spark: SparkSession, path: str) -> None:
    fs, jpath = _filesystem(spark, path)
    fs.delete(jpath, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, jpath = _filesystem(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(jpath)) if fs.exists(jpath) else []
