"""Intermediate tables in shared storage, so that no step is computed twice or lost with an executor."""

from pyspark.sql import DataFrame

from newslens.sources import storage


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the session's checkpoint folder and read it back."""
    spark = df.sparkSession
    path = storage.scratch_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
