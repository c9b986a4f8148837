"""A partitioned Parquet table that changes by whole partitions, one version after another.

Every change writes its rows into a folder of its own and then a manifest that says, for each partition,
which versions hold it. The manifest is written last, by a job that commits: until then readers see
the version before, a broken change leaves nothing behind but unused files, and running it again is safe. Nothing
that is already there is rewritten or moved. Manifests hold one line per partition, so
their size follows the calendar and not the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from newslens.sources import storage

_MANIFEST = "value string, version int, note string"


@dataclass(frozen=True)
class Part:
    """A partition's rows in one version. ``note`` is the owner's; without a version there are no rows, but the note counts."""

    value: str
    version: int | None
    note: str = ""


class VersionedTable:
    """The table in ``path``, partitioned by the text column ``column``. One writer at a time; a second one fails."""

    def __init__(self, spark: SparkSession, path: str, column: str):
        self.spark, self.path, self.column = spark, path.rstrip("/"), column

    def _versions(self, kind: str) -> list[int]:
        return [int(name.rpartition("=")[2]) for name in storage.children(self.spark, f"{self.path}/{kind}") if name.startswith("version=")]

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/version={version}"

    def latest(self) -> int | None:
        """The last version whose manifest is committed."""
        done = [v for v in self._versions("manifests") if storage.is_complete(self.spark, self._manifest(v))]
        return max(done, default=None)

    def parts(self) -> list[Part]:
        """What the latest manifest lists, in the order of values and versions."""
        version = self.latest()
        if version is None:
            return []
        rows = self.spark.read.schema(_MANIFEST).json(self._manifest(version)).collect()
        return sorted((Part(**r.asDict()) for r in rows), key=lambda p: (p.value, p.version or 0))

    def read(self, parts: list[Part], schema: T.StructType) -> DataFrame:
        """The rows of these parts: ``schema``'s columns and the partition column. No other file is opened."""
        whole = T.StructType([*schema.fields, T.StructField(self.column, T.StringType())])
        folders = [f"{self.path}/data/version={p.version}/{self.column}={p.value}" for p in parts if p.version is not None]
        if not folders:
            return self.spark.createDataFrame([], whole)
        found = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*folders)
        return found.select(*whole.fieldNames())

    def stage(self, rows: DataFrame) -> tuple[int, list[str]]:
        """Write rows that no reader sees yet; their version and the partitions that have any."""
        version = max([0, *self._versions("data"), *self._versions("manifests")]) + 1
        folder = f"{self.path}/data/version={version}"
        rows.write.partitionBy(self.column).option("compression", "snappy").parquet(folder)
        names = storage.children(self.spark, folder)
        return version, [n.partition("=")[2] for n in names if n.startswith(f"{self.column}=")]

    def publish(self, version: int, parts: list[Part]) -> None:
        """Make ``parts`` the table."""
        rows = self.spark.createDataFrame([(p.value, p.version, p.note) for p in parts], _MANIFEST)
        rows.coalesce(1).write.option("ignoreNullFields", False).json(self._manifest(version))

    def vacuum(self) -> list[int]:
        """Remove the versions that the latest manifest does not use; readers of earlier ones must be done."""
        used, last = {p.version for p in self.parts()}, self.latest()
        unused = [v for v in self._versions("data") if v not in used]
        for v in unused:
            storage.remove(self.spark, f"{self.path}/data/version={v}")
        for v in self._versions("manifests"):
            if v != last:
                storage.remove(self.spark, self._manifest(v))
        return unused


def partition_files(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row per partition of a Hive-style table: ``value`` and a ``note`` that changes whenever a file does.

    Spark lists the files, in parallel where there are many; none is opened.
    """
    files = spark.read.format("binaryFile").load(path)
    if column not in files.columns:
        return spark.createDataFrame([], "value string, note string")
    seen = F.bit_xor(F.xxhash64("path", "length", "modificationTime"))
    return (
        files.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.concat_ws(":", F.count("*"), F.sum("length"), F.hex(seen)).alias("note"))
    )
