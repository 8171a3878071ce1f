"""Versioned tables on plain files: a version is whole or not there, whoever writes it and however often.

A writer puts its rows into a folder of its own and then adds one small file, the marker, that names the folder and the
version.  Readers look at markers alone, so half-written rows are never seen.  Of two markers for one version the one
with the lesser token counts, for all readers alike; the writer that lost is told.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.tables import diff, materialised

MARKER = "version long, token string, rows long, created_at double, label string"


class Conflict(RuntimeError):
    """Another writer has made the version."""


class Snapshots:
    """Versions of one table in ``folder``, numbered from 1."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> DataFrame:
        """``version, token, rows, created_at, label`` of the whole versions."""
        try:
            found = self.spark.read.schema(MARKER).json(f"{self.folder}/markers/*/part-*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = self.spark.createDataFrame([], MARKER)
        return found.where("version IS NOT NULL").groupBy("version").agg(F.min_by(F.struct("token", "rows", "created_at", "label"), "token").alias("m")).select("version", "m.*")

    def newest(self) -> int:
        return self.versions().agg(F.max("version").alias("v")).first().v or 0

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        wanted = self.newest() if version is None else version
        marker = self.versions().where(F.col("version") == wanted).first()
        if marker is None:
            raise LookupError(f"there is no version {wanted}")
        return self.spark.read.parquet(f"{self.folder}/rows/{marker.token}")

    def replace(self, rows: DataFrame, *, after: int | None = None, created_at: float = 0.0, label: str = "") -> int:
        """Adds ``rows`` as the version after ``after`` (the newest if none is named) and returns its number.

        Raises ``Conflict`` where another writer has added that version: what is there stands.
        """
        version = (self.newest() if after is None else after) + 1
        if self.versions().where(F.col("version") == version).first() is not None:
            raise Conflict(f"version {version} is there")
        token = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/rows/{token}")
        n = self.spark.read.parquet(f"{self.folder}/rows/{token}").count()
        marker = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(token).alias("token"), F.lit(n).alias("rows"), F.lit(created_at).alias("created_at"), F.lit(label).alias("label"))
        marker.coalesce(1).write.json(f"{self.folder}/markers/{token}")
        if self.versions().where(F.col("version") == version).first().token != token:
            raise Conflict(f"version {version} was added by another writer")
        return version


class Archive:
    """Documents by version, each entry with what it adds, changes and removes against the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.documents, self.index = Snapshots(spark, f"{folder.rstrip('/')}/documents"), Snapshots(spark, f"{folder.rstrip('/')}/index")

    def add(self, documents: DataFrame, *, created_at: float, label: str = "") -> int:
        """``documents``: id, digest and whatever else they hold.  Nothing is added, changed or removed by a first entry."""
        version = self.documents.replace(documents, created_at=created_at, label=label)
        now = self.documents.read(version).select("id", "digest")
        status = diff(self.documents.read(version - 1).select("id", "digest"), now, "id", "digest") if version > 1 else now.select("id", F.lit("unchanged").alias("status"))
        entry = status.withColumns({"version": F.lit(version).cast("long"), "created_at": F.lit(created_at), "label": F.lit(label)})
        self.index.replace(materialised(entry), after=version - 1, created_at=created_at, label=label)
        return version

    def entries(self) -> DataFrame:
        """``version, created_at, label, documents, added, changed, removed``, for ordering by created_at, newest first."""
        count = lambda s: F.count_if(F.col("status") == s).alias(s)
        rows = self._rows().groupBy("version", "created_at", "label")
        return rows.agg(F.count_if(F.col("status") != "removed").alias("documents"), count("added"), count("changed"), count("removed")).orderBy(F.desc("created_at"), F.desc("version"))

    def entries_of(self, ids: DataFrame) -> DataFrame:
        """``id, version, created_at, status``: the entries that hold each of the ids."""
        return self._rows().where("status != 'removed'").join(ids.select("id").distinct(), "id", "left_semi").select("id", "version", "created_at", "status")

    def _rows(self) -> DataFrame:
        tokens = self.index.versions().select("token").collect()  # one row for each version
        paths = [f"{self.index.folder}/rows/{r.token}" for r in tokens]
        return self.index.spark.read.parquet(*paths) if paths else self.index.spark.createDataFrame([], "id string, status string, version long, created_at double, label string")
