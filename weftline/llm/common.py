"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    The temporary folder is for a single machine (``local`` masters, as in tests); a cluster must name its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return f"file://{_own}"


_own: str | None = None


def materialised(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, safe from lost executors."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(values: Column | Iterable[Column]) -> Column:
    """An array's elements, comma-joined."""
    return F.array_join(values, ",")


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def salted_join(many: DataFrame, one: DataFrame, key: str | list[str], how: str = "inner", salts: int = 8) -> DataFrame:
    """``many`` joined with ``one`` (each key once) so that a key with very many rows is dealt to ``salts`` tasks.

    The salt is a hash of the whole row: a task that runs again deals its rows as before.
    """
    dealt = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(salts)))
    each = one.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(each, [*([key] if isinstance(key, str) else key), "__salt"], how).drop("__salt")


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, a written table of a few numbers in a row, marked for broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df
