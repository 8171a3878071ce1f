"""Files as a table: paths under roots, filtered by patterns, with digests and text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import decoded, glob


def matches(path: Column, patterns: list[str]) -> Column:
    """Whether a path fits a pattern: as it is, after a slash, and for ``**/x`` also by ``x`` alone; ``*`` crosses slashes."""
    tests = [glob(path, p) | glob(F.concat(F.lit("/"), path), p) for p in patterns]
    tests += [glob(path, p.removeprefix("**/")) for p in patterns if p.startswith("**/")]
    return reduce(Column.__or__, tests, F.lit(False))


def outermost(roots: list[str]) -> list[str]:
    """The roots that lie under no other one."""
    plain = sorted({r.rstrip("/") or "/" for r in roots})
    return [r for r in plain if not any(r != o and r.startswith(o.rstrip("/") + "/") for o in plain)]


def source_files(spark: SparkSession, roots: list[str], *, include: list[str], exclude: list[str] = ()) -> DataFrame:
    """``path, sha256, size, mtime, source_text`` of the files under the roots, each path once.

    A root that lies under another is not read again, so no path comes twice and no bytes are shuffled to find out.
    Digests are of the bytes as they are.  Folders of version control and of installed modules are left out.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(outermost(roots))
    path = F.regexp_replace("path", "^file:(//)?", "")
    kept = found.withColumn("path", path).where(~F.col("path").rlike(r"/(?:\.git|node_modules)/"))
    kept = kept.where(matches(F.col("path"), list(include)) & ~matches(F.col("path"), list(exclude)))
    return kept.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), decoded(F.col("content")).alias("source_text"))
