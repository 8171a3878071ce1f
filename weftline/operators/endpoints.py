"""Endpoints from mappings: paths and methods expanded, doubles dropped, ids made unique, headers merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import normalized_path
from weftline.operators.tables import best_per_key


def or_else(values: Column, *fallback: str) -> Column:
    """An array, or the given values where it is null or empty."""
    other = F.array(*map(F.lit, fallback)) if fallback else F.array().cast("array<string>")
    return F.when(F.size(values) > 0, values).otherwise(other)


def joined_path(*parts: Column) -> Column:
    """Parts of a path, whatever slashes and blanks they begin and end with, as one."""
    return normalized_path(F.array_join(F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts)), "/"))


def expanded_endpoints(mappings: DataFrame) -> DataFrame:
    """``mappings`` with ``http_method, path, aliases, media`` in place of its arrays: one row for each method.

    ``base_paths``, ``paths``, ``http_methods``, ``own_media`` and ``class_media`` may be null or empty.  Every base path
    is joined with every path; the first is the endpoint's, the others are aliases.  No method means ``ANY``; own media
    types take the place of the class's.
    """
    every = F.flatten(F.transform(or_else(F.col("base_paths"), ""), lambda b: F.transform(or_else(F.col("paths"), ""), lambda p: joined_path(b, p))))
    rows = mappings.withColumn("__every", every).withColumn("http_method", F.explode(or_else(F.transform("http_methods", F.upper), "ANY")))
    kept = [c for c in mappings.columns if c not in ("base_paths", "paths", "http_methods", "own_media", "class_media")]
    media = F.when(F.size("own_media") > 0, F.col("own_media")).otherwise(or_else(F.col("class_media")))
    return rows.select(*kept, "http_method", F.get("__every", F.lit(0)).alias("path"), F.slice("__every", 2, F.size("__every")).alias("aliases"), media.alias("media"))


def unique_endpoints(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` (http_method, path, handler, seq, ...) with ``id``; of equal method, path and handler the first by seq.

    An id is the method and the path; where several handlers have it, each gets its class and method behind it.
    """
    first = best_per_key(endpoints, ["http_method", "path", "handler"], F.col("seq")).withColumn("id", F.concat_ws(" ", "http_method", "path"))
    shared = first.groupBy("id").agg((F.count(F.lit(1)) > 1).alias("__shared"))
    owner, member = F.substring_index("handler", "#", 1), F.substring_index(F.substring_index("handler", "#", -1), "(", 1)
    named = F.concat("id", F.lit(" @"), F.substring_index(owner, ".", -1), F.lit("."), member)
    return first.join(shared, "id").withColumn("id", F.when(F.col("__shared"), named).otherwise(F.col("id"))).drop("__shared")


def header_rows(endpoints: DataFrame, common: list[tuple[str, bool, str]], params: DataFrame, auth: DataFrame) -> DataFrame:
    """``endpoint, number, name, code_name, required, description``: the headers of each endpoint, names in any case once.

    ``common``: name, required and description of the headers that all endpoints have; ``params``: endpoint, seq, name,
    code_name, required, description; ``auth``: endpoint, seq, name.  A header's place, name and need are those of its
    first source; a description is the first that is not empty, the name in the code that of the last parameter, and
    authentication makes a header required.
    """
    row = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(n).alias("name"), F.lit(r).alias("required"), F.lit(d).alias("description")) for k, (n, r, d) in enumerate(common)))
    none = F.lit(None).cast("string")
    sources = []
    if common:
        each = endpoints.select("endpoint", F.explode(row).alias("h"))
        sources.append(each.select("endpoint", F.lit(0).alias("source"), "h.seq", "h.name", none.alias("code_name"), "h.required", "h.description"))
    sources.append(params.select("endpoint", F.lit(1).alias("source"), F.col("seq").cast("int").alias("seq"), "name", "code_name", "required", "description"))
    sources.append(auth.select("endpoint", F.lit(2).alias("source"), F.col("seq").cast("int").alias("seq"), "name", none.alias("code_name"), F.lit(True).alias("required"), none.alias("description")))
    rows = reduce(DataFrame.unionByName, sources).withColumn("key", F.lower("name"))
    at = F.struct("source", "seq")
    told = F.when(F.coalesce("description", F.lit("")) != "", F.col("description"))
    merged = rows.groupBy("endpoint", "key").agg(
        F.min(at).alias("at"),
        F.min_by("name", at).alias("name"),
        F.coalesce(F.max_by("code_name", F.when(F.col("source") == 1, F.col("seq"))), F.min_by("name", at)).alias("code_name"),
        (F.min_by("required", at) | F.bool_or(F.col("source") == 2)).alias("required"),
        F.coalesce(F.min_by(told, F.when(told.isNotNull(), at)), F.lit("")).alias("description"),
    )
    order = Window.partitionBy("endpoint").orderBy("at", "key")  # an endpoint's headers
    return merged.select("endpoint", F.row_number().over(order).alias("number"), "name", "code_name", "required", "description")
