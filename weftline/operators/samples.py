"""Sample documents of nested types: paths walked down by joins, objects put together level by level from below."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.tables import materialised


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    said = F.to_json(F.struct(text.alias("x")))
    return F.substring(said, 6, F.char_length(said) - 6)  # without {"x": and }


def assembled(leaves: DataFrame, key: list[str]) -> DataFrame:
    """``key..., json``: one JSON object for each key from ``key..., path, json``.

    ``path`` is an array of structs ``seq, name, list`` from the object's own members downwards; members stand in order of
    seq and name.  ``list``: the member's value stands alone in an array.  From the deepest level up, the members of an
    object become its text in one aggregate, which is a member of the level above: texts meet only within one object.
    """
    rows = leaves.select(*key, "path", "json")
    deepest = rows.agg(F.max(F.size("path")).alias("n")).first().n or 0
    done = rows
    for depth in range(deepest, 0, -1):
        here = done.where(F.size("path") == depth)
        last = F.element_at("path", -1)
        value = F.when(last["list"], F.concat(F.lit("["), "json", F.lit("]"))).otherwise(F.col("json"))
        member = F.struct(last["seq"].alias("seq"), last["name"].alias("name"), F.concat(quoted(last["name"]), F.lit(":"), value).alias("text"))
        packed = here.groupBy(*key, F.slice("path", 1, depth - 1).alias("path")).agg(F.array_sort(F.collect_list(member)).alias("m"))
        packed = packed.select(*key, "path", F.concat(F.lit("{"), F.array_join("m.text", ","), F.lit("}")).alias("json"))
        done = done.where(F.size("path") < depth).unionByName(packed)
    return done.select(*key, "json")


def samples(roots: DataFrame, fields: DataFrame, *, deepest: int = 5) -> DataFrame:
    """``root, json``: a sample object of each root type.

    ``roots``: root.  ``fields``: type, seq, name, sample (JSON text of a scalar member), nested (a type, else null),
    list.  A nested object is empty where its type has no fields, where it is one of the types around it, or ``deepest``
    levels down; a root without fields is an empty object.  Each level is one join; of equal names the last counts.
    """
    one = fields.groupBy("type", "name").agg(F.min("seq").alias("seq"), F.max_by(F.struct("sample", "nested", "list"), "seq").alias("f"))
    one = materialised(one.select("type", "seq", "name", "f.*"))
    step = F.struct(F.col("seq").cast("int").alias("seq"), F.col("name").alias("name"), F.coalesce("list", F.lit(False)).alias("list"))
    none = F.array().cast("array<struct<seq:int,name:string,list:boolean>>")
    at = materialised(roots.select("root").distinct().select("root", F.col("root").alias("type"), none.alias("path"), F.array().cast("array<string>").alias("around")))
    leaves = []
    for depth in range(deepest + 1):
        open_ = at.join(one.select("type").distinct().withColumn("known", F.lit(True)), "type", "left")
        leaves.append(open_.where("known IS NULL").select("root", "path", F.lit("{}").alias("json")))
        rows = open_.where("known").drop("known").join(one, "type").select("root", F.concat("path", F.array(step)).alias("path"), "around", "sample", F.col("nested").cast("string").alias("nested"))
        rows = materialised(rows)
        leaves.append(rows.where("nested IS NULL").select("root", "path", F.coalesce("sample", F.lit("null")).alias("json")))
        shut = F.array_contains("around", F.col("nested")) | F.lit(depth >= deepest)
        leaves.append(rows.where(F.col("nested").isNotNull() & shut).select("root", "path", F.lit("{}").alias("json")))
        at = materialised(rows.where(F.col("nested").isNotNull() & ~shut).select("root", F.col("nested").alias("type"), "path", F.array_append("around", F.col("nested")).alias("around")))
        if at.isEmpty():
            break
    return assembled(materialised(reduce(DataFrame.unionByName, leaves)), ["root"])
