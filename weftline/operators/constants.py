"""Constants that are made of literals and other constants: names resolved by stages, values in waves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.resolution import resolve
from weftline.operators.tables import materialised


def constant_refs(refs: DataFrame, constants: DataFrame, imports: DataFrame, types: DataFrame) -> DataFrame:
    """``ref, const``: the constant that each reference names, null if none.

    ``refs``: ref, owner, name (``NAME`` or ``Type.NAME``).  ``constants``: const, owner, name.  ``imports`` (static):
    owner, seq, from_type, member (null: all members).  ``types``: owner, name, type, how a name of a type reads in an
    owner.  A plain name is the owner's own constant, else that of the first import that has it; a qualified one is
    looked up in the type that its first part names.
    """
    members = constants.select(F.col("owner").alias("of_type"), F.col("name").alias("member"), "const")
    split = refs.withColumn("member", F.substring_index("name", ".", -1)).withColumn("head", F.expr("left(name, length(name) - length(member) - 1)"))
    plain, qualified = split.where("NOT contains(name, '.')"), split.where("contains(name, '.')")
    own = plain.join(members, (F.col("owner") == F.col("of_type")) & (plain["member"] == members["member"])).select("ref", F.col("const").alias("target"))
    named = imports.select("owner", "seq", F.col("from_type").alias("of_type"), F.col("member").alias("only"))
    taken = plain.join(named, "owner").where("only IS NULL OR only = member").join(members, ["of_type", "member"])
    taken = taken.groupBy("ref").agg(F.min_by("const", F.struct("seq", "const")).alias("target"))
    typed = qualified.join(types.select("owner", F.col("name").alias("head"), F.col("type").alias("of_type")), ["owner", "head"]).join(members, ["of_type", "member"]).select("ref", F.col("const").alias("target"))
    return resolve(refs, [own, taken, typed]).select("ref", F.col("target").alias("const"))


def expanded(parts: DataFrame, *, deepest: int = 12) -> DataFrame:
    """``const, value, depth``: the text of each constant, null if it cannot be made.

    ``parts``: const, pos, literal, ref (another constant; null where ``literal`` is given or the name is unknown).  A
    reference costs one level, a concatenation one more for its parts; values deeper than ``deepest`` are null, and so
    are those with a part that never gets a value: an unknown name, a null constant or a circle.

    Each wave joins the references that wait with the values of the wave before and finishes the constants that lack
    nothing more, so a wave costs what becomes known in it, and there are ``deepest`` of them at most.
    """
    rows = materialised(parts.select("const", "pos", F.col("literal").cast("string").alias("literal"), "ref"))
    sizes = materialised(rows.groupBy("const").agg(F.count(F.lit(1)).alias("n")))
    lit = rows.where("literal IS NOT NULL").join(sizes, "const").select("const", "pos", F.col("literal").alias("text"), F.when(F.col("n") > 1, 1).otherwise(0).alias("depth"))
    pieces = [materialised(lit)]
    open_refs = rows.where("literal IS NULL AND ref IS NOT NULL").join(sizes, "const").select("const", "pos", "ref", F.when(F.col("n") > 1, 2).otherwise(1).alias("step"))
    open_refs = materialised(open_refs)
    values: list[DataFrame] = []
    fresh = pieces[0].select("const").distinct()
    for _ in range(deepest + 1):
        have = reduce(DataFrame.unionByName, pieces).join(fresh, "const", "left_semi")  # only these can have become whole
        made = have.groupBy("const").agg(F.count(F.lit(1)).alias("got"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("x"), F.max("depth").alias("depth"))
        made = made.join(sizes, "const").where((F.col("got") == F.col("n")) & (F.col("depth") <= deepest))
        done = materialised(made.select("const", F.array_join("x.text", "").alias("value"), "depth"))
        if done.isEmpty():
            break
        values.append(done)
        new = open_refs.join(done.select(F.col("const").alias("ref"), "value", F.col("depth").alias("below")), "ref")
        pieces.append(materialised(new.select("const", "pos", F.col("value").alias("text"), (F.col("below") + F.col("step")).alias("depth"))))
        fresh = pieces[-1].select("const").distinct()
    everything = rows.select("const").distinct()
    if not values:
        return everything.select("const", F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("depth"))
    return everything.join(reduce(DataFrame.unionByName, values), "const", "left")
