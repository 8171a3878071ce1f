"""Keyed tables on immutable storage: merges, diffs, latest and first rows per key, and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; where that is unset, on a local master only, in a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="weftline-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = f"file://{_own[0]}"
    return f"{shared.rstrip('/')}/t-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: computed once, lineage cut."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def best_per_key(df: DataFrame, keys: list[str], order: Column, *, last: bool = False) -> DataFrame:
    """One whole row per key, the least by ``order`` or the greatest; one partial aggregate, no window."""
    row = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    pick = F.max_by if last else F.min_by
    return df.groupBy(*keys).agg(pick(row, order).alias("r")).select(*keys, "r.*")


def listed(df: DataFrame, keys: list[str], value: str, order: list[str | Column], most: int) -> DataFrame:
    """``keys..., n, first``: how many rows a key has and its first ``most`` values in the given order.

    Rows beyond the bound are left out before they meet, so a key with very many costs no long list.
    """
    from pyspark.sql import Window

    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= most)
    first = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(value).alias("v")))), lambda x: x["v"]).alias("first"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(first, keys)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], *, digest: str | None = None) -> DataFrame:
    """The old rows without those of the new keys, and the new rows.  With ``digest``, a row whose digest has not changed
    stays as it was."""
    if digest:
        same = old.select(*keys, F.col(digest).alias("__was"))
        new = new.join(same, keys, "left").where(~F.col(digest).eqNullSafe(F.col("__was")) | F.col("__was").isNull()).select(*new.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def without_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def refreshed(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """A full refresh: of rows with the same key the last by ``seq``."""
    return best_per_key(rows, keys, F.col(seq), last=True)


def appended(log: DataFrame, new: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """The log with new rows, which are numbered on from its greatest id."""
    last = log.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("last")).scalar()
    fresh = numbered(new, order).withColumn(id_column, (F.col("number") + last).cast("long")).drop("number")
    return log.unionByName(fresh.select(*log.columns))


def numbered(df: DataFrame, order: list[str | Column], total: Column | None = None) -> DataFrame:
    """``df`` with ``number``, 1 to n in the given order, and with ``total`` its running sum as ``running``.

    Rows are dealt to ranges of the order; a range numbers its own rows and adds what stands before it, one row for each
    range.  No window spans the table.
    """
    from pyspark.sql import Window

    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = materialised(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part").orderBy(*columns)
    value = F.lit(0) if total is None else total
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__v"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias("__v0"))
    out = parts.withColumns({"number": F.row_number().over(inside), "running": F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(offsets, "__part").withColumns({"number": (F.col("number") + F.col("__n0")).cast("long"), "running": F.col("running") + F.col("__v0")})
    return out.drop("__part", "__n0", "__v0", *([] if total is not None else ["running"]))


def spread_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", most: int = 20_000, few: bool = False) -> DataFrame:
    """``many`` joined with ``one`` (each key once); a key with more than ``most`` rows is dealt to several tasks by a hash
    of the row.  Only the rows of ``one`` for such keys are repeated, once for each ``most`` rows.  Where ``one`` is known
    to hold ``few`` values it is broadcast, and nothing is dealt."""
    if few:
        return many.join(F.broadcast(one), key, how)
    hot = many.groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot = F.broadcast(materialised(hot.select("__hot", F.expr(f"n div {most} + 1").alias("__salts"))))  # one in ``most`` rows at the most
    salts = F.coalesce("__salts", F.lit(1).cast("long"))
    dealt = many.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(*many.columns), salts))
    each = one.join(hot, F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    gone = ["__hot", "__salts"]
    tasks = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows may hold long lists
    return dealt.drop(*gone).repartition(tasks, key, "__salt").join(each.drop(*gone), [key, "__salt"], how).drop("__salt")


#: About how many values of a key one list of ``products`` holds, on the left and on the right.
LISTED = 1024, 512
#: So many values on the right are broadcast.
BROADCAST = 1_000_000


def products(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``a, b``: each value ``a`` of ``left`` with each value ``b`` of ``right`` that has the same key.  Both are written
    tables, as they are read twice.

    The values of a key are gathered to lists by a hash, lists meet, and pairs are made of them in the last step, which
    nothing is written or shuffled after: what is moved grows with the two tables, not with the pairs.  Up to a million
    values on the right are broadcast.  Above, keys are dealt to several tasks by their lists on the left in proportion
    to their pairs, and the right lists are repeated for each; a list on the left meets up to about a thousand at once.
    Pairs come list by list, so that few different values lie near each other: files of them stay small.
    """
    each_left, each_right = LISTED
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows here may stand for very many
    n, m = (df.groupBy(key).agg(F.count(F.lit(1)).alias(name)) for df, name in ((left, "n"), (right, "m")))
    sizes = materialised(n.join(m, key).withColumn("pairs", F.col("n").cast("double") * F.col("m")))
    pairs, values = sizes.agg(F.sum("pairs"), F.sum("m")).first()
    few, share = (values or 0) <= BROADCAST, max((pairs or 0) / (2 * tasks), each_left * each_right)
    lists = sizes.select(F.col(key).alias("__large"), F.expr(f"n div {each_left} + 1").alias("__left"), F.expr(f"m div {each_right} + 1").alias("__right"), F.ceil(F.col("pairs") / share).alias("__parts"))
    one = F.lit(1).cast("long")
    large = lists.where("__left > 1 OR __right > 1").withColumns({"__parts": F.least("__left", one if few else F.col("__parts")), "__bands": F.expr("__right div 1024 + 1")})
    large = F.broadcast(materialised(large))  # one for each list that is full at the most
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    def sliced(df, value, count):
        dealt = df.select(key, F.col(value).alias("v")).join(large, F.col(key) == F.col("__large"), "left")
        return dealt.withColumns({"__slice": F.pmod(F.xxhash64("v"), F.coalesce(count, one)), "__parts": F.coalesce("__parts", one), "__bands": F.coalesce("__bands", one)})

    def gathered(df, name, by):
        lists = df.repartition(tasks, *by).groupBy(*at, "__slice").agg(F.collect_list(F.struct("v")).alias(name))
        return lists.select(*at, F.col(f"{name}.v").alias(name))  # lists of structs keep nulls

    at = [key, "__part", "__band"]
    lefts = sliced(left, a, F.col("__left")).withColumn("__part", F.expr("__slice % __parts")).withColumn("__band", every("__bands"))
    rights = sliced(right, b, F.col("__right")).withColumn("__band", F.expr("__slice % __bands")).withColumn("__part", every("__parts"))
    lefts, rights = gathered(lefts, "__a", [key, "__slice"] if few else at), gathered(rights, "__b", at)
    # lists are small on disk, so their sizes say little: merged unless they are known to be few
    met = lefts.join(F.broadcast(rights) if few else rights.hint("merge"), at).select("__a", "__b")
    # compiled code holds all rows that it makes of one: each step is cut off from the next, without a shuffle
    apart = lambda df: df.coalesce(64 * tasks)
    return apart(apart(met).select(F.explode("__a").alias(a), "__b")).select(a, F.explode("__b").alias(b))


def diff(old: DataFrame, new: DataFrame, key: str, digest: str, *, missing_roots: list[str] | None = None) -> DataFrame:
    """``key, status``: added, changed, removed or unchanged, by key and digest.

    Paths at or under a missing root are not known to be gone: they are ``kept``.
    """
    a = old.select(F.col(key).alias("k"), F.col(digest).alias("was"))
    b = new.select(F.col(key).alias("k2"), F.col(digest).alias("now"))
    both = a.join(b, F.col("k") == F.col("k2"), "full")
    lost = F.lit("removed")
    for root in missing_roots or []:
        lost = F.when((F.col("k") == root) | F.col("k").startswith(root.rstrip("/") + "/"), "kept").otherwise(lost)
    status = F.when(F.col("k").isNull(), "added").when(F.col("k2").isNull(), lost).when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select(F.coalesce("k", "k2").alias(key), status.alias("status"))


def cache_state(log: DataFrame, key: str, op: str, at: str) -> DataFrame:
    """``key, entry, hits, last_used`` from a log of puts, touches and clears: the last put counts if no clear follows it,
    with the touches since (a put starts again at none).  Two partial aggregates, no window."""
    marks = log.groupBy(key).agg(F.max(F.when(F.col(op) == "put", F.col(at))).alias("entry"), F.max(F.when(F.col(op) == "clear", F.col(at))).alias("cleared"))
    live = marks.where(F.col("entry").isNotNull() & (F.col("cleared").isNull() | (F.col("cleared") < F.col("entry")))).select(key, "entry")
    since = log.where(F.col(op) == "touch").select(key, F.col(at).alias("__at")).join(live, key).where(F.col("__at") > F.col("entry"))
    used = since.groupBy(key).agg(F.count(F.lit(1)).alias("hits"), F.max("__at").alias("last"))
    return live.join(used, key, "left").select(key, "entry", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("last", "entry").alias("last_used"))
