"""Sharding by fixed virtual slots: records hash into thousands of slots, a versioned map says which shard holds a slot.

The number of slots never changes, so a record's slot never does.  Bytes are summed by slot, and rebalancing edits the
map alone: a shard keeps its slots, largest first, up to its fair share; the others go, largest first, to the shard that
holds the fewest bytes.  Every edit is a version of its own, written as one file, so a reader finds it whole or not at
all, and an older version still says where its rows lie.

The law of this method is ``bytes``: shards hold nearly the same number of bytes, as far as slots (one slot's rows stay
together) allow.  Plans are SQL functions alone; what one row holds is the map, of a fixed number of slots.

Defined results: a null text has size 1 and the checksum of no bytes; a null id is hashed as an empty one with its
text's checksum; rows equal in id and text share a slot and are numbered apart; an empty table gives no rows, and its
slots are dealt evenly; of further columns none is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import materialised, scratch_dir

SLOTS = 4096


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot``: a record's bytes, one more for itself, and the slot of its hash."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    return sized.withColumn("virtual_slot", F.pmod(F.xxhash64(key, F.col("text_crc32")), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, n``"""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """``virtual_slot, shard, version``: version 0, made before any size is known, deals the slots in turn."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(slot.alias("virtual_slot"), F.pmod(slot, F.lit(shards)).alias("shard"), F.lit(0).alias("version"))


def rebalanced(owners: DataFrame, sizes: DataFrame, shards: int, *, tolerance: float = 0.0) -> DataFrame:
    """The next version of the map ``owners`` for ``shards`` shards.

    A slot stays as long as its shard's bytes, larger slots first, are within the fair share and ``tolerance`` of it;
    slots of shards that are no more move as well.  With one more shard, slots move only into it, but for one or
    another where shares do not divide evenly.
    """
    held = owners.join(sizes, "virtual_slot", "left").select("virtual_slot", "shard", "version", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    packed = held.agg(
        F.max("version").alias("version"),
        (F.ceil(F.sum("bytes") * (1 + tolerance) / F.lit(shards))).cast("long").alias("share"),
        F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot", "shard"))).alias("slots"),
    )
    load = f"array_repeat(named_struct('bytes', 0L, 'n', 0), {shards})"  # by shard: bytes, and the number of slots among equals
    put = "transform(acc.load, (l, i) -> named_struct('bytes', l.bytes - IF(i = {at}, x.less, 0L), 'n', l.n + IF(i = {at}, 1, 0)))"
    least = "(array_position(acc.load, array_min(acc.load)) - 1)"
    stays = f"(x.shard < {shards} AND acc.load[x.shard].bytes - x.less <= share)"
    kept = packed.withColumn("k", F.expr(f"""aggregate(slots,
      named_struct('load', {load}, 'at', cast(array() AS array<struct<virtual_slot int, shard int>>), 'free', filter(slots, x -> false)),
      (acc, x) -> named_struct('load', IF({stays}, {put.format(at="x.shard")}, acc.load),
        'at', IF({stays}, concat(acc.at, array(named_struct('virtual_slot', x.virtual_slot, 'shard', x.shard))), acc.at),
        'free', IF({stays}, acc.free, concat(acc.free, array(x)))))"""))
    moved = kept.withColumn("m", F.expr(f"""aggregate(k.free, named_struct('load', k.load, 'at', k.at),
      (acc, x) -> named_struct('load', {put.format(at=least)},
        'at', concat(acc.at, array(named_struct('virtual_slot', x.virtual_slot, 'shard', cast({least} AS int))))))"""))
    return moved.select(F.explode("m.at").alias("s"), (F.col("version") + 1).alias("version")).select("s.virtual_slot", "s.shard", "version")


def save_version(owners: DataFrame, folder: str) -> None:
    """Adds a version to the folder of a map; a version that is there already is an error."""
    version = owners.agg(F.max("version").alias("v")).first().v
    owners.drop("version").coalesce(1).write.parquet(f"{folder.rstrip('/')}/version={version}")


def load_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A version of a map, the newest if none is named."""
    found = spark.read.schema("virtual_slot int, shard int, version int").parquet(folder)
    wanted = found.agg(F.max("version").alias("v")).first().v if version is None else version
    return found.where(F.col("version") == wanted)


def sharded(docs: DataFrame, shards: int = 16, *, slots: int = SLOTS, tolerance: float = 0.0, folder: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version`` of each row of ``docs``.

    ``slot`` numbers a shard's rows from 0, by virtual slot, id and checksum.  ``folder`` holds the map's versions; its
    newest is rebalanced by the sizes found and saved as the next.  Without one, a map of two versions is made.
    """
    import uuid

    spark = docs.sparkSession
    rows = materialised(records(docs, slots))  # a thin table; texts are read once and not shuffled
    sizes = slot_sizes(rows)
    if folder is None:
        folder = f"{scratch_dir(spark).rstrip('/')}/map-{uuid.uuid4().hex}"
        save_version(first_map(spark, shards, slots), folder)
    save_version(rebalanced(load_version(spark, folder), sizes, shards, tolerance=tolerance), folder)
    owners = load_version(spark, folder)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = owners.join(sizes, "virtual_slot", "left").withColumn("begins", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("bytes", "n")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(begins), "virtual_slot")  # one row for each slot
    slot = (F.col("begins") + F.col("nth") - 1).cast("long")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")
