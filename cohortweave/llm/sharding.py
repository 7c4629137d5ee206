"""Sharding by fixed virtual slots.

A record belongs to one of ``SLOTS`` virtual slots by a hash; slots belong to
shards by a small versioned map.  Version 1 deals the slots round robin; each
rebalancing edits the stored map's last version into the next one: shards over their
share give up their smallest slots, and those go, largest first, to the lightest
shards; all other slots stay where they are.  The map has ``SLOTS`` rows whatever the
input, and only that map is ever handled in one task.  DataFrame functions only.

A record's place in its shard is its slot's first place plus its rank within the
slot, so ranking is spread over thousands of slots instead of one task a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortweave.llm._store import exists, fresh_dir, stored

SLOTS = 4096
#: What a shard keeps of an equal share before any slot comes to it; the rest is in small slots that even out.
KEPT = 0.98


def record_slot(id_col: Column, crc: Column, slots: int = SLOTS, by_key: bool = False) -> Column:
    """The virtual slot of a record: by its id alone, or by id and text so that a repeated id is spread."""
    parts = [id_col] if by_key else [id_col, crc]
    return F.pmod(F.xxhash64(*parts), F.lit(slots)).cast("int")


def grown_shard(slot: Column, shards: int) -> Column:
    """Shard of a slot after growing from 1 to ``shards`` shards one by one: a new shard takes slots only into itself.

    Shard s takes a slot if the slot's hash for s falls in the s-th part of the range, so each
    step moves 1 / s of the slots, all of them to s.
    """
    taken = F.lit(0)
    for s in range(1, shards):
        taken = F.when(F.pmod(F.xxhash64(slot, F.lit(s)), F.lit(s + 1)) == s, F.lit(s)).otherwise(taken)
    return taken.cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: ``version, slot, shard, bytes``, dealt round robin."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(F.lit(1).alias("version"), slot.alias("slot"), F.pmod(slot, F.lit(shards)).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))


def rebalanced(last: DataFrame, per_slot: DataFrame, shards: int) -> DataFrame:
    """The next version of a map from its last one and the measured ``slot, bytes``.

    A shard keeps its largest slots up to ``KEPT`` of an equal share; the rest move, the
    largest first, each to the lightest shard (ties: the lowest number).  Slots of
    shards that are no more (``shard >= shards``) all move, and new shards are filled
    likewise.  One row of at most ``SLOTS`` entries; the placing is one ``aggregate`` over it.
    """
    known = last.select("version", "slot", "shard").join(F.broadcast(per_slot.select("slot", F.col("bytes").alias("b"))), "slot", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    share = F.sum("b").over(Window.partitionBy("version")) / shards
    held = F.sum("b").over(Window.partitionBy("version", "shard").orderBy(F.desc("b"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    stays = (F.col("shard") < shards) & ((held <= KEPT * share) | (F.col("b") == 0))
    table = known.withColumn("stays", stays)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("b")).alias("less"), "slot", "shard", "stays")))
    one = table.groupBy((F.col("version") + 1).cast("int").alias("version")).agg(entries.alias("all"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.filter("all", lambda x: x["stays"] & (x["shard"] == s)), F.lit(0).cast("long"), lambda a, x: a - x["less"]))
    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<slot:int,shard:int,bytes:bigint>>)").alias("done"))

    def place(acc: Column, item: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        load = F.transform(acc["loads"], lambda v, i: F.when(i == lightest, v - item["less"]).otherwise(v))
        entry = F.struct(item["slot"].alias("slot"), lightest.alias("shard"), (-item["less"]).alias("bytes"))
        return F.struct(load.alias("loads"), F.concat(acc["done"], F.array(entry)).alias("done"))

    moved = F.aggregate(F.filter("all", lambda x: ~x["stays"]), start, place)["done"]
    kept = F.transform(F.filter("all", lambda x: x["stays"]), lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard"), (-x["less"]).alias("bytes")))
    return one.select("version", F.explode(F.concat(kept, moved)).alias("p")).select("version", "p.slot", "p.shard", "p.bytes")


def next_map(per_slot: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Edit the map stored at ``path`` (made there if absent) and append the new version; returns it."""
    spark = per_slot.sparkSession
    if not exists(spark, path):
        first_map(spark, shards, slots).coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    version = table.agg(F.max("version")).first()[0]
    rebalanced(table.filter(F.col("version") == version), per_slot, shards).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("version") == version + 1)


def assign_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", law: str = "bytes", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per input row: ``id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version``.

    ``law`` is ``bytes`` (shards of nearly equal size, by the rebalanced map) or ``key``
    (id and shard count alone decide; ``grown_shard`` is the shard with one shard more).
    ``size`` is the text's UTF-8 bytes plus 1 (a null text has none, and the CRC of
    nothing).  ``slot`` is the place within the shard, from 0 without gaps.  Repeated
    rows get a place each; null ids share the slot of their text; extra columns are
    ignored; an empty table gives an empty table.  The map at ``map_path`` is edited (or
    made there); its new version decides.
    """
    spark = df.sparkSession
    raw = F.coalesce(F.col("t"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    rows = rows.select("id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("v", record_slot(F.col("id"), F.col("text_crc32"), slots, law == "key"))
    rows = stored(rows, "records")
    per_slot = stored(rows.groupBy("v").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slots")
    if law == "bytes":
        path = map_path or fresh_dir(spark, "slot-map")
        edited = next_map(per_slot.select(F.col("v").alias("slot"), "bytes"), shards, path, slots)
        current = edited.select(F.col("slot").alias("v"), "shard", F.lit(None).cast("int").alias("grown_shard"), "version")
    else:
        current = per_slot.select("v", grown_shard(F.col("v"), shards).alias("shard"), grown_shard(F.col("v"), shards + 1).alias("grown_shard"), F.lit(1).alias("version"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    table = per_slot.select("v", "n").join(current, "v").select("v", "shard", "grown_shard", "version", F.coalesce(before, F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id", "text_crc32", "size"))
    placed = rows.withColumn("r", rank - 1).join(F.broadcast(table), "v")  # at most `slots` rows
    return placed.select("id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("first") + F.col("r")).cast("long").alias("slot"), "grown_shard", F.col("v").alias("virtual_slot"), F.col("version").alias("map_version"))
