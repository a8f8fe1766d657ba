"""Keyed tables: upsert, lookups, deletes, offsets, neighbour lists, hot-set rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins: of each key the row of greatest ``seq`` stays."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_order"), *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def vector_offsets(vectors: DataFrame, seq: str, vec: str) -> DataFrame:
    """Byte offset of each float32 vector in an append-only file, in ``seq`` order.

    Ranges of ``seq`` are summed apart; their totals (one row a range) are then added up, so no
    task sees all rows.
    """
    own = vectors.repartitionByRange(F.col(seq)).sortWithinPartitions(seq)
    own = own.withColumn("_part", F.spark_partition_id()).withColumn("_bytes", 4 * F.size(vec).cast("long"))
    totals = own.groupBy("_part").agg(F.sum("_bytes").alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0).cast("long")).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    out = own.withColumn("_in", F.coalesce(F.sum("_bytes").over(inside), F.lit(0).cast("long"))).join(bases, "_part")
    return out.select(*vectors.columns, (F.col("_base") + F.col("_in")).alias("offset"))


def get(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def multi_get(table: DataFrame, key: str, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of the wanted keys in their order; keys that are not there are left out."""
    return wanted.join(table, key).orderBy(pos)


def membership(parents: DataFrame, parent: str, children: str, child: str) -> DataFrame:
    """(child, parent, pos) of an array of children: the reverse index as a table."""
    return parents.select(F.posexplode(children).alias("pos", child), parent)


def strongest_edges(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """Out-edges of each page by weight, heaviest first; ties by target."""
    w = Window.partitionBy("from_page_id").orderBy(F.desc("weight"), "to_page_id")
    ranked = edges.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def cascade_delete_volume(volumes: DataFrame, shelf_volumes: DataFrame, volume_books: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """Volumes without the deleted ones, and both membership tables without their rows."""
    return {
        "volumes": delete_keys(volumes, gone, ["volume_id"]),
        "shelf_volumes": delete_keys(shelf_volumes, gone, ["volume_id"]),
        "volume_books": delete_keys(volume_books, gone, ["volume_id"]),
    }


def tier_entries(hot: DataFrame, tier: str | None = None) -> DataFrame:
    return hot if tier is None else hot.where(F.col("tier") == tier)


def weakest(hot: DataFrame, by: list[str]) -> DataFrame:
    """Entry of least salience of each tier (and community); ties by id."""
    return hot.groupBy(*by).agg(F.min(F.struct("salience", "entity_id")).alias("w")).select(*by, F.col("w.entity_id").alias("entity_id"), F.col("w.salience").alias("salience"))


def evict_weakest(hot: DataFrame, tier: str, community: str | None = None) -> DataFrame:
    own = hot.where(F.col("tier") == tier)
    if community is not None:
        own = own.where(F.col("community_id") == community)
    least = own.agg(F.min(F.struct("salience", "entity_id")).alias("w")).select(F.col("w.entity_id").alias("entity_id"))
    return hot.join(least, "entity_id", "left_anti")


def set_flags(flags: DataFrame, ids: DataFrame, dirty: Column) -> DataFrame:
    """Upsert of the recalculation flag of the given volumes."""
    new = ids.select("volume_id").distinct().withColumn("needs_recalc", dirty).withColumn("_seq", F.lit(1))
    return upsert(flags.select("volume_id", "needs_recalc").withColumn("_seq", F.lit(0)).unionByName(new), ["volume_id"], "_seq").drop("_seq")
