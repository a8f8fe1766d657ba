"""Background upkeep: edge strengthening and decay, prototypes, replay, volume splits and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_id
from ..functions.vectors import centroid, nearest

#: Gain of a traversal, decay, pruning bound, variance that splits, least books of a volume.
LTP, LTD, PRUNE, SPLIT_VARIANCE, MIN_BOOKS = 0.1, 0.99, 0.01, 0.5, 2


def strengthen(edges: DataFrame, traversed: DataFrame, now: Column, gain: float = LTP, top: float | None = None) -> DataFrame:
    """Add ``gain`` to each traversed pair once, creating missing edges with it; ``top`` caps weights."""
    pairs = traversed.select("from_page_id", "to_page_id").distinct().withColumn("_hit", F.lit(True))
    both = edges.join(pairs, ["from_page_id", "to_page_id"], "full_outer")
    weight = F.coalesce("weight", F.lit(0.0)) + F.when(F.col("_hit"), gain).otherwise(0.0)
    weight = F.when(F.col("_hit"), F.least(weight, F.lit(top))).otherwise(weight) if top is not None else weight
    return both.select("from_page_id", "to_page_id", weight.alias("weight"), F.when(F.col("_hit"), now).otherwise(F.col("last_updated_at")).alias("last_updated_at"))


def decay(edges: DataFrame, max_degree: int, factor: float = LTD, least: float = PRUNE, pages: DataFrame | None = None) -> DataFrame:
    """Decayed weights over the bound, at most ``max_degree`` heaviest out-edges of each page; of the ``pages`` (page_id) only, if given."""
    own = edges if pages is None else edges.join(pages.select(F.col("page_id").alias("from_page_id")).distinct(), "from_page_id", "left_semi")
    own = own.withColumn("weight", F.col("weight") * factor).where(F.col("weight") >= least)
    w = Window.partitionBy("from_page_id").orderBy(F.desc("weight"), "to_page_id")
    return own.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_degree).drop("rank")


def decay_counts(edges: DataFrame, kept: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row (decayed, pruned): out-edges of the pages before, and those of them that ``decay`` dropped."""
    own = edges if pages is None else edges.join(pages.select(F.col("page_id").alias("from_page_id")).distinct(), "from_page_id", "left_semi")
    after = kept.agg(F.count("*").alias("kept"))
    return own.agg(F.count("*").alias("decayed")).join(F.broadcast(after)).select("decayed", (F.col("decayed") - F.col("kept")).alias("pruned"))


def recompute_volume_prototypes(volume_pages: DataFrame) -> DataFrame:
    """(volume_id, prototype): the mean of all its pages, to be appended to the volume's prototypes."""
    return centroid(volume_pages, ["volume_id"], "v", "prototype")


def recompute_shelf_prototypes(shelf_volumes: DataFrame, volumes: DataFrame) -> DataFrame:
    """(shelf_id, prototype): the mean of the last prototype of each of its volumes (volume_id, prototypes)."""
    last = volumes.select("volume_id", F.element_at("prototypes", -1).alias("p"))
    return centroid(shelf_volumes.join(last, "volume_id"), ["shelf_id"], "p", "prototype")


def append_prototype(table: DataFrame, new: DataFrame, ident: str) -> DataFrame:
    """Prototypes with the recomputed one at the end."""
    joined = table.join(new, ident, "left")
    return joined.withColumn("prototypes", F.when(F.col("prototype").isNull(), F.col("prototypes")).otherwise(F.concat("prototypes", F.array("prototype")))).drop("prototype")


def replay_pool(pages: DataFrame, pool: int = 200, sample: int = 5, seed: int | None = None) -> DataFrame:
    """``sample`` of the ``pool`` newest pages, without replacement."""
    newest = pages.orderBy(F.desc("created_at"), "page_id").limit(pool)
    return newest.orderBy(F.rand(seed) if seed is not None else F.rand(), "page_id").limit(sample)


def replay(pages: DataFrame, sources: DataFrame, edges: DataFrame, now: Column, k: int = 10) -> DataFrame:
    """Query each source page's vector and strengthen the edges to what it finds, capped at 1."""
    hits = nearest(pages, sources, k).where("query_id != id")
    pairs = hits.select(F.col("query_id").alias("from_page_id"), F.col("id").alias("to_page_id"))
    return strengthen(edges, pairs, now, top=1.0)


def split_volumes(volumes: DataFrame) -> DataFrame:
    """Two halves of each volume of high variance and at least two books.

    Two-means over the book positions starts from the halves and is at rest there for every
    number of books, so the split is the middle; each half gets half the variance.
    """
    wide = volumes.where((F.col("variance") > SPLIT_VARIANCE) & (F.size("book_ids") >= MIN_BOOKS))
    half = F.ceil(F.size("book_ids") / 2).cast("int")
    parts = F.array(F.slice("book_ids", F.lit(1), half), F.slice("book_ids", half + 1, F.size("book_ids")))
    rows = wide.select(F.col("volume_id").alias("parent_id"), "variance", F.posexplode(parts).alias("half", "book_ids"))
    ident = text_id(F.concat(F.lit("split:"), F.array_join("book_ids", "|")))
    return rows.select("parent_id", "half", ident.alias("volume_id"), "book_ids", (F.col("variance") / 2).alias("variance"))


def merge_volumes(volumes: DataFrame) -> DataFrame:
    """Volumes of fewer than two books, each with the volume that shares most books with it (first of equals).

    ``volumes`` is (volume_id, pos, book_ids, prototypes, variance).
    """
    few = volumes.where(F.size("book_ids") < MIN_BOOKS).select(F.col("volume_id").alias("small_id"), F.col("book_ids").alias("a"), F.col("variance").alias("va"), F.col("prototypes").alias("pa"))
    held = volumes.select(F.explode("book_ids").alias("book"), "volume_id")
    shared = few.select("small_id", F.explode("a").alias("book")).join(held, "book").where("small_id != volume_id").groupBy("small_id", "volume_id").agg(F.countDistinct("book").alias("n"))
    best = shared.join(volumes.select("volume_id", "pos"), "volume_id").groupBy("small_id").agg(F.max_by("volume_id", F.struct("n", -F.col("pos"))).alias("volume_id"))
    both = best.join(few, "small_id").join(volumes, "volume_id")
    union = F.array_union("book_ids", "a")
    ident = text_id(F.concat(F.lit("merge:"), F.array_join(union, "|")))
    return both.select("small_id", "volume_id", ident.alias("merged_id"), union.alias("book_ids"), F.concat("prototypes", "pa").alias("prototypes"), ((F.col("variance") + F.col("va")) / 2).alias("variance"))


def relabel_communities(activity: DataFrame, volume_books: DataFrame, book_pages: DataFrame) -> DataFrame:
    """Activity rows with the community of each page of these volumes set to the volume."""
    of = volume_books.join(book_pages, "book_id").groupBy("page_id").agg(F.min("volume_id").alias("_v"))
    return activity.join(of, "page_id", "left").withColumn("community_id", F.coalesce("_v", "community_id")).drop("_v")


def replace_in_shelves(shelves: DataFrame, replaced: DataFrame) -> DataFrame:
    """Shelves with each replaced volume (old_id, new_ids) taken out and its successors put at the end."""
    hit = shelves.select("shelf_id", F.explode("volume_ids").alias("old_id")).join(replaced, "old_id").groupBy("shelf_id").agg(F.collect_set("old_id").alias("_old"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("old_id", "new_ids"))), lambda s: s["new_ids"])).alias("_new"))
    joined = shelves.join(hit, "shelf_id", "left")
    kept = F.concat(F.array_except("volume_ids", "_old"), "_new")
    return joined.withColumn("volume_ids", F.when(F.col("_old").isNull(), F.col("volume_ids")).otherwise(kept)).drop("_old", "_new")
