"""One cycle of cluster stability: split wide volumes, merge small ones, mend shelves and community labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import maintenance as m
from ..sources.tables import checkpointed


def _pairs(volumes: DataFrame) -> DataFrame:
    """(small_id, volume_id, merged_id, ...) of the merges that may be done at once.

    Small volumes take their turn by place, and one that was merged neither merges nor is merged with again. A merge
    is done now if no earlier small volume shares a book with either side, so rounds give what turns would.
    """
    few = volumes.where(F.size("book_ids") < m.MIN_BOOKS)
    held = volumes.select("volume_id", F.explode("book_ids").alias("book"))
    near = few.select(F.col("volume_id").alias("small_id"), F.col("pos").alias("turn"), F.explode("book_ids").alias("book")).join(held, "book").where("small_id != volume_id")
    first = near.select(F.col("volume_id").alias("id"), "turn").unionByName(near.select(F.col("small_id").alias("id"), "turn")).groupBy("id").agg(F.min("turn").alias("first"))
    side = lambda k: first.select(F.col("id").alias(k), F.col("first").alias(f"f_{k}"))
    best = m.merge_volumes(volumes).join(few.select(F.col("volume_id").alias("small_id"), F.col("pos").alias("turn")), "small_id")
    return best.join(side("small_id"), "small_id").join(side("volume_id"), "volume_id").where("f_small_id = turn and f_volume_id = turn")


def run(volumes: DataFrame, shelves: DataFrame, book_pages: DataFrame, activity: DataFrame, rounds: int = 50) -> dict[str, DataFrame]:
    """Volumes, shelves, activity and counts after one cycle.

    ``volumes`` is (volume_id, book_ids, prototypes, variance), ``shelves`` (shelf_id, pos, volume_ids, ...), ``book_pages``
    (book_id, page_id), ``activity`` has page_id and community_id. First every volume over the variance
    bound with at least two books is split in halves; then volumes of fewer than two books, the new halves among them, merge
    with the one that shares most books, shelf by shelf in the order of ``pos`` and of their place there. Successors stand
    at the end of their shelf, and pages of their books get them as community. Parents that are gone leave both tables; a
    volume on no shelf takes no part.
    """
    cols = ["volume_id", "book_ids", "prototypes", "variance"]
    halves = m.split_volumes(volumes)
    parts = halves.join(volumes.select(F.col("volume_id").alias("parent_id"), "prototypes"), "parent_id")
    gone = halves.select(F.col("parent_id").alias("volume_id")).distinct()
    replaced = halves.groupBy(F.col("parent_id").alias("old_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("half", "volume_id"))), lambda s: s["volume_id"]).alias("new_ids"))
    kept = checkpointed(m.replace_in_shelves(shelves, replaced))
    turns = kept.select("pos", F.posexplode("volume_ids").alias("place", "volume_id")).groupBy("volume_id").agg(F.min(F.col("pos") * (1 << 20) + F.col("place")).alias("pos"))
    now = volumes.join(gone, "volume_id", "left_anti").select(*cols).unionByName(parts.select(*cols)).dropDuplicates(["volume_id"])
    now = checkpointed(now.join(turns, "volume_id"))
    named = halves.select("volume_id", F.explode("book_ids").alias("book_id"))
    labels = m.relabel_communities(activity, named, book_pages)
    merges, open_, made = 0, now, None
    for _ in range(rounds):
        pairs = checkpointed(_pairs(open_))
        n = pairs.count()
        if not n:
            break
        merges += n
        out = pairs.select(F.col("small_id").alias("volume_id")).unionByName(pairs.select("volume_id"))
        open_ = checkpointed(open_.join(out, "volume_id", "left_anti"))
        fresh = pairs.select(F.col("merged_id").alias("volume_id"), F.col("turn").alias("pos"), "book_ids", "prototypes", "variance")
        made = fresh if made is None else made.unionByName(fresh)
        taken = pairs.select(F.col("small_id").alias("old_id"), F.array("merged_id").alias("new_ids")).unionByName(pairs.select(F.col("volume_id").alias("old_id"), F.array().cast("array<string>").alias("new_ids")))
        kept = checkpointed(m.replace_in_shelves(kept, taken))
        labels = checkpointed(m.relabel_communities(labels, fresh.select("volume_id", F.explode("book_ids").alias("book_id")), book_pages))
    else:
        raise RuntimeError(f"merging did not settle in {rounds} rounds")
    final = open_ if made is None else open_.unionByName(made)
    counts = halves.agg(F.countDistinct("parent_id").alias("splits")).withColumn("merges", F.lit(merges).cast("long"))
    return {"volumes": final, "shelves": kept, "activity": labels, "counts": counts}
