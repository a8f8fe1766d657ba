"""The bounded similarity graph: insertion, merging, dirty volumes, recalculation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.vectors import cosine, doubles, nearest

#: Greatest cosine distance of a neighbour, least pair budget of a recalculation.
MAX_DISTANCE, MIN_PAIRS = 0.5, 2048


def forward(pages: DataFrame, new: DataFrame, max_degree: int, max_distance: float = MAX_DISTANCE) -> DataFrame:
    """(page_id, neighbor_id, similarity, distance, rank) of the new pages among all pages.

    Both are (id, v). New pages travel in blocks to the others; at most ``max_degree`` rows a new page and
    task are shuffled.
    """
    rows = nearest(pages, new, max_degree, 1 - max_distance, skip_self=True)
    return rows.select(F.col("query_id").alias("page_id"), F.col("id").alias("neighbor_id"), F.col("score").alias("similarity"), F.round(1 - F.col("score"), 6).alias("distance"), "rank")


def merge(stored: DataFrame, found: DataFrame, max_degree: int) -> DataFrame:
    """Stored lists, the new forward ones and their reverses, cut to the most similar ``max_degree`` of each page.

    Inputs are (page_id, neighbor_id, similarity); a pair that comes twice counts once.
    """
    cols = ["page_id", "neighbor_id", "similarity"]
    back = found.select(F.col("neighbor_id").alias("page_id"), F.col("page_id").alias("neighbor_id"), "similarity")
    every = stored.select(*cols).unionByName(found.select(*cols)).unionByName(back)
    every = every.groupBy("page_id", "neighbor_id").agg(F.max("similarity").alias("similarity"))
    w = Window.partitionBy("page_id").orderBy(F.desc("similarity"), "neighbor_id")
    return every.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_degree)


def dirty_volumes(new: DataFrame, book_pages: DataFrame, volume_books: DataFrame) -> DataFrame:
    """Volumes that hold a book of a new page."""
    return new.select("page_id").join(book_pages, "page_id").join(volume_books, "book_id").select("volume_id").distinct()


def recalc(volume_pages: DataFrame, dirty: DataFrame, mass: int, max_degree: int | None = None, c: float = policy.CAPACITY_C) -> DataFrame:
    """Neighbour lists within each dirty volume, for the volumes whose pairs fit the cycle's budget.

    ``volume_pages`` is (volume_id, page_id, v). Volumes are taken in id order while the running
    number of ordered pairs stays within the budget; the first that does not fit ends the cycle.
    No similarity cutoff applies. Volumes are bounded (four books of eight pages), and so are their pairs.
    """
    budget = max(MIN_PAIRS, policy.capacity(mass, c))
    degree = max_degree or policy.neighbor_degree(mass, c)
    own = volume_pages.join(dirty.select("volume_id").distinct(), "volume_id", "left_semi")
    sizes = own.groupBy("volume_id").agg((F.count("*") * (F.count("*") - 1)).alias("pairs"))
    # Volumes without a pair take nothing of the budget; each other takes two of it at least, so a cycle holds at most
    # half the budget of them, and only those in front are summed up in order.
    some = sizes.where("pairs > 0").orderBy("volume_id").limit(budget // 2 + 1)
    run = some.withColumn("sum", F.sum("pairs").over(Window.orderBy("volume_id").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= budget)
    own = own.join(run.select("volume_id"), "volume_id", "left_semi")
    a = own.select("volume_id", "page_id", doubles(F.col("v")).alias("v"))
    b = own.select("volume_id", F.col("page_id").alias("neighbor_id"), doubles(F.col("v")).alias("w"))
    pairs = a.join(b, "volume_id").where("page_id != neighbor_id").select("volume_id", "page_id", "neighbor_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("similarity"))
    w = Window.partitionBy("page_id").orderBy(F.desc("similarity"), "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= degree).withColumn("distance", F.round(1 - F.col("similarity"), 6))
