"""A text query as one plan: rank, fill up, probe, expand, order. Reads only; hits are recorded apart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import contrast, graph, ranking
from ..operators.store import upsert
from ..sources.tables import checkpointed


@dataclass
class Retrieval:
    pages: DataFrame
    probe: DataFrame
    nodes: DataFrame
    path: DataFrame


def retrieve(pages: DataFrame, hot: DataFrame, neighbors: DataFrame, query: list[float], k: int = 10, protected: int | None = None, mass: int | None = None, tree: dict[str, DataFrame] | None = None) -> Retrieval:
    """``pages`` (page_id, v), ``hot`` (entity_id, tier, ...), ``neighbors`` (page_id, neighbor_id, distance).

    ``tree`` holds shelves, volumes, books and their membership tables, as ``ingest.ingest`` returns them: with it the query
    routes from the resident shelves down, residents of each level joining; without it the resident pages
    compete alone. Where fewer than ``k`` are found, all pages fill up. Resident books lend their medoids to the probe.
    """
    if tree is None:
        best = ranking.rank_pages(pages, query, k, hot.where("tier = 'page'").select(F.col("entity_id").alias("id")))
    else:
        best = ranking.beam_route(tree["shelves"], tree["volumes"], tree["books"], pages, tree["shelf_volumes"], tree["volume_books"], tree["book_pages"], query, k, hot)
    top = ranking.merge_hot_warm(best, ranking.rank_pages(pages, query, k), k)
    found = checkpointed(top.join(pages, top.id == pages.page_id).select("id", "score", "v"))  # at most k rows, read many times
    listed = found.select("id", F.lit(1).alias("_late"), (-F.col("score")).alias("_s"), "v")
    if tree is not None:
        books = tree["books"].join(hot.where("tier = 'book'").select(F.col("entity_id").alias("book_id")), "book_id", "left_semi")
        listed = listed.unionByName(books.select(F.col("medoid_page_id").alias("id"), F.lit(0).alias("_late"), F.lit(0.0).alias("_s"), F.col("medoid_v").alias("v")))
    listed = listed.groupBy("id").agg(F.min(F.struct("_late", "_s")).alias("pos"), F.first("v").alias("v"))
    probe = contrast.probe(listed, query, protected)
    hops = policy.subgraph_bounds(mass if mass is not None else hot.count())[1]
    nodes, edges = graph.bfs(neighbors, found.select("id"), hops)
    return Retrieval(found.select("id", "score"), probe, nodes, graph.greedy_path(nodes, edges))


def record_hits(activity: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Activity with one more hit for each page found, and its last query now."""
    old = activity.join(hits.select(F.col("id").alias("page_id")).distinct(), "page_id", "left_semi")
    fresh = hits.select(F.col("id").alias("page_id")).distinct().join(old, "page_id", "left").select("page_id", (F.coalesce("query_hit_count", F.lit(0)) + 1).alias("query_hit_count"), now.alias("last_query_at"), "community_id", F.lit(1).alias("_seq"))
    return upsert(activity.withColumn("_seq", F.lit(0)).unionByName(fresh), ["page_id"], "_seq").drop("_seq")
