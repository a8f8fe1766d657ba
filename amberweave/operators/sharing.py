"""Privacy-filtered sharing: eligibility, export, validation, import, exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import eligibility, text_id
from .graph import expand_seeds

#: Columns of a page that stay at home.
PRIVATE = ("creator_pub_key", "signature")


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, status, reason) of each page (page_id, content)."""
    own = pages.select("page_id", eligibility(F.col("content")).alias("reason"))
    return own.select("page_id", F.when(F.col("reason").isNull(), "eligible").otherwise("blocked").alias("status"), "reason")


def eligible(pages: DataFrame) -> DataFrame:
    return pages.where(eligibility(F.col("content")).isNull())


def export_slice(pages: DataFrame, neighbors: DataFrame, edges: DataFrame, seeds: DataFrame, source: str, max_hops: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Eligible pages around the seeds, stripped of identity and tagged with ``source``, and edges between them."""
    visited, inner = expand_seeds(neighbors, edges, seeds, max_hops, max_nodes)
    nodes = eligible(pages.join(visited.select(F.col("id").alias("page_id"), "place"), "page_id"))
    stripped = [F.lit("").alias(c) if c in PRIVATE else F.col(c) for c in nodes.columns]
    nodes = nodes.select(*stripped, F.lit(source).alias("provenance"))
    ids = nodes.select("page_id")
    kept = inner.join(ids.select(F.col("page_id").alias("from_page_id")), "from_page_id", "left_semi").join(ids.select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_semi")
    return nodes, kept


def slice_message(nodes: DataFrame, edges: DataFrame, source: str, timestamp: str) -> DataFrame:
    """A slice as one row for a JSON sink; none when nothing is eligible. A slice is bounded by its node cap."""
    n = nodes.agg(F.collect_list(F.struct(*nodes.columns)).alias("nodes"), F.map_from_entries(F.collect_list(F.struct("page_id", F.lit(source)))).alias("provenance")).where(F.size("nodes") > 0)
    e = edges.agg(F.collect_list(F.struct(*edges.columns)).alias("edges"))
    return n.join(F.broadcast(e)).select(F.expr("uuid()").alias("slice_id"), "nodes", "edges", "provenance", F.create_map().cast("map<string,string>").alias("signatures"), F.lit(timestamp).alias("timestamp"))


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages with an id, content, hashes and a positive dimension."""
    return pages.where("page_id is not null and page_id != '' and content is not null and content_hash is not null and embedding_dim > 0")


def valid_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends and a finite weight that is not negative."""
    return edges.where("from_page_id is not null and from_page_id != '' and to_page_id is not null and to_page_id != '' and weight >= 0 and not isnan(weight) and weight < double('Infinity')")


def import_slice(nodes: DataFrame, edges: DataFrame, verify_hashes: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, edges, rejects): valid pages without identity and with dimension 0, valid edges between them.

    With ``verify_hashes`` a page's content must give its id and content hash.
    """
    good = valid_pages(nodes)
    if verify_hashes:
        good = good.where((text_id(F.col("content")) == F.col("page_id")) & (F.col("content_hash") == F.col("page_id")))
    rejects = nodes.select("page_id").exceptAll(good.select("page_id"))
    own = good.select(*[F.lit("").alias(c) if c in PRIVATE else F.lit(0).alias(c) if c in ("embedding_dim", "embedding_offset") else F.col(c) for c in nodes.columns])
    ids = own.select("page_id").distinct()
    kept = valid_edges(edges).join(ids.select(F.col("page_id").alias("from_page_id")), "from_page_id", "left_semi").join(ids.select(F.col("page_id").alias("to_page_id")), "to_page_id", "left_semi")
    return own, kept, rejects
