"""Documents to pages: chunk, identify, embed, link, start activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions import text as tx
from ..operators import hierarchy as h
from ..operators import neighbors as nb
from ..operators.store import vector_offsets
from ..sources import tables
from .crypto import vector_id


def pages_of(docs: DataFrame, budget: int, now: Column, dim: int = 64, embed=None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: doc, pos, page_id, content, content_hash, prev and next page, embedding, created_at.

    The id is the digest of the content. ``embed`` maps the content column to a vector column; by default the
    deterministic hash embedding. Empty texts give no pages.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.posexplode(tx.chunks(F.coalesce(F.col(text), F.lit("")), budget)).alias("pos", "content"))
    rows = rows.withColumn("page_id", tx.text_id(F.col("content")))
    w = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("prev_page_id", F.lag("page_id").over(w)).withColumn("next_page_id", F.lead("page_id").over(w))
    vec = (embed or (lambda c: tx.hash_embedding(c, dim)))(F.col("content"))
    return rows.select("doc", "pos", "page_id", "content", F.col("page_id").alias("content_hash"), "prev_page_id", "next_page_id", vec.alias("v"), now.alias("created_at"))


def checked(pages: DataFrame, dim: int) -> DataFrame:
    """Pages whose vectors have the model's dimension; any other fails the job."""
    return pages.withColumn("v", F.when(F.assert_true(F.size("v") == dim, F.lit("vector of another dimension")).isNull(), F.col("v")))


def start_activity(pages: DataFrame) -> DataFrame:
    """Activity rows of new pages: no hits, last query when they were made."""
    return pages.select("page_id", F.lit(0).cast("long").alias("query_hit_count"), F.col("created_at").alias("last_query_at"), F.lit(None).cast("string").alias("community_id")).dropDuplicates(["page_id"])


def build_pages(pages: DataFrame, dim: int, creator: str = "") -> DataFrame:
    """Stored pages of the rows ``pages_of`` gives: place and length of the vector, its digest, creator; not signed yet.

    Vectors are appended in document and chunk order. A row of another dimension fails the job. Signing takes the private key,
    which stays on the driver: see ``crypto.sign`` over ``text.canonical_page``.
    """
    own = checked(pages, dim).withColumn("_seq", F.struct("doc", "pos"))
    rows = vector_offsets(own, "_seq", "v").withColumn("vector_hash", vector_id(F.col("v")))
    return rows.select("doc", "pos", "page_id", "content", F.col("offset").alias("embedding_offset"), F.lit(dim).alias("embedding_dim"), "content_hash", "vector_hash", "prev_page_id", "next_page_id", F.lit(creator).alias("creator_pub_key"), F.lit("").alias("signature"), "created_at", "v")


def ingest(docs: DataFrame, budget: int, now: Column, dim: int = 64, embed=None, stored: DataFrame | None = None, neighbors: DataFrame | None = None, creator: str = "", doc: str = "doc_id", text: str = "text", max_distance: float = nb.MAX_DISTANCE) -> dict[str, DataFrame]:
    """Documents to every table of the store: pages, activity, books, volumes, shelves, memberships, adjacency, neighbours, flags.

    ``stored`` (page_id, v) are the pages that are there already and ``neighbors`` (page_id, neighbor_id, similarity) their
    lists; new pages are compared with both and cut to the degree that the number of all pages allows.
    Volumes of new pages are flagged for recalculation. A page that comes twice is stored once in the tables keyed by page.
    """
    rows = pages_of(docs, budget, now, dim, embed, doc, text)
    pages = build_pages(rows, dim, creator)
    books = h.books(rows, "doc", "pos")
    volumes = h.volumes(books)
    shelves = h.shelves(volumes)
    new = rows.select(F.col("page_id").alias("id"), "v").dropDuplicates(["id"])
    every = new if stored is None else new.unionByName(stored.select(F.col("page_id").alias("id"), "v").join(new.select("id"), "id", "left_anti"))
    degree = policy.neighbor_degree(every.count())
    found = nb.forward(every, new, degree, max_distance)
    held = neighbors if neighbors is not None else docs.sparkSession.createDataFrame([], "page_id string, neighbor_id string, similarity double")
    out = {
        "pages": pages, "page_activity": start_activity(rows), "books": books,
        "volumes": volumes.withColumn("prototypes", F.array("prototype")), "shelves": shelves.withColumn("prototypes", F.array("prototype")),
        "book_pages": books.select("book_id", F.explode("page_ids").alias("page_id")), "volume_books": volumes.select("volume_id", F.explode("book_ids").alias("book_id")),
        "shelf_volumes": shelves.select("shelf_id", F.explode("volume_ids").alias("volume_id")), "adjacency": h.adjacency(rows, "doc", "pos"),
        "neighbors": nb.merge(held, found, degree).withColumn("distance", F.round(1 - F.col("similarity"), 6)),
    }
    dirty = nb.dirty_volumes(new.select(F.col("id").alias("page_id")), out["book_pages"], out["volume_books"])
    return out | {"flags": dirty.withColumn("needs_recalc", F.lit(True))}


def store(made: dict[str, DataFrame], folder: str) -> None:
    """Write each table as Parquet under its name."""
    for name, df in made.items():
        tables.write(df, folder, name)
