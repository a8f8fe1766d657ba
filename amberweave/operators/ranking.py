"""Top-k ranking of pages, books, volumes and shelves, beam routing, hot and warm merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, doubles


def score(table: DataFrame, query: list[float], ident: str, vec: str) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return table.select(F.col(ident).alias("id"), F.round(cosine(doubles(F.col(vec)), q), 6).alias("score"))


def pick(scored: DataFrame, k: int) -> DataFrame:
    """Best k by score, ties by id."""
    return scored.orderBy(F.desc("score"), "id").limit(k)


def rank_pages(pages: DataFrame, query: list[float], k: int, candidates: DataFrame | None = None) -> DataFrame:
    """Best pages by cosine; of the candidates (id) only, if given. Unknown ids are left out."""
    own = pages if candidates is None else pages.join(candidates.select(F.col("id").alias("page_id")).distinct(), "page_id", "left_semi")
    return pick(score(own, query, "page_id", "v"), k)


def rank_books(books: DataFrame, query: list[float], k: int) -> DataFrame:
    """Books (book_id, medoid_v) by the vector of their medoid page."""
    return pick(score(books, query, "book_id", "medoid_v"), k)


def score_prototypes(table: DataFrame, query: list[float], ident: str, prototypes: str) -> DataFrame:
    """Volumes or shelves by their first prototype; those without one score 0."""
    first = F.coalesce(F.get(prototypes, F.lit(0)), F.array().cast("array<double>"))
    return score(table.select(ident, first.alias("p")), query, ident, "p")


def rank_by_prototype(table: DataFrame, query: list[float], k: int, ident: str, prototypes: str) -> DataFrame:
    return pick(score_prototypes(table, query, ident, prototypes), k)


def beam_width(n: int) -> int:
    return max(2, -(-n // 2))


def beam_route(shelves: DataFrame, volumes: DataFrame, books: DataFrame, pages: DataFrame, shelf_volumes: DataFrame, volume_books: DataFrame, book_pages: DataFrame, query: list[float], k: int, hot: DataFrame | None = None) -> DataFrame:
    """Shelf, volume, book, page: at each level the better half (at least two) opens its children.

    With ``hot`` (entity_id, tier) routing starts from the resident shelves only, and each further level is its
    residents and the children opened above; else all shelves compete. What competes at a level is counted, then its best
    half is taken.
    """

    def half(scored: DataFrame) -> DataFrame:
        return pick(scored, beam_width(scored.count())).select("id")

    def level(table: DataFrame, ident: str, tier: str, opened: DataFrame | None) -> DataFrame:
        if hot is None and opened is None:
            return table
        wanted = opened
        if hot is not None:
            own = hot.where(F.col("tier") == tier).select(F.col("entity_id").alias(ident))
            wanted = own if opened is None else opened.unionByName(own)
        return table.join(wanted.distinct(), ident, "left_semi")

    s = half(score_prototypes(level(shelves, "shelf_id", "shelf", None), query, "shelf_id", "prototypes"))
    v = shelf_volumes.join(s.select(F.col("id").alias("shelf_id")), "shelf_id").select("volume_id")
    v = half(score_prototypes(level(volumes, "volume_id", "volume", v), query, "volume_id", "prototypes"))
    b = volume_books.join(v.select(F.col("id").alias("volume_id")), "volume_id").select("book_id")
    b = half(score(level(books, "book_id", "book", b), query, "book_id", "medoid_v"))
    p = book_pages.join(b.select(F.col("id").alias("book_id")), "book_id").select("page_id")
    return pick(score(level(pages, "page_id", "page", p), query, "page_id", "v"), k)


def merge_hot_warm(hot: DataFrame, warm: DataFrame, k: int) -> DataFrame:
    """Hot results; where they are fewer than k, unseen warm ones fill up, and all are ranked again."""
    short = hot.agg((F.count("*") < k).alias("_short"))  # one row
    fill = warm.join(hot.select("id"), "id", "left_anti").join(F.broadcast(short), F.col("_short"), "inner").select("id", "score")
    return pick(hot.select("id", "score").unionByName(fill), k)
