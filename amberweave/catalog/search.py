"""Ranking, routing, the opposite-pole probe and hit recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contrast, ranking
from ..plans import retrieve
from .common import ACT, BOOKS, E, Q0, SHELVES, VOLUMES, first_vector, last_ship, part_activity, query, tree, vectors

TOP = "ORDER BY score DESC, id LIMIT 10"


def _pages(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("page_id"), "v", "doc")


@query(f"WITH {E}, {Q0} SELECT vec_id AS id, round(list_cosine_similarity(v, w), 6) AS score FROM e, q WHERE vec_id % 20 = 0 {TOP}")
def rank_pages(spark, d):
    p = _pages(spark, d)
    return ranking.rank_pages(p, first_vector(spark, d), 10, p.where("page_id % 20 = 0").select(F.col("page_id").alias("id")))


@query(f"WITH {BOOKS}, {Q0} SELECT book_id AS id, round(list_cosine_similarity(mv, w), 6) AS score FROM books, q {TOP}")
def rank_books(spark, d):
    return ranking.rank_books(tree(spark, d)["books"], first_vector(spark, d), 10)


@query(f"WITH {VOLUMES}, {Q0} SELECT volume_id AS id, round(list_cosine_similarity(prototype, w), 6) AS score FROM volumes, q {TOP}")
def rank_volumes(spark, d):
    return ranking.rank_by_prototype(tree(spark, d)["volumes"], first_vector(spark, d), 10, "volume_id", "prototypes")


@query(f"WITH {SHELVES}, {Q0} SELECT shelf_id AS id, round(list_cosine_similarity(prototype, w), 6) AS score FROM shelves, q {TOP}")
def rank_shelves(spark, d):
    return ranking.rank_by_prototype(tree(spark, d)["shelves"], first_vector(spark, d), 10, "shelf_id", "prototypes")


@query(f"WITH {E}, {Q0} SELECT vec_id AS id, round(list_cosine_similarity(v, w), 6) AS score FROM e, q {TOP}")
def warm_spill(spark, d):
    return ranking.rank_pages(_pages(spark, d), first_vector(spark, d), 10)


def _half(name: str, source: str, vec: str, ident: str) -> str:
    return f"{name} AS (SELECT {ident} FROM (SELECT {ident}, row_number() OVER (ORDER BY round(list_cosine_similarity({vec}, w), 6) DESC, {ident}) AS k, count(*) OVER () AS n FROM {source}, q) WHERE k <= greatest(2, ceil(n / 2)))"


@query(f"""WITH {SHELVES}, {Q0}, {_half("hs", "shelves", "prototype", "shelf_id")},
v1 AS (SELECT * FROM volumes WHERE volume_id IN (SELECT unnest(volume_ids) FROM shelves WHERE shelf_id IN (FROM hs))), {_half("hv", "v1", "prototype", "volume_id")},
b1 AS (SELECT * FROM books WHERE book_id IN (SELECT unnest(book_ids) FROM volumes WHERE volume_id IN (FROM hv))), {_half("hb", "b1", "mv", "book_id")}
SELECT page_id AS id, round(list_cosine_similarity(v, w), 6) AS score FROM e, q WHERE page_id IN (SELECT unnest(page_ids) FROM books WHERE book_id IN (FROM hb)) {TOP}""")
def beam_route(spark, d):
    t = tree(spark, d, written=True)
    return ranking.beam_route(t["shelves"], t["volumes"], t["books"], t["pages"], t["shelf_volumes"], t["volume_books"], t["book_pages"], first_vector(spark, d), 10)


@query(f"""WITH {SHELVES}, {Q0}, {_half("hs", "shelves", "prototype", "shelf_id")},
v1 AS (SELECT * FROM volumes WHERE volume_id IN (SELECT unnest(volume_ids) FROM shelves WHERE shelf_id IN (FROM hs))), {_half("hv", "v1", "prototype", "volume_id")},
b1 AS (SELECT * FROM books WHERE book_id IN (SELECT unnest(book_ids) FROM volumes WHERE volume_id IN (FROM hv))), {_half("hb", "b1", "mv", "book_id")}
SELECT page_id AS id, round(list_cosine_similarity(v, w), 6) AS score FROM e, q WHERE page_id IN (SELECT unnest(page_ids) FROM books WHERE book_id IN (FROM hb)) OR vec_id % 20 = 0 {TOP}""")
def retrieve_pages(spark, d):
    """The whole query by page ids: resident shelves open their children, resident pages join, the best ten are found."""
    t, v = tree(spark, d, written=True), vectors(spark, d)
    hot = t["shelves"].select(F.col("shelf_id").alias("entity_id"), F.lit("shelf").alias("tier")).unionByName(v.where("vec_id % 20 = 0").select(F.col("page_id").alias("entity_id"), F.lit("page").alias("tier")))
    none = spark.createDataFrame([], "page_id string, neighbor_id string, distance double")
    return retrieve.retrieve(v.select("page_id", "v"), hot, none, first_vector(spark, d), 10, 32, tree=t).pages


@query(f"""WITH {E}, {Q0}, s AS (SELECT vec_id AS id, doc, round(list_cosine_similarity(v, w), 6) AS score FROM e, q), hot AS (SELECT id, score FROM s WHERE doc = 3 ORDER BY score DESC, id LIMIT 4),
warm AS (SELECT id, score FROM s {TOP}) SELECT id, score FROM (FROM hot UNION ALL SELECT * FROM warm WHERE id NOT IN (SELECT id FROM hot)) {TOP}""")
def hot_warm_merge(spark, d):
    p, q = _pages(spark, d), first_vector(spark, d)
    return ranking.merge_hot_warm(ranking.rank_pages(p.where("doc = 3"), q, 4), ranking.rank_pages(p, q, 10), 10)


PROBE = f"""{E}, {Q0}, s AS (SELECT vec_id AS id, v, round(list_cosine_similarity(v, w), 9) AS s FROM e, q), t AS (SELECT id AS t_id, v AS t_v FROM s ORDER BY s DESC, id LIMIT 1),
o AS (SELECT id, v, t_id, t_v, v[33:64] AS f, round(-list_cosine_similarity(v[33:64], t_v[33:64]), 9) AS away FROM s, t WHERE id != t_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY away DESC, id) AS k, count(*) OVER () AS n, count(*) FILTER (away >= 0) OVER () AS opp FROM o)
  WHERE CASE WHEN opp >= 2 THEN away >= 0 ELSE k <= greatest(1, ceil(n / 2)) END),
d AS (SELECT a.id, a.v, a.t_id, a.t_v, CASE WHEN a.opp >= 2 THEN a.id ELSE a.k END AS place, round(sum(1 - list_cosine_similarity(a.f, b.f)), 9) AS t FROM p a, p b GROUP BY ALL),
b AS (SELECT * FROM d ORDER BY t, place LIMIT 1)"""


def _probe(spark, d):
    c = vectors(spark, d).select("id", F.col("id").alias("pos"), "v")
    return contrast.probe(c, first_vector(spark, d), 32)


@query(f"WITH {PROBE} SELECT t_id AS thesis, id AS antithesis, i - 1 AS pos, round(CASE WHEN i <= 32 THEN t_v[i] ELSE (t_v[i] + v[i]) / 2 END, 6) AS value, false AS knowledge_gap FROM b, range(1, 65) r(i)")
def contrast_probe(spark, d):
    p = _probe(spark, d).select("thesis", "antithesis", F.posexplode("synthesis").alias("pos", "x"), "knowledge_gap")
    return p.select("thesis", "antithesis", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"), "knowledge_gap")


@query("SELECT sha256('which memory is missing' || '2024-01-01T00:00:00.000Z') AS probe_id, '0' AS thesis, 'which memory is missing' AS query_text, '2024-01-01T00:00:00.000Z' AS detected_at")
def gap_probe(spark, d):
    c = vectors(spark, d).select("id", F.col("id").alias("pos"), "v")
    probe = contrast.probe(c, first_vector(spark, d), None)
    return contrast.gap_probe(probe, "which memory is missing", "2024-01-01T00:00:00.000Z")


@query(f"""WITH {ACT}, hit AS (SELECT page_id FROM act WHERE page_id % 20 = 0)
SELECT page_id, query_hit_count + CASE WHEN page_id IN (FROM hit) THEN 1 ELSE 0 END AS query_hit_count, CASE WHEN page_id IN (FROM hit) THEN ts ELSE last_query_at END AS last_query_at, community_id FROM act, now""")
def record_hits(spark, d):
    a = part_activity(spark, d)
    return retrieve.record_hits(a, a.where("page_id % 20 = 0").select(F.col("page_id").alias("id")), last_ship(spark, d))
