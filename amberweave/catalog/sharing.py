"""Seed expansion, export, import and store operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import text_id
from ..operators import graph, sharing, store
from ..plans import models
from .common import NB, PAIRS, asked, part_edges, query, read, vectors
from .hierarchy import _forward
from .texts import _case

#: Seeds are the first vectors of the query set, as a query's best results are few; two hops, at most 50 pages in visit order.
MAX_NODES, SEEDS = 50, 60
EXPAND = f"""{NB}, s0 AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM e WHERE vec_id % 20 = 0 AND vec_id < {SEEDS}),
c1 AS (SELECT neighbor_id AS id, min([place, rank]) AS o FROM fwd JOIN s0 ON page_id = s0.id WHERE neighbor_id NOT IN (SELECT id FROM s0) GROUP BY ALL),
s1 AS (SELECT id, (SELECT count(*) FROM s0) + row_number() OVER (ORDER BY o) - 1 AS place FROM c1 QUALIFY place < {MAX_NODES}),
v1 AS (FROM s0 UNION ALL FROM s1),
c2 AS (SELECT neighbor_id AS id, min([place, rank]) AS o FROM fwd JOIN s1 ON page_id = s1.id WHERE neighbor_id NOT IN (SELECT id FROM v1) GROUP BY ALL),
s2 AS (SELECT id, (SELECT count(*) FROM v1) + row_number() OVER (ORDER BY o) - 1 AS place FROM c2 QUALIFY place < {MAX_NODES}),
visited AS (FROM v1 UNION ALL FROM s2)"""


def _seeds(spark, d):
    from pyspark.sql import Window

    return asked(spark, d).where(F.col("id") < SEEDS).select("id", (F.row_number().over(Window.orderBy("id")) - 1).alias("pos"))  # a few seeds


def _similar_edges(spark, d):
    return _forward(spark, d).select(F.col("page_id").alias("from_page_id"), F.col("neighbor_id").alias("to_page_id"), F.col("similarity").alias("weight"))


@query(f"WITH {EXPAND} SELECT id, place FROM visited")
def expand_seeds(spark, d):
    return graph.expand_seeds(_forward(spark, d), _similar_edges(spark, d), _seeds(spark, d), 2, MAX_NODES)[0].select("id", "place")


@query(f"""WITH {EXPAND}, ok AS (SELECT doc_id FROM documents WHERE ({_case()}) IS NULL), n AS (SELECT id, place FROM visited WHERE id IN (SELECT doc_id FROM ok))
SELECT 'node' AS kind, id AS a, NULL::BIGINT AS b FROM n UNION ALL SELECT 'edge', page_id, neighbor_id FROM fwd WHERE page_id IN (SELECT id FROM n) AND neighbor_id IN (SELECT id FROM n)""")
def export_slice(spark, d):
    """A page's text is the document of the same number; pages without one are not exported."""
    pages = vectors(spark, d).select(F.col("id").alias("page_id")).join(read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("text").alias("content")), "page_id")
    pages = pages.withColumn("creator_pub_key", F.lit("k")).withColumn("signature", F.lit("s"))
    nodes, edges = sharing.export_slice(pages, _forward(spark, d), _similar_edges(spark, d), _seeds(spark, d), "exchange-1", 2, MAX_NODES)
    return nodes.select(F.lit("node").alias("kind"), F.col("page_id").alias("a"), F.lit(None).cast("long").alias("b")).unionByName(edges.select(F.lit("edge").alias("kind"), F.col("from_page_id").alias("a"), F.col("to_page_id").alias("b")))


def _wire(spark, d):
    c = read(spark, d, "conversations").withColumn("id", text_id(F.col("text")))
    bad = F.col("turn") % 5 == 3  # a fifth of the pages come with a wrong hash
    return c.select(F.col("id").alias("page_id"), F.col("text").alias("content"), F.when(bad, "0").otherwise(F.col("id")).alias("content_hash"), F.lit(64).alias("embedding_dim"), F.lit("k").alias("creator_pub_key"), F.lit("s").alias("signature"), "conv_id", "turn")


@query("""SELECT sha256(text) AS page_id, conv_id, turn, 0 AS embedding_dim, '' AS creator_pub_key FROM conversations WHERE turn % 5 != 3""")
def import_validate(spark, d):
    none = spark.createDataFrame([], "from_page_id string, to_page_id string, weight double")
    own, _, _ = sharing.import_slice(_wire(spark, d), none, verify_hashes=True)
    return own.select("page_id", "conv_id", "turn", "embedding_dim", "creator_pub_key")


@query(f"WITH {PAIRS}, w AS (SELECT from_page_id::VARCHAR AS f, to_page_id::VARCHAR AS t, CASE WHEN to_page_id % 7 = 0 THEN -weight ELSE weight END AS weight FROM edges) SELECT f AS from_page_id, t AS to_page_id, weight FROM w WHERE weight >= 0")
def valid_edges(spark, d):
    e = part_edges(spark, d).select(F.col("from_page_id").cast("string").alias("from_page_id"), F.col("to_page_id").cast("string").alias("to_page_id"), F.when(F.col("to_page_id") % 7 == 0, -F.col("weight")).otherwise(F.col("weight")).alias("weight"))
    return sharing.valid_edges(e)


@query("SELECT l.doc_id, d.lang, d.source FROM labels l JOIN documents d ON d.doc_id = l.doc_id + 100")
def multi_get(spark, d):
    """Documents wanted by a list of ids, in its order; ids that are not there are left out."""
    wanted = read(spark, d, "labels").select((F.col("doc_id") + 100).alias("doc_id"), F.col("doc_id").alias("pos"))
    return store.multi_get(read(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id", wanted).select(F.col("pos").alias("doc_id"), "lang", "source")


@query("SELECT source AS volume_id, bool_or(toxic = 1) AS needs_recalc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL HAVING needs_recalc IS NOT NULL UNION ALL SELECT source, false FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL HAVING bool_or(toxic = 1) IS NULL")
def dirty_flags(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("volume_id"))
    flags = docs.select("volume_id").distinct().withColumn("needs_recalc", F.lit(False))
    toxic = docs.join(read(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return store.set_flags(flags, toxic, F.lit(True))


@query("SELECT p_type AS model_id, coalesce(CASE WHEN p_size % 2 = 0 THEN p_size::BIGINT END, 768) AS dimension, 512::BIGINT AS context, p_partkey FROM part")
def resolve_profiles(spark, d):
    wanted = read(spark, d, "part").select(F.col("p_type").alias("model_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("long")).alias("dimension"), F.lit(None).cast("long").alias("context"), "p_partkey")
    registry = wanted.select("model_id").distinct().select("model_id", F.lit(768).cast("long").alias("dimension"), F.lit(512).cast("long").alias("context"))
    return models.resolve_profiles(wanted, registry)
