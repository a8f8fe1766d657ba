"""Graph walks, communities and edge upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..functions.vectors import nearest
from ..operators import graph
from ..operators import maintenance as m
from ..operators import store
from ..streaming import activity as st
from .common import E, NB, PAIRS, asked, last_ship, part_edges, query, read, vectors
from .hierarchy import _forward

HOPS = 2
BFS = f"""{NB}, walk AS (SELECT vec_id AS id, 0 AS hop FROM e WHERE vec_id = 0 UNION SELECT neighbor_id, hop + 1 FROM walk JOIN fwd ON page_id = id WHERE hop < {HOPS}),
nodes AS (SELECT id, min(hop) AS hop FROM walk GROUP BY ALL),
ed AS (SELECT DISTINCT page_id AS from_id, neighbor_id AS to_id, distance FROM fwd JOIN nodes ON page_id = id WHERE hop < {HOPS})"""


def _walk(spark, d):
    v = vectors(spark, d)
    return graph.bfs(_forward(spark, d), v.where("id = 0").select("id"), HOPS)


@query(f"WITH RECURSIVE {BFS} SELECT id, hop::BIGINT AS hop FROM nodes")
def bfs_nodes(spark, d):
    return _walk(spark, d)[0].select("id", F.col("hop").cast("long").alias("hop"))


@query(f"WITH RECURSIVE {BFS} SELECT from_id, to_id, distance FROM ed")
def bfs_edges(spark, d):
    return _walk(spark, d)[1]


@query(f"""WITH RECURSIVE {BFS}, two AS (SELECT from_id AS x, to_id AS y, distance AS d, from_id AS f, to_id AS t FROM ed UNION ALL SELECT to_id, from_id, distance, from_id, to_id FROM ed),
adj AS (SELECT x, y, arg_max(d, [f, t]) AS d FROM two GROUP BY ALL),
path AS (SELECT 0 AS step, min(id) AS id, [min(id)] AS seen FROM nodes
  UNION ALL
  SELECT step + 1, arg_min(n.id, [coalesce(d, 'inf'::DOUBLE), n.id]), list_append(seen, arg_min(n.id, [coalesce(d, 'inf'::DOUBLE), n.id]))
  FROM path JOIN nodes n ON NOT list_contains(seen, n.id) LEFT JOIN adj ON x = path.id AND y = n.id GROUP BY step, path.id, seen)
SELECT step::BIGINT AS step, id FROM path""")
def greedy_path(spark, d):
    nodes, edges = _walk(spark, d)
    return graph.greedy_path(nodes, edges).select(F.col("step").cast("long").alias("step"), "id")


@query()
def label_propagation(spark, d):
    """Communities of the whole similarity graph (checked against a sequential model in the tests)."""
    return graph.label_propagation(_forward(spark, d)).select("page_id", "label")


LABELS = "l AS (SELECT doc_id AS page_id, lang AS label FROM documents)"


def _labels(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("label"))


@query(f"WITH {LABELS} SELECT label, count(*) AS n FROM l GROUP BY ALL HAVING count(*) > 0.5 * (SELECT count(*) FROM l)")
def oversized_communities(spark, d):
    return graph.oversized(_labels(spark, d))


@query("SELECT DISTINCT source AS label FROM documents WHERE source NOT IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def emptied_communities(spark, d):
    """Sources without a toxic document."""
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("label"))
    toxic = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return graph.emptied(docs, docs.join(toxic, "doc_id", "left_semi"))


#: Pairs traversed by the lines shipped in the last year.
HIT = "hit AS (SELECT DISTINCT from_page_id, to_page_id FROM edges WHERE last_updated_at >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY)"


@query(f"""WITH {PAIRS}, {HIT}, seeded AS (SELECT * FROM edges WHERE to_page_id % 3 != 0)
SELECT coalesce(from_page_id, f) AS from_page_id, coalesce(to_page_id, t) AS to_page_id, round(coalesce(weight, 0) + CASE WHEN f IS NOT NULL THEN 0.1 ELSE 0 END, 6)::DOUBLE AS weight
FROM seeded FULL JOIN (SELECT from_page_id AS f, to_page_id AS t FROM hit) h ON from_page_id = f AND to_page_id = t""")
def strengthen_edges(spark, d):
    """Edges to two thirds of the parts are stored; recent traversals strengthen or create edges."""
    e, now = part_edges(spark, d), last_ship(spark, d)
    hit = e.where(F.col("last_updated_at") >= now - F.expr("INTERVAL 365 DAYS"))
    return m.strengthen(e.where("to_page_id % 3 != 0"), hit, now).select("from_page_id", "to_page_id", F.round("weight", 6).alias("weight"))


@query(f"""WITH {PAIRS}, x AS (SELECT from_page_id, to_page_id, weight * 0.99 AS weight FROM edges WHERE weight * 0.99 >= 0.01)
SELECT from_page_id, to_page_id, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY from_page_id ORDER BY weight DESC, to_page_id) AS k FROM x) WHERE k <= (SELECT least(32, greatest(1, ceil(0.5 * sqrt(count(*) * log2(1 + count(*)))))) FROM part)""")
def decay_edges(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    return m.decay(part_edges(spark, d), policy.neighbor_degree(parts.count()), pages=parts).select("from_page_id", "to_page_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {PAIRS} SELECT from_page_id, to_page_id, weight, row_number() OVER (PARTITION BY from_page_id ORDER BY weight DESC, to_page_id) AS rank FROM edges QUALIFY rank <= 5")
def edge_topn(spark, d):
    e = store.strongest_edges(part_edges(spark, d), 5)
    return e.select("from_page_id", "to_page_id", "weight", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAIRS} SELECT from_page_id, to_page_id, weight FROM edges WHERE (from_page_id, to_page_id) NOT IN (SELECT (from_page_id, to_page_id) FROM edges WHERE weight < 0.15)")
def delete_edges(spark, d):
    e = part_edges(spark, d)
    return store.delete_keys(e, e.where("weight < 0.15"), ["from_page_id", "to_page_id"]).select("from_page_id", "to_page_id", "weight")


@query(f"""WITH {E}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0),
k AS (SELECT query_id, id FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)
SELECT query_id AS from_page_id, id AS to_page_id, 0.1::DOUBLE AS weight FROM k WHERE query_id != id""")
def replay(spark, d):
    """Replay of every source page whose id is divisible by 20, into an empty edge table."""
    none = spark.createDataFrame([], "from_page_id long, to_page_id long, weight double, last_updated_at timestamp")
    return m.replay(vectors(spark, d), asked(spark, d), none, last_ship(spark, d)).select("from_page_id", "to_page_id", "weight")


@query("SELECT user_id AS page_id, count(*) AS query_hit_count, max(ts) AS last_query_at FROM events GROUP BY ALL")
def stream_activity(spark, d):
    return st.run_available(st.activity(st.read_events(spark, d)), "stream_activity")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY ALL")
def upsert_latest(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_type", "event_id", F.col("event_id").alias("seq"))
    return store.upsert(rows, ["user_id"], "seq").select("user_id", "event_type", "event_id")


@query(f"WITH {NB}, n AS (SELECT page_id, neighbor_id, rank, row_number() OVER () AS r FROM fwd) SELECT page_id AS query_id, neighbor_id AS id, rank FROM n WHERE page_id % 20 = 0 AND rank <= 3")
def neighbor_lists(spark, d):
    return nearest(vectors(spark, d), asked(spark, d), 3, 0.3, skip_self=True).select("query_id", "id", F.col("rank").cast("long").alias("rank"))
