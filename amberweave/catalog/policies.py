"""Capacity, quotas, salience and the hot set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as p
from ..operators import hotset
from ..operators.store import evict_weakest as evict
from ..operators.store import weakest as least
from .common import ACT, SAL, last_ship, part_activity, part_edges, query, read, vectors

T = "t AS (SELECT c_custkey AS t FROM customer)"
CAP = "greatest(1, ceil(0.5 * sqrt(t * log2(1 + t))))::BIGINT"


def _masses(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("t"))


@query(f"WITH {T} SELECT t, {CAP} AS capacity FROM t")
def capacity_curve(spark, d):
    return _masses(spark, d).select("t", p.capacity_col(F.col("t")).alias("capacity"))


@query(f"WITH {T} SELECT t, least(32, {CAP}) AS degree FROM t")
def neighbor_degree(spark, d):
    return _masses(spark, d).select("t", p.neighbor_degree_col(F.col("t")).alias("degree"))


@query(f"""WITH {T}, b AS (SELECT t, CASE WHEN t < 2 THEN 1 ELSE least(30, greatest(1, floor(sqrt(t * log2(1 + t)) / log2(t)))) END::BIGINT AS size,
CASE WHEN t < 2 THEN 1 ELSE greatest(1, ceil(log2(log2(1 + t)))) END::BIGINT AS hops FROM t)
SELECT t, size, hops, CASE WHEN t < 2 THEN 1 ELSE greatest(1, floor(pow(size::DOUBLE, 1.0::DOUBLE / hops))) END::BIGINT AS branch FROM b""")
def subgraph_bounds(spark, d):
    size, hops, branch = p.subgraph_bounds_col(F.col("t"))
    return _masses(spark, d).select("t", size.alias("size"), hops.alias("hops"), branch.alias("branch"))


@query(f"WITH {T} SELECT t, greatest(1, ceil(0.5 * sqrt(greatest(2, t) * log2(1 + greatest(2, t)))))::BIGINT AS fanout FROM t")
def fanout_limit(spark, d):
    return _masses(spark, d).select("t", p.fanout_limit_col(F.col("t")).alias("fanout"))


@query(f"""WITH {T}, r AS (SELECT t, least(t, greatest(8, t // 8 // 8 * 8)) AS broad_dim, least(t, greatest(8, t // 4 // 8 * 8)) AS normal_dim, least(t, greatest(8, t // 2 // 8 * 8)) AS narrow_dim FROM t)
SELECT t, broad_dim, 0::BIGINT AS broad_offset, normal_dim, broad_dim * t AS normal_offset, narrow_dim, (broad_dim + normal_dim) * t AS narrow_offset FROM r""")
def routing_dims(spark, d):
    return _masses(spark, d).select("t", *[c.alias(n) for n, c in p.routing_dims_col(F.col("t")).items()])


@query(f"WITH {T}, a AS (SELECT t, greatest(256, floor(0.75 * t))::BIGINT AS truncation FROM t) SELECT t, truncation, least(2048, greatest(128, floor(0.25 * truncation)))::BIGINT AS chunk FROM a")
def chunk_limits(spark, d):
    cut, chunk = p.limits_col(F.col("t"))
    return _masses(spark, d).select("t", cut.alias("truncation"), chunk.alias("chunk"))


@query(f"""WITH {T}, c AS (SELECT DISTINCT {CAP} AS capacity FROM t), r(pos, tier, r) AS (VALUES (0, 'shelf', 0.1::DOUBLE), (1, 'volume', 0.2::DOUBLE), (2, 'book', 0.2::DOUBLE), (3, 'page', 0.5::DOUBLE)),
s AS (SELECT capacity, pos, tier, floor(r * capacity) AS f, r * capacity - floor(r * capacity) AS frac FROM c, r),
k AS (SELECT *, row_number() OVER (PARTITION BY capacity ORDER BY frac DESC, pos) AS k, capacity - sum(f) OVER (PARTITION BY capacity) AS rest FROM s)
SELECT capacity, tier, (f + CASE WHEN k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def tier_quotas(spark, d):
    return p.tier_quota_rows(_masses(spark, d).select(p.capacity_col(F.col("t")).alias("capacity")).distinct())


@query("""WITH s AS (SELECT label::VARCHAR AS community, count(*) AS size FROM embeddings GROUP BY ALL),
b AS (SELECT *, CASE WHEN 64 >= count(*) OVER () THEN 1 ELSE 0 END AS least, count(*) OVER () AS n, sum(size) OVER () AS total FROM s),
x AS (SELECT *, 64 - least * n AS rest, size / total * (64 - least * n) AS share FROM b),
k AS (SELECT *, floor(share) AS f, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, community) AS k, rest - sum(floor(share)) OVER () AS extra FROM x)
SELECT community, size, (least + f + CASE WHEN k <= extra THEN 1 ELSE 0 END)::BIGINT AS quota FROM k""")
def community_quotas(spark, d):
    sizes = vectors(spark, d).groupBy(F.col("doc").cast("string").alias("community")).agg(F.count("*").alias("size"))
    return p.community_quota_rows(sizes, 64)


def _salience(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    s = hotset.node_salience(parts, part_edges(spark, d), part_activity(spark, d), last_ship(spark, d))
    return s.select("page_id", F.round("salience", 6).alias("salience"), "community_id")


@query(f"WITH {SAL} SELECT page_id, salience, community_id FROM sal")
def salience_score(spark, d):
    return _salience(spark, d)


BOOT = f"""{SAL}, cap AS (SELECT greatest(1, ceil(0.5 * sqrt(count(*) * log2(1 + count(*)))))::BIGINT AS c FROM sal),
quota AS (SELECT least(c, (SELECT q FROM (SELECT tier, (f + CASE WHEN k <= rest THEN 1 ELSE 0 END) AS q FROM (SELECT tier, f, row_number() OVER (ORDER BY frac DESC, pos) AS k, c - sum(f) OVER () AS rest
  FROM (SELECT pos, tier, floor(r * c) AS f, r * c - floor(r * c) AS frac FROM cap, (VALUES (0, 'shelf', 0.1::DOUBLE), (1, 'volume', 0.2::DOUBLE), (2, 'book', 0.2::DOUBLE), (3, 'page', 0.5::DOUBLE)) r(pos, tier, r)))) WHERE tier = 'page')) AS q FROM cap),
hot AS (SELECT page_id AS entity_id, 'page' AS tier, salience, community_id FROM (SELECT *, row_number() OVER (ORDER BY salience DESC, page_id) AS k FROM sal), quota WHERE k <= q)"""


def _hot(spark, d):
    return hotset.bootstrap(_salience(spark, d))


@query(f"WITH {BOOT} SELECT entity_id, tier, salience, community_id FROM hot")
def bootstrap_hotset(spark, d):
    return _hot(spark, d)


@query(f"WITH {BOOT} SELECT entity_id, tier, salience, community_id FROM hot WHERE entity_id != (SELECT entity_id FROM hot ORDER BY salience, entity_id LIMIT 1)")
def evict_weakest(spark, d):
    return evict(_hot(spark, d), "page")


@query(f"WITH {BOOT} SELECT tier, community_id, arg_min(entity_id, [salience, entity_id]) AS entity_id, min(salience) AS salience FROM hot GROUP BY ALL")
def weakest_by_community(spark, d):
    return least(_hot(spark, d), ["tier", "community_id"])


@query(f"""WITH {BOOT}, s AS (SELECT coalesce(community_id, '__none__') AS community, count(*) AS size FROM hot GROUP BY ALL UNION ALL SELECT 'newcomer', 1)
SELECT community, max(size)::BIGINT AS size FROM s GROUP BY ALL""")
def community_distribution(spark, d):
    return hotset.community_distribution(_hot(spark, d), "newcomer")


@query()
def promotion_sweep(spark, d):
    """Residents as bootstrapped, then all other parts swept in."""
    s = _salience(spark, d)
    return hotset.promotion_sweep(_hot(spark, d), s.join(_hot(spark, d).select(F.col("entity_id").alias("page_id")), "page_id", "left_anti"))


@query(f"WITH {ACT} SELECT page_id, query_hit_count, last_query_at, community_id FROM act")
def page_activity(spark, d):
    return part_activity(spark, d)
