"""Books, volumes, shelves, splits, membership, neighbour graph upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..operators import hierarchy as h
from ..operators import maintenance as m
from ..operators import neighbors as nb
from ..operators import store
from .common import BOOKS, DEGREE, E, NB, PG, SHELVES, VOLUMES, pages, query, read, tree, vectors


@query(f"WITH {BOOKS} SELECT doc, book_no, book_id, len(page_ids)::BIGINT AS n_pages, medoid_page_id FROM books")
def books(spark, d):
    b = h.books(pages(spark, d))
    return b.select("doc", F.col("book_no").cast("long").alias("book_no"), "book_id", F.size("page_ids").cast("long").alias("n_pages"), "medoid_page_id")


@query(f"""WITH {PG}, n AS (SELECT page_id, v, lead(page_id) OVER w AS n_id, lead(v) OVER w AS n_v FROM pg WINDOW w AS (PARTITION BY doc, pos // 8 ORDER BY pos)),
p AS (SELECT page_id, n_id AS neighbor_id, round(list_cosine_similarity(v, n_v), 6) AS similarity FROM n WHERE n_id IS NOT NULL)
SELECT page_id, neighbor_id, similarity FROM p UNION ALL SELECT neighbor_id, page_id, similarity FROM p""")
def adjacency(spark, d):
    return h.adjacency(pages(spark, d))


@query(f"WITH {VOLUMES} SELECT doc, volume_no, volume_id, len(book_ids)::BIGINT AS n_books, round(prototype[1], 6) AS p0, round(variance, 6) AS variance FROM volumes")
def volumes(spark, d):
    v = tree(spark, d)["volumes"]
    return v.select("doc", F.col("volume_no").cast("long").alias("volume_no"), "volume_id", F.size("book_ids").cast("long").alias("n_books"), F.round(F.col("prototype")[0], 6).alias("p0"), F.round("variance", 6).alias("variance"))


@query(f"WITH {SHELVES} SELECT doc, shelf_no, shelf_id, len(volume_ids)::BIGINT AS n_volumes, round(prototype[1], 6) AS p0 FROM shelves")
def shelves(spark, d):
    s = tree(spark, d)["shelves"]
    return s.select("doc", F.col("shelf_no").cast("long").alias("shelf_no"), "shelf_id", F.size("volume_ids").cast("long").alias("n_volumes"), F.round(F.col("prototype")[0], 6).alias("p0"))


LISTS = f"{E}, g AS (SELECT doc::VARCHAR AS parent_id, list(page_id ORDER BY vec_id) AS ids FROM e GROUP BY ALL)"


def _wide(spark, d, limit, salt, keep):
    g = vectors(spark, d).groupBy(F.col("doc").cast("string").alias("volume_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "page_id"))), lambda s: s["page_id"]).alias("ids"))
    out = h.split_wide(g, "volume_id", "ids", limit, salt, keep)
    return out.select("parent_id", F.col("part").cast("long").alias("part"), "volume_id", F.size("ids").cast("long").alias("n"))


@query(f"WITH {LISTS} SELECT parent_id, part, sha256('split-vol:' || array_to_string(list_sort(ids[part * 10 + 1:part * 10 + 10]), '|')) AS volume_id, len(ids[part * 10 + 1:part * 10 + 10])::BIGINT AS n FROM g, LATERAL (SELECT unnest(range(0, (len(ids) + 9) // 10)) AS part)")
def volume_split(spark, d):
    return _wide(spark, d, 10, "split-vol:", False)


@query(f"WITH {LISTS} SELECT parent_id, part, CASE WHEN part = 0 THEN parent_id ELSE sha256('split-shelf:' || array_to_string(list_sort(ids[part * 10 + 1:part * 10 + 10]), '|')) END AS volume_id, len(ids[part * 10 + 1:part * 10 + 10])::BIGINT AS n FROM g, LATERAL (SELECT unnest(range(0, (len(ids) + 9) // 10)) AS part)")
def shelf_split(spark, d):
    return _wide(spark, d, 10, "split-shelf:", True)


@query(f"WITH {SHELVES} SELECT p.page_id, b.book_id, v.volume_id, s.shelf_id FROM (SELECT book_id, unnest(page_ids) AS page_id FROM books) p JOIN books b USING (book_id) JOIN (SELECT volume_id, unnest(book_ids) AS book_id FROM volumes) v USING (book_id) JOIN (SELECT shelf_id, unnest(volume_ids) AS volume_id FROM shelves) s USING (volume_id)")
def reverse_lookup(spark, d):
    t = tree(spark, d)
    return t["book_pages"].join(t["volume_books"], "book_id").join(t["shelf_volumes"], "volume_id").select("page_id", "book_id", "volume_id", "shelf_id")


@query("SELECT vec_id, coalesce(sum(4 * len(embedding)) OVER (ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM embeddings")
def vector_offsets(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "embedding")
    return store.vector_offsets(e, "vec_id", "embedding").select("vec_id", F.col("offset").alias("byte_offset"))


def _forward(spark, d):
    v = vectors(spark, d).select("id", "v")
    return nb.forward(v, v, policy.neighbor_degree(v.count()), 0.7)


@query(f"WITH {NB} SELECT page_id, neighbor_id, similarity, distance, rank FROM fwd")
def neighbors_forward(spark, d):
    return _forward(spark, d).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {NB}, m AS (SELECT page_id, neighbor_id, similarity FROM fwd UNION SELECT neighbor_id, page_id, similarity FROM fwd)
SELECT page_id, neighbor_id, similarity, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, neighbor_id) AS rank FROM m QUALIFY rank <= {DEGREE}""")
def neighbors_merged(spark, d):
    none = spark.createDataFrame([], "page_id long, neighbor_id long, similarity double")
    return nb.merge(none, _forward(spark, d), policy.neighbor_degree(vectors(spark, d).count())).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {VOLUMES} SELECT DISTINCT volume_id FROM e JOIN (SELECT book_id, unnest(page_ids) AS page_id FROM books) USING (page_id) JOIN (SELECT volume_id, unnest(book_ids) AS book_id FROM volumes) USING (book_id) WHERE vec_id % 20 = 0")
def dirty_volumes(spark, d):
    t = tree(spark, d)
    new = vectors(spark, d).where("vec_id % 20 = 0").select("page_id")
    return nb.dirty_volumes(new, t["book_pages"], t["volume_books"])


@query(f"""WITH {VOLUMES}, vpg AS (SELECT volume_id, page_id, v FROM (SELECT volume_id, unnest(book_ids) AS book_id FROM volumes) JOIN (SELECT book_id, unnest(page_ids) AS page_id FROM books) USING (book_id) JOIN e USING (page_id)),
z AS (SELECT volume_id, sum(count(*) * (count(*) - 1)) OVER (ORDER BY volume_id) AS pairs FROM vpg GROUP BY volume_id),
run AS (SELECT volume_id FROM z WHERE pairs <= greatest(2048, (SELECT ceil(0.5 * sqrt(count(*) * log2(1 + count(*)))) FROM e)))
SELECT a.volume_id, a.page_id, b.page_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, round(1 - round(list_cosine_similarity(a.v, b.v), 6), 6) AS distance,
  row_number() OVER (PARTITION BY a.page_id ORDER BY round(list_cosine_similarity(a.v, b.v), 6) DESC, b.page_id) AS rank
FROM vpg a JOIN vpg b ON a.volume_id = b.volume_id AND a.page_id != b.page_id WHERE a.volume_id IN (SELECT volume_id FROM run) QUALIFY rank <= {DEGREE}""")
def neighbor_recalc(spark, d):
    t = tree(spark, d)
    vp = t["volume_books"].join(t["book_pages"], "book_id").join(t["pages"].select("page_id", "v"), "page_id")
    out = nb.recalc(vp, t["volumes"].select("volume_id"), vectors(spark, d).count())
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {VOLUMES}, m AS (SELECT volume_id, i, avg(v[i]) AS x FROM (SELECT volume_id, unnest(book_ids) AS book_id FROM volumes) JOIN (SELECT book_id, unnest(page_ids) AS page_id FROM books) USING (book_id) JOIN e USING (page_id), range(1, 65) r(i) GROUP BY ALL)
SELECT volume_id, i - 1 AS pos, round(x, 6) AS value FROM m""")
def prototype_recompute(spark, d):
    t = tree(spark, d)
    vp = t["volume_books"].join(t["book_pages"], "book_id").join(t["pages"].select("page_id", "v"), "page_id")
    p = m.recompute_volume_prototypes(vp).select("volume_id", F.posexplode("prototype").alias("pos", "x"))
    return p.select("volume_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


def _volumes(spark, d):
    return tree(spark, d)["volumes"].select("volume_id", "book_ids", "prototypes", F.lit(0.6).alias("variance"), (F.col("doc") * 1000 + F.col("volume_no")).alias("pos"))


@query(f"""WITH {VOLUMES}, h AS (SELECT volume_id AS parent_id, half, CASE WHEN half = 0 THEN book_ids[1:(len(book_ids) + 1) // 2] ELSE book_ids[(len(book_ids) + 1) // 2 + 1:] END AS ids FROM volumes, range(0, 2) t(half) WHERE len(book_ids) >= 2)
SELECT parent_id, half, sha256('split:' || array_to_string(ids, '|')) AS volume_id, len(ids)::BIGINT AS n_books, 0.3::DOUBLE AS variance FROM h""")
def volume_halves(spark, d):
    s = m.split_volumes(_volumes(spark, d))
    return s.select("parent_id", F.col("half").cast("long").alias("half"), "volume_id", F.size("book_ids").cast("long").alias("n_books"), "variance")


@query("""WITH v AS (SELECT o_custkey AS c, o_orderkey AS pos, 'o' || o_orderkey AS volume_id, list(DISTINCT l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS book_ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
s AS (SELECT * FROM v WHERE len(book_ids) < 2), n AS (SELECT s.volume_id AS small_id, v.volume_id, v.pos FROM s JOIN (SELECT volume_id, pos, unnest(book_ids) AS b FROM v) v ON v.b = s.book_ids[1] AND v.volume_id != s.volume_id)
SELECT small_id, arg_min(volume_id, pos) AS volume_id FROM n GROUP BY ALL""")
def volume_merge(spark, d):
    """Orders as volumes of the suppliers on their lines: those of one supplier merge with the first order that shares it."""
    lines = read(spark, d, "lineitem").join(read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    v = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))).alias("book_ids"))
    v = v.select(F.concat(F.lit("o"), "l_orderkey").alias("volume_id"), F.col("l_orderkey").alias("pos"), "book_ids", F.array().cast("array<array<double>>").alias("prototypes"), F.lit(0.1).alias("variance"))
    return m.merge_volumes(v).select("small_id", "volume_id")


@query(f"""WITH {VOLUMES}, pv AS (SELECT page_id, min(volume_id) AS vol FROM (SELECT volume_id, unnest(book_ids) AS book_id FROM volumes) JOIN (SELECT book_id, unnest(page_ids) AS page_id FROM books) USING (book_id) GROUP BY ALL)
SELECT e.page_id, coalesce(vol, e.doc::VARCHAR) AS community_id FROM e LEFT JOIN pv ON pv.page_id = e.page_id""")
def community_relabel(spark, d):
    t = tree(spark, d)
    activity = t["pages"].select("page_id", F.col("doc").cast("string").alias("community_id"))
    return m.relabel_communities(activity, t["volume_books"], t["book_pages"]).select("page_id", "community_id")


@query(f"WITH {SHELVES}, g AS (SELECT min(volume_id) AS g FROM volumes) SELECT volume_id, 'volumes' AS source FROM volumes, g WHERE volume_id != g UNION ALL SELECT volume_id, 'shelves' FROM (SELECT unnest(volume_ids) AS volume_id FROM shelves), g WHERE volume_id != g")
def cascade_delete(spark, d):
    t = tree(spark, d)
    gone = t["volumes"].agg(F.min("volume_id").alias("volume_id"))
    out = store.cascade_delete_volume(t["volumes"], t["shelf_volumes"], t["volume_books"], gone)
    return out["volumes"].select("volume_id", F.lit("volumes").alias("source")).unionByName(out["shelf_volumes"].select("volume_id", F.lit("shelves").alias("source")))


@query(f"""WITH {E}, s AS (SELECT a.page_id, b.page_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.page_id != b.page_id)
SELECT page_id, neighbor_id, similarity, round(1 - similarity, 6) AS distance, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, neighbor_id) AS rank FROM s WHERE similarity >= 0.3 QUALIFY rank <= {DEGREE}""")
def page_neighbors(spark, d):
    """The similarity graph by page id, as ingest makes it."""
    v = vectors(spark, d).select(F.col("page_id").alias("id"), "v")
    return nb.forward(v, v, policy.neighbor_degree(v.count()), 0.7).withColumn("rank", F.col("rank").cast("long"))
