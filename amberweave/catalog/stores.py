"""Scans, lookups and the smaller store operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy
from ..functions.backend import VectorBackend
from ..functions.text import set_id
from ..operators import hotset, maintenance, store
from .common import ACT, E, SHELVES, VOLUMES, first_vector, last_ship, part_activity, query, read, tree, vectors
from .policies import BOOT, _hot, _salience


@query("SELECT vec_id, label, len(embedding)::BIGINT AS dim FROM embeddings")
def full_scan(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 7")
def point_lookup(spark, d):
    return store.get(read(spark, d, "documents"), "doc_id", 7).select("doc_id", "lang", "source", "n_chars")


@query("SELECT e.vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id")
def read_vectors(spark, d):
    """Vectors of the pages that are labelled."""
    wanted = read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), F.col("doc_id").alias("pos"))
    return store.multi_get(vectors(spark, d).select("vec_id", "v"), "vec_id", wanted).select("vec_id", F.round(F.col("v")[0], 6).alias("first"))


@query(f"WITH {BOOT} SELECT tier, count(*) AS residents FROM hot GROUP BY ALL")
def resident_count(spark, d):
    return _hot(spark, d).groupBy("tier").agg(F.count("*").alias("residents"))


@query(f"WITH {BOOT} SELECT entity_id, salience FROM hot WHERE tier = 'page'")
def tier_entries(spark, d):
    return store.tier_entries(_hot(spark, d), "page").select("entity_id", "salience")


@query(f"WITH {BOOT} SELECT page_id, salience > (SELECT min(salience) FROM hot) AS promote FROM sal")
def should_promote(spark, d):
    weakest = F.broadcast(_hot(spark, d).agg(F.min("salience").alias("w")))  # one row
    return _salience(spark, d).join(weakest).select("page_id", hotset.should_promote(F.col("salience"), F.col("w"), F.lit(0)).alias("promote"))


@query(f"WITH {ACT} SELECT page_id, round(exp(-ln(2) * greatest(0, epoch(ts) - epoch(last_query_at)) / 604800), 6) AS recency FROM act, now")
def recency(spark, d):
    return part_activity(spark, d).select("page_id", F.round(policy.recency_col(F.col("last_query_at"), last_ship(spark, d)), 6).alias("recency"))


@query(f"WITH {E} SELECT doc, sha256('merge:' || array_to_string(list_sort(list(page_id)), '|')) AS set_id FROM e GROUP BY doc")
def set_ids(spark, d):
    return vectors(spark, d).groupBy("doc").agg(F.collect_list("page_id").alias("ids")).select("doc", set_id(F.col("ids"), "merge:").alias("set_id"))


@query(f"""WITH {SHELVES}, m AS (SELECT shelf_id, i, avg(p[i]) AS x FROM (SELECT shelf_id, unnest(volume_ids) AS volume_id FROM shelves) JOIN (SELECT volume_id, prototype AS p FROM volumes) USING (volume_id), range(1, 65) r(i) GROUP BY ALL)
SELECT shelf_id, i - 1 AS pos, round(x, 6) AS value FROM m""")
def shelf_prototypes(spark, d):
    t = tree(spark, d)
    p = maintenance.recompute_shelf_prototypes(t["shelf_volumes"], t["volumes"]).select("shelf_id", F.posexplode("prototype").alias("pos", "x"))
    return p.select("shelf_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query(f"""WITH {SHELVES}, u AS (SELECT shelf_id, unnest(volume_ids) AS v, generate_subscripts(volume_ids, 1) AS i FROM shelves), w AS (SELECT volume_id FROM volumes WHERE len(book_ids) >= 4)
SELECT shelf_id, array_to_string(list(CASE WHEN v IN (FROM w) THEN v || '-a|' || v || '-b' ELSE v END ORDER BY (v IN (FROM w)), CASE WHEN v IN (FROM w) THEN v END, i), '|') AS volume_ids FROM u GROUP BY shelf_id""")
def shelf_replacement(spark, d):
    """Volumes of four books give way to two successors each, at the end of their shelves."""
    t = tree(spark, d)
    gone = t["volumes"].where(F.size("book_ids") >= 4).select(F.col("volume_id").alias("old_id"), F.array(F.concat("volume_id", F.lit("-a")), F.concat("volume_id", F.lit("-b"))).alias("new_ids"))
    out = maintenance.replace_in_shelves(t["shelves"].select("shelf_id", "volume_ids"), gone)
    return out.select("shelf_id", F.array_join("volume_ids", "|").alias("volume_ids"))


@query(f"WITH {VOLUMES} SELECT volume_id, 2::BIGINT AS n_prototypes FROM volumes")
def append_prototype(spark, d):
    t = tree(spark, d)
    vp = t["volume_books"].join(t["book_pages"], "book_id").join(t["pages"].select("page_id", "v"), "page_id")
    out = maintenance.append_prototype(t["volumes"].select("volume_id", "prototypes"), maintenance.recompute_volume_prototypes(vp), "volume_id")
    return out.select("volume_id", F.size("prototypes").cast("long").alias("n_prototypes"))


@query(f"WITH {E} SELECT a.vec_id AS id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a, (SELECT v FROM e WHERE vec_id = 0) b")
def backend_dot(spark, d):
    """The Catalyst engine of the kernel that dot_many runs in numpy."""
    return VectorBackend("catalyst").dot_many(vectors(spark, d).select("id", "v"), first_vector(spark, d))
