"""Vector kernels and vector math."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from .common import E, Q0, asked, first_vector, query, vectors


@query(f"WITH {E}, {Q0} SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS score FROM e, q ORDER BY score DESC, vec_id LIMIT 10")
def vec_topk(spark, d):
    v = vectors(spark, d)
    return vx.nearest(v, v.where("id = 0"), 10).select(F.col("id").alias("vec_id"), "score")


@query(f"WITH {E}, {Q0} SELECT vec_id, round(list_inner_product(v, w), 6) AS score FROM e, q")
def dot_many(spark, d):
    v = vectors(spark, d)
    return vx.nearest(v, v.where("id = 0"), None, kind="dot").select(F.col("id").alias("vec_id"), "score")


@query(f"""WITH {E}, s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_inner_product(a.v, b.v), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""")
def dot_batch(spark, d):
    return vx.nearest(vectors(spark, d), asked(spark, d), 10, kind="dot").select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {E} SELECT vec_id, r AS pos, round(list_sum(list_transform(range(0, 64), lambda c: v[c + 1] * ((r * 7 + c * 3) % 11 - 5) / 10)), 6) AS value FROM e, range(0, 8) t(r)""")
def project_dims(spark, d):
    rows = [[((r * 7 + c * 3) % 11 - 5) / 10 for c in range(64)] for r in range(8)]
    v = vectors(spark, d).select("vec_id", F.posexplode(vx.project(F.col("v"), vx.matrix(rows))).alias("pos", "x"))
    return v.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


def _planes(bits: int, dims: int):
    """Deterministic hyperplanes from a rule; folded to one literal by the optimizer."""
    return F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda c: ((b * 31 + c * 17) % 23 - 11).cast("double")))


CODE = f"""WITH {E}, bits AS (SELECT vec_id, b, CASE WHEN list_sum(list_transform(range(0, 64), lambda c: v[c + 1] * ((b * 31 + c * 17) % 23 - 11))) >= 0 THEN 1 ELSE 0 END AS bit FROM e, range(0, 64) t(b)),
code AS (SELECT vec_id, sum(CASE WHEN b < 32 THEN bit * 2::BIGINT ** b ELSE 0 END)::BIGINT AS w0, sum(CASE WHEN b >= 32 THEN bit * 2::BIGINT ** (b - 32) ELSE 0 END)::BIGINT AS w1 FROM bits GROUP BY ALL)"""


def _codes(spark, d):
    return vectors(spark, d).select("vec_id", vx.sign_bits(F.col("v"), _planes(64, 64), 64).alias("code"))


@query(CODE + " SELECT vec_id, w0, w1 FROM code")
def lsh_code(spark, d):
    return _codes(spark, d).select("vec_id", F.col("code")[0].alias("w0"), F.col("code")[1].alias("w1"))


@query(CODE + """ SELECT a.vec_id, (bit_count(xor(a.w0, b.w0)) + bit_count(xor(a.w1, b.w1)))::BIGINT AS distance FROM code a, (SELECT w0, w1 FROM code WHERE vec_id = 0) b ORDER BY distance, vec_id LIMIT 10""")
def hamming_topk(spark, d):
    c = _codes(spark, d)
    q = F.broadcast(c.where("vec_id = 0").select(F.col("code").alias("q")))  # one row
    return c.join(q).select("vec_id", vx.hamming(F.col("code"), F.col("q")).cast("long").alias("distance")).orderBy("distance", "vec_id").limit(10)


@query(f"WITH {E}, {Q0} SELECT vec_id, round(1 - round(list_cosine_similarity(v, w), 6), 6) AS distance FROM e, q ORDER BY distance, vec_id LIMIT 10")
def topk_distance(spark, d):
    q = F.array(*[F.lit(x) for x in first_vector(spark, d)])
    v = vectors(spark, d).select("vec_id", F.round(1 - F.round(vx.cosine(F.col("v"), q), 6), 6).alias("distance"))
    return v.orderBy("distance", "vec_id").limit(10)


@query(f"WITH {E} SELECT doc AS label, i - 1 AS pos, round(avg(v[i]), 6) AS value FROM e, range(1, 65) t(i) GROUP BY ALL")
def centroid_by_label(spark, d):
    c = vx.centroid(vectors(spark, d), ["doc"], "v")
    return c.select(F.col("doc").alias("label"), F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query(f"""WITH {E}, t AS (SELECT a.doc, a.vec_id, round(sum(1 - list_cosine_similarity(a.v, b.v)), 9) AS t FROM e a JOIN e b ON a.doc = b.doc GROUP BY ALL)
SELECT doc AS label, arg_min(vec_id, [t, vec_id]) AS medoid, round(min(t), 6) AS total, count(*) AS size FROM t GROUP BY ALL""")
def medoid_by_label(spark, d):
    v = vectors(spark, d).withColumn("pos", F.col("vec_id"))
    return vx.medoid(v, ["doc"], "vec_id", "v", "pos").select(F.col("doc").alias("label"), "medoid", "total", "size")


@query(f"""WITH {E}, m AS (SELECT doc, i, avg(v[i]) AS x FROM e, range(1, 65) t(i) GROUP BY ALL), c AS (SELECT doc, list(x ORDER BY i) AS c FROM m GROUP BY ALL)
SELECT e.doc AS label, round(avg((1 - list_cosine_similarity(v, c)) ** 2), 6) AS variance FROM e JOIN c ON e.doc = c.doc GROUP BY ALL""")
def cluster_variance(spark, d):
    v = vectors(spark, d)
    far = v.join(vx.centroid(v, ["doc"], "v"), "doc").withColumn("d", 1 - vx.cosine(F.col("v"), F.col("centroid")))
    return far.groupBy(F.col("doc").alias("label")).agg(F.round(F.avg(F.col("d") * F.col("d")), 6).alias("variance"))


@query(f"WITH {E}, {Q0} SELECT vec_id, round(list_cosine_similarity(v[1:32], w[1:32]), 6) AS score FROM e, q")
def prefix_cosine(spark, d):
    q = F.array(*[F.lit(x) for x in first_vector(spark, d)[:32]])
    return vectors(spark, d).select("vec_id", F.round(vx.cosine(vx.prefix(F.col("v"), 32), q), 6).alias("score"))


@query(f"WITH {E}, {Q0} SELECT vec_id, round(list_cosine_similarity(v[33:64], w[33:64]), 6) AS score FROM e, q")
def suffix_cosine(spark, d):
    q = F.array(*[F.lit(x) for x in first_vector(spark, d)[32:]])
    return vectors(spark, d).select("vec_id", F.round(vx.cosine(vx.suffix(F.col("v"), 32), q), 6).alias("score"))
