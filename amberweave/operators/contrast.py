"""Opposite-pole probe: best match, its counterpart in the free dimensions, and the synthesis vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot, doubles, norm, prefix, suffix


def probe(candidates: DataFrame, query: list[float], protected: int | None) -> DataFrame:
    """One row: thesis, antithesis, synthesis, knowledge_gap.

    ``candidates`` is (id, pos, v), a ranked list. The thesis is the candidate nearest to the query (first
    of equals). The antithesis is the medoid, in the dimensions after ``protected``, of the candidates
    that point away from the thesis there (or, where fewer than two do, of the half that points away
    most). The synthesis copies the protected dimensions and averages the others. With no candidates, no
    protected size or no second candidate there is a gap and no antithesis.
    """
    spark = candidates.sparkSession
    kind = candidates.schema["id"].dataType.simpleString()  # page ids are text, others numbers
    none = f"thesis {kind}, antithesis {kind}, synthesis array<double>, knowledge_gap boolean"
    q = F.array(*[F.lit(float(x)) for x in query])
    c = candidates.select("id", "pos", doubles(F.col("v")).alias("v"))
    thesis = c.groupBy().agg(F.min(F.struct((-F.round(cosine(F.col("v"), q), 9)).alias("s"), "pos", "id", "v")).alias("t")).where("t is not null").select("t.id", "t.v")
    if protected is None:
        return thesis.select(F.col("id").alias("thesis"), F.lit(None).cast(kind).alias("antithesis"), F.lit(None).cast("array<double>").alias("synthesis"), F.lit(True).alias("knowledge_gap"))
    t = F.broadcast(thesis.select(F.col("id").alias("t_id"), F.col("v").alias("t_v")))  # one row
    others = c.join(t, F.col("id") != F.col("t_id")).withColumn("f", suffix(F.col("v"), protected))
    others = others.withColumn("away", F.round(-cosine(F.col("f"), suffix(F.col("t_v"), protected)), 9))
    # Two counts decide which way the pole is cut; neither way gathers the list in one task's window.
    n, opposed = others.agg(F.count("*"), F.coalesce(F.sum((F.col("away") >= 0).cast("int")), F.lit(0))).first()
    if opposed >= 2:
        pole = others.where("away >= 0").withColumn("place", F.struct(F.lit(0.0).alias("away"), F.col("pos").alias("pos")))
    else:  # where the free set falls back to a ranked half its order is the ranking, else the list's
        pole = others.orderBy(F.desc("away"), "pos").limit(max(1, -(-n // 2))).withColumn("place", F.struct((-F.col("away")).alias("away"), F.col("pos").alias("pos")))
    pole = pole.withColumn("_n", norm(F.col("f"))).withColumn("u", F.transform("f", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)))
    total = pole.select(F.posexplode("u").alias("p", "x")).groupBy("p").agg(F.sum("x").alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("sum"))
    best = pole.join(F.broadcast(total)).agg(F.min(F.struct(F.round(-dot(F.col("u"), F.col("sum")), 9).alias("d"), "place", "id", "v", "t_id", "t_v")).alias("b")).where("b is not null").select("b.*")
    mixed = F.concat(prefix(F.col("t_v"), protected), F.zip_with(suffix(F.col("t_v"), protected), suffix(F.col("v"), protected), lambda a, b: (a + b) / 2))
    full = best.select(F.col("t_id").alias("thesis"), F.col("id").alias("antithesis"), mixed.alias("synthesis"), F.lit(False).alias("knowledge_gap"))
    gap = thesis.join(best.select("t_id"), F.col("id") == F.col("t_id"), "left_anti").select(F.col("id").alias("thesis"), F.lit(None).cast(kind).alias("antithesis"), F.lit(None).cast("array<double>").alias("synthesis"), F.lit(True).alias("knowledge_gap"))
    empty = spark.createDataFrame([(None, None, None, True)], none)
    some = thesis.agg(F.count("*").alias("_n"))
    return full.unionByName(gap).unionByName(empty.join(some, F.col("_n") == 0).drop("_n"))


def gap_probe(probes: DataFrame, text: str, detected_at: str) -> DataFrame:
    """Curiosity probe of each probe with a gap: probe_id is the digest of the query text and the time."""
    ident = F.sha2(F.concat(F.lit(text), F.lit(detected_at)), 256)
    return probes.where("knowledge_gap").select(ident.alias("probe_id"), F.coalesce(F.col("thesis").cast("string"), F.lit("")).alias("thesis"), F.lit(text).alias("query_text"), F.lit(detected_at).alias("detected_at"))
