"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, lookup


def exact_duplicates(docs: DataFrame, prefix: int = 64, digest_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts (A-Z lower-cased; null counts as empty); the largest id stays.

    Lengths that occur once are settled by one narrow pass; of the rest, prefixes of
    ``prefix`` characters that occur once within their length; only texts left over
    are hashed whole. What is counted and joined at any size are lengths and prefix hashes. Texts meet the list of
    surviving (length, prefix) groups in a join: by broadcast while the list has a checked size, else shuffled.
    ``digest_all`` hashes the other texts too, for callers who report digests; then no text is shuffled at any size.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256 (null
    where it was not needed). Equal rows count one by one; rows that repeat the largest id
    are all kept. Null ids are counted and never chosen while another id is there; a
    group of null ids alone has a null keep_id and its rows have a null kept. Other columns are not looked at.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("len", F.octet_length("text"))
    lengths = scratch.put(base.groupBy("len").agg(F.count("*").alias("n")).where("n > 1").select("len"), "lengths")
    narrow = base.select("len", F.xxhash64(ascii_lower(F.substring("text", 1, prefix))).alias("head"))
    heads = narrow.join(lookup(lengths), "len", "left_semi").groupBy("len", "head").agg(F.count("*").alias("n"))
    heads = scratch.put(heads.where("n > 1").select("len", "head", F.lit(True).alias("again")), "heads")
    whole = base.withColumn("head", F.xxhash64(ascii_lower(F.substring("text", 1, prefix))))
    sha = F.sha2(ascii_lower(F.col("text")), 256)
    if digest_all:
        whole = whole.select("doc_id", "len", "head", sha.alias("text_sha256")).join(lookup(heads), ["len", "head"], "left")
    else:
        whole = whole.join(lookup(heads), ["len", "head"], "left").withColumn("text_sha256", F.when(F.col("again"), sha))
    whole = scratch.put(whole.select("doc_id", F.coalesce("again", F.lit(False)).alias("again"), "text_sha256"), "hashed")
    groups = whole.where("again").groupBy("text_sha256").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    out = whole.join(groups.withColumnRenamed("text_sha256", "sha"), F.col("again") & (F.col("text_sha256") == F.col("sha")), "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("doc_id") == keep).alias("kept"), "text_sha256")
