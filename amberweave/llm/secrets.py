"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by its content. Only pairs of blob and rule version
that the ledger does not hold are scanned, each once; findings join back to all paths.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, lookup
from .spans import add_matches, tagged

#: Changes whenever a rule below does.
RULES = "1"
#: The rules, with the least length of what they must catch.
ASSIGN = r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{32,}+"
PEM = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
HOST = r"gh[pousr]_[A-Za-z0-9]{36,}+"
BASE, ADDED = ["assign", "access", "hex"], ["pem", "jwt", "host"]
FINDINGS = "array<struct<kind:string,start:int,end:int>>"


def scan(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add a column for each rule with its matches (start, end, hit)."""
    has = lambda s: F.contains(F.col(text), F.lit(s))
    df = add_matches(texts, text, "assign", ASSIGN, lambda h: F.length(F.regexp_extract(h, ASSIGN, 1)) >= 8)
    df = add_matches(df, text, "access", ACCESS, lambda h: F.length(h) >= 16, has("AKIA"))
    df = add_matches(df, text, "hex", HEX)
    df = add_matches(df, text, "pem", PEM, None, has("-----BEGIN "))
    df = add_matches(df, text, "jwt", JWT, None, has("eyJ"))
    return add_matches(df, text, "host", HOST, None, has("gh") & has("_"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: str = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Findings of every version, and the ledger with what was scanned now.

    ``versions`` has one row per version of a path; null texts count as empty. ``ledger`` (blob,
    rules, findings) holds earlier scans; pairs of blob and rule version in it are not scanned. Returns
    (doc_id, blob, findings: array of kind, start, end by start and kind) with a row per input row,
    repeated and null ids included, and the new ledger. Texts are never shuffled while the
    list of repeated versions is of a checked size; beyond, it meets the texts in a shuffled join.
    """
    spark = versions.sparkSession
    scratch = Scratch(spark, "secrets")
    own = versions.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("blob", F.sha2("text", 256))
    if ledger is None:
        ledger = spark.createDataFrame([], f"blob string, rules string, findings {FINDINGS}")
    paths = scratch.put(own.select("doc_id", "blob"), "paths")
    known = ledger.where(F.col("rules") == rules).dropDuplicates(["blob"]).select("blob", "findings")
    firsts = paths.groupBy("blob").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    unseen = firsts.join(known.select("blob"), "blob", "left_anti")
    # Versions not to be scanned: their blob is in the ledger, or another version stands for it.
    again = firsts.where("n > 1").join(unseen, "blob", "left_semi")
    others = paths.join(again.select("blob", "first"), "blob").where("not (doc_id <=> first)").select("doc_id", "blob")
    others = others.unionByName(paths.join(known.select("blob"), "blob", "left_semi").select("doc_id", "blob")).distinct()
    others = lookup(scratch.put(others.select(F.col("doc_id").alias("d"), F.col("blob").alias("b")), "others"))
    todo = own.join(others, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("blob") == F.col("b")), "left_anti")
    found = scan(todo).select("blob", tagged([*BASE, *ADDED], "start").alias("findings")).where(F.size("findings") > 0)
    found = scratch.put(found.dropDuplicates(["blob"]), "found")
    all_found = found.unionByName(known.where(F.size("findings") > 0))
    result = paths.join(all_found, "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    fresh = unseen.select("blob").join(found, "blob", "left").select("blob", F.lit(rules).alias("rules"), F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return result, ledger.unionByName(fresh)
