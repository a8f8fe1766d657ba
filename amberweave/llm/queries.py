"""The queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, exact_dedup, fuzzy_lines, minhash, packing, pii, quality, secrets, spans, substring


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file; AMBERWEAVE_TOKENIZERS overrides the installed folder."""
    folder = os.environ.get("AMBERWEAVE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle=2, percent=80)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_versions(_read(spark, sf_dir, "documents"))
    base = F.filter("findings", lambda s: s["kind"].isin(*secrets.BASE))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(spans.joined(base), 256).alias("base_sha256"), spans.joined(F.col("findings")).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = fuzzy_lines.drop_lines(docs, fuzzy_lines.duplicate_lines(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(_read(spark, sf_dir, "documents"), window=20).drop("kept_text")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(spans.joined(spans.tagged(pii.BASE, "kind")), 256).alias("base_sha256"), spans.joined(pii.all_spans()).alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"), digest_all=True)


#: ASCII white space between words, and lower-casing of A-Z alone.
SPLIT = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda w: w != '')"
LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _groups() -> str:
    """Least id reachable over link(a, b), both ways."""
    return f"""linked AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
        reach AS (SELECT a AS id, b AS r FROM linked UNION SELECT id, b FROM reach JOIN linked ON r = a),
        least AS (SELECT id, min(r) AS r FROM reach GROUP BY id)"""


def _spans(kinds: list[tuple[str, str, str]]) -> str:
    """(doc_id, k, kind, s, e): places of each kind's matches, from what matched and what lies between."""
    one = []
    for k, (kind, pattern, keep) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        one.append(f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS s, length(h[i]) AS n, h[i] AS hit
            FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS h, string_split_regex(t, {p}) AS g FROM docs WHERE regexp_matches(t, {p})), LATERAL (SELECT unnest(range(1, len(h) + 1)) AS i) WHERE {keep}""")
    return " UNION ALL ".join(one)


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRETS = [
    ("assign", ASSIGN, "length(regexp_extract(h[i], '" + ASSIGN.replace("'", "''") + "', 1)) >= 8"), ("access", "AKIA[A-Z0-9]+", "length(h[i]) >= 16"), ("hex", "[0-9a-f]+", "length(h[i]) >= 32"),
    ("pem", secrets.PEM, "true"), ("jwt", secrets.JWT.replace("}+", "}"), "true"), ("host", secrets.HOST.replace("}+", "}"), "true"),
]

ORACLE = {
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(LOW)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) > 1 THEN w[i] || ' ' || w[i + 1] ELSE w[1] END AS g
              FROM w, LATERAL (SELECT unnest(range(1, greatest(2, len(w)))) AS i) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
        {_groups()}
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(r, d.doc_id) AS component_id, coalesce(r, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.id = d.doc_id""",
    "op3_secret_scan": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_spans(SECRETS)}),
        a AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
              string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, k) AS spans FROM f GROUP BY doc_id)
        SELECT docs.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN a ON a.doc_id = docs.doc_id""",
    "op7_embedding_near_dedup": f"""
        WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0),
        link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
        {_groups()}, c AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
        SELECT m.vec_id, coalesce(n, 0) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
        FROM embeddings m LEFT JOIN c ON c.a = m.vec_id LEFT JOIN least ON least.id = m.vec_id""",
    "op8_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i)),
        later AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
        gone AS (SELECT DISTINCT doc_id, j FROM later, LATERAL (SELECT unnest(range(i, i + 20)) AS j)),
        word AS (SELECT doc_id, j, w[j] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS j)),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({LOW}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_minhash_near_dedup, op3_secret_scan, op4_bpe, op5_fuzzy_lines, op6_packing, op7_embedding_near_dedup, op8_substring_dedup, op9_pii, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
