"""Text, hashing, identity and eligibility."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import ingest
from .common import query, read

NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
PARTS = rf"n AS (SELECT doc_id, {NORM} AS t FROM documents), s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x != '') AS s FROM n)"


@query(f"SELECT doc_id, sha256({NORM}) AS norm_sha256 FROM documents")
def normalize_ws(spark, d):
    return read(spark, d, "documents").select("doc_id", F.sha2(tx.normalize_space(F.col("text")), 256).alias("norm_sha256"))


@query(f"WITH {PARTS} SELECT doc_id, len(s)::BIGINT AS n_sentences, sha256(array_to_string(s, '|')) AS sha256 FROM s")
def sentences(spark, d):
    s = tx.sentences(tx.normalize_space(F.col("text")))
    return read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "|"), 256).alias("sha256"))


BUDGET = 128
CHUNKS = rf"""WITH RECURSIVE {PARTS}, w AS (SELECT doc_id, i, string_split(s[i], ' ') AS words FROM s, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
r AS (
  SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS c, 0::BIGINT AS held, -1::BIGINT AS next FROM s
  UNION ALL
  SELECT r.doc_id, w.i, CASE WHEN len(words) > {BUDGET} OR held + len(words) > {BUDGET} THEN r.c + CASE WHEN next >= 0 THEN next WHEN held > 0 THEN 1 ELSE 0 END
                            WHEN next >= 0 THEN r.c + next ELSE r.c END,
    CASE WHEN len(words) > {BUDGET} THEN 0 WHEN held + len(words) > {BUDGET} THEN len(words) ELSE held + len(words) END,
    CASE WHEN len(words) > {BUDGET} THEN (len(words) + {BUDGET - 1}) // {BUDGET} ELSE -1 END
  FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i + 1),
x AS (SELECT r.doc_id, r.c + CASE WHEN r.next >= 0 THEN (k - 1) // {BUDGET} ELSE 0 END AS pos, r.i, k, words[k] AS word
  FROM r JOIN w ON w.doc_id = r.doc_id AND w.i = r.i, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS k))
SELECT doc_id, pos, count(*) AS n_tokens, sha256(string_agg(word, ' ' ORDER BY i, k)) AS page_id FROM x GROUP BY ALL"""


@query(CHUNKS)
def chunks(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(tx.chunks(F.col("text"), BUDGET)).alias("pos", "content"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.size(F.split("content", " ")).cast("long").alias("n_tokens"), tx.text_id(F.col("content")).alias("page_id"))


@query("SELECT doc_id, sha256(text) AS page_id FROM documents")
def page_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", tx.text_id(F.col("text")).alias("page_id"))


@query("""SELECT conv_id, turn, sha256(text) AS page_id, lag(sha256(text)) OVER w AS prev_page_id, lead(sha256(text)) OVER w AS next_page_id
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def page_links(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("page_id", tx.text_id(F.col("text")))
    return rows.select("conv_id", "turn", "page_id", F.lag("page_id").over(w).alias("prev_page_id"), F.lead("page_id").over(w).alias("next_page_id"))


HEX = "sha256(encode(text) || unhex(repeat('00', (greatest(1, ceil(strlen(text) / 64.0)) * 64 - strlen(text))::BIGINT)) || unhex(lpad(to_hex(k), 8, '0')))"


@query(f"""WITH h AS (SELECT item_id, string_agg({HEX}, '' ORDER BY k) AS h FROM benchmark, range(0, 2) t(k) GROUP BY item_id)
SELECT item_id, pos, round(('0x' || substr(h, pos * 2 + 1, 2))::INT / 127.5::DOUBLE - 1, 6) AS value FROM h, range(0, 40) t(pos)""")
def hash_embedding(spark, d):
    rows = read(spark, d, "benchmark").select("item_id", F.posexplode(tx.hash_embedding(F.col("text"), 40)).alias("pos", "x"))
    return rows.select("item_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@query("""SELECT conv_id, turn, sha256(to_json({'pageId': sha256(text), 'content': text, 'embeddingDim': 64, 'prevPageId': lag(sha256(text)) OVER w})::VARCHAR) AS canonical_sha256
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def canonical_page(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, d, "conversations").withColumn("page_id", tx.text_id(F.col("text"))).withColumn("prev", F.lag("page_id").over(w))
    json = tx.canonical_page(pageId=F.col("page_id"), content=F.col("text"), embeddingDim=F.lit(64), prevPageId=F.col("prev"))
    return rows.select("conv_id", "turn", F.sha2(json, 256).alias("canonical_sha256"))


def _case() -> str:
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{r}'" for r, p in tx.RULES)
    return rf"CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < {tx.MIN_PUBLIC_CHARS} THEN 'no_public_interest' {rules} END"


@query(f"SELECT doc_id, CASE WHEN r IS NULL THEN 'eligible' ELSE 'blocked' END AS status, r AS reason FROM (SELECT doc_id, {_case()} AS r FROM documents)")
def pii_classify(spark, d):
    r = read(spark, d, "documents").select("doc_id", tx.eligibility(F.col("text")).alias("reason"))
    return r.select("doc_id", F.when(F.col("reason").isNull(), "eligible").otherwise("blocked").alias("status"), "reason")


@query(f"SELECT doc_id FROM documents WHERE ({_case()}) IS NULL")
def pii_eligible(spark, d):
    return read(spark, d, "documents").where(tx.eligibility(F.col("text")).isNull()).select("doc_id")


INGEST = CHUNKS.replace("count(*) AS n_tokens, sha256(string_agg(word, ' ' ORDER BY i, k)) AS page_id FROM x GROUP BY ALL", "string_agg(word, ' ' ORDER BY i, k) AS text FROM x GROUP BY ALL")


@query(f"""WITH c AS ({INGEST}), h AS (SELECT doc_id AS doc, pos, text, sha256(text) AS page_id, {HEX.replace("to_hex(k)", "to_hex(0)")} AS h FROM c)
SELECT doc, pos::BIGINT AS pos, page_id, lag(page_id) OVER w AS prev_page_id, lead(page_id) OVER w AS next_page_id, round(('0x' || substr(h, 1, 2))::INT / 127.5::DOUBLE - 1, 6) AS v0 FROM h WINDOW w AS (PARTITION BY doc ORDER BY pos)""")
def ingest_pages(spark, d):
    """Chunk, identify, embed and link all documents."""
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    p = ingest.pages_of(read(spark, d, "documents"), BUDGET, now, dim=32)
    return p.select("doc", F.col("pos").cast("long").alias("pos"), "page_id", "prev_page_id", "next_page_id", F.round(F.col("v")[0], 6).alias("v0"))
