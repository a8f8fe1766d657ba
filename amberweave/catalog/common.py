"""Registration, and the derived tables that queries and SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import text_id
from ..functions.vectors import doubles
from ..operators import hierarchy as h
from ..sources.tables import checkpointed

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Page vectors: vec_id as id, page_id as the digest of it, label as the document."""
    e = read(spark, folder, "embeddings")
    return e.select("vec_id", F.col("vec_id").alias("id"), text_id(F.col("vec_id").cast("string")).alias("page_id"), F.col("label").alias("doc"), doubles(F.col("embedding")).alias("v"))


def first_vector(spark: SparkSession, folder: str) -> list[float]:
    """The query vector: that of vec_id 0."""
    return list(vectors(spark, folder).where("vec_id = 0").select("v").first()[0])


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set: vectors of ids divisible by 20."""
    return vectors(spark, folder).where("vec_id % 20 = 0")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return vectors(spark, folder).select("doc", F.col("vec_id").alias("ord"), "page_id", "v")


def tree(spark: SparkSession, folder: str, written: bool = False) -> dict[str, DataFrame]:
    """Books, volumes and shelves over the page vectors, with membership tables; ``written`` once, for queries that read them often."""
    keep = checkpointed if written else lambda df: df
    p = pages(spark, folder)
    b = keep(h.books(p))
    v = keep(h.volumes(b))
    s = keep(h.shelves(v))
    return {
        "pages": p, "books": b, "volumes": v.withColumn("prototypes", F.array("prototype")), "shelves": s.withColumn("prototypes", F.array("prototype")),
        "book_pages": b.select("book_id", F.explode("page_ids").alias("page_id")), "volume_books": v.select("volume_id", F.explode("book_ids").alias("book_id")),
        "shelf_volumes": s.select("shelf_id", F.explode("volume_ids").alias("volume_id")),
    }


def part_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Association edges: parts on consecutive lines of an order; 0.1 a traversal.

    The SQL leaves open which of two lines of one number and part comes last; here it is the one shipped later, so that runs agree.
    """
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_shipdate")
    pairs = read(spark, folder, "lineitem").select(F.col("l_partkey").alias("from_page_id"), F.lead("l_partkey").over(w).alias("to_page_id"), F.col("l_shipdate").alias("ts"))
    pairs = pairs.where("to_page_id is not null and from_page_id != to_page_id")
    return pairs.groupBy("from_page_id", "to_page_id").agg(F.round(F.count("*") * 0.1, 6).alias("weight"), F.max("ts").alias("last_updated_at"))


def part_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Activity of parts: lines as hits, last ship date as last query, brand as community."""
    hits = read(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("page_id")).agg(F.count("*").alias("query_hit_count"), F.max("l_shipdate").alias("last_query_at"))
    brand = read(spark, folder, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_brand").alias("community_id"))
    return brand.join(hits, "page_id").select("page_id", "query_hit_count", "last_query_at", "community_id")


def last_ship(spark: SparkSession, folder: str):
    """Now: the last ship date of all, as a literal."""
    return F.lit(read(spark, folder, "lineitem").agg(F.max("l_shipdate")).first()[0])


#: The same tables in SQL.
E = "e AS (SELECT vec_id, label AS doc, embedding::DOUBLE[] AS v, sha256(vec_id::VARCHAR) AS page_id FROM embeddings)"
Q0 = "q AS (SELECT embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id = 0)"
PG = E + ", pg AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY vec_id) - 1 AS pos FROM e)"
BOOKS = PG + """, bt AS (
  SELECT a.doc, a.pos // 8 AS book_no, a.page_id, a.pos, a.v, round(sum(1 - list_cosine_similarity(a.v, b.v)), 9) AS t
  FROM pg a JOIN pg b ON a.doc = b.doc AND a.pos // 8 = b.pos // 8 GROUP BY ALL),
bk AS (SELECT doc, book_no, list(page_id ORDER BY pos) AS page_ids, arg_min(page_id, [t, pos]) AS medoid_page_id, arg_min(v, [t, pos]) AS mv FROM bt GROUP BY ALL),
books AS (SELECT *, sha256(array_to_string(list_sort(page_ids), '|')) AS book_id FROM bk)"""
VOLUMES = BOOKS + """, vm AS (SELECT doc, book_no // 4 AS volume_no, i, avg(mv[i]) AS x FROM books, range(1, 65) r(i) GROUP BY ALL),
vp AS (SELECT doc, volume_no, list(x ORDER BY i) AS prototype FROM vm GROUP BY ALL),
vv AS (SELECT b.doc, b.book_no // 4 AS volume_no, list(book_id ORDER BY book_no) AS book_ids, avg((1 - list_cosine_similarity(mv, prototype)) ** 2) AS variance
  FROM books b JOIN vp ON b.doc = vp.doc AND b.book_no // 4 = vp.volume_no GROUP BY ALL),
volumes AS (SELECT vv.doc, vv.volume_no, sha256(array_to_string(list_sort(book_ids), '|')) AS volume_id, book_ids, prototype, variance
  FROM vv JOIN vp ON vv.doc = vp.doc AND vv.volume_no = vp.volume_no)"""
SHELVES = VOLUMES + """, sm AS (SELECT doc, volume_no // 4 AS shelf_no, i, avg(prototype[i]) AS x FROM volumes, range(1, 65) r(i) GROUP BY ALL),
sp AS (SELECT doc, shelf_no, list(x ORDER BY i) AS prototype FROM sm GROUP BY ALL),
sv AS (SELECT doc, volume_no // 4 AS shelf_no, list(volume_id ORDER BY volume_no) AS volume_ids FROM volumes GROUP BY ALL),
shelves AS (SELECT sv.doc, sv.shelf_no, sha256(array_to_string(list_sort(volume_ids), '|')) AS shelf_id, volume_ids, prototype
  FROM sv JOIN sp ON sv.doc = sp.doc AND sv.shelf_no = sp.shelf_no)"""
PAIRS = """pr AS (SELECT l_partkey AS f, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS t, l_shipdate AS ts FROM lineitem),
edges AS (SELECT f AS from_page_id, t AS to_page_id, round(count(*) * 0.1, 6)::DOUBLE AS weight, max(ts) AS last_updated_at FROM pr WHERE t IS NOT NULL AND f != t GROUP BY ALL)"""
ACT = """act AS (SELECT p_partkey AS page_id, count(*) AS query_hit_count, max(l_shipdate) AS last_query_at, p_brand AS community_id
  FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_brand), now AS (SELECT max(l_shipdate) AS ts FROM lineitem)"""
SAL = PAIRS + ", " + ACT + """, st AS (SELECT from_page_id AS page_id, sum(weight) AS h FROM edges GROUP BY ALL),
sal AS (SELECT p_partkey AS page_id, round(0.5 * coalesce(h, 0) + 0.3 * CASE WHEN last_query_at IS NULL THEN 0 ELSE exp(-ln(2) * greatest(0, epoch(now.ts) - epoch(last_query_at)) / 604800) END
  + 0.2 * coalesce(query_hit_count, 0), 6) AS salience, community_id
  FROM part LEFT JOIN st ON st.page_id = p_partkey LEFT JOIN act ON act.page_id = p_partkey, now)"""
#: Most neighbours of a page in a graph of all vectors.
DEGREE = "(SELECT least(32, greatest(1, ceil(0.5 * sqrt(count(*) * log2(1 + count(*)))))) FROM e)"
#: Similarity lists of all vectors: cosine 0.3 and up, at most the degree each.
NB = E + """, nb AS (SELECT a.vec_id AS page_id, b.vec_id AS neighbor_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id != b.vec_id),
fwd AS (SELECT *, round(1 - similarity, 6) AS distance, row_number() OVER (PARTITION BY page_id ORDER BY similarity DESC, neighbor_id) AS rank FROM nb WHERE similarity >= 0.3 QUALIFY rank <= """ + DEGREE + ")"
