"""Tables as Parquet: schemas, reading, writing, and checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "pages": "page_id string, content string, embedding_offset bigint, embedding_dim int, content_hash string, vector_hash string, prev_page_id string, next_page_id string, creator_pub_key string, signature string, created_at timestamp, embedding array<float>",
    "books": "book_id string, page_ids array<string>, medoid_page_id string, meta struct<title:string,source_uri:string,tags:array<string>,extra:string>",
    "volumes": "volume_id string, book_ids array<string>, prototypes array<array<float>>, prototype_dim int, variance double",
    "shelves": "shelf_id string, volume_ids array<string>, routing_prototypes array<array<float>>, routing_dim int",
    "edges": "from_page_id string, to_page_id string, weight double, last_updated_at timestamp",
    "neighbors": "page_id string, neighbor_page_id string, cosine_similarity double, distance double, rank int",
    "page_activity": "page_id string, query_hit_count bigint, last_query_at timestamp, community_id string",
    "hotpath": "entity_id string, tier string, salience double, community_id string",
    "flags": "volume_id string, needs_recalc boolean",
    "eligibility": "page_id string, status string, reason string",
}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def write(df: DataFrame, folder: str, table: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{folder}/{table}.parquet")


def bootstrap(spark: SparkSession, folder: str) -> None:
    """Empty tables of the fixed schemas for those that are not there yet."""
    for table, schema in SCHEMAS.items():
        write(spark.createDataFrame([], schema), folder, table, mode="ignore")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir; where none is set and all runs on this machine, in one of our own."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="amberweave-"))
    return df.checkpoint()
