"""Vector backends: one interface over Catalyst expressions or numpy in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors as vx

ENGINES = ("arrow", "catalyst")


def detect() -> str:
    """Arrow where numpy and pyarrow can be imported, else Catalyst."""
    try:
        import numpy  # noqa: F401
        import pyarrow  # noqa: F401
    except ImportError:
        return "catalyst"
    return "arrow"


class VectorBackend:
    """Kernels over a table (id, v). k is cut to the number of rows; ties go to the smaller id."""

    def __init__(self, engine: str | None = None):
        self.engine = engine or detect()
        if self.engine not in ENGINES:
            raise ValueError(f"engine must be one of {ENGINES}")

    def dot_many(self, table: DataFrame, query: list[float]) -> DataFrame:
        """(id, score) of every row."""
        if self.engine == "catalyst":
            q = F.array(*[F.lit(float(x)) for x in query])
            return table.select("id", F.round(vx.dot(vx.doubles(F.col("v")), q), 6).alias("score"))
        asked = table.sparkSession.createDataFrame([(0, [float(x) for x in query])], "id long, v array<double>")
        return vx.nearest(table, asked, None, kind="dot").select("id", "score")

    def top_scores(self, scored: DataFrame, k: int) -> DataFrame:
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def top_distances(self, distances: DataFrame, k: int) -> DataFrame:
        return distances.orderBy("distance", "id").limit(k)

    def project(self, table: DataFrame, rows: list[list[float]]) -> DataFrame:
        return table.select("id", vx.project(vx.doubles(F.col("v")), vx.matrix(rows)).alias("v"))

    def sign_bits(self, table: DataFrame, planes: list[list[float]]) -> DataFrame:
        return table.select("id", vx.sign_bits(vx.doubles(F.col("v")), vx.matrix(planes), len(planes)).alias("code"))

    def hamming_top(self, codes: DataFrame, code: list[int], k: int) -> DataFrame:
        c = F.array(*[F.lit(x).cast("long") for x in code])
        return self.top_distances(codes.select("id", vx.hamming(F.col("code"), c).alias("distance")), k)
