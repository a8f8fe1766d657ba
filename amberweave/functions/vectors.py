"""Vector math as columns, and blocked scoring of a query set with numpy.

Columns suit one product per row. A query set against all rows goes through ``nearest``: vectors
are dealt over the tasks, blocks of queries travel to them, and each task keeps its own best k.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries and vectors whose products are worked out at a time.
QUERY_BLOCK, VECTOR_BLOCK = 512, 8192


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Product over the shorter of both lengths."""
    return F.aggregate(F.filter(F.zip_with(a, b, lambda x, y: x * y), lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a vector is zero or empty. Over the shorter of both lengths."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, 1, n), F.slice(b, 1, n)
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(0.0)


def prefix(v: Column, dims: int) -> Column:
    return F.slice(v, 1, dims)


def suffix(v: Column, dims: int) -> Column:
    return F.slice(v, F.lit(dims + 1), F.greatest(F.lit(0), F.size(v) - dims))


def matrix(rows: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])


def project(v: Column, rows: Column) -> Column:
    """Dense projection: one product per row of the matrix."""
    return F.transform(rows, lambda r: dot(v, r))


def sign_bits(v: Column, planes: Column, bits: int) -> Column:
    """Random-hyperplane code: bit b is 1 where the product with plane b is not negative; 32 bits a word."""
    words = -(-bits // 32)

    def code(signs: Column) -> Column:
        def word(w: Column) -> Column:
            return F.aggregate(F.slice(signs, w * 32 + 1, F.lit(32)), F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).cast("long").alias("bit")), lambda s, on: F.struct((s["sum"] + s["bit"] * on).alias("sum"), (s["bit"] * 2).alias("bit")), lambda s: s["sum"])

        return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), word)

    signs = F.transform(F.slice(planes, 1, bits), lambda r: (dot(v, r) >= 0).cast("long"))
    # The signs are bound once: an expression named inside a lambda would be worked out again for every word.
    return F.transform(F.array(signs), code)[0]


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def centroid(df: DataFrame, group: list[str], vec: str, name: str = "centroid") -> DataFrame:
    """Element mean of the vectors of each group (double)."""
    long = df.select(*group, F.posexplode(doubles(F.col(vec))).alias("pos", "x"))
    mean = long.groupBy(*group, "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias(name))


def medoid(df: DataFrame, group: list[str], ident: str, vec: str, pos: str) -> DataFrame:
    """Member of least total cosine distance to its group; ties go to the least ``pos``.

    The distances of a member sum to n minus its product with the sum of the group's unit vectors, so
    no pairs are formed.
    """
    u = df.withColumn("_n", norm(doubles(F.col(vec)))).withColumn("_u", F.transform(doubles(F.col(vec)), lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(0.0)))
    sums = u.select(*group, F.posexplode("_u").alias("p", "x")).groupBy(*group, "p").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("_s"), F.max("n").alias("_size"))
    total = u.join(sums, group).withColumn("total", F.round(F.col("_size") - dot(F.col("_u"), F.col("_s")), 9))
    best = total.groupBy(*group).agg(F.min(F.struct("total", pos, ident)).alias("b"), F.count("*").alias("size"))
    return best.select(*group, F.col(f"b.{ident}").alias("medoid"), F.round("b.total", 6).alias("total"), "size")


def _matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a column of number lists, padded or cut to ``dim`` (the longest of them); nulls are zero."""
    rows = column.to_pylist()
    dim = max((len(x) for x in rows if x), default=0) if dim is None else dim
    out = np.zeros((len(rows), dim))
    for i, x in enumerate(rows):
        if x:
            m = min(len(x), dim)
            out[i, :m] = x[:m]
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1)
    return v / np.where(n > 0, n, 1)[:, None]


def _scores(k: int | None, cutoff: float | None, kind: str, skip_self: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of the queries of a part against its vectors, which come first and are held; rows are (part, asks, id, v)."""
    part, held = None, []
    for batch in batches:
        parts, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(parts)]):
            if lo == hi:
                continue
            own = batch.slice(lo, hi - lo)
            if parts[lo] != part:
                part, held = parts[lo], []
            if not asks[lo]:
                held.append((own.column(2), own.column(3)))
            elif held:
                ids = pa.concat_arrays([i for i, _ in held])
                for at in range(0, hi - lo, QUERY_BLOCK):
                    q = own.slice(at, QUERY_BLOCK)
                    for first in range(0, len(ids), VECTOR_BLOCK):
                        some = pa.concat_arrays([v for _, v in held]).slice(first, VECTOR_BLOCK)
                        yield _best(q.column(2), _matrix(q.column(3)), ids.slice(first, VECTOR_BLOCK), some, k, cutoff, kind, skip_self)


def _best(qid: pa.Array, q: np.ndarray, ids: pa.Array, vectors: pa.Array, k: int | None, cutoff: float | None, kind: str, skip_self: bool) -> pa.RecordBatch:
    v = _matrix(vectors, q.shape[1])
    if kind == "cosine":
        q, v = _unit(q), _unit(v)
    s = np.round(q @ v.T, 6)
    names, asked = (x.to_numpy(zero_copy_only=False) for x in (ids, qid))
    names, asked = (x.astype(str) if x.dtype == object else x for x in (names, asked))
    ok = np.ones_like(s, bool) if cutoff is None else s >= cutoff
    if skip_self:
        ok &= asked[:, None] != names[None, :]
    if k is not None and k < s.shape[1]:  # rows under the k-th best score are out; ties go on
        kept = np.where(ok, s, -np.inf)
        ok &= s >= -np.partition(-kept, k - 1, axis=1)[:, k - 1 : k]
    a, b = np.nonzero(ok)
    if k is not None:
        order = np.lexsort((names[b], -s[a, b], a))
        a, b = a[order], b[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        a, b = a[rank < k], b[rank < k]
    return pa.RecordBatch.from_arrays([qid.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s[a, b])], names=["query_id", "id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None = 10, cutoff: float | None = None, kind: str = "cosine", skip_self: bool = False, ident: str = "id", vec: str = "v") -> DataFrame:
    """(query_id, id, score, rank): rows of best score for each query, score rounded to 6 and ties by id.

    Ids are numbers (as long) or text. ``k`` None keeps every row at or over ``cutoff``. Vectors are dealt by id over as many parts as
    there are shuffle partitions and held there, once; every query goes to each part, in blocks, and of a part at most k
    rows a query and block of vectors come back. Nothing passes through the driver. Null ids and null queries are
    left out; a null vector scores 0.
    """
    kind_of = "string" if vectors.schema[ident].dataType.typeName() == "string" else "long"
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = lambda df: df.select(F.col(ident).cast(kind_of).alias("id"), doubles(F.col(vec)).alias("v")).where("id is not null")
    held = own(vectors).select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(False).alias("asks"), "id", "v")
    asked = own(queries).where("v is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(True).alias("asks"), "id", "v")
    dealt = held.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "asks")
    rows = dealt.mapInArrow(functools.partial(_scores, k, cutoff, kind, skip_self), f"query_id {kind_of}, id {kind_of}, score double")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
