"""Embedding near-dedup: tiled comparison of vectors rotated into PCA order.

After the rotation the leading dimensions carry most of a product. A tile pair sums them
first and drops every pair whose sum plus the product of its suffix norms stays under the
threshold (Cauchy-Schwarz), so later dimensions are computed for few pairs.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, partitions
from .components import components

#: Vectors of a tile, tiles of a run.
TILE, RUN = 1024, 8
#: Leading dimensions of the first and second partial sum; the last takes all.
STEPS = (8, 24)
#: Products of rotated unit vectors this near to the threshold are decided on the vectors as they came.
EPS = 1e-9


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        klass, unit, dim = [], [], []
        for vec_id, group, v in zip(*(c.to_pylist() for c in batch.columns)):
            k = u = None
            if vec_id is not None and group is not None and v and None not in v:
                x = np.array(v, np.float64)
                top = np.abs(x).max() if np.isfinite(x).all() else 0.0
                if top > 0:
                    u = x / np.exp2(np.floor(np.log2(top)))  # a power of two: no norm overflows, no digit is lost
                    k = hashlib.blake2b(x.tobytes() + repr(group).encode(), digest_size=16).digest()
            klass.append(k)
            unit.append(None if u is None else u.tobytes())
            dim.append(None if u is None else len(u))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(klass, pa.binary()), pa.array(unit, pa.binary()), pa.array(dim, pa.int64())], names=["vec_id", "grp", "klass", "vec", "dim"])


def _moments(top: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((top, top))
    for batch in batches:
        x = _units_of(batch.column("vec").to_pylist(), top)
        total += x.T @ x
    yield pa.RecordBatch.from_pydict({"at": np.arange(top * top), "v": total.ravel()})


def _units_of(vectors: list[bytes], top: int) -> np.ndarray:
    """Stored vectors at length one, padded to ``top`` dimensions."""
    out = np.zeros((len(vectors), top))
    for k, v in enumerate(vectors):
        x = np.frombuffer(v)
        out[k, : len(x)] = x / np.linalg.norm(x)
    return out


def _rotate(axes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = _units_of(batch.column("vec").to_pylist(), len(axes)) @ axes
        lead = pa.array(y[:, 0] if len(y) else np.empty(0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "grp", "dim", "mult")), lead, pa.array([r.tobytes() for r in y], pa.binary())], names=["rep", "grp", "dim", "mult", "lead", "y"])


def _tiles(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, held, key = TaskContext.get().partitionId(), 0, [], None

    def block() -> pa.RecordBatch:
        rep, grp, dim, mult, lead, y = zip(*held)
        row = {"tile": [(part << 32) + k], "grp": [grp[0]], "dim": [dim[0]], "lo": [min(lead)], "hi": [max(lead)], "ids": [np.array(rep, np.int64).tobytes()], "mults": [np.array(mult, np.int64).tobytes()], "ys": [b"".join(y)]}
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and (row[1:3] != key or len(held) >= size):
                yield block()
                k, held = k + 1, []
            held.append(row)
            key = row[1:3]
    if held:
        yield block()


def products(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (unit vectors in PCA order) whose product may reach the threshold, and the products.

    Sums of the leading dimensions grow step by step; rows and columns leave once no pair of theirs can
    reach the threshold. Products carry rounding, so pairs up to EPS under it are named too.
    """
    dim = a.shape[1]
    i, j, part = np.arange(len(a)), np.arange(len(b)), np.zeros((len(a), len(b)))
    for lo, hi in zip((0, *STEPS), (*STEPS, dim)):
        lo, hi = min(lo, dim), min(hi, dim)
        part = part + a[i, lo:hi] @ b[j, lo:hi].T
        rest = np.sqrt((a[i, hi:] ** 2).sum(axis=1))[:, None] * np.sqrt((b[j, hi:] ** 2).sum(axis=1))[None, :]
        alive = part + rest >= threshold - EPS
        rows, cols = alive.any(axis=1), alive.any(axis=0)
        i, j, part, alive = i[rows], j[cols], part[rows][:, cols], alive[rows][:, cols]
        if not len(i):
            break
    x, y = np.nonzero(part >= threshold - EPS) if len(i) else (np.empty(0, int), np.empty(0, int))
    return i[x], j[y], part[x, y]


def links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of a and b (unit vectors in PCA order) whose product reaches the threshold."""
    i, j, p = products(a, b, threshold)
    return i[p >= threshold], j[p >= threshold]


def cosine(x: bytes, y: bytes) -> float:
    """Cosine of two stored vectors, summed in the order of their components."""
    total = xx = yy = 0.0
    for p, q in zip(np.frombuffer(x).tolist(), np.frombuffer(y).tolist()):
        total += p * q
        xx += p * p
        yy += q * q
    return total / math.sqrt(xx * yy)


def _works(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Tiles of one pair of runs after another (the partition is sorted by them)."""
    held = []
    for batch in batches:
        for k in range(batch.num_rows):  # row by row: a row holds a tile
            r = batch.slice(k, 1).to_pylist()[0]
            if held and (r["ra"], r["rb"]) != (held[0]["ra"], held[0]["rb"]):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _compare(threshold: float, gap: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for tiles in _works(batches):
        for t in tiles:
            t["ids"], t["mults"] = np.frombuffer(t["ids"], np.int64), np.frombuffer(t["mults"], np.int64)
            t["ys"] = np.frombuffer(t["ys"]).reshape(len(t["ids"]), -1)
        for u, v in ((u, v) for u in tiles for v in tiles if u["side"] == 0 and (v["side"] == 1 if u["ra"] != u["rb"] else u["tile"] <= v["tile"])):
            if v["lo"] - u["hi"] > gap or u["lo"] - v["hi"] > gap:
                continue
            same = u["tile"] == v["tile"]
            i, j, p = products(u["ys"], v["ys"], threshold)
            if same:
                i, j, p = i[i < j], j[i < j], p[i < j]
            sure = p >= threshold + EPS
            if not sure.all():
                near_i, near_j = u["ids"][i[~sure]], v["ids"][j[~sure]]
                none = pa.nulls(len(near_i), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(near_i), none, none, pa.array(near_j)], names=["id", "n", "root", "peer"])
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            ids = np.concatenate([u["ids"], v["ids"]])
            n, back = np.zeros(len(ids), np.int64), j if same else j + len(u["ids"])
            np.add.at(n, i, v["mults"][j])
            np.add.at(n, back, u["mults"][i])
            root = ids.copy()
            while True:  # least id reachable inside this tile pair
                low, before = np.minimum(root[i], root[back]), root.copy()
                np.minimum.at(root, i, low)
                np.minimum.at(root, back, low)
                if (before == root).all():
                    break
            on = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[on]), pa.array(n[on]), pa.array(root[on]), pa.nulls(int(on.sum()), pa.int64())], names=["id", "n", "root", "peer"])


def _decide(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [cosine(x, y) >= threshold for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())]
        yield batch.select(["a", "b", "ma", "mb"]).filter(pa.array(ok, pa.bool_()))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label") -> DataFrame:
    """Links and groups of vectors of one group whose cosine (double precision) reaches the threshold.

    Returns one row per input row: vec_id, n_links (other rows linked directly),
    component_id (least vec_id reachable), kept. A vector that is null, empty, zero or holds null
    or non-finite components, or has a null group, links with nothing. Vectors of
    different lengths are never linked. Equal vectors of a group form a class, compared once;
    each counts as a link of the others, repeated ids too. A row of null vec_id links with
    nothing and has null component and kept. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embed")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(group_col).cast("string").alias("grp"), F.col(vec_col).cast("array<double>").alias("v"))
    units = scratch.put(own.mapInArrow(_stored, "vec_id long, grp string, klass binary, vec binary, dim long"), "units")
    good = units.where("klass is not null")
    classes = scratch.put(good.groupBy("klass").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "classes")
    reps = good.join(classes, (good.klass == classes.klass) & (good.vec_id == classes.rep)).select("rep", "grp", "dim", "mult", "vec").dropDuplicates(["rep", "vec"])
    reps = scratch.put(reps, "reps")
    top = reps.agg(F.max("dim")).first()[0]
    if top is None:
        found = spark.createDataFrame([], "klass binary, c long, n long")
    else:
        scatter = np.zeros(top * top)
        # A fixed number of rows: one for each entry of the scatter matrix.
        for r in reps.select("vec").mapInArrow(functools.partial(_moments, top), "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            scatter[r["at"]] = r["v"]
        axes = np.linalg.eigh(scatter.reshape(top, top))[1][:, ::-1].copy()
        turned = reps.mapInArrow(functools.partial(_rotate, axes), "rep long, grp string, dim long, mult long, lead double, y binary")
        turned = turned.repartitionByRange(partitions(spark), "grp", "dim", "lead").sortWithinPartitions("grp", "dim", "lead", "rep")
        tiles = scratch.put(turned.mapInArrow(functools.partial(_tiles, TILE), "tile long, grp string, dim long, lo double, hi double, ids binary, mults binary, ys binary"), "tiles")
        # Unit vectors at cosine t lie sqrt(2 - 2t) apart, so also in the leading coordinate.
        gap = max(1e-3, float(np.sqrt(max(0.0, 2 - 2 * threshold)))) + 1e-9
        tiles = tiles.withColumn("run", F.floor(F.col("tile") / RUN))
        # Runs of neighbouring tiles meet, so a tile travels once for a run of others; they are found by the strips of
        # width ``gap`` that they reach, so a large group does not meet in one task.
        runs = tiles.groupBy("grp", "dim", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        strips = F.sequence(F.floor(F.col("lo") / gap), F.floor(F.col("hi") / gap) + 1)
        reach = lambda k: runs.select("grp", "dim", F.col("run").alias(k), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}"), F.explode(strips).alias("strip"))
        close = (F.col("ra") <= F.col("rb")) & (F.col("lorb") - F.col("hira") <= gap) & (F.col("lora") - F.col("hirb") <= gap)
        pairs = scratch.put(reach("ra").join(reach("rb"), ["grp", "dim", "strip"]).where(close).select("grp", "dim", "ra", "rb").distinct(), "pairs")
        side = lambda k, r: pairs.join(tiles.withColumnRenamed("run", r), ["grp", "dim", r]).select("grp", "dim", "ra", "rb", F.lit(k).alias("side"), "tile", "lo", "hi", "ids", "mults", "ys")
        work = side(0, "ra").unionByName(side(1, "rb").where("ra != rb"))
        work = work.repartition(8 * partitions(spark), "grp", "dim", "ra", "rb").sortWithinPartitions("grp", "dim", "ra", "rb", "side", "tile").drop("grp", "dim")
        got = scratch.put(work.mapInArrow(functools.partial(_compare, threshold, gap), "id long, n long, root long, peer long"), "links")
        # Pairs at the threshold itself are decided on the vectors as they came.
        end = lambda k: reps.select(F.col("rep").alias(k), F.col("vec").alias(f"v{k}"), F.col("mult").alias(f"m{k}"))
        edge = got.where("peer is not null").select(F.col("id").alias("a"), F.col("peer").alias("b")).join(end("a"), "a").join(end("b"), "b")
        edge = scratch.put(edge.mapInArrow(functools.partial(_decide, threshold), "a long, b long, ma long, mb long"), "edge")
        sure = got.where("peer is null")
        n = sure.select("id", "n").unionByName(edge.select(F.col("a").alias("id"), F.col("mb").alias("n"))).unionByName(edge.select(F.col("b").alias("id"), F.col("ma").alias("n")))
        n = n.groupBy("id").agg(F.sum("n").alias("n"))
        group = components(sure.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(edge.select("a", "b")), scratch)
        at = classes.join(n, classes.rep == n.id, "left").drop("id").join(group, F.col("rep") == group.id, "left")
        found = at.select("klass", F.coalesce("component_id", "rep").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n"))
    out = units.select("vec_id", "klass").join(found, "klass", "left")
    c = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), c.alias("component_id"), (F.col("vec_id") == c).alias("kept"))
