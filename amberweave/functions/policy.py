"""Capacity, quota and routing policy: each rule as a Python function and as a column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The policy's constants.
CAPACITY_C = 0.5
TIER_RATIOS = {"shelf": 0.10, "volume": 0.20, "book": 0.20, "page": 0.50}
SALIENCE_WEIGHTS = (0.5, 0.3, 0.2)
HALF_LIFE_S = 7 * 24 * 3600
NEIGHBOR_CAP = 32
SUBGRAPH_CAP = 30
ROUTING_RATIOS = {"broad": 1 / 8, "normal": 1 / 4, "narrow": 1 / 2}
ROUTING_ALIGN, ROUTING_MIN, ROUTING_BITS = 8, 8, 128
TRUNCATION = (0.75, 256)
CHUNK = (0.25, 128, 2048)


def _mass(t: Column) -> Column:
    return F.when(t.isNull() | F.isnan(t.cast("double")) | (t < 0) | (t == float("inf")), 0.0).otherwise(t.cast("double"))


def capacity(t: float, c: float = CAPACITY_C) -> int:
    """Hot-set capacity of a graph of mass t; 1 for masses that are no finite positive number."""
    if t is None or not math.isfinite(t) or t <= 0:
        return 1
    return max(1, math.ceil(c * math.sqrt(t * math.log2(1 + t))))


def capacity_col(t: Column, c: float = CAPACITY_C) -> Column:
    m = _mass(t)
    return F.greatest(F.lit(1), F.ceil(c * F.sqrt(m * F.log2(1 + m)))).cast("long")


def neighbor_degree_col(t: Column, c: float = CAPACITY_C) -> Column:
    return F.least(F.lit(NEIGHBOR_CAP).cast("long"), capacity_col(t, c))


def neighbor_degree(t: float, c: float = CAPACITY_C) -> int:
    return min(NEIGHBOR_CAP, capacity(t, c))


def salience(h: float, r: float, q: float, weights: tuple = SALIENCE_WEIGHTS) -> float:
    total = sum(w * x for w, x in zip(weights, (h, r, q)))
    return total if math.isfinite(total) else 0.0


def salience_col(h: Column, r: Column, q: Column, weights: tuple = SALIENCE_WEIGHTS) -> Column:
    total = weights[0] * h + weights[1] * r + weights[2] * q
    return F.when(F.isnan(total) | total.isin(float("inf"), float("-inf")) | total.isNull(), 0.0).otherwise(total)


def recency_col(last: Column, now: Column) -> Column:
    """exp(-ln 2 * age / 7 days); a missing time gives 0 and a future one counts as now."""
    age = F.greatest(F.lit(0.0), now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double"))
    return F.when(last.isNull(), 0.0).otherwise(F.exp(-math.log(2) * age / HALF_LIFE_S))


def largest_remainder(total: int, shares: list[float]) -> list[int]:
    """Whole parts of the shares, then one more each by largest fraction, earlier first."""
    floors = [math.floor(s) for s in shares]
    order = sorted(range(len(shares)), key=lambda i: floors[i] - shares[i])
    for i in order[: max(0, total - sum(floors))]:
        floors[i] += 1
    return floors


def tier_quotas(cap: float, ratios: dict[str, float] = TIER_RATIOS) -> dict[str, int]:
    whole, norm = max(0, math.floor(cap)), sum(ratios.values())
    shares = [(r / norm if norm > 0 else 0.25) * whole for r in ratios.values()]
    return dict(zip(ratios, largest_remainder(whole, shares)))


def community_quotas(budget: float, sizes: list[float]) -> list[int]:
    n, whole = len(sizes), max(0, math.floor(budget))
    if not n or not whole:
        return [0] * n
    least = 1 if whole >= n else 0
    rest, total = whole - least * n, sum(max(0, s) for s in sizes)
    if not rest or not total:
        return [least] * n
    return [least + x for x in largest_remainder(rest, [max(0, s) / total * rest for s in sizes])]


def tier_quota_rows(caps: DataFrame, ratios: dict[str, float] = TIER_RATIOS) -> DataFrame:
    """(capacity) -> (capacity, tier, quota) by largest remainder."""
    norm = sum(ratios.values())
    tiers = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(t).alias("tier"), F.lit(r / norm).alias("r")) for k, (t, r) in enumerate(ratios.items())])
    rows = caps.select("capacity", F.explode(tiers).alias("t")).select("capacity", "t.*")
    share = F.col("r") * F.col("capacity")
    rows = rows.withColumn("floor", F.floor(share)).withColumn("frac", share - F.floor(share))
    w = Window.partitionBy("capacity")
    rank = F.row_number().over(w.orderBy(F.desc("frac"), "pos"))
    left = F.col("capacity") - F.sum("floor").over(w)
    return rows.withColumn("k", rank).withColumn("left", left).select("capacity", "tier", (F.col("floor") + (F.col("k") <= F.col("left")).cast("long")).alias("quota"))


def community_quota_rows(sizes: DataFrame, budget: int) -> DataFrame:
    """(community, size) -> (community, size, quota); one slot each where the budget allows, rest by largest remainder."""
    w = Window.partitionBy(F.lit(0))  # one row per community
    n, total = F.count("*").over(w), F.sum(F.greatest(F.lit(0), F.col("size"))).over(w)
    least = F.when(F.lit(budget) >= n, 1).otherwise(0)
    rest = F.lit(budget) - least * n
    base = sizes.select("community", "size", least.alias("least"), rest.alias("rest"), F.when(total > 0, F.greatest(F.lit(0), F.col("size")) / total * rest).otherwise(F.lit(0.0)).alias("share"))
    base = base.withColumn("floor", F.floor("share"))
    left = F.col("rest") - F.sum("floor").over(w)
    ranked = base.withColumn("k", F.row_number().over(w.orderBy(F.desc(F.round(F.col("share") - F.col("floor"), 9)), "community"))).withColumn("left", left)
    return ranked.select("community", "size", (F.col("least") + F.col("floor") + (F.col("k") <= F.col("left")).cast("long")).cast("long").alias("quota"))


def subgraph_bounds_col(t: Column) -> tuple[Column, Column, Column]:
    """(size, hops, branch) of a query's subgraph; masses under 2 give 1, 1, 1."""
    m = F.greatest(F.lit(2.0), t.cast("double"))
    size = F.least(F.lit(SUBGRAPH_CAP), F.greatest(F.lit(1), F.floor(F.sqrt(m * F.log2(1 + m)) / F.log2(m)).cast("int")))
    hops = F.greatest(F.lit(1), F.ceil(F.log2(F.log2(1 + m))).cast("int"))
    branch = F.greatest(F.lit(1), F.floor(F.pow(size.cast("double"), 1.0 / hops)).cast("int"))
    few = t < 2
    return tuple(F.when(few, 1).otherwise(x).cast("long") for x in (size, hops, branch))


def subgraph_bounds(t: float) -> tuple[int, int, int]:
    if t < 2:
        return 1, 1, 1
    size = min(SUBGRAPH_CAP, max(1, math.floor(math.sqrt(t * math.log2(1 + t)) / math.log2(t))))
    hops = max(1, math.ceil(math.log2(math.log2(1 + t))))
    return size, hops, max(1, math.floor(size ** (1 / hops)))


def fanout_limit_col(n: Column, c: float = CAPACITY_C) -> Column:
    m = F.greatest(F.lit(2.0), n.cast("double"))
    return F.greatest(F.lit(1), F.ceil(c * F.sqrt(m * F.log2(1 + m)))).cast("long")


def fanout_limit(n: float, c: float = CAPACITY_C) -> int:
    m = max(2, n)
    return max(1, math.ceil(c * math.sqrt(m * math.log2(1 + m))))


def routing_dims_col(dim: Column) -> dict[str, Column]:
    """Projection sizes and element offsets of the broad, normal and narrow routing matrices."""
    out, at = {}, F.lit(0).cast("long")
    for name, ratio in ROUTING_RATIOS.items():
        raw = F.floor(F.floor(dim * ratio) / ROUTING_ALIGN) * ROUTING_ALIGN
        size = F.least(dim, F.greatest(F.lit(ROUTING_MIN), raw)).cast("long")
        out[f"{name}_dim"], out[f"{name}_offset"] = size, at
        at = at + size * dim
    return out


def routing_policy(dim: int, ratios: dict[str, float] = ROUTING_RATIOS, align: int = ROUTING_ALIGN, least: int = ROUTING_MIN, bits: int = ROUTING_BITS) -> dict[str, dict[str, int]]:
    for name, v in (("embedding dimension", dim), ("alignment", align), ("least dimension", least), ("bits", bits)):
        if not isinstance(v, int) or v <= 0:
            raise ValueError(f"{name} must be a positive integer")
    if any(not math.isfinite(r) or r <= 0 for r in ratios.values()):
        raise ValueError("ratios must be positive and finite")
    out, at = {}, 0
    for name, ratio in ratios.items():
        size = min(dim, max(least, math.floor(dim * ratio) // align * align))
        out[name] = {"dim_in": dim, "dim_out": size, "offset": at} | ({"bits": bits} if name == "broad" else {})
        at += size * dim
    return out


def truncation_tokens(context: int) -> int:
    return max(TRUNCATION[1], math.floor(TRUNCATION[0] * context))


def chunk_limit(truncation: int) -> int:
    return min(CHUNK[2], max(CHUNK[1], math.floor(CHUNK[0] * truncation)))


def limits_col(context: Column) -> tuple[Column, Column]:
    truncation = F.greatest(F.lit(TRUNCATION[1]), F.floor(TRUNCATION[0] * context)).cast("long")
    return truncation, F.least(F.lit(CHUNK[2]), F.greatest(F.lit(CHUNK[1]), F.floor(CHUNK[0] * truncation))).cast("long")
