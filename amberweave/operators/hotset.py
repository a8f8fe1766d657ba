"""Salience and the bounded hot set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy


def node_salience(pages: DataFrame, edges: DataFrame, activity: DataFrame, now: Column) -> DataFrame:
    """(page_id, salience, community_id): out-strength, recency of the last query and hits, weighted.

    Pages without edges or activity count 0 for them.
    """
    strength = edges.groupBy(F.col("from_page_id").alias("page_id")).agg(F.sum("weight").alias("h"))
    own = pages.select("page_id").join(strength, "page_id", "left").join(activity.select("page_id", "query_hit_count", "last_query_at", "community_id"), "page_id", "left")
    recency = policy.recency_col(F.col("last_query_at"), now)
    s = policy.salience_col(F.coalesce("h", F.lit(0.0)), recency, F.coalesce(F.col("query_hit_count").cast("double"), F.lit(0.0)))
    return own.select("page_id", s.alias("salience"), "community_id")


def should_promote(candidate: Column, weakest: Column, remaining: Column) -> Column:
    return (remaining > 0) | (candidate > weakest)


def bootstrap(candidates: DataFrame, current: int = 0, current_pages: int = 0, c: float = policy.CAPACITY_C) -> DataFrame:
    """Greedy fill by salience until the capacity or the page quota is reached.

    Capacity is that of residents and candidates together. One count comes to the driver.
    """
    cap = policy.capacity(current + candidates.count(), c)
    room = max(0, min(cap - current, policy.tier_quotas(cap)["page"] - current_pages))
    best = candidates.orderBy(F.desc("salience"), "page_id").limit(room)
    return best.select(F.col("page_id").alias("entity_id"), F.lit("page").alias("tier"), "salience", "community_id")


def community_distribution(entries: DataFrame, candidate: str) -> DataFrame:
    """(community, size) of a tier, entries of none under __none__, the candidate's community counted once at least."""
    sizes = entries.groupBy(F.coalesce("community_id", F.lit("__none__")).alias("community")).agg(F.count("*").alias("size"))
    own = entries.sparkSession.createDataFrame([(candidate, 1)], "community string, size long")
    return sizes.unionByName(own).groupBy("community").agg(F.max("size").alias("size"))


def _sweep(rows: pd.DataFrame, c: float) -> pd.DataFrame:
    """Fold of the candidates, strongest first, into the residents; residents are at most the capacity."""
    hot = rows[rows["resident"]].sort_values("entity_id")
    hot = [dict(r) for r in hot[["entity_id", "tier", "salience", "community_id"]].to_dict("records")]
    cands = rows[~rows["resident"]].sort_values(["salience", "entity_id"], ascending=[False, True])
    key = lambda e: (e["salience"], e["entity_id"])
    for cand in cands.to_dict("records"):
        cap = policy.capacity(len(hot) + len(cands), c)
        quota = policy.tier_quotas(cap)["page"]
        pages = [e for e in hot if e["tier"] == "page"]
        new = {"entity_id": cand["entity_id"], "tier": "page", "salience": cand["salience"], "community_id": cand["community_id"]}
        rivals = None
        if len(pages) >= quota:
            rivals = pages
            who = cand["community_id"]
            if who is not None:
                sizes: dict = {}
                for e in pages:
                    name = "__none__" if e["community_id"] is None else e["community_id"]
                    sizes[name] = sizes.get(name, 0) + 1
                held = sizes.get(who, 0)
                sizes[who] = max(1, held)
                names = sorted(sizes)
                budget = policy.community_quotas(quota, [sizes[n] for n in names])[names.index(who)]
                if held >= budget and held > 0:
                    rivals = [e for e in pages if e["community_id"] == who]
        if rivals is None:
            if cap - len(hot) > 0:
                hot.append(new)
            continue
        if rivals and new["salience"] > min(rivals, key=key)["salience"]:
            weakest = min(rivals, key=key)["entity_id"]
            hot = [e for e in hot if e["entity_id"] != weakest] + [new]
    # The store holds one row for an entity: the last one written.
    last = {e["entity_id"]: e for e in hot}
    return pd.DataFrame(list(last.values()), columns=["entity_id", "tier", "salience", "community_id"])


def promotion_sweep(hot: DataFrame, candidates: DataFrame, c: float = policy.CAPACITY_C) -> DataFrame:
    """Hot set after the candidates (page_id, salience, community_id) were swept in.

    The rule is order-dependent, so it is folded in one group: the candidates of a sweep are the pages of
    one query or one ingest, and residents are bounded by the capacity.
    """
    own = candidates.select(F.col("page_id").alias("entity_id"), F.lit("page").alias("tier"), F.col("salience").cast("double"), F.col("community_id").cast("string"), F.lit(False).alias("resident"))
    now = hot.select("entity_id", "tier", F.col("salience").cast("double"), F.col("community_id").cast("string"), F.lit(True).alias("resident"))
    kind = dict(candidates.dtypes)["page_id"]
    rows = now.unionByName(own)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(community_id=pdf["community_id"].astype(object).where(pdf["community_id"].notna(), None))
        return _sweep(pdf, c)

    return rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fold, f"entity_id {kind}, tier string, salience double, community_id string")
