"""Breadth-first subgraphs, greedy open paths, label propagation, seed expansion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bfs(neighbors: DataFrame, seeds: DataFrame, max_hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, hop) within ``max_hops``, and the out-edges of all nodes but the last layer's.

    ``neighbors`` is (page_id, neighbor_id, distance). Each hop joins the frontier alone to the edges. Only
    nodes that were reached stay in the plan; hops are few (their number grows as log log of the graph).
    """
    visited = seeds.select(F.col("id"), F.lit(0).alias("hop")).distinct()
    frontier = visited
    for hop in range(1, max_hops + 1):
        step = neighbors.join(frontier.select(F.col("id").alias("page_id")), "page_id", "left_semi")
        new = step.select(F.col("neighbor_id").alias("id")).distinct().join(visited.select("id"), "id", "left_anti")
        frontier = new.select("id", F.lit(hop).alias("hop"))
        visited = visited.unionByName(frontier)
    inner = visited.where(F.col("hop") < max_hops).select(F.col("id").alias("page_id"))
    edges = neighbors.join(inner, "page_id", "left_semi").select(F.col("page_id").alias("from_id"), F.col("neighbor_id").alias("to_id"), "distance").distinct()
    return visited, edges


def greedy_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, id): from the least id always to the nearest node not visited; ties by id, missing edges last.

    Edges count both ways; where both directions are given, the later in (from, to) order holds. The
    subgraph of one query is bounded by its policy, so it is folded as one row.
    """
    both = edges.select(F.col("from_id").alias("x"), F.col("to_id").alias("y"), "distance", F.struct("from_id", "to_id").alias("o")).unionByName(edges.select(F.col("to_id").alias("x"), F.col("from_id").alias("y"), "distance", F.struct("from_id", "to_id").alias("o")))
    one = both.groupBy("x", "y").agg(F.max_by("distance", "o").alias("d"))
    e = one.agg(F.map_from_entries(F.collect_list(F.struct(F.struct("x", "y"), "d"))).alias("adj"))
    n = nodes.select("id").distinct().agg(F.array_sort(F.collect_list("id")).alias("ids"))
    row = n.join(F.broadcast(e))

    def step(path: Column, _: Column) -> Column:
        here = F.element_at(path, -1)
        left = F.array_except("ids", path)
        far = F.transform(left, lambda y: F.struct(F.coalesce(F.try_element_at("adj", F.struct(here.alias("x"), y.alias("y"))), F.lit(float("inf"))).alias("d"), y.alias("id")))
        return F.concat(path, F.array(F.array_min(far)["id"]))

    turns = F.slice("ids", 2, F.greatest(F.lit(0), F.size("ids") - 1))
    path = F.aggregate(turns, F.slice("ids", 1, 1), step)
    return row.select(F.posexplode(F.when(F.size("ids") > 0, path)).alias("step", "id"))


def _propagate(edges: pd.DataFrame, rounds: int) -> pd.DataFrame:
    """In place, in id order: each node takes the commonest label among its out-neighbours, least label on ties."""
    out: dict = {}
    for a, b in zip(edges["page_id"], edges["neighbor_id"]):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    label = {n: n for n in out}
    order, turns = sorted(out), 0
    for turns in range(1, rounds + 1):
        changed = False
        for n in order:
            votes: dict = {}
            for m in out[n]:
                if m != n:
                    votes[label[m]] = votes.get(label[m], 0) + 1
            if votes:
                best = min(votes, key=lambda x: (-votes[x], x))
                changed |= best != label[n]
                label[n] = best
        if not changed:
            break
    return pd.DataFrame({"page_id": order, "label": [label[n] for n in order], "iterations": turns})


def weak_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(page_id, root): least id of each weakly connected part, by min-label rounds with pointer jumps.

    Each round is written to the checkpoint folder, so the plan stays short and lost executors cost one round.
    """
    from ..sources.tables import checkpointed

    both = edges.select("page_id", "neighbor_id").unionByName(edges.select(F.col("neighbor_id").alias("page_id"), F.col("page_id").alias("neighbor_id"))).distinct()
    both = checkpointed(both)
    root = both.select("page_id", F.col("page_id").alias("root")).distinct()
    for _ in range(rounds):
        near = both.join(root.select(F.col("page_id").alias("neighbor_id"), "root"), "neighbor_id").groupBy("page_id").agg(F.min("root").alias("m"))
        new = root.join(near, "page_id", "left").select("page_id", F.least("root", F.coalesce("m", "root")).alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("page_id").alias("root"), F.col("root").alias("up"))
        new = checkpointed(new.join(jump, "root").select("page_id", F.least("root", "up").alias("root"), "old"))
        if not new.where("root != old").limit(1).count():
            return new.select("page_id", "root")
        root = new.select("page_id", "root")
    raise RuntimeError("weak components did not settle")


def label_propagation(neighbors: DataFrame, rounds: int = 20) -> DataFrame:
    """Communities by asynchronous label propagation, exact to the sequential rule.

    Labels never cross weakly connected parts, so each part runs on its own; a part must fit one task.
    Nodes without neighbours are not in the result.
    """
    parts = weak_components(neighbors)
    own = neighbors.select("page_id", "neighbor_id").join(parts, "page_id")
    kind = {"bigint": "long", "int": "int", "string": "string"}[dict(neighbors.dtypes)["page_id"]]
    return own.groupBy("root").applyInPandas(lambda pdf: _propagate(pdf.sort_values(["page_id", "neighbor_id"]), rounds), f"page_id {kind}, label {kind}, iterations int")


def oversized(labels: DataFrame, share: float = 0.5) -> DataFrame:
    """Communities that hold more than ``share`` of all pages."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    total = F.broadcast(labels.agg(F.count("*").alias("total")))  # one row
    return sizes.join(total).where(F.col("n") > share * F.col("total")).select("label", "n")


def emptied(known: DataFrame, labels: DataFrame) -> DataFrame:
    return known.select("label").distinct().join(labels.select("label").distinct(), "label", "left_anti")


def expand_seeds(neighbors: DataFrame, edges: DataFrame, seeds: DataFrame, max_hops: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """Pages reached from the seeds in visit order, at most ``max_nodes`` (seeds are never cut), and edges between them.

    ``neighbors`` is (page_id, neighbor_id, rank), ``seeds`` (id, pos). A page's place is the place
    of the first page that lists it, then its rank in that list.
    """
    visited = seeds.select("id", F.col("pos").cast("long").alias("place"), F.lit(0).alias("hop"))
    frontier = visited
    for hop in range(1, max_hops + 1):
        found = neighbors.join(frontier.select(F.col("id").alias("page_id"), "place"), "page_id").groupBy(F.col("neighbor_id").alias("id")).agg(F.min(F.struct("place", "rank")).alias("o"))
        new = found.join(visited.select("id"), "id", "left_anti")
        start = F.broadcast(visited.agg(F.count("*").alias("base")))  # one row
        w = Window.partitionBy(F.lit(0)).orderBy("o")
        placed = new.join(start).withColumn("place", F.col("base") + F.row_number().over(w) - 1)
        frontier = placed.where(F.col("place") < max_nodes).select("id", "place", F.lit(hop).alias("hop"))
        visited = visited.unionByName(frontier)
    ids = visited.select("id")
    inner = edges.join(ids.select(F.col("id").alias("from_page_id")), "from_page_id", "left_semi").join(ids.select(F.col("id").alias("to_page_id")), "to_page_id", "left_semi")
    return visited, inner.dropDuplicates(["from_page_id", "to_page_id"])
