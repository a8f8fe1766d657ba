"""Connected components of a link table, and the candidate resolution that feeds them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch

#: Ids of more common buckets are compared in any case: hardly any share so many by chance.
FEW = 4
#: The last pairs are made in so many parts, so what their join shuffles at once stays small.
PARTS = 4


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every linked node: alternate large-star and small-star rounds.

    ``edges`` has columns a, b (ids, any order, repeats allowed; null and self links
    are ignored). Returns (id, component_id) for nodes with at least one link. Hubs
    are met by aggregates with map-side combining and by joins AQE can split; nothing
    is gathered on the driver but a count and a checksum per round. Rounds grow with the logarithm of the longest
    chain of links; more than ``rounds`` of them are an error, never a partial result.
    """
    # Counted while written: links settle when a round leaves their count and checksum as they were.
    checksum = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")]

    def put(df: DataFrame, k: int) -> tuple[DataFrame, dict]:
        seen = Observation()
        return scratch.put(df.observe(seen, *checksum), f"{name}_{k}"), seen.get

    e, now = put(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 0)
    before, k = None, 0
    while now["n"] and now != before:
        before, k = now, k + 1
        if k > rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        tree = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = tree.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e, now = put(after, k)
        scratch.free(f"{name}_{k - 1}")
    roots = e.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return e.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)


def star_pairs(cands: DataFrame, near: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(a, b): each member of a bucket (bucket, id) with the bucket's smallest id; ``near`` tells by tags what can be linked.

    Where ``cands`` has components c, ids of the same one are no pair.
    """
    tags = [F.min_by("tag", "id").alias("lead_tag")] if near else []
    tags += [F.min_by("c", "id").alias("lead_c")] if "c" in cands.columns else []
    lead = cands.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n"), *tags).where("n > 1").drop("n")
    pairs = cands.join(lead, "bucket").where(F.col("id") != F.col("a"))
    pairs = pairs.where("c != lead_c") if "c" in cands.columns else pairs
    pairs = pairs.where(near(F.col("tag"), F.col("lead_tag"))) if near else pairs
    return pairs.select("a", F.col("id").alias("b")).distinct()


def pairs_once(marked: DataFrame, near: Callable[[Column, Column], Column], fits: Callable[..., Column] | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """(a, b), each once: the near pairs of different components in the buckets of ``marked`` (bucket, id, tag, c, main).

    A pair that shares several buckets is made in one of them, so the join makes no more rows than there are
    pairs. Of a pair at least one id is not of the bucket's main component. ``fits`` tells by two tags and their
    fields ``at`` in a bucket whether ids can be linked for that bucket; a pair that shares up to FEW buckets is made only if it
    fits one of them. ``part``: (i, n), the buckets of one of n parts.

    Buckets come in the order of their numbers. A pair is made in the first that it fits, or in the one after FEW that it does not, so a
    row has to know only the buckets of its id up to its own.
    """
    at = F.col("tag")["at"] if fits else F.lit(None).cast("int")
    held = marked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bucket", at.alias("at")))).alias("own"))
    rows = marked.where(F.pmod(F.xxhash64("bucket"), F.lit(part[1])) == part[0]).select("bucket", "id", "tag", "c", "main").join(held, "id")
    upto = F.slice("own", F.lit(1), F.array_position("own.bucket", F.col("bucket")).cast("int"))
    rows = rows.withColumn("own", upto).select("bucket", "id", "tag", "c", "main", F.col("own.bucket").alias("own"), F.col("own.at").alias("ats"))
    stray = rows.where("c != main").select(F.col("bucket").alias("xb"), F.col("id").alias("x"), F.col("c").alias("xc"), F.col("tag").alias("xt"), F.col("own").alias("xo"), F.col("ats").alias("xats"))
    differ = (F.col("bucket") == F.col("xb")) & (F.col("c") != F.col("xc")) & ((F.col("c") == F.col("main")) | (F.col("id") < F.col("x")))
    place = lambda ats, own, b: F.get(ats, (F.array_position(own, b) - 1).cast("int"))
    fit = lambda b: fits(F.col("tag"), F.col("xt"), place(F.col("ats"), F.col("own"), b), place(F.col("xats"), F.col("xo"), b))
    last = lambda ats: F.element_at(ats, -1)

    def here(both: Column) -> Column:
        if not fits:
            return F.size(both) == 1
        own = fits(F.col("tag"), F.col("xt"), last(F.col("ats")), last(F.col("xats")))
        return F.when(F.size(both) > FEW + 1, False).when(F.size(both) == FEW + 1, True).otherwise(own) & ~F.exists(both, lambda b: (b != F.col("bucket")) & fit(b))

    made = F.transform(F.array(F.array_intersect("own", "xo")), here)[0]
    pairs = rows.join(stray, differ & near(F.col("tag"), F.col("xt")) & made)
    return pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))


def resolve(cands: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, near: Callable[[Column, Column], Column], more: DataFrame | None = None, spare: int = 20, fits: Callable[..., Column] | None = None) -> DataFrame:
    """Components of the links hidden in candidate buckets, without emitting all pairs of a bucket.

    ``cands`` has (bucket, id, tag), distinct and written; no link joins ids whose tags are not ``near``;
    ``more`` are further pairs (a, b) to verify. Each round compares the members of a bucket that are not yet
    in one component with its leader, the bucket's smallest id not yet compared (``verify`` keeps
    the pairs (a, b) that are links), then joins the components found so far. Once the comparisons left
    between different components number at most ``spare`` times the rows, they are all made; ``spare`` is doubled
    each round, so buckets of unrelated members take few rounds. So no pair
    of a bucket that could join two components is left out, and a bucket of near copies of one text
    costs as many pairs as it has members. ``fits``: ids share many buckets, and the last pairs are made once
    each, by ``pairs_once``, instead of once for each bucket.
    """
    pairs = star_pairs(cands, near)
    edges = scratch.put(verify(pairs if more is None else pairs.unionByName(more)), "edges_0")
    rows, left, k = max(1000, cands.count()), cands, 0
    while True:
        k += 1
        # Components stand for all links before, so what is carried from round to round stays small.
        found = scratch.put(components(edges, scratch, f"cc{k}"), f"found_{k}")
        named = left.join(found, "id", "left").select("bucket", "id", "tag", F.coalesce("component_id", "id").alias("c"))
        lead = named.groupBy("bucket").agg(F.min_by("c", "id").alias("main"), F.min("id").alias("lead"), F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n"))
        marked = scratch.put(named.join(lead.where("low < high and n > 2").drop("low", "high"), "bucket"), f"open_{k}")
        if k > 1:
            scratch.free(f"open_{k - 1}")
        work = marked.where("c != main").groupBy().agg(F.sum("n").alias("pairs")).first()[0] or 0
        if not work:
            return found
        last = work <= spare * rows
        if last and fits:
            # Numbers in place of hashes: rows list their buckets, and small numbers are packed better.
            codes = scratch.put(marked.select("bucket").distinct().select("bucket", F.monotonically_increasing_id().alias("code")), "codes")
            marked = scratch.put(marked.join(codes, "bucket").select(F.col("code").alias("bucket"), "id", "tag", "c", "main"), "coded")
            parts = []
            for i in range(PARTS):
                parts.append(scratch.put(pairs_once(marked, near, fits, (i, PARTS)), f"last_{i}"))
                scratch.sweep()
            pairs = reduce(DataFrame.unionByName, parts)
        elif last:
            stray = marked.where("c != main").select(F.col("bucket").alias("xb"), F.col("id").alias("x"), F.col("c").alias("xc"), F.col("tag").alias("xt"))
            pairs = marked.select("bucket", "id", "c", "tag").join(stray, (F.col("bucket") == F.col("xb")) & (F.col("c") != F.col("xc")) & near(F.col("tag"), F.col("xt")))
            pairs = pairs.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
        else:  # the leader was compared before; the next one takes its turn
            left = marked.where("id != lead").select("bucket", "id", "tag", "c")
            pairs = star_pairs(left, near)
        fresh = scratch.put(verify(pairs.distinct()), f"edges_{k}")
        if last and not fresh.take(1):
            return found
        edges = found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(fresh)
        if last:
            return scratch.put(components(edges, scratch, "cc_end"), "found_end")
        spare *= 2
