"""Regex matches with their places, from DataFrame functions alone.

``regexp_extract_all`` gives what matched and ``split`` what lies between, in the same left-to-right
scan, so running lengths are the places (code points, end exclusive).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,hit:string>>"
#: Matches of a text that are placed at a time.
RUN = 256


def add_matches(df: DataFrame, text: str, name: str, pattern: str, keep: Callable[[Column], Column] | None = None, gate: Column | None = None) -> DataFrame:
    """Add column ``name``: leftmost non-overlapping matches of ``pattern`` that ``keep`` accepts, in order.

    ``gate`` is a cheap condition that holds for every text with a match. Matches that ``keep`` rejects
    still count as read, so nothing inside them is tried again. A null text has none.
    """
    hits = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_hits", F.coalesce(F.when(gate, hits) if gate is not None else hits, none))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["hit"])
        item = F.array(F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("hit")))
        more = F.concat(state["out"], item)
        return F.struct(end.alias("at"), (F.when(keep(pair["hit"]), more).otherwise(state["out"]) if keep else more).alias("out"))

    empty = F.array().cast(SPAN)

    def by_run(state: Column, run: Column) -> Column:
        """One run of pairs after another: appending copies a run's spans or the list of runs, never all spans."""
        own = F.aggregate(run, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        return F.transform(F.array(own), lambda o: F.struct(o["at"].alias("at"), F.concat(state["out"], F.array(o["out"])).alias("out")))[0]

    pairs = F.zip_with(gaps, F.col(f"{name}_hits"), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    pairs = F.filter(pairs, lambda p: p["hit"].isNotNull())
    runs = lambda ps: F.transform(F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / RUN).cast("int")), lambda k: F.slice(ps, k * RUN + 1, F.lit(RUN)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    placed = F.transform(F.array(pairs), lambda ps: F.flatten(F.aggregate(runs(ps), zero, by_run)["out"]))[0]
    some = F.size(f"{name}_hits") > 0
    if keep:  # most texts have no match worth placing
        some = some & F.exists(f"{name}_hits", keep)
    spans = F.when(some, placed).otherwise(empty)
    return df.withColumn(name, spans).drop(f"{name}_hits")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs that hold them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(kinds: list[str], order: str) -> Column:
    """Spans of the columns ``kinds`` as one array, ordered by start then kind as listed, or by kind then start."""

    def placed(kind: str, k: int) -> Column:
        def item(s: Column) -> Column:
            at, rank = s["start"], F.lit(k)
            keys = (at.alias("a"), rank.alias("b")) if order == "start" else (rank.alias("a"), at.alias("b"))
            return F.struct(*keys, s["end"].alias("end"), s["start"].alias("start"), F.lit(kind).alias("kind"))

        return F.transform(kind, item)

    arrays = [placed(kind, k) for k, kind in enumerate(kinds)]
    return F.transform(F.array_sort(F.concat(*arrays)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
