"""Personal data: candidate spans scored by boosted trees, with calibrated thresholds.

Base rules (e-mail, address, card, phone) always report. Beside them, generators of high recall
propose overlapping spans; boosted trees over format and context score them, and those over
their kind's threshold are reported too. The trees learn from made-up identifiers and look-alikes
(pii_samples), counted by their binned features, so they are fitted on the driver from a table whose size is
bounded by the bins; thresholds are set on the half they were not fitted on. Scoring is a Catalyst
expression. DataFrame functions only.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .pii_samples import luhn_sum, mod97, samples
from .spans import add_matches, tagged

#: The base rules.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ["email", "ip", "card", "phone"]
#: The generators. They overlap each other and the base rules on purpose. CODE has the form of account
#: numbers: two letters, two digits and 11 to 30 more, in one run or in fours.
NUMBER = r"\+?\(?(?<![0-9])[0-9](?:[\x20().-]{0,3}[0-9]){6,}+"
CODE = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]++)*+"
GENERATORS = ["number", "code", "spelled"]
#: Words before a span that speak for a kind of it.
CONTEXT = ["(?i:phone|tel|call|fax|mobile)", "(?i:card|visa|credit|paid)", "(?i:ssn|social|passport|tax|iban|account)", "(?i:mail|contact|write|reach)"]
#: Forms of numbers. Security numbers that are given out, their form, phones, fours.
SSN = "^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"
FORMS = [SSN, "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", "^\\([0-9]{3}\\)\\x20?[0-9]{3}-[0-9]{4}$|^[2-9][0-9]{2}([.\\x20-])[0-9]{3}\\1[0-9]{4}$", "^[0-9]{4}([\\x20.-]{1,3})[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}$", "^[0-9]{7,11}$"]
FEATURES = ["kind", "digits", "marks", "fits", "form", "ends", "before", "after", "context", "plus"]
#: Characters before a span in which context words are looked for, and labelled samples the trees learn from.
CONTEXT_CHARS, SAMPLES = 24, 24_000


def digits_of(hit: Column) -> Column:
    return F.translate(hit, " ()+.-", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    return luhn_sum(d) % 10 == 0


def _ip_ok(hit: Column) -> Column:
    part = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
    value = lambda p: F.coalesce(F.when(part(p), F.regexp_replace(p, "^0+(?=[0-9])", "").cast("int")), F.lit(999)) <= 255
    return F.forall(F.split(hit, "[.]"), value)


def _card_ok(hit: Column) -> Column:
    d = digits_of(hit)
    return F.length(d).between(13, 19) & F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))


def find_base(texts: DataFrame, text: str = "text") -> DataFrame:
    """Add a column for each base rule with its matches (start, end, hit)."""
    has = lambda s: F.contains(F.col(text), F.lit(s))
    df = add_matches(texts, text, "email", EMAIL, None, has("@"))
    df = add_matches(df, text, "ip", IP, _ip_ok, F.col(text).rlike("[0-9]\\.[0-9]"))
    df = add_matches(df, text, "card", CARD, _card_ok)
    return add_matches(df, text, "phone", PHONE, lambda h: F.length(digits_of(h)).between(9, 15), has("+"))


def _bin(value: Column, cuts: list[int]) -> Column:
    return sum(((value >= c).cast("int") for c in cuts[1:]), (value >= cuts[0]).cast("int"))


def add_candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``cands``: proposed spans (kind, start, end) with their binned features f."""
    has = lambda s: F.contains(F.col(text), F.lit(s))
    df = add_matches(df, text, "number", NUMBER)
    df = add_matches(df, text, "code", CODE)
    df = add_matches(df, text, "spelled", SPELLED, None, has("[at]") | has("(at)"))

    def proposed(k: int, name: str) -> Column:
        def item(s: Column) -> Column:
            hit = s["hit"]
            d, n = digits_of(hit), F.length(F.regexp_replace(hit, "[^0-9]", ""))
            lead = F.when(s["start"] > 0, F.substring(F.col(text), s["start"], F.lit(1))).otherwise("")
            tail = F.substring(F.col(text), s["end"] + 1, F.lit(1))
            near = F.substring(F.col(text), F.greatest(F.lit(1), s["start"] + 1 - CONTEXT_CHARS), F.least(F.lit(CONTEXT_CHARS), s["start"]))
            side = lambda c: F.when(c.rlike("[A-Za-z0-9]"), 2).when(c.rlike("[\\s]") | (c == ""), 0).otherwise(1)
            first = lambda value, patterns: F.coalesce(*[F.when(value.rlike(p), F.lit(j + 1)) for j, p in enumerate(patterns)], F.lit(0))
            none = F.lit(0)
            if name == "number":
                fits, form, ends = F.when(d.rlike("^[0-9]{13,19}$"), luhn(d).cast("int")).otherwise(0), first(hit, FORMS), none
            elif name == "code":
                fits, form, ends = (mod97(F.translate(hit, " ", "")) == 1).cast("int"), none, none
            else:
                fits, form, ends = none, none, hit.rlike("(\\.|\\(dot\\)|\\[dot\\])\\x20?[A-Za-z]{2,}$").cast("int")
            f = [F.lit(k), _bin(n, [7, 9, 10, 11, 13, 16, 17, 20]), _bin(F.length(hit) - n, [1, 2, 3, 4, 8]), fits, form, ends, side(lead), side(tail), first(near, CONTEXT), F.startswith(hit, F.lit("+")).cast("int")]
            return F.struct(F.lit(name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*[x.cast("int") for x in f]).alias("f"))

        return F.transform(name, item)

    return df.withColumn("cands", F.concat(*(proposed(k, name) for k, name in enumerate(GENERATORS))))


class Boosted:
    """Gradient-boosted depth-2 trees for logistic loss on weighted cells of binned features."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray, trees: int = 40, rate: float = 0.3, precision: float = 0.98):
        self.trees, self.base = [], float(np.log((pos.sum() + 1) / (neg.sum() + 1)))
        score, n = np.full(len(x), self.base), pos + neg
        for _ in range(trees if len(x) else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = pos - n * p, n * p * (1 - p)
            first = self._split(x, g, h, np.ones(len(x), bool))
            if first is None:
                break
            f, c = first
            leaves = []
            for side in (x[:, f] >= c, x[:, f] < c):
                inner = self._split(x, g, h, side)
                cells = [side] if inner is None else [side & (x[:, inner[0]] >= inner[1]), side & (x[:, inner[0]] < inner[1])]
                values = [rate * g[m].sum() / (h[m].sum() + 1.0) for m in cells]
                leaves.append((inner, values))
                for m, v in zip(cells, values):
                    score[m] += v
            self.trees.append((f, c, leaves))
        self.precision = precision
        self.threshold = self.least_score(x, pos, neg)

    def values(self, x: np.ndarray) -> np.ndarray:
        """The sum of the trees for rows of binned features."""
        out = np.full(len(x), self.base)
        for f, c, leaves in self.trees:
            for side, (inner, values) in zip((x[:, f] >= c, x[:, f] < c), leaves):
                cells = [side] if inner is None else [side & (x[:, inner[0]] >= inner[1]), side & (x[:, inner[0]] < inner[1])]
                for m, v in zip(cells, values):
                    out[m] += v
        return out

    def least_score(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
        """Least score of these rows from which up the share of positives stays at the asked precision; infinite if there is none."""
        score = self.values(x)
        cuts, at = np.unique(-score, return_inverse=True)  # rows of one score are taken or left together
        p, n = np.bincount(at, pos, len(cuts)), np.bincount(at, pos + neg, len(cuts))
        good = np.nonzero((np.cumsum(p) / np.maximum(np.cumsum(n), 1) >= self.precision) & (np.cumsum(n) > 0))[0]
        return float(-cuts[good[-1]]) if len(good) else float("inf")

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray) -> tuple[int, int] | None:
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
        best, at = 1e-6 + gain(own), None
        for f in range(x.shape[1]):
            for c in np.unique(x[own, f])[1:]:
                now = gain(own & (x[:, f] >= c)) + gain(own & (x[:, f] < c))
                if now > best:
                    best, at = now, (f, int(c))
        return at

    def score(self, f: Column) -> Column:
        """The sum of the trees as an expression over the array of binned features."""
        total = F.lit(self.base)
        for first, cut, leaves in self.trees:
            sides = []
            for inner, values in leaves:
                sides.append(F.lit(float(values[0])) if inner is None else F.when(f[inner[0]] >= inner[1], float(values[0])).otherwise(float(values[1])))
            total = total + F.when(f[first] >= cut, sides[0]).otherwise(sides[1])
        return total


@functools.lru_cache(4)
def _fitted(rows: int, precision: float) -> tuple[Boosted, dict[str, float]]:
    """The trees and each kind's threshold, from the labelled samples of the active session; one fit a process."""
    spark = SparkSession.active()
    # Written, so that neither a text nor its candidates are worked out again for each use.
    scratch = Scratch(spark, "pii_samples")
    made = scratch.put(samples(spark, rows), "samples")
    seen = scratch.put(add_candidates(made).select("id", "start", "end", "y", "cands"), "cands")
    seen = seen.select("id", "start", "end", "y", F.explode("cands").alias("c"))
    held = F.pmod(F.xxhash64("id", F.lit(0)), F.lit(2)).alias("held")
    # A look-alike's parts are none either; a part of an identifier is no example.
    whole = (F.col("y") == 0) | ((F.col("c.start") <= F.col("start")) & (F.col("c.end") >= F.col("end")))
    cells = seen.where(whole).groupBy(held, F.col("c.f").alias("f")).agg(F.sum("y").alias("pos"), F.count("*").alias("n")).collect()  # bounded by the bins
    cells.sort(key=lambda r: (r["held"], r["f"]))

    def part(held: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [r for r in cells if r["held"] == held]
        pos = np.array([r["pos"] for r in own], float)
        return np.array([r["f"] for r in own], int).reshape(-1, len(FEATURES)), pos, np.array([r["n"] for r in own], float) - pos

    model, (x, pos, neg) = Boosted(*part(0), precision=precision), part(1)
    of = lambda k: x[:, 0] == k
    return model, {name: model.least_score(x[of(k)], pos[of(k)], neg[of(k)]) for k, name in enumerate(GENERATORS)}


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple | list = (), rows: int = SAMPLES, precision: float = 0.98) -> DataFrame:
    """Personal data in every text: base spans by kind, and spans the trees add.

    Returns one row per input row: doc_id, a column for each base kind (start, end, hit), ``added``
    (kind, start, end) and the columns asked for in ``keep`` (``text`` comes with them). Null texts count as empty; rows do not
    depend on ids, so null and repeated ids pass through. Spans are in code points, end exclusive. An
    added span never overlaps a base span; added spans may overlap each other. ``rows`` labelled samples
    train the trees, and ``precision`` is what each kind's threshold keeps on the half held out.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    model, least = _fitted(rows, precision)
    held = [F.col(c).alias(f"_keep_{k}") for k, c in enumerate(keep)]
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *held)
    held = ["text", *(f"_keep_{k}" for k in range(len(keep)))] if keep else []
    # Written, so that what is found is worked out once.
    wide = scratch.put(add_candidates(find_base(own)).select("doc_id", *held, *BASE, "cands"), "wide")
    apart = lambda c: (F.forall(k, lambda b: (b["end"] <= c["start"]) | (b["start"] >= c["end"])) for k in BASE)
    finite = {k: v for k, v in least.items() if np.isfinite(v)}
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    if not finite:
        return wide.select("doc_id", *held, *BASE, none.alias("added"))

    def chosen(c: Column) -> Column:
        bar = F.coalesce(*[F.when(c["kind"] == k, F.lit(v)) for k, v in finite.items()], F.lit(float("inf")))
        return functools.reduce(lambda x, y: x & y, apart(c), model.score(c["f"]) >= bar)

    added = F.transform(F.filter("cands", chosen), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return wide.select("doc_id", *held, *BASE, F.when(F.size("cands") > 0, added).otherwise(none).alias("added"))


def all_spans() -> Column:
    """Base spans by kind and start, then the added ones."""
    return F.concat(tagged(BASE, "kind"), F.array_sort("added"))


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: tuple | list = ()) -> DataFrame:
    """The columns ``keep`` (or the id) and the text, with every reported span replaced by its kind in brackets.

    Overlapping spans are replaced as one, under the kind of the one that begins first. A null text
    comes back empty.
    """
    keep = list(keep) or [id_col]
    ordered = F.array_sort(F.transform(all_spans(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    found = find(docs, id_col, text_col, keep).withColumn("_all", ordered)

    def step(state: Column, s: Column) -> Column:
        new = s["start"] >= state["at"]
        piece = F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(state["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))
    text = F.when(F.size("_all") > 0, F.aggregate("_all", zero, step, end)).otherwise(F.col("text"))
    return found.select(*[F.col(f"_keep_{k}").alias(c) for k, c in enumerate(keep)], text.alias(text_col))
