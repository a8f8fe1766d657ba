"""Text, hashing and identity functions as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the text rules (Unicode spaces and the byte-order mark).
SPACE = "[\\s\\x0B\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
#: Patterns by reason, tried in this order; the first that matches decides.
MIN_PUBLIC_CHARS = 20
RULES = [
    ("pii_credentials", r"(?i)\b(?:password|passwd|api[_-]?key|secret[_-]?key|auth[_-]?token|access[_-]?token)\s*[:=]\s*\S+"),
    ("pii_credentials", r"(?:Bearer\s+[A-Za-z0-9\-._~+/]+=*|-----BEGIN (?:RSA |EC |)PRIVATE KEY-----)"),
    ("pii_financial", r"\b(?:4[0-9]{12}(?:[0-9]{3,6})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12,15})\b"),
    ("pii_financial", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,16})?\b"),
    ("pii_identity", r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"),
    ("pii_identity", r"(?i)\b[-a-zA-Z0-9._%+]+@[a-zA-Z0-9.]+\.[a-zA-Z]{2,}\b"),
    ("pii_health", r"(?i)\b(?:medical[_-]?record|patient[_-]?id|diagnosis|prescription|ICD[-\s]?\d{1,2})\b"),
]
#: What a match of each rule holds, in the order of the rules: one of some words in lower case, or a simpler pattern.
GATES = [("passw", "key", "token"), ("bearer", "-----begin "), "[0-9]{13}", "[A-Z]{2}[0-9]{2}", "[0-9]{3}[-\\s][0-9]{2}[-\\s][0-9]{4}", ("@",), ("medical", "patient", "diagnosis", "prescription", "icd")]
#: Sentences that are packed at a time.
RUN = 64
#: An ASCII word boundary; Java's own one counts every Unicode letter as a word character.
BOUNDARY = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def normalize_space(text: Column) -> Column:
    """Runs of white space become one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def sentences(text: Column) -> Column:
    """Parts of a normalised text that end in . ! or ? and a space; none for an empty text."""
    return F.filter(F.split(text, "(?<=[.!?])\\s+"), lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def chunks(text: Column, budget: int) -> Column:
    """Greedy packing of sentences into chunks of at most ``budget`` tokens.

    A sentence over the budget first closes the open chunk and is then cut into runs of ``budget`` tokens;
    its rest is a chunk of its own.
    """
    if not isinstance(budget, int) or budget <= 0:
        raise ValueError("the token budget must be a positive integer")
    # A normalised text has single spaces only.
    parts = F.transform(sentences(normalize_space(text)), lambda s: F.split(s, " "))
    words = F.array().cast("array<string>")
    none = F.array().cast("array<array<string>>")

    def step(state: Column, words_of: Column) -> Column:
        flushed = F.when(F.size(state["open"]) > 0, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        n = F.size(words_of)
        cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / budget).cast("int")), lambda i: F.slice(words_of, i * budget + 1, F.lit(budget)))
        long = F.struct(F.concat(flushed, cut).alias("done"), words.alias("open"))
        fits = F.struct(state["done"].alias("done"), F.concat(state["open"], words_of).alias("open"))
        turn = F.struct(flushed.alias("done"), words_of.alias("open"))
        return F.when(n > budget, long).when(F.size(state["open"]) + n > budget, turn).otherwise(fits)

    def by_run(state: Column, run: Column) -> Column:
        """Chunks of one run of sentences after another, so that appending never copies all chunks."""
        own = F.aggregate(run, F.struct(none.alias("done"), state["open"].alias("open")), step)
        return F.transform(F.array(own), lambda o: F.struct(F.concat(state["done"], F.array(o["done"])).alias("done"), o["open"].alias("open")))[0]

    def packed(ss: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(ss) - 1) / RUN).cast("int")), lambda i: F.slice(ss, i * RUN + 1, F.lit(RUN)))
        return F.aggregate(F.when(F.size(ss) > 0, runs).otherwise(F.array().cast("array<array<array<string>>>")), F.struct(F.array().cast("array<array<array<string>>>").alias("done"), words.alias("open")), by_run, finish)

    def finish(state: Column) -> Column:
        whole = F.concat(F.flatten(state["done"]), F.when(F.size(state["open"]) > 0, F.array(state["open"])).otherwise(none))
        return F.transform(whole, lambda w: F.array_join(w, " "))

    return F.transform(F.array(parts), packed)[0]


def text_id(text: Column) -> Column:
    return F.sha2(text, 256)


def set_id(ids: Column, salt: str = "") -> Column:
    """Identity of a set of ids: digest of the sorted ids joined by a bar, after a salt."""
    return F.sha2(F.concat(F.lit(salt), F.array_join(F.array_sort(ids), "|")), 256)


def hash_embedding(text: Column, dim: int, block: int = 64) -> Column:
    """Deterministic vector of a text: bytes of SHA-256 over the zero-padded text and a counter, scaled to -1..1."""
    raw = F.encode(text, "UTF-8")
    n = F.octet_length(text)
    size = F.greatest(F.lit(block), F.ceil(n / block) * block).cast("int")
    padded = F.concat(raw, F.unhex(F.repeat(F.lit("00"), size - n)))
    digests = [F.sha2(F.concat(padded, F.unhex(F.lit(f"{k:08x}"))), 256) for k in range(-(-dim // 32))]
    hexes = F.concat(*digests)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)


def canonical_page(**fields: Column) -> Column:
    """JSON of a page in the fixed key order that is signed; nulls are written out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def eligibility(text: Column) -> Column:
    """Reason that blocks a text from being shared, or null: too short, then the patterns in order.

    A pattern is tried only on texts that hold what each of its matches holds.
    """
    out = F.lit(None).cast("string")
    low = F.lower(text)
    for (reason, pattern), gate in reversed(list(zip(RULES, GATES))):
        may = text.rlike(gate) if isinstance(gate, str) else functools.reduce(lambda a, b: a | b, (F.contains(low, F.lit(word)) for word in gate))
        out = F.when(may & text.rlike(pattern.replace("\\b", BOUNDARY)), reason).otherwise(out)
    bare = SPACE.replace("[", "[^", 1)
    long = text.rlike(f"(?s){bare}.{{{MIN_PUBLIC_CHARS - 2},}}{bare}")
    return F.when(text.isNotNull() & ~long, "no_public_interest").otherwise(out)
