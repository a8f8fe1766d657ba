"""Labelled samples for the PII trees: made-up identifiers and look-alikes of the same form, in made-up context.

A sample's label comes from how it was made (a check digit that fits or not, an area that exists or not, a
grouping in use or not), never from the base rules. Samples are rows of ``range`` and DataFrame functions of
hashes; equal calls give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words around the identifiers.
PHONE_WORDS = ["phone", "tel", "call me at", "fax", "mobile"]
CARD_WORDS = ["card", "visa", "credit card", "paid with"]
ID_WORDS = ["ssn", "social security", "account", "iban", "tax id"]
MAIL_WORDS = ["mail", "contact", "write to", "reach me at"]
PLAIN_WORDS = ["order", "part", "see section", "version", "item", "total of", "about", "invoice", "the", "and"]
NAMES, HOSTS, ENDS = ["ann.lee", "j_smith", "office", "maria", "kim42"], ["mail", "example", "host-1", "uni"], ["com", "org", "net", "de", "co.uk"]
#: Country of an account number, digits after the check digits.
ACCOUNTS = [("DE", 18), ("ES", 20), ("FR", 23), ("PL", 24), ("AT", 16), ("BE", 12)]


def luhn_sum(d: Column) -> Column:
    """Sum of the digits of a string, every second one from the right doubled."""

    def add(total: Column, i: Column) -> Column:
        v = d.substr(F.length(d) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * v - F.when(v > 4, 9).otherwise(0)).otherwise(v)

    return F.when(F.length(d) > 0, F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)).otherwise(0)


def mod97(code: Column) -> Column:
    """An account number's remainder modulo 97: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(code, 5, 1000), F.substring(code, 1, 4))

    def add(state: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (state * 10 + c.cast("int")) % 97).otherwise((state * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add)


def _pick(values: list[str], k: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_draw(k, len(values)) + 1).cast("int"))


def _draw(k: int, n: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))


def _digits(k: int, n: int) -> Column:
    parts = [F.lpad(_draw(100 * k + j, 10 ** min(15, n - j)).cast("string"), min(15, n - j), "0") for j in range(0, n, 15)]
    return F.concat(*parts)


def _grouped(d: Column, sizes: list[int], sep: Column) -> Column:
    at, parts = 1, []
    for n in sizes:
        parts += [F.substring(d, at, n), sep]
        at += n
    return F.concat(*parts[:-1])


def samples(spark: SparkSession, rows: int) -> DataFrame:
    """(id, text, start, end, y): a text with one identifier (y 1) or look-alike (y 0) at start to end."""
    good = _draw(1, 2) == 0
    sep = _pick([".", "-", " ", ". ", " - "], 2)
    words = lambda own, k: F.when(_draw(k, 10) < 6, _pick(own, k + 1)).otherwise(_pick(PLAIN_WORDS, k + 2))
    # Cards: the last digit fits or not.
    body = F.concat(_pick(["4", "51", "55"], 3), _digits(4, 15)).substr(1, 15)
    fit = (10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, F.when(good, fit).otherwise((fit + 1 + _draw(5, 9)) % 10).cast("string"))
    card = (_grouped(card, [4, 4, 4, 4], sep), words(CARD_WORDS, 10))
    # National phones: groups in use, or a bare run after a word that says so; else other groups and bare runs.
    d = F.concat((_draw(6, 8) + 2).cast("string"), _digits(7, 11))
    closed = F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))
    small = _pick([".", "-", " "], 8)
    bare = _draw(9, 5) == 0
    phone = F.when(bare, F.substring(d, 1, 10)).when(_draw(20, 3) == 0, closed).otherwise(_grouped(d, [3, 3, 4], small))
    other = F.when(bare, F.substring(d, 1, 10)).when(_draw(20, 3) == 0, _grouped(d, [2, 2, 2, 2], small)).when(_draw(20, 3) == 1, _grouped(d, [4, 3, 5], small)).otherwise(_grouped(d, [1, 3, 3, 3], small))
    phone = (F.when(good, phone).otherwise(other), F.when(bare & good, _pick(PHONE_WORDS, 21)).when(bare, _pick(PLAIN_WORDS, 22)).otherwise(words(PHONE_WORDS, 23)))
    # Social security numbers: area, group and number that are given out, or not.
    area = F.lpad((_draw(30, 665) + 1).cast("string"), 3, "0")
    fine = F.concat_ws("-", area, F.lpad((_draw(31, 99) + 1).cast("string"), 2, "0"), F.lpad((_draw(32, 9999) + 1).cast("string"), 4, "0"))
    wrong = F.when(_draw(33, 3) == 0, F.concat(_pick(["000", "666", "912", "987"], 34), F.substring(fine, 4, 8))).when(_draw(33, 3) == 1, F.concat(area, F.lit("-00-"), F.substring(fine, 8, 4))).otherwise(F.concat(F.substring(fine, 1, 7), F.lit("0000")))
    ssn = (F.when(good, fine).otherwise(wrong), words(ID_WORDS, 35))
    # Account numbers: check digits that fit, or not; in one run or in fours.
    shapes = [F.concat(F.lit(c), F.lit("00"), _digits(40 + k, n)) for k, (c, n) in enumerate(ACCOUNTS)]
    raw = F.element_at(F.array(*shapes), (_draw(50, len(shapes)) + 1).cast("int"))
    check = F.lit(98) - mod97(raw)
    check = F.when(good, check).otherwise((check + 1 + _draw(51, 95) - 2) % 97 + 2)
    code = F.concat(F.substring(raw, 1, 2), F.lpad(check.cast("string"), 2, "0"), F.substring(raw, 5, 40))
    code = (F.when(_draw(52, 2) == 0, code).otherwise(F.trim(F.regexp_replace(code, "(.{4})", "$1 "))), words(ID_WORDS, 53))
    # Spelled-out addresses: a host that ends in a name, or a place in brackets.
    at, dot = _pick(["[at]", "(at)", " [at] ", " (at) "], 60), _pick([".", "[dot]", " (dot) ", " [dot] "], 61)
    mail = F.concat(_pick(NAMES, 62), at, _pick(HOSTS, 63), F.when(good, F.concat(dot, _pick(ENDS, 64))).otherwise(""))
    mail = (mail, words(MAIL_WORDS, 65))
    # Long runs of numbers that are none of these.
    run = (F.array_join(F.transform(F.sequence(F.lit(1), (_draw(70, 20) + 5).cast("int")), lambda i: F.pmod(F.xxhash64("id", i), F.lit(1000)).cast("string")), " "), _pick(PLAIN_WORDS, 71))
    kinds = [card, phone, ssn, code, mail, run]
    kind = _draw(80, len(kinds))
    choose = lambda part: F.element_at(F.array(*[k[part] for k in kinds]), (kind + 1).cast("int"))
    made = spark.range(rows).select("id", choose(0).alias("hit"), F.concat(_pick(PLAIN_WORDS, 81), F.lit(" "), choose(1), _pick([" ", ": ", " = "], 82)).alias("lead"), (good & (kind < 5)).cast("int").alias("y"))
    return made.select("id", F.concat("lead", "hit", F.lit(" "), _pick(PLAIN_WORDS, 83)).alias("text"), F.length("lead").alias("start"), (F.length("lead") + F.length("hit")).alias("end"), "y")
