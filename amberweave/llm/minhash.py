"""MinHash near-dedup with HyperMinHash registers.

Each register keeps the leading-zero count and ten mantissa bits of the smallest hash
that its own hash function gives over a document's shingles, in 16 bits. Every bucket has
a hash function of its own, so short texts leave none empty. Bands of compressed
registers give candidates, a collision-corrected Jaccard estimate thins them, and full
shingle sets confirm what is left.
"""

from __future__ import annotations

import functools
import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, lookup
from .components import components, star_pairs

ROWS, BANDS, MANTISSA = 5, 32, 10
REGISTERS = ROWS * BANDS
#: Estimates within this many standard deviations under the threshold go on to be verified.
SLACK = 5.0
#: Bands of the first round. Documents from which the order of shingles is taken, and how many common ones go last;
#: any order gives the same links.
FIRST_BANDS, ORDER_SAMPLE, COMMON = 4, 5000, 100_000
#: Longs of parity bits that go with a shingle.
PARITY = 8
SIG = "doc_id long, n_shingles long, klass binary, regs binary, bands array<long>"


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


@functools.lru_cache(1)
def _words() -> _Words:
    return _Words()


@functools.lru_cache(1)
def _hashers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 2**32, REGISTERS, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of an A-Z lower-cased UTF-8 text."""
    words = text.lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def registers(s: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash per bucket, as uint16."""
    mul, add = _hashers()
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    short = (s ^ (s >> np.uint64(32))).astype(np.uint32)  # 32-bit products are vectorised
    for k in range(0, len(s), 256):
        least = np.minimum(least, (short[k : k + 256, None] * mul + add).min(axis=0))
    m, e = np.frexp(np.maximum(least, np.uint32(1)).astype(np.float64))
    bits = np.minimum(((m - 0.5) * 2 * 2**MANTISSA).astype(np.uint16), 2**MANTISSA - 1)
    return (np.clip(32 - e, 0, 63).astype(np.uint16) << MANTISSA) | bits.astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    r = regs.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + r[:, k])
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from matching registers, less the matches that unrelated minima of n and m shingles give by chance.

    For minima of rate n and m the chance of one cell of relative width 2^-MANTISSA
    within an octave is about 2^-MANTISSA / (2 ln 2) * nm / (n + m)^2.
    """
    share = (a == b).mean(axis=1)
    c = 2.0**-MANTISSA / (2 * np.log(2)) * n * m / (n + m) ** 2
    return np.clip((share - c) / (1 - c), 0, 1)


def _signatures(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut(batches):
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        n, klass, regs, keys = [], [], [], []
        for text in texts:
            s = shingles(text or b"", size)
            n.append(len(s))
            klass.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            r = registers(s) if len(s) else None
            regs.append(None if r is None else r.tobytes())
            keys.append(None if r is None else bands(r))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(klass, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "klass", "regs", "bands"],
        )


def _tokens(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in cut(batches):
        for text in batch.column(0).cast(pa.binary()).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text or b"", size).astype(np.int64))], names=["token"])


def _near(threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    low = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
        n, m = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        ok = (estimate(a, b, n, m) >= low) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _confirm(size: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: OrderedDict[int, np.ndarray] = OrderedDict()  # the left document repeats in a run of pairs

    def of(doc: int, text: bytes) -> np.ndarray:
        if doc not in held:
            held[doc] = shingles(text, size)
            if len(held) > 64:
                held.popitem(last=False)
        return held[doc]

    for batch in cut(batches):
        keep = []
        for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in ("a", "b")), *(batch.column(k).cast(pa.binary()).to_pylist() for k in ("ta", "tb"))):
            x, y = of(a, ta), of(b, tb)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _rare_first(size: int, common: np.ndarray, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix of each set in the order (not common, then hash): what two sets of the threshold must share one of.

    Each row carries the set's parities: bit k tells whether an odd number of shingles fall on k. Two
    sets differ in at least as many shingles as their parities differ in bits.
    """
    names = ["id", "n", "token", "at", *(f"p{k}" for k in range(PARITY))]
    for batch in cut(batches):
        out = [[] for _ in names]
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            s = shingles(text or b"", size)
            k = np.minimum(np.searchsorted(common, s), max(len(common) - 1, 0))
            known = common[k] == s if len(common) else np.zeros(len(s), bool)
            parity = np.packbits(np.bincount((s >> np.uint64(20)) % np.uint64(64 * PARITY), minlength=64 * PARITY) & 1).view(np.int64)
            keep = len(s) - -(-percent * len(s) // 100) + 1
            first = s[np.argsort(known, kind="stable")][:keep].astype(np.int64)
            cols = (np.full(keep, doc), np.full(keep, len(s)), first, np.arange(1, keep + 1), *(np.full(keep, p) for p in parity))
            for col, v in zip(out, cols):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names=names)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of documents by the Jaccard similarity of their word shingles.

    Returns one row per input row: doc_id, n_shingles, component_id, kept. Texts of
    equal shingle sets form a class first, so copies are never paired; classes are linked
    where 100 * intersection >= percent * union, and component_id is the least doc_id
    reachable. Null or wordless texts have no shingles and link with nothing. A row of
    null doc_id gets its n_shingles and a null component and kept. Rows that repeat a
    doc_id are one node; each still gives a row. Other columns are not looked at. The
    banding misses a pair at the threshold itself with a chance of about three in a million.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = scratch.put(own.mapInArrow(functools.partial(_signatures, shingle), SIG), "sig")
    classes = scratch.put(sig.where("klass is not null and doc_id is not null").groupBy("klass").agg(F.min("doc_id").alias("rep")), "classes")
    # One row for each class: its least doc_id stands for it.
    reps = sig.join(classes, (sig.klass == classes.klass) & (sig.doc_id == classes.rep), "left_semi").dropDuplicates(["doc_id", "klass"])
    reps = scratch.put(reps.select("doc_id", "n_shingles", "regs", "bands"), "reps")
    regs = reps.select("doc_id", "n_shingles", "regs")

    def verify(pairs: DataFrame) -> DataFrame:
        side = lambda k: regs.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("regs").alias(f"r{k}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b")
        verify.k += 1
        near = scratch.put(near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(functools.partial(_near, percent / 100), "a long, b long"), f"near_{verify.k}")
        needed = near.select(F.col("a").alias("doc_id")).unionByName(near.select(F.col("b").alias("doc_id"))).distinct()
        texts = own.join(needed, "doc_id", "left_semi")
        side = lambda k: texts.select(F.col("doc_id").alias(k), F.col("text").alias(f"t{k}"))
        full = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
        return full.mapInArrow(functools.partial(_confirm, shingle, percent), "a long, b long").distinct()

    verify.k = 0
    # A few bands find most links and gather large groups; the others then see components, not members.
    first = reps.select(F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"), F.col("doc_id").alias("id"))
    edges = scratch.put(verify(star_pairs(first)), "edges_1")
    found = scratch.put(components(edges, scratch, "cc1"), "found_1")

    def strays(name: str) -> DataFrame:
        """Members of buckets with several components, outside of the component of the bucket's least id."""
        named = reps.join(found, reps.doc_id == found.id, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("c"), "bands")
        named = named.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "c", F.explode("bands").alias("bucket"))
        lead = named.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("id").alias("lead"), F.min_by("c", "id").alias("main"), F.min_by("n", "id").alias("lead_n")).where("low < high").drop("low", "high")
        return scratch.put(named.join(lead, "bucket").where("c != main"), name)

    share = percent / 100
    apart = lambda x, y: F.least(x, y) >= share * F.greatest(x, y) - 1e-9
    pairs = strays("strays_1").where(apart("n", "lead_n")).select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()
    # Components stand for all links before them.
    linked = lambda found: found.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    edges = linked(found).unionByName(scratch.put(verify(pairs), "edges_2"))
    found = scratch.put(components(edges, scratch, "cc2"), "found_2")
    rest = strays("strays_2")
    open_ = scratch.put(rest.select("bucket").distinct(), "open")
    if open_.count():
        # What is left may link to any member of its buckets. Shared rare shingles find those it can link to.
        probes = rest.select("id").distinct()
        members = reps.select("doc_id", F.explode("bands").alias("bucket")).join(lookup(open_), "bucket", "left_semi").select("doc_id").distinct()
        texts = scratch.put(own.join(members, "doc_id", "left_semi"), "members")
        # Shingles that a sample holds more than twice go last. Any order gives the same links.
        sample = scratch.put(texts.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(ORDER_SAMPLE), "sample")
        tokens = texts.join(F.broadcast(sample), "doc_id", "left_semi").select("text").mapInArrow(functools.partial(_tokens, shingle), "token long")
        tokens = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(COMMON)
        common = np.sort(np.array([r[0] for r in tokens.select("token").collect()], np.int64).view(np.uint64))
        bits = [f"p{k}" for k in range(PARITY)]
        rare = texts.mapInArrow(functools.partial(_rare_first, shingle, common, percent), "id long, n long, token long, at long, " + ", ".join(f"{b} long" for b in bits))
        rare = scratch.put(rare.join(found, "id", "left").select("id", "n", "token", "at", *bits, F.coalesce("component_id", "id").alias("c")), "rare")
        p = rare.join(probes, "id", "left_semi").select("token", *[F.col(c).alias(f"{c}_") for c in ("id", "n", "at", "c", *bits)])
        # Of two sets that reach the threshold, the tokens from the first shared one on must suffice for the overlap.
        need = F.ceil(share / (1 + share) * (F.col("n") + F.col("n_")) - 1e-9)
        can = (F.col("c") != F.col("c_")) & (1 + F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_")) >= need) & apart("n", "n_")
        differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_"))) for b in bits[1:]), F.bit_count(F.col("p0").bitwiseXOR(F.col("p0_"))))
        can = can & (differ * (1 + share) <= (F.col("n") + F.col("n_")) * (1 - share) + 1e-6)
        pairs = rare.join(p, "token").where(can).select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b")).distinct()
        edges = linked(found).unionByName(scratch.put(verify(pairs), "edges_3"))
        found = components(edges, scratch, "cc3")
    of_class = classes.join(found, classes.rep == found.id, "left").select("klass", F.coalesce("component_id", "rep").alias("c"))
    out = sig.select("doc_id", "n_shingles", "klass").join(of_class, "klass", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
