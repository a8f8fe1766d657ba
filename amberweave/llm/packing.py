"""Packing by best-fit decreasing over the whole corpus.

Only the histogram of piece lengths (at most ``window`` rows) reaches the driver. The
tightest open window is found in a segment tree indexed by remaining capacity, and
all pieces of one length are placed in bulk; the plan is a short list of rules
"ranks r.. of length L go to windows s.. at offset o". Each piece then finds its
rule from its rank within its length, which is counted without sorting any texts.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
#: Beyond these letters and marks, tables of Unicode classes may differ between the two libraries.
RARE = re.compile("[^\u0000-ɏ‐-‧€]")
UNBROKEN = re.compile(r"\S{4000}|\s{4000}")


class ByteBpe:
    """Ids of byte-level BPE: the rank table for common texts, the full tokenizer for rare ones."""

    def __init__(self, json_path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.full.no_truncation()
        self.full.no_padding()
        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_char = {c: b for b, c in byte_chars().items()}
        ranks = {bytes(of_char[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special) or not text.isascii() and RARE.search(text) or UNBROKEN.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def byte_chars() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(2)
def _bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _cut(path: str, end_id: int, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, seen, bpe = TaskContext.get().partitionId(), Counter(), _bpe(path)
    for batch in cut(batches):
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = np.append(bpe.ids(text or ""), np.uint32(end_id)).astype("<u4")
            for start in range(0, len(ids), window):
                piece = ids[start : start + window]
                rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), part, seen[len(piece)]))
                seen[len(piece)] += 1
        cols = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.int32(), pa.int64()])]
        if rows:
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])


class CapacityTree:
    """Counts of open windows by remaining capacity; finds the least capacity that still fits."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        k = need + self.size
        if self.count[k]:
            return need
        while k > 1:  # up until a right sibling holds a window, then down its left edge
            if not k & 1 and self.count[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit(lengths: dict[int, int], window: int) -> list[tuple[int, int, int, int]]:
    """Rules (length, first rank, first window, offset) of best-fit decreasing; see place().

    A rule holds for the ranks from its first rank to the next rule of its length:
    rank r goes to window first + (r - first rank). Pieces of one length are alike, so
    whole runs of windows of one capacity are filled at once.
    """
    tree, runs, rules, opened = CapacityTree(window), {}, [], 0

    def open_run(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            runs.setdefault(capacity, []).append((first, n))
            tree.add(capacity, n)

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = window, window // length
                n = -(-left // each)
                first, opened = opened, opened + n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
                each = room // length
            whole = min(n, left // each)
            for slot in range(each if whole else 0):
                rules.append((length, rank, first, window - room + slot * length))
                rank += whole
            left -= whole * each
            open_run(room - each * length, first, whole)
            if whole < n:
                for slot in range(left if left < each else 0):
                    rules.append((length, rank, first + whole, window - room + slot * length))
                    rank += 1
                used = left if left < each else 0
                left -= used
                open_run(room - used * length, first + whole, 1)
                open_run(room, first + whole + 1, n - whole - 1)
    return rules


def _place(rules: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((rules[:, 1], rules[:, 0]))
    rules = rules[order]
    first_of = {int(n): k for k, n in reversed(list(enumerate(rules[:, 0])))}
    ends = np.append(np.nonzero(np.diff(rules[:, 0]))[0] + 1, len(rules))
    last_of = {int(rules[e - 1, 0]): int(e) for e in ends} if len(rules) else {}
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        at = np.empty(len(length), np.int64)
        for n in np.unique(length):
            own = length == n
            lo, hi = first_of[int(n)], last_of[int(n)]
            at[own] = lo + np.searchsorted(rules[lo:hi, 1], rank[own], "right") - 1
        seq, off = rules[at, 2] + rank - rules[at, 1], rules[at, 3]
        keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(seq), pa.array(off)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into windows of ``window`` ids.

    A document is its ids and ``end_id``; null and empty texts are the end id alone, and
    each row of the input is packed, repeated or of null id or not. Documents longer than
    a window are cut into full windows and a rest. Returns one row per piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset. An empty table gives no pieces.
    Ties between pieces of one length fall by input partition and position.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.put(own.mapInArrow(functools.partial(_cut, tokenizer, end_id, window), PIECES), "pieces")
    counts = scratch.put(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `window` rows
    rules = np.array(best_fit(histogram, window), np.int64).reshape(-1, 4)
    ranked = pieces.join(starts, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInArrow(functools.partial(_place, rules), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
