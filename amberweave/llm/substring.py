"""Substring dedup with difference-cover anchors.

Two equal windows of W words contain equal short anchors at places that both count as
cover positions, whatever their offsets: positions are taken modulo a period v, and every
difference occurs between two members of the cover. So only |D|/v of the places
are hashed. Where an anchor repeats, it is extended to the whole windows around it.

Documents travel as compressed blocks. Hashes go out as packed arrays, cut by
range, one row for each block and range; verdicts come back as bits.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, partitions
from .minhash import _mix, _words

#: A difference cover modulo 13; each residue is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words or rows a range of hashes should hold, documents and bytes of text in a block.
RANGE, BLOCK_DOCS, BLOCK_BYTES = 2_000_000, 256, 2_000_000
BLOCKS = "block long, n_words long, ids binary, sizes binary, texts binary"
PACKED = "block long, part long, low binary, ids binary, base long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

    def block() -> pa.RecordBatch:
        ids, texts = zip(*held)
        words = sum(len(t.split()) for t in texts)
        row = [[part + k], [words], [np.array(ids, np.int64).tobytes()], [np.array([len(t) for t in texts], np.int64).tobytes()], [zstandard.compress(b"".join(texts), 3)]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["block", "n_words", "ids", "sizes", "texts"])

    for batch in cut(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            text = text or b""
            if held and (len(held) >= BLOCK_DOCS or size + len(text) > BLOCK_BYTES):
                yield block()
                k, held, size = k + 1, [], 0
            held.append((doc, text))
            size += len(text)
    if held:
        yield block()


class _Block:
    """Words of a block's documents as one array of hashes; no window crosses a document."""

    def __init__(self, ids: bytes, sizes: bytes, texts: bytes):
        raw, sizes = zstandard.decompress(texts), np.frombuffer(sizes, np.int64)
        ends = np.cumsum(sizes)
        self.ids = np.frombuffer(ids, np.int64)
        self.words = [raw[e - n : e].split() for e, n in zip(ends, sizes)]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(self.n) - self.n
        know = _words().__getitem__
        self.hash = np.fromiter((know(w) for words in self.words for w in words), np.uint64, int(self.n.sum()))
        self.at = np.arange(len(self.hash)) - np.repeat(self.first, self.n)  # position within its document
        self.left = np.repeat(self.n, self.n) - self.at  # words from here to the end

    def grams(self, size: int, where: np.ndarray, by: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        out = np.full(len(where), size, np.uint64)
        for k in range(size):
            out = _mix(out * np.uint64(by) + self.hash[where + k])
        return out

    def pairs(self, window: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window, which together tell windows apart."""
        return self.grams(window, where), self.grams(window, where, 0xA0761D6478BD642F)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Cover positions of documents that hold a window, and the hashes of their anchors."""
        size = window - PERIOD + 1
        on = np.isin(self.at % PERIOD, COVER) & (self.left >= size) & (np.repeat(self.n, self.n) >= window)
        where = np.nonzero(on)[0]
        return where, self.grams(size, where)

    def windows(self, window: int, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold one of the repeated anchors."""
        near = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(near, np.maximum(repeated - PERIOD + 1, repeated - self.at[repeated]), 1)
        np.add.at(near, repeated + 1, -1)
        return np.nonzero((np.cumsum(near[:-1]) > 0) & (self.left >= window))[0]


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash by its upper 32 bits, so that sorted hashes are grouped by range."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _split(block: int, h: np.ndarray, parts: int, low: np.ndarray, ids: np.ndarray | None, base: int) -> list[tuple]:
    """Rows of packed arrays, one for each range that the sorted hashes h reach."""
    part = _part_of(h, parts)
    cuts = np.flatnonzero(np.diff(part)) + 1
    lows, docs = np.split(low, cuts), np.split(ids, cuts) if ids is not None else None
    starts = part[np.concatenate(([0], cuts))] if len(part) else []
    return [(block, int(p), x.tobytes(), docs[k].tobytes() if docs else b"", base) for k, (p, x) in enumerate(zip(starts, lows))]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["block", "part", "low", "ids", "base"])


def _send_anchors(window: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in (x for one in cut([batch], 1) for x in one.to_pylist()):
            _, h = _Block(r["ids"], r["sizes"], r["texts"]).anchors(window)
            h, n = np.unique(h, return_counts=True)
            # 31 bits within the range are enough for a filter; the last bit tells of a repeat inside the block.
            low = (h.astype(np.uint32) & np.uint32(0xFFFFFFFE)) | (n > 1).astype(np.uint32)
            yield _rows(_split(r["block"], h, parts, low, None, 0))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one range after another (the partition is sorted by range)."""
    held, part = [], None
    for batch in cut(batches, 64):
        for r in batch.to_pylist():
            if held and r["part"] != part:
                yield held
                held = []
            part = r["part"]
            held.append(r)
    if held:
        yield held


def _judge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches):
        each = [np.frombuffer(r["low"], np.uint32) for r in rows]
        low = np.concatenate(each)
        _, back, n = np.unique(low >> np.uint32(1), return_inverse=True, return_counts=True)
        yield from _answers(rows, each, (n[back] > 1) | (low & np.uint32(1) == 1))


def _answers(rows: list[dict], each: list[np.ndarray], yes: np.ndarray) -> Iterator[pa.RecordBatch]:
    cuts, out = np.cumsum([len(x) for x in each])[:-1], []
    for r, bits in zip(rows, np.split(yes, cuts)):
        if bits.any():
            out.append((r["block"], r["part"], np.packbits(bits).tobytes(), b"", 0))
    yield _rows(out)


def _flags(h: np.ndarray, parts: int, answers: list[dict]) -> np.ndarray:
    """Verdicts of all ranges in the order of the sorted hashes h."""
    part, out = _part_of(h, parts), np.zeros(len(h), bool)
    for a in answers or ():
        lo, hi = np.searchsorted(part, [a["part"], a["part"] + 1])
        out[lo:hi] = np.unpackbits(np.frombuffer(a["low"], np.uint8), count=hi - lo).astype(bool)
    return out


def _candidates(b: _Block, window: int, parts: int, answers: list[dict]) -> np.ndarray:
    where, h = b.anchors(window)
    if not len(where) or not answers:
        return np.empty(0, np.int64)
    sorted_h, back = np.unique(h, return_inverse=True)
    return b.windows(window, where[_flags(sorted_h, parts, answers)[back]])


def _distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of h and g in order, and the place of each among them."""
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return h[new], g[new], back


def _send_windows(window: int, parts: int, wide: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in (x for one in cut([batch], 1) for x in one.to_pylist()):
            b = _Block(r["ids"], r["sizes"], r["texts"])
            where = _candidates(b, window, parts, r["answers"])
            if not len(where):
                continue
            h, g, back = _distinct(*b.pairs(window, where))
            doc = np.full(len(h), np.iinfo(np.int64).max)
            np.minimum.at(doc, back, np.repeat(b.ids, b.n)[where])
            base = int(doc.min())
            span = int(doc.max()) - base
            kind = np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.uint64
            yield _rows(_split(r["block"], h, wide, np.stack([h, g], axis=1), (doc - base).astype(kind), base))


def _judge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches):
        each = [np.frombuffer(r["low"], np.uint64).reshape(-1, 2) for r in rows]
        kinds = {2: np.uint16, 4: np.uint32, 8: np.uint64}
        doc = np.concatenate([np.frombuffer(r["ids"], kinds[len(r["ids"]) // max(len(x), 1)]).astype(np.int64) + r["base"] for r, x in zip(rows, each)])
        both = np.concatenate(each)
        _, _, back = _distinct(both[:, 0], both[:, 1])
        least = np.full(back.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, back, doc)
        yield from _answers(rows, each, doc > least[back])


def _cut(window: int, parts: int, wide: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in (x for one in cut([batch], 1) for x in one.to_pylist()):
            b = _Block(r["ids"], r["sizes"], r["texts"])
            gone = np.zeros(len(b.hash) + 1, np.int64)
            where = _candidates(b, window, parts, r["answers"])
            if len(where):
                sorted_h, _, back = _distinct(*b.pairs(window, where))
                doc = np.repeat(b.ids, b.n)[where]
                order = np.lexsort((where, doc, back))  # first of a block: least document, then least start
                first = np.zeros(len(back), bool)
                first[order] = np.concatenate(([True], back[order][1:] != back[order][:-1]))
                # Rows that repeat a doc_id are not earlier than each other.
                row, head = np.repeat(np.arange(len(b.n)), b.n)[where], np.maximum.accumulate(np.where(first[order], np.arange(len(back)), 0))
                tie = np.zeros(len(back), bool)
                tie[order] = (doc[order] == doc[order][head]) & (row[order] != row[order][head])
                later = _flags(sorted_h, wide, r["found"])[back]
                hit = where[later | ~(first | tie)]
                np.add.at(gone, hit, 1)
                np.add.at(gone, hit + window, -1)
            keep = np.cumsum(gone[:-1]) == 0
            out = []
            for words, at, n, doc in zip(b.words, b.first, b.n, b.ids):
                own = keep[at : at + n]
                text = b" ".join(compress(words, own))
                out.append((int(doc), int(n), int(n - own.sum()), hashlib.sha256(text).hexdigest(), text))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if k != pa.string() or not c or isinstance(c[0], str) else pa.array(c, pa.binary()).cast(k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier: in a document of smaller id, or further left in the same one; windows are judged on the
    input. Words are runs of other than ASCII white space, unchanged; null texts have none. Returns one
    row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words
    joined by one space). Rows of null id are returned as they are, in no order with the others, so
    nothing of them is removed. Rows that repeat an id are not earlier than each other.
    Windows are equal if two 64-bit hashes over the hashes of their words are: of 10^13 windows a wrong pair is
    expected with a chance under 10^-12, but for words whose own 64-bit hashes agree.
    """
    if window < PERIOD + 4:
        raise ValueError(f"windows of fewer than {PERIOD + 4} words leave too short anchors")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.put(own.where("doc_id is not null").mapInArrow(_blocks, BLOCKS), "blocks")
    words, n = (blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]), partitions(spark)
    parts = max(4 * n, -(-words * len(COVER) // (PERIOD * RANGE)))
    packed = lambda f, source: source.mapInArrow(f, PACKED)
    dealt = lambda df: df.repartition(max(n, parts // 4), "part").sortWithinPartitions("part")
    listed = lambda df, name: df.select("block", "part", "low").groupBy("block").agg(F.collect_list(F.struct("part", "low")).alias(name))  # noqa: E731  at most one row a range
    anchors = packed(functools.partial(_send_anchors, window, parts), blocks.select("block", "ids", "sizes", "texts"))
    answers = scratch.put(listed(dealt(anchors).mapInArrow(_judge_anchors, PACKED), "answers"), "answers")
    with_answers = scratch.put(blocks.join(answers, "block", "left"), "answered")
    scratch.free("blocks")
    windows = packed(functools.partial(_send_windows, window, parts, parts), with_answers.where("answers is not null").select("block", "ids", "sizes", "texts", "answers"))
    found = scratch.put(listed(dealt(windows).mapInArrow(_judge_windows, PACKED), "found"), "found")
    last = with_answers.join(found, "block", "left").select("block", "ids", "sizes", "texts", "answers", "found")
    kept = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    out = last.mapInArrow(functools.partial(_cut, window, parts, parts), kept)
    # Rows of null id, word by word as they are.
    text = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), " ")
    rest = own.where("doc_id is null").select("doc_id", text.alias("t")).select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", " "))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2("t", 256).alias("kept_sha256"), F.col("t").alias("kept_text"))
    return out.unionByName(rest)
