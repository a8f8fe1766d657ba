"""BPE by backtracking: longest token matches checked against the pair table.

Exact merges in linear time: a token may follow another only if merging the text of
both would leave that pair. Longest matches come from an Aho-Corasick automaton over
the vocabulary; a match that cannot follow gives way to its longest proper prefix token, and where none can,
the token before is taken back and that place is barred.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut
from .packing import RARE, byte_chars

#: White space as the vocabulary's normalizer takes it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CACHE = 600_000
CODED = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"


class WordBpe:
    """Encoder and decoder of a lower-casing BPE vocabulary with word ends, from its JSON file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.full = spec["model"], Tokenizer.from_file(path)
        self.end, vocab = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.chars = byte_chars()
        self.table = {b: c for b, c in self.chars.items()}
        self.mark = "\u0003"  # stands for the word end inside the automaton; no byte is written as it
        own = lambda t: t[: -len(self.end)] + self.mark if t.endswith(self.end) else t
        # Rank of a symbol: base symbols come before every merge, merges in their order.
        ranked = {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = {a + b for a, b in merges}
        base = sorted((t for t in vocab if t not in made), key=vocab.get)
        for t in base:
            ranked[t] = len(ranked)
        self.pairs, self.halves = {}, [(k, k) for k in range(len(base))]
        for a, b in merges:
            t = a + b
            if t not in ranked:
                ranked[t] = len(ranked)
                self.halves.append((ranked[a], ranked[b]))
            self.pairs[ranked[a], ranked[b]] = ranked[t]
        self.ids = [vocab[t] for t in ranked]
        self.length = [len(own(t)) for t in ranked]
        usable = [t for t, k in ranked.items() if k < len(base) or self._follows(*self.halves[k], limit=k)]
        self.usable = {own(t): ranked[t] for t in usable}
        self.shorter = {}
        self.auto = ahocorasick.Automaton()
        for t, k in self.usable.items():
            # Reversed words: a match that ends at a place in the reversed text begins there in the text.
            self.auto.add_word(t[::-1], k)
            self.shorter[k] = next((self.usable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.usable), None)
        self.auto.make_automaton()
        self.packed = [int(i).to_bytes(4, "little") for i in self.ids]
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [by_id.get(i, "").encode() + b" " for i in range(max(by_id) + 1)]
        self.offset = np.cumsum([0, *map(len, texts)])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.plain_words = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.cache: dict[str, bytes] = {}
        self.may: dict[tuple[int, int], bool] = {}  # the pair-compatibility table, filled as pairs come up

    def _follows(self, left: int, right: int, limit: int = 1 << 60) -> bool:
        """Whether merging the text of both tokens would leave just this pair (or merge it last, as `limit`)."""
        while True:
            made = self.pairs.get((left, right))
            if made is not None and made < limit:
                return False
            # Undo the younger of the two merges and look across the seam again.
            if left > right:
                limit, inner = left, self.halves[left][1]
                if inner != left:
                    left = inner
                    continue
                limit, inner = right + 1, self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                limit, inner = right + 1, self.halves[right][0]
                if inner != right:
                    right = inner
                    continue
                limit, inner = left, self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def word(self, symbols: str) -> bytes:
        """Ids of one word (its byte characters and the end mark), packed as 32-bit integers."""
        known = self.usable.get(symbols)
        if known is not None:
            return self.packed[known]
        n = len(symbols)
        longest: list[int | None] = [None] * (n + 1)
        for end, k in self.auto.iter(symbols[::-1]):  # all matches; of those that begin at a place the longest comes first
            at = n - 1 - end
            if longest[at] is None:
                longest[at] = k
        may, length = self.may, self.length
        if len(may) > CACHE:
            may.clear()
        barred, out, at, token = bytearray(n + 1), [], 0, longest[0]
        barred[n - 1] = 1  # no token ends between the last character and its end mark
        while token is not None:
            last, k = out[-1] if out else None, token
            while k is not None:
                if not barred[at + length[k]]:
                    if last is None:
                        break
                    ok = may.get((last, k))
                    if ok is None:
                        ok = may[last, k] = self._follows(last, k)
                    if ok:
                        break
                k = self.shorter[k]
            if k is not None:
                out.append(k)
                at += length[k]
                token = longest[at]
            else:
                barred[at] = 1
                token = out.pop()
                at -= length[token]
        return b"".join(map(self.packed.__getitem__, out))

    def _symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table) + self.mark

    def _part(self, text: str) -> bytes:
        if text.isascii():
            words = self.plain_words.findall(text.lower())
        elif not RARE.search(text):
            words = self.words.findall(self.spaces.sub(" ", unicodedata.normalize("NFC", text)).lower())
        else:  # rare letters: the vocabulary's own normalizer and splitter decide
            back = {c: b for b, c in self.chars.items()}
            cut = self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(text))
            words = [bytes(back[c] for c in w).decode() for w, _ in cut]
        cache, out = self.cache, []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = self.word(self._symbols(w))
                if len(w) < 64:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if "<|" not in text:
            return self._part(text)
        parts = self.split_special.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._part(p) for p in parts)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: each token's bytes are copied from one buffer by the offset table."""
        out = []
        for k in range(0, len(ids), 1 << 16):
            own = ids[k : k + (1 << 16)]
            first, size = self.offset[own], self.offset[own + 1] - self.offset[own]
            shift = np.repeat(first - np.concatenate(([0], np.cumsum(size)[:-1])), size)
            out.append(self.bytes[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)[:-1]


@functools.lru_cache(1)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _code(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bpe = word_bpe(path)
    for batch in cut(batches):
        n, ids, text = [], [], []
        for t in batch.column(1).to_pylist():
            coded = bpe.encode(t or "")
            n.append(len(coded) // 4)
            ids.append(coded)
            text.append(hashlib.sha256(bpe.decode(np.frombuffer(coded, "<u4").astype(np.int64))).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(text)], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text and the digest of what they decode to.

    Returns one row per input row: doc_id, n_tokens, ids (packed little-endian unsigned
    32-bit integers), decoded_sha256. A null text counts as empty: no ids, an empty decoded text.
    No row depends on another, so null and repeated ids pass through.
    """
    Scratch(docs.sparkSession, "bpe")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return own.mapInArrow(functools.partial(_code, tokenizer), CODED)


def decode_text(ids: bytes, tokenizer: str) -> str:
    """Text of packed ids."""
    return word_bpe(tokenizer).decode(np.frombuffer(ids, "<u4").astype(np.int64)).decode()
