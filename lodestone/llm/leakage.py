"""Problem 8: evaluation texts leaking into training text.

Pigeonhole matching: a passage of ``min_words`` words with at most ``errors`` wrong ones holds at
least one undamaged aligned block of an item; blocks are found by exact hits of a rolling hash and
each hit is verified, word for word or by Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
FOUND = "doc_id long, item_id long, n_words int, first_word int, distance int"
_M = 0xFFFFFFFFFFFFFFFF
_B = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Word -> 64-bit hash, computed once for each distinct word of a worker."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def word_hashes(text: str, ids: dict) -> np.ndarray:
    """Hashes of the words of ``text``; letter case and everything between words is ignored."""
    words = WORD.findall(text.lower())
    return np.fromiter(map(ids.__getitem__, words), dtype=np.uint64, count=len(words))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` successive words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= _B
        out += h[j : j + n] ^ (h[j : j + n] >> np.uint64(29))
    return out ^ (out >> np.uint64(31))


def myers(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any run of ``text``, and where that run ends.

    Bit-parallel over symbols (here word hashes); a pattern may be of any length, as Python's
    integers serve as bit vectors.
    """
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[int, int] = {}
    for i, s in enumerate(pattern.tolist()):
        peq[s] = peq.get(s, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, at = mask, 0, m, m, 0
    for j, s in enumerate(text.tolist(), 1):
        eq = peq.get(s, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = (mv | ~(xh | pv)) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class _Index:
    """Aligned blocks of a bounded set of items."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, errors: int):
        ids = _Ids()
        self.min_words, self.errors = min_words, errors
        # a run of min_words words covers errors + 1 whole aligned blocks of this size
        self.size = max(1, (min_words + 1) // (errors + 2))
        self.ids = [i for i, _ in items]
        self.words = [word_hashes(t or "", ids) for _, t in items]
        keys, item, pos = [], [], []
        for k, w in enumerate(self.words):
            r = rolled(w, self.size)[:: self.size]
            keys.append(r)
            item.append(np.full(len(r), k))
            pos.append(np.arange(len(r)) * self.size)
        if keys:
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            self.key, self.item, self.pos = key[order], np.concatenate(item)[order], np.concatenate(pos)[order]
        else:
            self.key = np.empty(0, np.uint64)

    def search(self, doc: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Item number -> (matched words, first word in the document, distance)."""
        found: dict[int, tuple[int, int, int]] = {}
        r = rolled(doc, self.size)
        if not len(r) or not len(self.key):
            return found
        lo = np.searchsorted(self.key, r, "left")
        hit = np.flatnonzero((lo < len(self.key)) & (self.key[np.minimum(lo, len(self.key) - 1)] == r))
        done: dict[int, set[int]] = {}
        for p in hit.tolist():
            j = int(lo[p])
            while j < len(self.key) and self.key[j] == r[p]:
                k, q = int(self.item[j]), int(self.pos[j])
                j += 1
                diagonal = p - q
                if diagonal in done.setdefault(k, set()):
                    continue
                got = self._verify(doc, self.words[k], p, q)
                if got is not None:
                    n, first, dist = got
                    if k not in found or (n, -dist) > (found[k][0], -found[k][2]):
                        found[k] = got
                    done[k].add(diagonal)
        return found

    def _verify(self, doc: np.ndarray, item: np.ndarray, p: int, q: int) -> tuple[int, int, int] | None:
        a, b = p, q
        while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
            a -= 1
            b -= 1
        c, d = p, q
        while c < len(doc) and d < len(item) and doc[c] == item[d]:
            c += 1
            d += 1
        if c - a >= self.min_words:
            return c - a, a, 0
        if not self.errors:
            return None
        best = None
        for start in range(max(0, q + self.size - self.min_words), min(q, len(item) - self.min_words) + 1):
            around = doc[max(0, p - q + start - self.errors) : p - q + start + self.min_words + self.errors]
            dist, at = myers(item[start : start + self.min_words], around)
            if dist <= self.errors and (best is None or dist < best[2]):
                best = (self.min_words, max(0, max(0, p - q + start - self.errors) + at - self.min_words), dist)
        return best


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = 12, errors: int = 0, block_chars: int = 16_000_000) -> DataFrame:
    """``(doc_id, item_id, n_words, first_word, distance)`` of every document holding an item's passage.

    A passage is ``min_words`` successive words of the item with at most ``errors`` words changed,
    left out or put in; of several in one document the longest, then most exact one is reported.
    Items are read in blocks of about ``block_chars`` characters, each searched through all
    documents, so no broadcast grows with the item table. Null or empty texts, and items of fewer
    than ``min_words`` words, match nothing; a repeated document id is reported once.
    """
    spark = documents.sparkSession
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_chars))
    docs = documents.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    out = None
    for b in range(n_blocks):
        mine = items.select(F.col("item_id").cast("long"), "text")
        if n_blocks > 1:
            mine = mine.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b)
        rows = [(r["item_id"], r["text"]) for r in mine.collect()]
        index = spark.sparkContext.broadcast(_Index(rows, min_words, errors))

        def search(it: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            ids, ix = _Ids(), index.value
            for pdf in it:
                got = []
                for doc, text in zip(pdf["doc_id"], pdf["text"]):
                    for k, (n, first, dist) in ix.search(word_hashes(text, ids)).items():
                        got.append((doc, ix.ids[k], n, first, dist))
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "n_words", "first_word", "distance"]).astype(
                    {"doc_id": "Int64", "item_id": "Int64"}
                )

        part = docs.mapInPandas(search, FOUND)
        out = part if out is None else out.unionByName(part)
    best = F.max_by(F.struct("n_words", "first_word", "distance"), F.struct("n_words", -F.col("distance"), -F.col("first_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
