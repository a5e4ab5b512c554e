"""Problem 10: text garbled by a wrong character encoding, found and restored.

Expectation-maximization over latent encoding chains. A chain says how a text was garbled: its bytes
were written in one encoding and read in another. Each record has one chain or none. The E-step
weighs, for each record, how much likelier its words become when the chain is undone, under a
character model of the corpus, together with the share of that chain in the record's source; the
M-step re-estimates those shares and the character model, now on the repaired words. So a weak sign
in one record counts when its source is known for that fault.

The texts are read twice: once to take out the words beyond ASCII, with the counts of their grams,
and once to decide and repair. The rounds between run on the words of each record only. A chain is
undone for all new words of a batch at once, by table look-ups over their joined code points, and
remembered by the worker over batches and rounds.

What is broadcast has a fixed size: hashed trigram counts and one row of shares for each of 4,096
source buckets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

#: Chains as (written in, read in), applied once; a name with ``*2`` was garbled twice (fixed values).
CHAINS = (
    ("utf-8", "cp1252"),
    ("utf-8", "latin-1"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "mac_roman"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "koi8_r"),
    ("utf-8", "cp866"),
    ("utf-8", "cp1253"),
    ("utf-8", "cp1254"),
    ("utf-8", "iso8859_2"),
    ("utf-8*2", "cp1252"),
    ("utf-8*2", "latin-1"),
    ("cp1252", "latin-1"),
    ("cp1252", "mac_roman"),
    ("cp1252", "cp437"),
    ("cp1252", "cp850"),
    ("cp1252", "cp1250"),
    ("cp1252", "cp1251"),
    ("cp1252", "koi8_r"),
    ("cp1252", "cp866"),
    ("cp1252", "cp1253"),
    ("mac_roman", "cp1252"),
    ("cp437", "cp1252"),
    ("cp850", "cp1252"),
    ("cp1250", "cp1252"),
    ("cp1251", "cp1252"),
    ("cp1251", "latin-1"),
    ("cp1251", "koi8_r"),
    ("cp1251", "cp866"),
    ("cp1251", "mac_roman"),
    ("koi8_r", "cp1251"),
    ("koi8_r", "cp1252"),
    ("koi8_r", "latin-1"),
    ("koi8_r", "cp866"),
    ("cp866", "cp1251"),
    ("cp866", "cp1252"),
    ("cp866", "latin-1"),
)
K = len(CHAINS)
LOST = "�"
BUCKETS, SLOTS = 4096, 1 << 20
#: A run of letters and other characters with at least one beyond ASCII.
_UNIT = re.compile(r"[A-Za-z]*(?:[^\x00-\x7f]+[A-Za-z]*)+")
_ENTITY = re.compile(r"&#(?:(\d{3,5})|[xX]([0-9A-Fa-f]{2,4}));|\\u([0-9A-Fa-f]{4})")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")
#: Costs: of claiming that a word is garbled; credit for each sequence that reads as UTF-8.
CLAIM, UTF8_CREDIT, CLEAN_PRIOR = 1.0, 3.0, 0.95
#: Gain from which a word that is left as it was counts as still garbled.
SURE = 6.0


@lru_cache(maxsize=None)
def _to_bytes(codec: str) -> np.ndarray:
    """Byte of each code point below 2^16 in a one-byte codec, -1 without one; ASCII and undefined bytes stand for themselves."""
    out = np.full(1 << 16, -1, np.int16)
    out[:128] = np.arange(128)
    defined = set()
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
            defined.add(b)
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        # readers pass undefined bytes through as control characters, some all of them
        if out[b] < 0 and (b not in defined or (b < 160 and codec in ("cp1252", "cp1250", "cp1254"))):
            out[b] = b
    return out


@lru_cache(maxsize=None)
def _from_bytes(codec: str) -> np.ndarray:
    """Code point of each byte in a one-byte codec; the replacement character where there is none."""
    return np.array([ord(bytes([b]).decode(codec, "replace")) for b in range(256)], "<u4")


def _utf8_inside(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words (by their starts in ``raw``) that hold a lead byte of UTF-8 and one that continues it."""
    cont, lead = (raw >= 0x80) & (raw < 0xC0), (raw >= 0xC2) & (raw < 0xF5)
    return np.add.reduceat(lead & np.r_[cont[1:], False], starts) > 0


def _strict_utf8(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=None)
def _sequence(read: str) -> re.Pattern:
    """A sequence of UTF-8 of two to four bytes, as the characters it was read as."""
    table = _to_bytes(read)

    def some(low: int, high: int) -> str:
        return "[" + "".join(re.escape(chr(c)) for c in np.flatnonzero((table >= low) & (table <= high)).tolist()) + "]"

    cont = some(0x80, 0xBF)
    return re.compile("|".join(some(*lead) + cont * n for lead, n in (((0xC2, 0xDF), 1), ((0xE0, 0xEF), 2), ((0xF0, 0xF4), 3))))


def _sequences_read(word: str, read: str) -> tuple[str, int]:
    """``word`` with each sequence of UTF-8 in it read as such, and how many there were."""
    table, n = _to_bytes(read), 0

    def char(m: re.Match) -> str:
        nonlocal n
        out = _strict_utf8(bytes(int(table[ord(c)]) for c in m[0]))
        n += out is not None
        return m[0] if out is None else out

    return _sequence(read).sub(char, word), n


def undo_all(words: list[str]) -> list[tuple[tuple[int, str, int], ...]]:
    """For each word (without line ends) the chains it can have come from: ``(chain, word undone, n)``.

    ``n`` counts the sequences that read as UTF-8; where only a part of the word does, the rest stays
    as it is and the first sequence does not count.
    """
    if not words:
        return []
    found: list[list[tuple[int, str, int]]] = [[] for _ in words]

    def keep(i: int, k: int, out: str | None, n: int = 0) -> None:
        if out and out != words[i] and LOST not in out and not _C1.search(out):
            found[i].append((k, out, n))

    joined = "\n".join(words) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.minimum(points, 0xFFFF).astype(np.int64)
    ends = np.flatnonzero(points == 10)
    starts = np.r_[0, ends[:-1] + 1]
    for read in dict.fromkeys(r for _, r in CHAINS):
        table = _to_bytes(read)
        raw = table[at]
        raw[points > 0xFFFF] = -1
        able = np.add.reduceat(raw < 0, starts) == 0
        octets = np.where(raw < 0, 63, raw).astype(np.uint8)
        for k, (written, r) in enumerate(CHAINS):
            if r != read:
                continue
            if not written.startswith("utf-8"):
                texts = _from_bytes(written)[octets].astype("<u4").tobytes().decode("utf-32-le").split("\n")
                for i in np.flatnonzero(able).tolist():
                    keep(i, k, texts[i])
                continue
            for i in np.flatnonzero(_utf8_inside(octets, starts)).tolist():
                out = _strict_utf8(octets[starts[i] : ends[i]].tobytes()) if able[i] else None
                n, part = sum(ord(c) > 127 for c in out or ""), 0
                if out is None:
                    out, n = _sequences_read(words[i], read)
                    part = 1
                if written.endswith("*2"):
                    again = table[[min(ord(c), 0xFFFF) for c in out]]
                    out = None if part or (again < 0).any() else _strict_utf8(again.astype(np.uint8).tobytes())
                    n = sum(ord(c) > 127 for c in out or "")
                keep(i, k, out, n - part)
    return [tuple(sorted(f)) for f in found]


class _Undone(dict):
    """Word -> its :func:`undo_all`, kept by a worker; forgotten when it grows large."""

    def learn(self, words: list[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > 500_000:
            self.clear()
            new = words
        self.update(zip(new, undo_all(new)))


_UNDONE = _Undone()


def unescape(text: str) -> str:
    """Numeric references and escapes of characters beyond ASCII as characters."""

    def char(m: re.Match) -> str:
        n = int(m[1]) if m[1] else int(m[2] or m[3], 16)
        return chr(n) if 128 <= n < 0xD800 or 0xE000 <= n < 0x10000 else m[0]

    return _ENTITY.sub(char, text)


def _h(*cols: np.ndarray) -> np.ndarray:
    x = np.zeros(len(cols[0]), np.uint64)
    for c in cols:
        x = (x + c.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(31)
    return (x & np.uint64(SLOTS - 1)).astype(np.int64)


def _grams(words: list[str]) -> tuple[np.ndarray, ...]:
    """Slots of the uni-, bi- and trigrams of the words, each closed in by a mark, and their owner."""
    joined = "".join("\x02\x02" + w + "\x03" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.array([len(w) + 3 for w in words])
    owner = np.repeat(np.arange(len(words)), n)
    at = np.flatnonzero(c != 2)
    one = _h(c[at])
    two = _h(c[at - 1], c[at]) + SLOTS
    ctx1 = _h(c[at - 1])
    ctx2 = _h(c[at - 2], c[at - 1]) + SLOTS
    three = _h(c[at - 2], c[at - 1], c[at]) + 2 * SLOTS
    return one, two, three, ctx1, ctx2, owner[at]


def _count_grams(words: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occupied slots and their counts; slot -1 holds the number of characters."""
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    one, two, three, _, _, owner = _grams(words)
    # the opening marks are contexts too
    first = _h(np.array([2])), _h(np.array([2]), np.array([2])) + SLOTS
    # a gram counts once for each word that holds it: a long run would else vouch for itself
    pair = np.unique(np.concatenate([owner * (3 * SLOTS) + x for x in (one, two, three)]))
    slots = np.concatenate([pair % (3 * SLOTS), first[0], first[1]])
    weight = np.concatenate([times[pair // (3 * SLOTS)], [times.sum()], [times.sum()]])
    u, inv = np.unique(slots, return_inverse=True)
    return u, np.bincount(inv, weights=weight)


class Model:
    """Interpolated trigram model over hashed counts."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        self.n = np.zeros(3 * SLOTS, np.float32)
        self.n[slots] = counts
        self.total = float(self.n[:SLOTS].sum())

    def score(self, words: list[str]) -> np.ndarray:
        one, two, three, c1, c2, owner = _grams(words)
        n = self.n
        p1 = (n[one] + 0.05) / (self.total + 200.0)
        p2 = (n[two] + 2.0 * p1) / (n[c1] + 2.0)
        p3 = (n[three] + 2.0 * p2) / (n[c2] + 2.0)
        return np.bincount(owner, weights=np.log(p3), minlength=len(words))


class _Scorer:
    """Gains of the words of a worker, each distinct word computed once."""

    def __init__(self, model: Model, log_share: np.ndarray):
        self.model, self.log_share, self.known = model, log_share, {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > 500_000:
            self.known.clear()
        todo = [w for w in words if w not in self.known]
        _UNDONE.learn(todo)
        texts, where = [], []
        for w in todo:
            self.known[w] = ()
            for k, d, n in _UNDONE[w]:
                texts.append(d)
                where.append((w, k, d, n))
        if not where:
            return
        some = list(dict.fromkeys(x[0] for x in where))
        base = dict(zip(some, self.model.score(some)))
        for s, (w, k, d, n) in zip(self.model.score(texts), where):
            gain = s - base[w] - CLAIM + UTF8_CREDIT * n
            if gain > 0:
                self.known[w] = (*self.known[w], (k, gain, d))

    def left_over(self, words: dict[str, int], fix: dict[str, str]) -> bool:
        """Whether a word without a repair still reads far better with a chain undone that leaves UTF-8."""
        return any(gain > SURE and CHAINS[k][0].startswith("utf-8") for w in words if w not in fix for k, gain, _ in self.known.get(w, ()))

    def record(self, words: dict[str, int], bucket: int) -> tuple[int, float, dict[str, str], np.ndarray]:
        """Best chain (-1: none), its posterior, its repairs and all posteriors (the last: none)."""
        g = np.zeros(K + 1)
        for w, n in words.items():
            for k, gain, _ in self.known.get(w, ()):
                # the third time the same word says little that is new
                g[k] += gain * min(n, 2)
        if not g.any():
            p = np.zeros(K + 1)
            p[K] = 1.0
            return -1, 1.0, {}, p
        s = g + self.log_share[bucket]
        s[:K][g[:K] == 0] = -np.inf
        s -= s.max()
        p = np.exp(s)
        p /= p.sum()
        if p[K] >= 0.5:
            return -1, float(p[K]), {}, p
        k = int(np.argmax(p[:K]))
        return k, float(1 - p[K]), {w: d for w in words for kk, _, d in self.known.get(w, ()) if kk == k}, p


def _words(text: str) -> dict[str, int]:
    """Units of a text with their counts, however long; those with a lost character cannot be undone."""
    out: dict[str, int] = {}
    for w in _UNIT.findall(text):
        if LOST not in w:
            out[w] = out.get(w, 0) + 1
    return out


def _no_share() -> np.ndarray:
    s = np.full((1, K + 1), np.log((1 - CLEAN_PRIOR) / K), np.float32)
    s[0, K] = np.log(CLEAN_PRIOR)
    return np.repeat(s, BUCKETS, axis=0)


def _model(counts: DataFrame) -> Model:
    """Sum the slots of all partitions; at most 3 * 2^20 rows reach the driver."""
    pdf = counts.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    return Model(pdf["slot"].to_numpy(), pdf["n"].to_numpy())


_UNITS = "slot long, n double, bucket int, words array<string>, times array<int>"
_SUMS = "slot long, n double"


def garbled(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", rounds: int = 3) -> DataFrame:
    """``(doc_id, chain, posterior, recovered, text)`` of every affected record.

    ``chain`` names how it was garbled (``lost`` where only replacement characters are left);
    ``recovered`` is false where some of them, control characters or words that still read as
    garbled remain. Null and empty texts and texts of plain ASCII are never affected; a null source
    is a source of its own. Rows count as they come, each result row stands for its own input row.
    """
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000"))), F.lit(BUCKETS)).cast("int").alias("bucket"),
    ).where(F.col("text").rlike(r"[^\x00-\x7F]|&#[xX]?[0-9A-Fa-f]{2,5};|\\u[0-9A-Fa-f]{4}"))

    def take(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The units of each record, and the grams of each batch."""
        for pdf in it:
            each = [_words(unescape(t)) for t in pdf["text"]]
            words: dict[str, int] = {}
            for ws in each:
                for w, n in ws.items():
                    words[w] = words.get(w, 0) + n
            u, n = _count_grams(list(words), np.array(list(words.values()), float))
            yield pd.DataFrame({"slot": u, "n": n, "bucket": pd.array([None] * len(u), "Int32"), "words": None, "times": None})
            full = [(b, ws) for b, ws in zip(pdf["bucket"], each) if ws]
            yield pd.DataFrame(
                {"slot": pd.array([None] * len(full), "Int64"), "n": np.nan, "bucket": pd.array([b for b, _ in full], "Int32"), "words": [list(ws) for _, ws in full], "times": [list(ws.values()) for _, ws in full]}
            )

    taken = materialize(rows.mapInPandas(take, _UNITS))
    model = _model(taken.where("slot is not null").select("slot", "n"))
    units = taken.where("words is not null").select("bucket", "words", "times")
    share = _no_share()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((model, share))

        def expect(it: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            scorer = _Scorer(*sent.value)
            total = np.zeros((BUCKETS, K + 1))
            clean: dict[str, int] = {}

            def sums() -> pd.DataFrame:
                """Grams of the words as repaired, shares behind them."""
                u, n = _count_grams(list(clean), np.array(list(clean.values()), float))
                b, k = np.nonzero(total)
                return pd.DataFrame({"slot": np.r_[u, 3 * SLOTS + b * (K + 1) + k], "n": np.r_[n, total[b, k]]})

            for pdf in it:
                each = [dict(zip(w, t)) for w, t in zip(pdf["words"], pdf["times"])]
                scorer.learn({w for ws in each for w in ws})
                for ws, b in zip(each, pdf["bucket"]):
                    _, _, fix, p = scorer.record(ws, b)
                    total[b] += p
                    for w, n in ws.items():
                        w = fix.get(w, w)
                        clean[w] = clean.get(w, 0) + int(n)
                if len(clean) > 200_000:
                    yield sums()
                    clean.clear()
                    total[:] = 0
            yield sums()

        pdf = units.mapInPandas(expect, _SUMS).groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
        slot, n = pdf["slot"].to_numpy(), pdf["n"].to_numpy()
        grams = slot < 3 * SLOTS
        model = Model(slot[grams], n[grams])
        mass = np.zeros((BUCKETS, K + 1))
        mass.reshape(-1)[slot[~grams] - 3 * SLOTS] = n[~grams]
        overall = mass.sum(axis=0) + 1e-9
        # a source's shares lean on those of the corpus, as far as it is small
        base = np.exp(_no_share()[0]) * 0.2 + 0.8 * overall / overall.sum()
        mass += 20 * base
        share = np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32)
    final = spark.sparkContext.broadcast((model, share))

    def decide(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(*final.value)
        for pdf in it:
            plain = [unescape(t) for t in pdf["text"]]
            each = [_words(t) for t in plain]
            scorer.learn({w for ws in each for w in ws})
            out = []
            for i, raw, t, ws, b in zip(pdf["doc_id"], pdf["text"], plain, each, pdf["bucket"]):
                k, p, fix, _ = scorer.record(ws, b)
                lost = LOST in t
                if k >= 0:
                    fixed = _UNIT.sub(lambda m: fix.get(m[0], m[0]), t)
                    whole = not lost and not _C1.search(fixed) and not scorer.left_over(ws, fix)
                    out.append((i, f"{CHAINS[k][0]} as {CHAINS[k][1]}", p, whole, fixed))
                elif lost or _C1.search(t):
                    out.append((i, "lost", 1.0, False, raw))
            yield pd.DataFrame(out, columns=["doc_id", "chain", "posterior", "recovered", "text"]).astype({"doc_id": "Int64"})

    return rows.mapInPandas(decide, "doc_id long, chain string, posterior double, recovered boolean, text string")
