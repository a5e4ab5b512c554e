"""Problem 4: text cut off by field limits or in mid-transfer.

Two signs are weighed together. Per source and column, histograms of the length in characters and
in bytes are tested for spikes: lengths far more frequent than their neighbours. And an end-of-text
n-gram model, counted over all texts, says how often the characters before the end of a text are
followed by an end elsewhere. At a spike, a text needs good evidence that it is complete; off the
spikes, it needs good evidence that it is not. Ends at spikes vouch for no text off them, but for
each other: words that stand at the end of texts of different lengths and are hardly ever continued
are a closing, while those before a cut go on in other texts, or are met at one length only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import bounded_broadcast, materialize

#: Lengths of the character contexts.
ORDERS = (5, 9, 15, 25)
#: Contexts of words before the last, as distances from the end; the last word itself may be any. What
#: extends another comes after it.
MASKS = ((1, 2), (1, 2, 3), (1, 3), (1, 3, 4))
#: Code of the first mask among the orders.
MASK = 100
#: Least share of ends among the uses of a context for a complete text: at a spike; off it, after the
#: characters and after the words before the last.
AT_SPIKE, OFF_SPIKE, AFTER_WORDS = 0.25, 0.015, 0.25
#: The same at a spike with the ends at spikes counted in: words that are hardly ever continued.
CLOSING = 0.75
#: Below these shares of word ends among its uses, a context stops surely, or likely, inside a word.
IN_WORD, NEAR_WORD = 0.02, 0.3
#: The filter of contexts has this many slots for each, from 2^20 to 2^27 in all; where that leaves less
#: than ``SLOTS_LEAST`` for each, contexts are counted in passes over ranges of their hashes.
SLOTS_EACH, SLOTS_LEAST, LEAST_BITS, MOST_BITS = 256, 16, 20, 27
_B = np.uint64(0x9E3779B97F4A7C15)
_BI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_INVISIBLE = " \t\r\n\f\v ­​‌‍⁠﻿  　"
_CLOSERS = "\"'”’»)]}*_>"
_SPAN = re.compile(r"`[^`\n]+`")
_DIGITS = re.compile(r"\d+")
_SMILE = re.compile(r"\s*[:;]-?[)(DP]$")
#: Marks left behind a cut, or written for a pause (fixed values).
_MARK = re.compile(r"(?:…|\.{3,}|\.\.|(?:[\[(<{]\s*)(?:…|\.{2,}|truncated|cut(?: off)?|snip(?:ped)?|more|continued|abgeschnitten|gekürzt|tronqué|recortado|cortado)(?:\s*[\])>}])|\[more\]|-{2,}|—|–)$", re.I)
_TERMINAL = ".!?。！？‽"
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+\S")


def _normal(text: str) -> str:
    """What contexts are counted on: code spans and numbers are one symbol, case is ignored."""
    return _DIGITS.sub("0", _SPAN.sub("`x`", text.lower()))


def ending(text: str | None) -> tuple[str, str, bool]:
    """``(status, body, marked)``: ``whole``, ``cut`` or ``open``, and the text up to its end.

    ``open`` endings are for the model to judge. Null and blank texts are whole.
    """
    t = (text or "").rstrip(_INVISIBLE)
    if not t:
        return "whole", "", False
    if t.endswith("�"):
        return "cut", t, False
    if t.count("```") % 2:
        return "cut", t, False
    if t.endswith("```"):
        return "whole", t, False
    if t[-1] in ")(DP" and _SMILE.search(t[-6:]):
        return "whole", t, False
    marked = False
    # no mark is longer than this
    while t and not t[-1].isalnum() and (m := _MARK.search(t[-24:])):
        marked = True
        t = t[: len(t) - len(t[-24:]) + m.start()].rstrip(_INVISIBLE)
    if not t:
        return "whole", t, marked
    last = t[t.rfind("\n") + 1 :]
    if last.count("`") % 2:
        return "cut", t, marked
    body = t.rstrip(_CLOSERS + _INVISIBLE)
    if not body:
        return "whole", t, marked
    if body[-1] in _TERMINAL:
        if body[-1] == "." and body[-2:-1].isdigit() and not marked:
            return "open", body, False
        return "whole", body, marked
    if _ITEM.match(last) and not marked and last.rstrip().endswith("`"):
        return "whole", body, marked
    return "open", t.rstrip("\"'”’»*_"), marked


_TOKEN = re.compile(r"[\x01-\x03]|`x`|[^\W\d]\w*|0|[^\w\s]|\n")
_STOPS = (*".!?…\n", "\x04")


class _Roller:
    """Rolling hashes over one string, for all orders."""

    def __init__(self):
        self.power = self.inverse = np.ones(1, np.uint64)

    def read(self, text: str) -> None:
        """Take ``text`` as the string that :meth:`before` looks at."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        if len(self.power) <= len(c):
            base = np.full(max(len(c) + 1, 1 << 16), _B, np.uint64)
            base[0] = 1
            self.power = np.cumprod(base, dtype=np.uint64)
            base[1:] = _BI
            self.inverse = np.cumprod(base, dtype=np.uint64)
        x = (c * np.uint64(0xD6E8FEB86659FD93)) ^ (c << np.uint64(40))
        x *= self.power[: len(c)]
        self.prefix = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(x, out=self.prefix[1:])

    def before(self, at: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the ``n`` characters before each of the positions ``at``, which are ``n`` or more."""
        h = self.prefix[at] - self.prefix[at - n]
        h *= self.inverse[at - n]
        h *= np.uint64((n * 0x9E3779B97F4A7C15 | 1) & 0xFFFFFFFFFFFFFFFF)
        return h


class _Ids(dict):
    """Token -> 64-bit hash, computed once for each token of a worker."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


def _words_before(k: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the words that mask ``m`` names before each of the tokens ``at``, in its reach or more."""
    h = np.full(len(at), m + 1, np.uint64)
    for d in MASKS[m]:
        h = (h ^ k[at - d]) * _B
        h ^= h >> np.uint64(31)
    return h * _B


_SALT = {"content": "\x01", "title": "\x02"}


def _salted(field: str, body: str) -> str:
    """A normalized text behind a mark of its field, whose contexts count apart."""
    return _SALT.get(field, "\x03") + _normal(body)


def _tails(texts: list[tuple[str, str]], roller: _Roller, ids: _Ids) -> list[list[tuple[int, int]]]:
    """For each ``(field, body)`` the ``(order, hash)`` of what comes before its end, as signed numbers.

    All texts of a batch are hashed at once, joined; contexts that would reach into the text before
    are left out.
    """
    if not texts:
        return []
    salted = [_salted(f, b) for f, b in texts]
    reach = max(ORDERS) + 1
    heads = [s[-reach:] for s in salted]
    ends = np.cumsum([len(h) for h in heads])
    size = np.array([len(h) for h in heads])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    roller.read("".join(heads))
    for n in ORDERS:
        at = np.flatnonzero(size >= n)
        for i, x in zip(at.tolist(), roller.before(ends[at], n).view(np.int64).tolist()):
            out[i].append((n, x))
    back = max(x[-1] for x in MASKS) + 1
    # the last few tokens: of a text whose end holds fewer, all of it is read
    tokens = [_TOKEN.findall(s[-300:])[-back:] if len(s) > 300 else _TOKEN.findall(s)[-back:] for s in salted]
    tokens = [t if len(t) == back or len(s) <= 300 else _TOKEN.findall(s)[-back:] for t, s in zip(tokens, salted)]
    ends = np.cumsum([len(t) for t in tokens])
    size = np.array([len(t) for t in tokens])
    k = np.array([ids[t] for ts in tokens for t in ts], np.uint64)
    for m, mask in enumerate(MASKS):
        at = np.flatnonzero(size > mask[-1])
        for i, x in zip(at.tolist(), _words_before(k, ends[at] - 1, m).view(np.int64).tolist()):
            out[i].append((MASK + m, x))
    return out


_ENDS = np.zeros(128, bool)
_ENDS[[ord(x) for x in ".!?\n\x04"]] = True
_FOLLOWED = np.zeros(128, bool)
_FOLLOWED[[32, 10, 4, 5, 6, 34, 39, 41, 46, 33, 63]] = True
_BORDER = np.array([not (chr(i).isalnum() or i in (5, 6, 39)) for i in range(128)])
_MOUTH = np.zeros(128, bool)
_MOUTH[[ord(x) for x in ")(dp"]] = True
#: Marks behind a text: its end is trusted, at a spike, cut (or of the joined texts).
_TRUSTED, _AT_SPIKE, _CUT = "\x04\x05\x06"


class _Filter:
    """The contexts to be counted: of a range of hashes, the slots told by the bits behind the range's."""

    def __init__(self, bitmap: np.ndarray, bits: int, part_bits: int = 0, part: int = 0):
        self.bits, self.part_bits, self.part = bitmap, np.uint64(part_bits), np.uint64(part)
        self.shift, self.coarse_shift = np.uint64(64 - bits), np.uint64(66 - bits)
        self.coarse = np.unpackbits(bitmap, bitorder="little").reshape(-1, 4).any(axis=1)

    def hits(self, h: np.ndarray) -> np.ndarray:
        if self.part_bits:
            mine = np.flatnonzero((h >> (np.uint64(64) - self.part_bits)) == self.part)
            return mine[self._hits(h[mine] << self.part_bits)]
        return self._hits(h)

    def _hits(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.coarse[(h >> self.coarse_shift).astype(np.int64)])
        slot = (h[maybe] >> self.shift).astype(np.int64)
        return maybe[((self.bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1).astype(bool)]


def _count(texts: list[tuple[str, str, str, int]], only: _Filter, roller: _Roller, ids: _Ids) -> tuple[np.ndarray, ...]:
    """For the contexts in ``only``: uses, uses before an end, before the end of a word, before one at a
    spike, and the shortest and longest text that ends so (0 and -1 without one).

    ``texts`` are ``(field, body, mark, length of the whole text)``; the end of a text that is not trusted ends nothing.
    """
    hs, es, bs, ls = [], [], [], []
    salted = [_salted(f, b) for f, b, _, _ in texts]
    joined = "".join(s + mark for s, (_, _, mark, _) in zip(salted, texts)) + 2 * _CUT
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    after = np.append(raw[1:], np.uint32(ord(_CUT)))
    small = np.minimum(raw, 127)
    end = _ENDS[small] & (raw < 128)
    stop = (raw == 46) | (raw == 33) | (raw == 63)
    # a stop inside a number, name or path ends nothing; one behind a space ends what is before it
    end[stop & ~(_FOLLOWED[np.minimum(after, 127)] & (after < 128))] = False
    end[(raw == 32) & ((after == 33) | (after == 63))] = True
    end[raw == 0x2026] = True
    # so does a smile
    smile = ((after[:-1] == 58) | (after[:-1] == 59)) & _MOUTH[np.minimum(after[1:], 127)]
    end[:-1][(raw[:-1] == 32) & smile] = True
    # beyond ASCII all but a few marks are letters of words here; an untrusted end is neither
    border = _BORDER[small] & (raw < 128)
    sizes = np.array([n for _, _, _, n in texts] + [0])
    bounds = np.cumsum([len(s) + 1 for s in salted]) - 1
    roller.read(joined)
    every = at = np.arange(ORDERS[0], len(raw))
    for n in ORDERS:
        # a text with a longer context has the shorter ones too: only where these are counted
        at = every[n - ORDERS[0] :] if only.part_bits else at[at >= n]
        h = roller.before(at, n)
        hit = only.hits(h)
        at = at[hit]
        hs.append(h[hit])
        es.append(end[at])
        bs.append(border[at])
        ls.append(np.where(raw[at] == ord(_AT_SPIKE), sizes[np.searchsorted(bounds, at)], 0))
    # the marks between the texts are tokens too: what reaches over one is counted nowhere
    tokens = _TOKEN.findall(joined)
    k = np.fromiter(map(ids.__getitem__, tokens), np.uint64, len(tokens))
    e = np.append(np.isin(k[1:], [np.uint64(ids[t]) for t in _STOPS]), False)
    met: dict[tuple, np.ndarray] = {}
    for m, mask in enumerate(MASKS):
        at = met.get(mask[:-1]) if not only.part_bits else None
        at = np.arange(mask[-1], len(k)) if at is None else at[at >= mask[-1]]
        h = _words_before(k, at, m)
        hit = only.hits(h)
        met[mask] = at = at[hit]
        hs.append(h[hit])
        es.append(e[at])
        bs.append(np.ones(len(at), bool))
        ls.append(np.zeros(len(at), np.int64))
    u, inv = np.unique(np.concatenate(hs), return_inverse=True)
    size = np.concatenate(ls)
    low, high = np.full(len(u), 1 << 30), np.full(len(u), -1)
    ends = np.flatnonzero(size)
    np.minimum.at(low, inv[ends], size[ends])
    np.maximum.at(high, inv[ends], size[ends])
    low[high < 0] = 0
    weigh = lambda x: np.bincount(inv, weights=x, minlength=len(u))
    return u.view(np.int64), np.bincount(inv, minlength=len(u)), weigh(np.concatenate(es)), weigh(np.concatenate(bs)), weigh(size > 0), low, high


def length_spikes(rows: DataFrame, least: int = 12, factor: float = 6.0, reach: int = 6) -> DataFrame:
    """``(source, unit, length, n)`` of the lengths that are spikes of their source's histogram.

    A length is a spike when its count is at least ``least`` and ``factor`` times the mean of the
    ``reach`` lengths on either side, and it is no short one (32 or more). Counts cover all rows and
    are aggregated before anything is compared.
    """
    lengths = F.explode(
        F.array(
            F.struct(F.lit("chars").alias("unit"), F.length("text").alias("length")),
            F.struct(F.lit("bytes").alias("unit"), F.octet_length("text").alias("length")),
        )
    )
    hist = rows.where("text is not null").select("source", lengths.alias("l")).groupBy("source", "l.unit", "l.length").count()
    around = W.partitionBy("source", "unit").orderBy("length").rangeBetween(-reach, reach)
    mean = (F.sum("count").over(around) - F.col("count")) / (2.0 * reach)
    return (
        hist.withColumn("mean", mean)
        .where((F.col("count") >= least) & (F.col("count") >= factor * F.col("mean")) & (F.col("length") >= 32))
        .select("source", "unit", "length", F.col("count").alias("n"))
    )


def _judged(rows: DataFrame) -> DataFrame:
    """``(src_table, row_id, source, cut)`` of the rows without a plain end; ``rows`` as of :func:`cut_rows`."""
    spark = rows.sparkSession
    spikes = materialize(length_spikes(rows).select("source", "unit", "length").withColumn("spike", F.lit(True)))
    sp = bounded_broadcast(spikes, 200_000)
    chars = sp.where("unit = 'chars'").select("source", F.col("length").alias("n_chars"), F.col("spike").alias("s1"))
    octets = sp.where("unit = 'bytes'").select("source", F.col("length").alias("n_bytes"), F.col("spike").alias("s2"))
    marked = (
        rows.withColumns({"n_chars": F.length("text"), "n_bytes": F.octet_length("text")})
        .join(bounded_broadcast(chars, 200_000), ["source", "n_chars"], "left")
        .join(bounded_broadcast(octets, 200_000), ["source", "n_bytes"], "left")
        .select("src_table", "row_id", "source", "field", "text", (F.coalesce("s1", F.lit(False)) | F.coalesce("s2", F.lit(False))).alias("spike"))
    )

    def ends(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        roller, ids = _Roller(), _Ids()
        for pdf in it:
            out, left, bodies = [], [], []
            for tab, rid, src, field, text, spike in zip(*(pdf[c] for c in ("src_table", "row_id", "source", "field", "text", "spike"))):
                status, body, _ = ending(text)
                if status == "cut":
                    out.append((tab, rid, src, spike, True, None, None))
                elif status == "open":
                    left.append((tab, rid, src, spike, None))
                    bodies.append((field, body))
            for row, tails in zip(left, _tails(bodies, roller, ids)):
                out.append((*row, [n for n, _ in tails], [h for _, h in tails]))
            yield pd.DataFrame(out, columns=["src_table", "row_id", "source", "spike", "cut", "orders", "hashes"]).astype({"row_id": "Int64"})

    ended = materialize(
        marked.mapInPandas(ends, "src_table string, row_id long, source string, spike boolean, cut boolean, orders array<int>, hashes array<long>")
    )
    tails = ended.where("cut is null").select(
        "src_table", "row_id", "source", "spike", F.explode(F.arrays_zip("orders", "hashes")).alias("z")
    ).select("src_table", "row_id", "source", "spike", F.col("z.orders").alias("order"), F.col("z.hashes").alias("h"))
    contexts = tails.agg(F.approx_count_distinct("h")).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (SLOTS_EACH * contexts).bit_length()))
    part_bits = max(0, (SLOTS_LEAST * contexts).bit_length() - MOST_BITS)

    # repeated texts are counted once; a text at a spike in one source is not trusted in any
    same = F.unhex(F.sha2("text", 256))
    texts = marked.where("text <> ''").groupBy("field", same.alias("_d")).agg(F.first("text").alias("text"), F.bool_or("spike").alias("spike"))

    def counted(part: int) -> DataFrame:
        bitmap = spark.sparkContext.broadcast(_bitmap(tails, bits, part_bits, part))

        def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            roller, ids, only = _Roller(), _Ids(), _Filter(bitmap.value, bits, part_bits, part)
            for pdf in it:
                rows = []
                for field, text, spike in zip(pdf["field"], pdf["text"], pdf["spike"]):
                    status, body, _ = ending(text)
                    # the end of a text at a spike, or of a cut one, is no end
                    rows.append((field, body or text, _CUT if status == "cut" else _AT_SPIKE if spike else _TRUSTED, len(text)))
                yield pd.DataFrame(dict(zip(("h", "n", "e", "b", "u", "low", "high"), _count(rows, only, roller, ids))))

        return texts.select("field", "text", "spike").mapInPandas(count, "h long, n double, e double, b double, u double, low int, high int")

    counts = counted(0)
    for part in range(1, 1 << part_bits):
        counts = counts.unionByName(counted(part))
    counts = counts.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "e", "b", "u")], F.min(F.when(F.col("high") >= 0, F.col("low"))).alias("low"), F.max("high").alias("high"))
    used = tails.join(counts, "h", "left")
    # the text itself is taken out of its context's counts
    own = F.when(F.col("spike"), 0.0).otherwise(1.0)
    at_spike = F.when(F.col("spike"), F.greatest(F.coalesce("u", F.lit(0.0)) - 1.0, F.lit(0.0))).otherwise(0.0)
    less = lambda c, by: F.greatest(F.coalesce(F.col(c), F.lit(0.0)) - by, F.lit(0.0)).alias(c)
    step = F.struct(F.col("order").alias("o"), less("n", F.lit(1.0)), less("e", own), less("b", own), (F.greatest(F.coalesce("e", F.lit(0.0)) - own, F.lit(0.0)) + at_spike).alias("a"), F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("many"))
    folded = used.groupBy("src_table", "row_id", "source", "spike").agg(F.sort_array(F.collect_list(step)).alias("s"))

    def share(part: Column, c: str, prior: float) -> Column:
        return F.aggregate(part, F.lit(prior), lambda acc, x: (x[c] + 2.0 * acc) / (x["n"] + 2.0))

    chars = F.filter("s", lambda x: x["o"] < MASK)
    words = F.filter("s", lambda x: x["o"] >= MASK)
    after_words = F.coalesce(F.array_max(F.transform(words, lambda x: (x["e"] + 0.04) / (x["n"] + 2.0))), F.lit(0.02))
    model = folded.select(
        "src_table", "row_id", "source", "spike", share(chars, "e", 0.02).alias("share"), F.when(F.exists(chars, lambda x: x["many"] & (x["o"] > ORDERS[0])), share(chars, "a", 0.02)).otherwise(0.0).alias("closing"), share(chars, "b", 0.5).alias("border"), after_words.alias("words")
    )
    off = ((F.col("share") < OFF_SPIKE) & ((F.col("words") < AFTER_WORDS) | (F.col("border") < NEAR_WORD))) | ((F.col("border") < IN_WORD) & (F.col("share") < 0.1))
    verdict = model.select("src_table", "row_id", "source", F.when(F.col("spike"), (F.col("share") < AT_SPIKE) & (F.col("closing") < CLOSING)).otherwise(off).alias("cut"))
    return verdict.unionByName(ended.where("cut").select("src_table", "row_id", "source", "cut"))


def _bitmap(tails: DataFrame, bits: int, part_bits: int = 0, part: int = 0) -> np.ndarray:
    """Slots of the contexts to be counted, of one range of hashes: ``2 ** bits`` bits."""
    if part_bits:
        tails = tails.where(F.shiftrightunsigned("h", 64 - part_bits) == part)
    slot = F.shiftrightunsigned(F.shiftleft("h", part_bits), 64 - bits)
    words = tails.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(shiftleft(h, {part_bits}), {64 - bits}) & 63))").alias("b"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    pdf = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    if len(pdf):
        out[pdf["w"].to_numpy()] = pdf["b"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def message_rows(messages: DataFrame) -> DataFrame:
    """Messages as rows to be judged; the source is the JSON's ``client``, ``(unknown)`` without one."""
    client = F.coalesce(F.get_json_object("retrieved_chunks", "$.client"), F.nullif(F.regexp_extract("retrieved_chunks", '"client": *"([^"]+)"', 1), F.lit("")))
    return messages.select(
        F.lit("chat_messages").alias("src_table"), F.col("id").cast("long").alias("row_id"), F.coalesce(client, F.lit("(unknown)")).alias("source"),
        F.lit("content").alias("field"), F.col("content").alias("text"),
    )


def title_rows(sessions: DataFrame) -> DataFrame:
    """Titles as rows to be judged; their source is the title field."""
    return sessions.select(
        F.lit("sessions").alias("src_table"), F.col("id").cast("long").alias("row_id"), F.lit("title").alias("source"), F.lit("title").alias("field"), F.col("title").alias("text")
    )


def cut_rows(rows: DataFrame) -> DataFrame:
    """``(src_table, row_id)`` of the rows whose text was cut.

    ``rows`` has ``src_table, row_id, source, field, text``. Null, empty and blank texts are whole.
    A row delivered twice is reported once; it is cut if one of its copies is.
    """
    return _judged(rows).where("cut").select("src_table", "row_id").distinct()


def cut_shares(rows: DataFrame) -> DataFrame:
    """For each source: rows (distinct ids), cut rows, and their share."""
    total = rows.select("source", "src_table", "row_id").distinct().groupBy("source").agg(F.count("*").alias("n_rows"))
    cut = _judged(rows).where("cut").select("source", "src_table", "row_id").distinct().groupBy("source").agg(F.count("*").alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0))
    return total.join(cut, "source", "left").select("source", "n_rows", n.alias("n_cut"), (n / F.col("n_rows")).alias("share_cut"))
