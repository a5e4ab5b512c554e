"""Problem 7: near-duplicate records with small edits, by PartEnum signatures.

A record is the set of its runs of three successive words. Sets are put into bands of similar size;
within a band the domain of runs is hashed into partitions, partitions into groups of ``OF``, and of
each group every subset of ``TAKE`` partitions is a signature of what a set holds there: two sets
whose symmetric difference is small agree, untouched, on such a subset of many groups, and one shared
signature makes them a candidate.

* Equal sets are one class from the start; classes are compared, sessions are written out last.
* Band ``b`` holds sizes in ``(HIGH[b] * t, HIGH[b]]`` and a set signs for its own band and the next,
  so any pair at the threshold ``t`` meets in a band. The band's domain is thinned by hash to about
  ``DOMAIN`` runs of a full set.
* Runs are counted, range by range, in 2^35 slots: in how many texts each occurs. What every task holds is
  two bitmaps, of the slots of several texts and of the hot ones, of 2^27 to 2^29 bits. A subset with a run that no other
  text has can agree with nothing and is left out, which leaves few signatures. Of a subset's runs one
  at least occurs in ``HOT`` texts or fewer, so no signature is shared by more, and no group of sets is
  larger, whatever the data.
* A set with a subset that holds hot runs only is also signed by its exact prefix, as are all small
  sets (under ``SMALL`` runs), and such pairs are never missed. Prefixes follow one order of all runs:
  those of no other text, which need no signature, the others, the hot ones. One shared prefix run
  makes a candidate, unless what follows it in the two sets is too short for the threshold. Hot runs
  reach a prefix only where little else is in a set; then sets are compared block by block.
* For sets of ``SMALL`` runs and more a pair at the threshold shares signatures of 11 groups or more
  in expectation; the chance to share none, simulated, is 2 in 40,000 at 0.6 and none at 0.7. Candidates of sizes that allow
  the threshold are verified exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import bounded_broadcast, materialize

WORD = re.compile(r"[A-Za-z0-9_]+")
#: Groups of partitions, partitions of a group, and how many of them a signature takes.
GROUPS, OF, TAKE = 80, 3, 2
PARTS, DOMAIN, SMALL, HOT = GROUPS * OF, 320, 128, 256
SUBSETS = tuple(combinations(range(OF), TAKE))
#: Least runs of a signature.
RUNS = 3
#: Slots that runs are counted in, and the least and most of the bitmaps of what was counted, which every task holds.
COUNT_BITS, SLOT_BITS, MOST_BITS = 35, 27, 29
_U = np.uint64


class _Ids(dict):
    """Word -> 64-bit hash; forgotten when it grows large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def run_hashes(text: str | None, ids: dict) -> np.ndarray:
    """Sorted distinct hashes of the runs of three successive words; none in shorter texts."""
    words = WORD.findall(text or "")
    if len(words) < 3:
        return np.empty(0, _U)
    h = np.fromiter(map(ids.__getitem__, words), dtype=_U, count=len(words))
    return np.unique(_mix(h[:-2] * _U(3) + _mix(h[1:-1] * _U(5) + _mix(h[2:]))))


def _bands(n: int, threshold: float) -> list[tuple[int, float]]:
    """The two bands a set of ``n`` runs signs for: number and largest size."""
    b = int(np.ceil(np.log(max(n, 1)) / -np.log(threshold) - 1e-9))
    return [(k, threshold**-k) for k in (b, b + 1)]


class Sketch:
    """What is known of a run's frequency: in one text, in several, in more than ``HOT`` (by slots)."""

    def __init__(self, twice: np.ndarray, hot: np.ndarray):
        self.twice, self.hot = twice, hot

    def rank(self, runs: np.ndarray) -> np.ndarray:
        """0 for runs of one text, 1 for those of several, 2 for hot ones."""
        twice, hot = (_bit(held, runs) for held in (self.twice, self.hot))
        return twice * (1 + hot)


def _bit(held: np.ndarray, runs: np.ndarray) -> np.ndarray:
    slots = runs >> _U(65 - (len(held) * 8).bit_length())
    return (held[(slots >> _U(3)).astype(np.int64)] >> (slots & _U(7)).astype(np.uint8)) & 1


def _part_enum(runs: np.ndarray, rank: np.ndarray, band: int, high: float) -> tuple[np.ndarray, bool]:
    """Signatures of one set for one band, and whether a subset holds hot runs only."""
    key = _mix(runs + _U(band * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    # two sets meet in a band on the same thinned domain
    keep = (key >> _U(40)) < _U(int(min(1.0, DOMAIN / high) * (1 << 24)))
    key, rank = key[keep], rank[keep]
    part = ((key & _U(0xFFFFFF)) % _U(PARTS)).astype(np.int64)
    kinds = np.bincount(part * 3 + rank, minlength=PARTS * 3).reshape(GROUPS, OF, 3)
    total = np.zeros(PARTS, _U)
    np.add.at(total, part, _mix(key))
    total = total.reshape(GROUPS, OF)
    out, hot = [], False
    for n, subset in enumerate(SUBSETS):
        some = kinds[:, subset].sum(axis=1)
        whole = (some[:, 0] == 0) & (some.sum(axis=1) >= RUNS)
        bounded = whole & (some[:, 1] > 0)
        hot = hot or bool((whole & ~bounded).any())
        group = np.flatnonzero(bounded)
        h = (group + (band * len(SUBSETS) + n) * GROUPS).astype(_U)
        for p in subset:
            h = _mix(h * _U(0x9E3779B97F4A7C15) + total[group, p])
        out.append(h)
    return np.concatenate(out), hot


def _prefix(runs: np.ndarray, rank: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the exact prefix, and their positions in it: the first ``1 - t`` of two sets at the
    threshold share a run."""
    n = len(runs)
    first = np.argsort(rank, kind="stable")[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
    at = np.flatnonzero(rank[first])
    return _mix(runs[first[at]] ^ _U(0xA5A5A5A5A5A5A5A5)), at


def _signatures(runs: np.ndarray, threshold: float, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set and their places.

    The place of a prefix run is the set's size (from bit 32 up) and the run's position; that of a
    band's signature is the size below zero.
    """
    n = len(runs)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    rank = sketch.rank(runs)
    out, hot = [], n < SMALL / threshold
    if n >= SMALL:
        for band, high in _bands(n, threshold):
            sigs, only_hot = _part_enum(runs, rank, band, high)
            out.append(sigs)
            hot = hot or only_hot
    places = [np.full(len(x), -n, np.int64) for x in out]
    if hot:
        sigs, at = _prefix(runs, rank, threshold)
        out.append(sigs)
        places.append((n << 32) + at)
    return np.concatenate(out), np.concatenate(places)


#: Two bytes that add to the next difference instead of ending one.
_WIDE = 0xFFFF


def _packed(sorted_slots: np.ndarray) -> bytes:
    """Ascending numbers as differences, of two bytes where most are small."""
    d = np.diff(sorted_slots, prepend=np.uint32(0))
    wide, rest = np.divmod(d, np.uint32(_WIDE))
    n = len(d) + int(wide.sum(dtype=np.int64))
    if n > 2 * len(d):
        return b"\x04" + d.astype(np.uint32).tobytes()
    out = np.full(n, _WIDE, np.uint16)
    out[np.arange(len(d)) + np.cumsum(wide, dtype=np.int64)] = rest
    return b"\x02" + out.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    d = np.frombuffer(raw, np.uint16 if raw[0] == 2 else np.uint32, offset=1)
    total = np.cumsum(d, dtype=np.uint32)
    return total[d != _WIDE] if raw[0] == 2 else total


def _union_rows(it: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """Class rows (id, set hash, size) and, by range of slots, the slots each batch's sets hold."""
    width = (1 << COUNT_BITS) // ranges
    ids = _Ids()
    for pdf in it:
        rid, h1, h2, sizes, slots = [], [], [], [], []
        for i, text in zip(pdf["id"].tolist(), pdf["text"]):
            if text is None or i is None or i != i:
                continue
            r = run_hashes(text, ids)
            if len(r):
                a, b = int(r.sum(dtype=_U)), int(_mix(r ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                slots.append(np.unique(r >> _U(64 - COUNT_BITS)))
            else:
                # texts without a run are alike only when equal
                a, b = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 1), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 2)
            rid.append(i)
            h1.append(a)
            h2.append(b)
            sizes.append(len(r))
        yield pd.DataFrame(
            {
                "id": pd.array(rid, dtype="Int64"),
                "h1": np.array(h1, dtype=_U).view(np.int64),
                "h2": np.array(h2, dtype=_U).view(np.int64),
                "n": np.array(sizes, dtype=np.int32),
                "range": pd.array([None] * len(rid), dtype="Int32"),
                "slots": None,
            }
        )
        if slots:
            s = np.sort(np.concatenate(slots))
            cut = np.searchsorted(s, np.arange(1, ranges, dtype=_U) * _U(width))
            pieces = [(k, (p - _U(k * width)).astype(np.uint32)) for k, p in enumerate(np.split(s, cut)) if len(p)]
            yield pd.DataFrame(
                {
                    "id": pd.array([None] * len(pieces), dtype="Int64"),
                    "h1": 0,
                    "h2": 0,
                    "n": 0,
                    "range": pd.array([k for k, _ in pieces], dtype="Int32"),
                    "slots": [_packed(p) for _, p in pieces],
                }
            )


def _count_slots(it: Iterator[pd.DataFrame], ranges: int, hot: int, bits: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Two bitmaps for each range: slots held at least twice, and more than ``hot`` times (of so many ``bits`` in all).

    Memory is that of one range's slots.
    """
    now, held, many, most = None, [], 0, 1 << 22

    def counted():
        return np.unique(np.concatenate(held), return_counts=True)

    def done():
        u, times = counted()
        maps = []
        for least, of in zip((2, hot + 1), bits):
            some = np.zeros((1 << of) // ranges, np.bool_)
            some[u[times >= least] >> np.uint32(COUNT_BITS - of)] = True
            maps.append([np.packbits(some, bitorder="little").tobytes()])
        return pd.DataFrame({"range": [now], "twice": maps[0], "hot": maps[1]})

    for pdf in it:
        for k, raw in zip(pdf["range"].tolist(), pdf["slots"]):
            if k != now:
                if now is not None:
                    yield done()
                now, held, many, most = k, [], 0, 1 << 22
            held.append(_unpacked(raw))
            many += len(held[-1])
            if many > most:  # more of a slot than tells it as hot are not kept
                u, times = counted()
                held = [np.repeat(u, np.minimum(times, hot + 1))]
                many = len(held[0])
                most = max(most, 2 * many)
    if now is not None:
        yield done()


def _sketch(base: DataFrame, ranges: int, hot: int) -> Sketch:
    """The sketch of all runs, made range by range in as many tasks.

    Runs are counted in so many slots that those of one text hardly meet. Only what occurs twice is set in a
    bitmap, which grows with the number of runs up to a fixed size.
    """
    runs = base.where("id is not null").agg(F.sum("n")).first()[0] or 0
    bits = min(MOST_BITS, max(SLOT_BITS, runs.bit_length())), SLOT_BITS
    twice, many = (np.zeros(1 << (b - 3), np.uint8) for b in bits)
    parts = base.where("range is not null").select("range", "slots").repartition(ranges, "range").sortWithinPartitions("range")
    for r in parts.mapInPandas(lambda it: _count_slots(it, ranges, hot, bits), "range int, twice binary, hot binary").toLocalIterator():
        for held, raw in ((twice, r["twice"]), (many, r["hot"])):
            step = len(held) // ranges
            held[r["range"] * step : (r["range"] + 1) * step] = np.frombuffer(raw, np.uint8)
    return Sketch(twice, many)


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """``members`` (id, class) of all rows and ``links`` (class_a, class_b, jaccard) at the threshold.

    ``class`` is the smallest id of the rows with the same set of runs. Null texts and null ids
    belong to nothing. Texts of fewer than three words are alike only when equal. Rows delivered
    twice under one id count once.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # as many ranges as tasks, at least 64 and at most 4,096
    ranges = 1 << min(12, max(6, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()))
    base = materialize(
        rows.mapInPandas(lambda it: _union_rows(it, ranges), "id long, h1 long, h2 long, n int, range int, slots binary")
    )
    one = base.where("id is not null").groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("s")).select("id", "s.*")
    rep = one.groupBy("h1", "h2", "n").agg(F.min("id").alias("class"))
    members = one.join(rep, ["h1", "h2", "n"]).select("id", "class", "n")
    held = spark.sparkContext.broadcast(_sketch(base, ranges, HOT))

    def sign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, sketch = _Ids(), held.value
        for pdf in it:
            keys, own, places = [], [], []
            for i, text in zip(pdf["id"].tolist(), pdf["text"]):
                if text is None or i is None or i != i:
                    continue
                s, at = _signatures(run_hashes(text, ids), threshold, sketch)
                if len(s):
                    keys.append(s)
                    own.append(np.full(len(s), i, np.int64))
                    places.append(at)
            if keys:
                yield pd.DataFrame({"sig": np.concatenate(keys).view(np.int64), "id": np.concatenate(own), "place": np.concatenate(places)})

    copies = materialize(members.where("id <> class").select("id"))
    signed = rows.mapInPandas(sign, "sig long, id long, place long").join(bounded_broadcast(copies, 2_000_000), "id", "left_anti")
    signed = materialize(signed)
    # a band's signature is shared by HOT sets at most
    groups = signed.where("place < 0").groupBy("sig").agg(F.sort_array(F.collect_set(F.struct("id", "place"))).alias("sets")).where(F.size("sets") > 1)
    heads = groups.select("sets", F.posexplode(F.slice("sets", F.lit(1), F.size("sets") - 1)).alias("k", "x"))
    pairs = heads.select("x", F.explode(F.slice("sets", F.col("k") + 2, F.size("sets"))).alias("y"))
    near = F.greatest("x.place", "y.place") <= threshold * F.least("x.place", "y.place") + 1e-6
    pairs = pairs.where(near & F.expr("x.id < y.id")).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    exact = signed.where("place >= 0").distinct()
    exact = exact.join(exact.groupBy("sig").agg(F.count("*").alias("count")).where("count > 1"), "sig")
    pairs = pairs.unionByName(_prefix_pairs(exact.where(F.col("count") <= HOT), ["sig"], threshold))
    crowds = materialize(exact.where(F.col("count") > HOT))
    if crowds.limit(1).count():
        pairs = pairs.unionByName(_prefix_pairs(_blocks(crowds), ["sig", "low", "high"], threshold))
    candidates = materialize(pairs.distinct())
    links = _verified(rows, candidates, threshold)
    return members, links


def _blocks(crowds: DataFrame) -> DataFrame:
    """Sets of a crowded run in blocks of about ``HOT``, each set once for each two blocks (``low``, ``high``) it is in."""
    n = F.ceil(F.col("count") / HOT)
    own = F.pmod(F.xxhash64("id"), n).alias("own")
    split = crowds.select("sig", "id", "place", own, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("with"))
    return split.select("sig", "id", "place", "own", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"))


def _prefix_pairs(signed: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Pairs that share a prefix run which, as their first common one, leaves enough for the threshold."""
    size = F.shiftright("place", 32)
    left = size - F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    own = F.col("own") if "low" in keys else F.lit(0)
    a = signed.select(*keys, F.col("id").alias("a"), size.alias("n_a"), left.alias("left_a"), own.alias("own_a"))
    b = signed.select(*keys, F.col("id").alias("b"), size.alias("n_b"), left.alias("left_b"), own.alias("own_b"))
    pairs = a.join(b, keys).where("a < b")
    if "low" in keys:
        pairs = pairs.where("low = high or own_a <> own_b")
    enough = F.least("left_a", "left_b") * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-6
    return pairs.where(enough).select("a", "b").distinct()


def _verified(rows: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Candidates whose full sets are alike at the threshold."""
    wanted = materialize(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def sets(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for pdf in it:
            yield pd.DataFrame({"id": pdf["id"], "runs": [run_hashes(t, ids).tobytes() for t in pdf["text"]]})

    texts = rows.join(bounded_broadcast(wanted, 2_000_000), "id", "left_semi")
    full = materialize(texts.mapInPandas(sets, "id long, runs binary").dropDuplicates(["id"]))

    def jaccard(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            j = []
            for x, y in zip(pdf["x"], pdf["y"]):
                p, q = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                j.append(both / max(1, len(p) + len(q) - both))
            yield pd.DataFrame({"class_a": pdf["a"], "class_b": pdf["b"], "jaccard": j})

    x = full.select(F.col("id").alias("a"), F.col("runs").alias("x"))
    y = full.select(F.col("id").alias("b"), F.col("runs").alias("y"))
    scored = candidates.join(x, "a").join(y, "b").mapInPandas(jaccard, "class_a long, class_b long, jaccard double")
    return scored.where(F.col("jaccard") >= threshold - 1e-12)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6) -> DataFrame:
    """``(session_a, session_b)`` of all alike rows, smaller id first, identical ones included."""
    members, links = near_duplicate_classes(df, id_col, text_col, threshold)
    a = members.select(F.col("id").alias("x"), F.col("class").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class").alias("class_b"))
    across = links.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("session_a"), F.greatest("x", "y").alias("session_b"))


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.6, max_rounds: int = 50) -> DataFrame:
    """``(id, class, n_links, group_id)``: each row's class, the class's links, its connected group.

    Groups are joined by label propagation with pointer jumping: each round a class takes the least
    label among its neighbours and then that label's own label, so chains shrink geometrically.
    Raises if ``max_rounds`` do not settle it.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, threshold)
    links = materialize(links)
    edges = links.select(F.explode(F.array(F.struct(F.col("class_a").alias("u"), F.col("class_b").alias("v")), F.struct(F.col("class_b").alias("u"), F.col("class_a").alias("v")))).alias("e")).select("e.*")
    edges = materialize(edges)
    labels = materialize(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(max_rounds):
        near = edges.join(labels.withColumnRenamed("u", "v").withColumnRenamed("label", "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = labels.join(near, "u").select("u", F.least("label", "l").alias("next"), "label")
        jump = labels.select(F.col("u").alias("next"), F.col("label").alias("root"))
        step = step.join(jump, "next", "left").select("u", F.least("next", F.coalesce("root", "next")).alias("label"), F.col("label").alias("old"))
        step = materialize(step)
        labels = step.select("u", "label")
        if not step.where("label <> old").limit(1).count():
            break
    else:
        raise RuntimeError("groups did not settle; raise max_rounds")
    degree = edges.groupBy("u").agg(F.count("*").alias("n_links"))
    known = labels.join(degree, "u").withColumnRenamed("u", "class")
    return members.join(known, "class", "left").select(
        "id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("label", "class").alias("group_id")
    )
