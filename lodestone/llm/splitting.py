"""Problem 6: cut oversized texts at natural boundaries, with overlapping lines.

Balanced targets: the least number of pieces is computed, equal-length targets are placed, each is
snapped to the strongest boundary nearby, and pieces are added while any breaks the limit. A piece
that leaves no room for the lines it should share is then cut in two where a smaller one would.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "src_table string, row_id long, piece_no int, start_line int, end_line int, n_bytes int, piece string"
_KEYED = PIECES + ", digest long"

_HEAD = re.compile(rb"(?:@|class\b|(?:async\s+)?def\b|\[|function\b|func\b)")


def _width(raw: bytes) -> int:
    """Bytes of the UTF-8 character at the start of ``raw``."""
    b = raw[0]
    return 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


def _atoms(data: bytes, limit: int) -> tuple[list[int], list[int], list[int]]:
    """Offsets where a cut is possible, the strength of each, and its line (from 0).

    A line start is always possible. A line above the limit also gets cuts behind a blank, or, in
    a run of more than a sixteenth of the limit without one, between two characters.
    """
    starts = [0]
    p = data.find(b"\n")
    while p >= 0:
        starts.append(p + 1)
        p = data.find(b"\n", p + 1)
    offs, strength, line_of = [], [], []
    blank_before, indent_before = True, 0
    for ln, s in enumerate(starts):
        e = starts[ln + 1] if ln + 1 < len(starts) else len(data)
        line = data[s:e]
        body = line.strip()
        indent = len(line) - len(line.lstrip())
        if body:
            v = 1
            if blank_before:
                v = 4 if indent else 6
            elif indent < indent_before:
                v = 3
            if _HEAD.match(body):
                v += 3 if not indent else 2
        else:
            v = 2
        offs.append(s)
        strength.append(v)
        line_of.append(ln)
        if e - s > limit:
            q, last_cut = s, s
            room = max(4, limit // 16)
            while e - last_cut > room:
                stop = last_cut + room
                q = data.rfind(b" ", last_cut + 1, stop)
                cut = q + 1 if q > 0 else stop
                while cut < e and 0x80 <= data[cut] < 0xC0:
                    cut -= 1
                if cut <= last_cut:
                    cut = last_cut + _width(data[last_cut:])
                if cut >= e:
                    break
                offs.append(cut)
                strength.append(0)
                line_of.append(ln)
                last_cut = cut
        blank_before = not body
        if body:
            indent_before = indent
    return offs, strength, line_of


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """``(start_line, end_line, piece)``, each of at most ``limit`` bytes, lines counted from 1.

    Consecutive pieces share ``overlap`` lines where these fit: the shared lines are taken back to
    as few as still leave the piece within the limit, none in the middle of a line. Leaving out the
    shared lines, the pieces joined are the text. A character wider than the limit stays whole.
    """
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= limit:
        return [(1, data.count(b"\n") + 1, text)] if data else []
    offs, strength, line_of = _atoms(data, limit)
    n = len(offs)
    ends = offs[1:] + [len(data)]
    total = len(data)
    k = max(2, -(-total // limit))
    while True:
        bounds = [0, *_place(offs, strength, total, k), n]
        over = sum(ends[b - 1] - offs[a] > limit for a, b in zip(bounds, bounds[1:]))
        if not over or k >= n:
            break
        # as many more as a part of those that fail, so that a long text takes few rounds
        k = min(n, k + max(1, over // 4))
    if over:
        bounds = list(range(n + 1))
    bounds = _with_room(bounds, offs, ends, strength, line_of, limit, overlap)
    out = []
    for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
        first = offs[a]
        start_line = line_of[a]
        if j and overlap > 0 and strength[a] > 0:
            first, start_line = _shared(data, offs, line_of, a, ends[b - 1], limit, overlap)
        end = ends[b - 1]
        last_line = line_of[b - 1]
        out.append((start_line + 1, last_line + 1, data[first:end].decode("utf-8", "surrogatepass")))
    return out


def _place(offs: list[int], strength: list[int], total: int, k: int) -> list[int]:
    """``k - 1`` growing positions among the possible cuts, each near its equal-length target."""
    cuts, low = [], 1
    reach = total / k / 3
    for j in range(1, k):
        target = total * j / k
        lo = max(low, bisect_left(offs, target - reach))
        hi = min(bisect_right(offs, target + reach), len(offs) - (k - 1 - j))
        if hi <= lo:
            near = bisect_left(offs, target)
            if near > low and near < len(offs) and target - offs[near - 1] < offs[near] - target:
                near -= 1
            best = min(max(low, near), len(offs) - (k - j))
        else:
            best = max(range(lo, hi), key=lambda i: (strength[i] - 4 * abs(offs[i] - target) / max(reach, 1), -abs(offs[i] - target)))
        if best < low:
            best = low
        cuts.append(best)
        low = best + 1
    return cuts


def _shared(data: bytes, offs: list[int], line_of: list[int], a: int, end: int, limit: int, overlap: int) -> tuple[int, int]:
    """Start offset and line of a piece with as many of the lines before it as fit."""
    first, line = offs[a], line_of[a]
    i = a
    for _ in range(overlap):
        if i == 0:
            break
        i -= 1
        while i > 0 and line_of[i] == line_of[i - 1]:
            i -= 1
        if end - offs[i] > limit:
            break
        first, line = offs[i], line_of[i]
    return first, line


def _with_room(bounds: list[int], offs: list[int], ends: list[int], strength: list[int], line_of: list[int], limit: int, overlap: int) -> list[int]:
    """Bounds with each piece cut that cannot hold its shared lines, where a shorter one could.

    The cut is the strongest boundary nearest to the middle of what fits.
    """
    out = [bounds[0]]
    todo = list(reversed(bounds[1:]))
    while todo:
        a, b = out[-1], todo.pop()
        if a and overlap > 0 and strength[a] > 0:
            i = bisect_left(line_of, line_of[a] - overlap, 0, a)
            room = limit - (offs[a] - offs[i])
            if ends[b - 1] - offs[a] > room >= ends[a] - offs[a]:
                fits = bisect_right(ends, offs[a] + room, a + 1, b)
                middle = offs[a] + min(room, ends[b - 1] - offs[a]) / 2
                cut = max(range(a + 1, fits + 1), key=lambda j: (strength[j] - 4 * abs(offs[j] - middle) / limit, -abs(offs[j] - middle))) if fits > a + 1 else a + 1
                todo += [b, cut] if cut < b else [b]
                if cut < b:
                    continue
        out.append(b)
    return out


def split_oversized(
    df: DataFrame, id_col: str, text_col: str, src_table: str, max_bytes: int, overlap_lines: int, with_text: bool = True
) -> DataFrame:
    """Pieces of every row of ``df`` whose text takes more than ``max_bytes`` in UTF-8.

    Only oversized rows leave the JVM. A row delivered twice (same id and text) gives its pieces
    once, one id with two texts gives those of both. Null and empty texts and texts within the limit give no row; a null id stays null.
    """
    if max_bytes < 4:
        raise ValueError("max_bytes must hold any character")
    big = (
        df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
        .where(F.octet_length("text") > max_bytes)
    )

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rid, text, digest in zip(pdf["row_id"], pdf["text"], pdf["digest"]):
                rid = None if pd.isna(rid) else int(rid)
                for no, (a, b, piece) in enumerate(split_text(text, max_bytes, overlap_lines)):
                    rows.append((src_table, rid, no, a, b, len(piece.encode("utf-8", "surrogatepass")), piece if with_text else None, digest))
            out = pd.DataFrame(rows, columns=["src_table", "row_id", "piece_no", "start_line", "end_line", "n_bytes", "piece", "digest"])
            out["row_id"] = out["row_id"].astype("Int64")
            yield out

    out = big.mapInPandas(pieces, _KEYED)
    if not with_text:
        return out.drop("piece", "digest")
    # equal rows fall together by place and content hash; the text itself is no key
    return out.dropDuplicates(["src_table", "row_id", "digest", "piece_no"]).drop("digest")


def split_by_limits(tables: dict[str, DataFrame], limits: DataFrame, with_text: bool = True) -> DataFrame:
    """Pieces of all fields named in ``limits`` (one row for each field, read by the driver).

    ``tables`` maps ``src_table`` to its rows, which have an ``id``. Limits without a table, or
    without ``max_bytes``, are passed over; a null ``overlap_lines`` is none.
    """
    parts = []
    for r in limits.select("src_table", "field", "max_bytes", "overlap_lines").distinct().collect():
        if r["src_table"] in tables and r["max_bytes"] is not None:
            parts.append(
                split_oversized(tables[r["src_table"]], "id", r["field"], r["src_table"], r["max_bytes"], r["overlap_lines"] or 0, with_text)
            )
    if not parts:
        spark = limits.sparkSession
        empty = spark.createDataFrame([], PIECES)
        return empty if with_text else empty.drop("piece")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
