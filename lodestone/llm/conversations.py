"""Problem 2: rebuild conversations from message rows.

Rows are sessionized by ``session_id``, sorted by time stamp and id, split into segments at a
calibrated inactivity gap, given clean roles, and dropped without reciprocal replies. Nothing is
collected by session: a session is folded from one summary for each block of sorted rows, so a
session with a third of all rows costs no task more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.text import clean_role, content_digest, deduplicated_messages, ordered_blocks
from lodestone.session import bounded_broadcast, materialize

ORDER = ("session_id", "created_at", "id")
USER, ASSISTANT, OTHER = 1, 2, 0
LOG2_LONGEST = 20

_SUMMARY = (
    "session_id long, block long, n long, first_code int, last_code int, all_blank boolean, "
    "other boolean, same boolean, blank_user boolean, blank_assistant boolean"
)


def _seconds(name: str) -> Column:
    """Seconds of a time stamp with or without zone."""
    return F.col(name).cast("timestamp").cast("double")


def _codes(df: DataFrame) -> DataFrame:
    code = F.when(F.col("role") == "user", USER).when(F.col("role") == "assistant", ASSISTANT)
    return df.withColumn("code", F.coalesce(code, F.lit(OTHER)))


def _block(part: int, batch: int) -> int:
    """Number of an Arrow batch of a partition; partitions sort first, whatever their number."""
    return (part << 32) + batch


def _summaries(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each session and Arrow batch of the sorted partition.

    Blocks are numbered by partition and batch, so that they sort as their rows do.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k, pdf in enumerate(it):
        if pdf.empty:
            continue
        s = pdf["session_id"].to_numpy()
        c = pdf["code"].to_numpy()
        b = pdf["blank"].to_numpy().astype(bool)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        ends = np.r_[starts[1:], len(s)]
        same = np.r_[False, (s[1:] == s[:-1]) & (c[1:] == c[:-1])]
        fold = lambda x: np.add.reduceat(x.astype(np.int64), starts)
        yield pd.DataFrame(
            {
                "session_id": s[starts],
                "block": _block(part, k),
                "n": ends - starts,
                "first_code": c[starts],
                "last_code": c[ends - 1],
                "all_blank": fold(b) == ends - starts,
                "other": fold(c == OTHER) > 0,
                "same": fold(same) > 0,
                "blank_user": fold(b & (c == USER)) > 0,
                "blank_assistant": fold(b & (c == ASSISTANT)) > 0,
            }
        )


def conversation_defects(messages: DataFrame) -> DataFrame:
    """``(session_id, defect)`` of every conversation to be dropped.

    ``empty``, ``broken`` and ``missing_reply`` as in TESTDATA.md, the first that holds. Order is
    ``created_at`` (null first), then id. An unknown or missing role makes a conversation broken;
    repeated rows count once; an empty table gives no row.
    """
    rows = _codes(deduplicated_messages(messages)).select(*ORDER, "code", "blank")
    blocks = ordered_blocks(rows, *ORDER).mapInPandas(_summaries, _SUMMARY)
    piece = F.struct("block", "first_code", "last_code")
    folded = blocks.groupBy("session_id").agg(
        F.sort_array(F.collect_list(piece)).alias("pieces"),
        *[F.bool_and(c).alias(c) for c in ("all_blank",)],
        *[F.bool_or(c).alias(c) for c in ("other", "same", "blank_user", "blank_assistant")],
    )
    joins = F.expr(
        "exists(sequence(1, size(pieces) - 1 + int(size(pieces) = 1)), "
        "i -> i < size(pieces) and pieces[i].first_code = pieces[i - 1].last_code)"
    )
    first, last = F.col("pieces")[0]["first_code"], F.element_at("pieces", -1)["last_code"]
    defect = (
        F.when(F.col("all_blank"), "empty")
        .when(F.col("other") | (first != USER) | F.col("same") | joins | F.col("blank_user"), "broken")
        .when((last == USER) | F.col("blank_assistant"), "missing_reply")
    )
    return folded.select("session_id", defect.alias("defect")).where("defect is not null")


_GAPS = "bin int, n long, session_id long, block long, first_at double, last_at double"


def _gap_bins(gap: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each positive gap on the scale of ``log2``; the last bin takes what is longer."""
    return np.clip(np.floor(np.log2(gap) * bins / LOG2_LONGEST), 0, bins - 1).astype(np.int64)


def calibrated_gap(messages: DataFrame, bins: int = 64) -> float:
    """Seconds of inactivity that separate two segments of one conversation.

    A histogram of ``log2`` of the gaps between all neighbours of a session (``bins`` counts reach
    the driver, whatever the input) is cut where the variance between its two sides is largest.
    Without gaps, or when all are of one bin, nothing separates: infinity.
    """
    rows = messages.where("session_id is not null and created_at is not null").select("session_id", _seconds("created_at").alias("t"))

    def pieces(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Counts of the gaps within each batch; ends of the batch's first and last session."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, pdf in enumerate(it):
            if pdf.empty:
                continue
            s, t = pdf["session_id"].to_numpy(), pdf["t"].to_numpy()
            gap = np.diff(t)[s[1:] == s[:-1]]
            n = np.bincount(_gap_bins(gap[gap > 0], bins), minlength=bins)
            used = np.flatnonzero(n)
            yield pd.DataFrame({"bin": used, "n": n[used], "session_id": 0, "block": -1, "first_at": 0.0, "last_at": 0.0})
            ends = [(i, t[s == i]) for i in dict.fromkeys((s[0], s[-1]))]
            yield pd.DataFrame(
                {"bin": -1, "n": 0, "session_id": [i for i, _ in ends], "block": _block(part, k), "first_at": [x[0] for _, x in ends], "last_at": [x[-1] for _, x in ends]}
            )

    found = materialize(ordered_blocks(rows, "session_id", "t").mapInPandas(pieces, _GAPS))
    over = W.partitionBy("session_id").orderBy("block")
    bridge = found.where("bin < 0").select((F.col("first_at") - F.lag("last_at").over(over)).alias("gap")).where("gap > 0")
    step = LOG2_LONGEST / bins
    b = F.greatest(F.least(F.floor(F.log2("gap") / step), F.lit(bins - 1)), F.lit(0)).cast("int")
    counts = found.where("bin >= 0").select("bin", "n").unionByName(bridge.select(b.alias("bin"), F.lit(1).cast("long").alias("n")))
    n = np.zeros(bins)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        n[r["bin"]] = r["n"]
    if np.count_nonzero(n) < 2:
        return float("inf")
    x = np.arange(bins) + 0.5
    left, total = np.cumsum(n), n.sum()
    mean_left = np.cumsum(n * x) / np.maximum(left, 1)
    mean_right = ((n * x).sum() - np.cumsum(n * x)) / np.maximum(total - left, 1)
    between = left * (total - left) * (mean_left - mean_right) ** 2
    return float(2 ** ((int(np.argmax(between)) + 1) * step))


def with_inferred_roles(messages: DataFrame) -> DataFrame:
    """Messages whose role is ``user`` or ``assistant`` wherever that can be told, else as it was.

    A role spelled otherwise, or missing, follows from the row itself (only users' texts are hashed,
    only answers say what kind of question they took), else from what the rows of the same spelling
    say in their majority (a tie says nothing). Spellings are counted over all rows, pre-aggregated;
    a spelling with a third of all rows is one row of that count.
    """
    role = clean_role(F.col("role"))
    answer = F.get_json_object("retrieved_chunks", "$.query_type").isNotNull()
    own = F.when(role.isin("user", "assistant"), role).when(F.col("query_hash").isNotNull(), "user").when(answer, "assistant")
    told = messages.withColumns({"_spelled": role, "_own": own})
    odd = told.where("_spelled is not null and _spelled not in ('user', 'assistant')")
    votes = odd.groupBy("_spelled").agg(F.count_if(F.col("_own") == "user").alias("u"), F.count_if(F.col("_own") == "assistant").alias("a"))
    votes = materialize(votes.where("u <> a").select("_spelled", F.when(F.col("u") > F.col("a"), "user").otherwise("assistant").alias("_voted")))
    out = told.join(bounded_broadcast(votes, 100_000), "_spelled", "left")
    return out.withColumn("role", F.coalesce("_own", "_voted", "role")).select(*messages.columns)


def conversations(messages: DataFrame, gap_seconds: float | None = None, turns_per_row: int = 1000) -> DataFrame:
    """Kept conversations as ordered lists of turns: ``(session_id, part, n_turns, turns)``.

    ``turns`` holds ``(turn, segment, role, content, created_at, id)``; a conversation of more than
    ``turns_per_row`` turns continues in the next ``part``, so no row and no group is unbounded.
    ``segment`` counts up after each gap of ``gap_seconds`` (None: never). Conversations named by
    :func:`conversation_defects` are left out.
    """
    dropped = bounded_broadcast(materialize(conversation_defects(messages).select("session_id")), 500_000)
    kept = deduplicated_messages(messages, digest=True).drop("blank").join(dropped, "session_id", "left_anti")
    kept = kept.where(F.col("role").isin("user", "assistant"))
    # turns are numbered without their texts; the blocks' numbers must not change between the two uses: written once
    placed = materialize(ordered_blocks(kept, *ORDER).withColumn("block", F.spark_partition_id()))
    t = _seconds("created_at")
    in_block = W.partitionBy("session_id", "block").orderBy("created_at", "id")
    local = placed.withColumns(
        {
            "r": F.row_number().over(in_block),
            "cut": F.coalesce((t - F.lag(t).over(in_block) > F.lit(gap_seconds or float("inf"))).cast("long"), F.lit(0)),
        }
    ).withColumn("seg", F.sum("cut").over(in_block.rowsBetween(W.unboundedPreceding, 0)))
    sums = local.groupBy("session_id", "block").agg(
        F.max("r").cast("long").alias("rows"), F.max("seg").alias("segs"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")
    )
    over = W.partitionBy("session_id").orderBy("block")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    bridge = F.coalesce(
        (_seconds("first_at") - F.lag(_seconds("last_at")).over(over) > F.lit(gap_seconds or float("inf"))).cast("long"), F.lit(0)
    )
    offsets = sums.withColumn("bridge", bridge).select(
        "session_id",
        "block",
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        (F.coalesce(F.sum("segs").over(before), F.lit(0)) + F.sum("bridge").over(over.rowsBetween(W.unboundedPreceding, 0))).alias("segs_before"),
    )
    numbered = local.join(offsets, ["session_id", "block"]).select(
        "session_id",
        (F.col("r") + F.col("rows_before")).alias("turn"),
        (F.col("seg") + F.col("segs_before")).alias("segment"),
        "role",
        "id",
        "digest",
    )
    texts = messages.where("session_id is not null").select("session_id", "id", "content", "created_at", content_digest().alias("digest"))
    same = ["session_id", "id"]
    turns = texts.join(numbered.withColumnRenamed("digest", "d"), same).where(F.col("digest").eqNullSafe(F.col("d")))
    part = F.floor((F.col("turn") - 1) / turns_per_row).cast("long")
    turn = F.struct("turn", "segment", "role", "content", "created_at", "id")
    # a row delivered twice is one turn
    lists = turns.groupBy("session_id", part.alias("part")).agg(F.sort_array(F.collect_set(turn)).alias("turns"))
    return lists.select("session_id", "part", F.size("turns").cast("long").alias("n_turns"), "turns")
