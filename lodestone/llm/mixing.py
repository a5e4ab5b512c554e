"""Problem 9: mix sources to target weights, sized in tokens of a public tokenizer.

Systematic sampling: within a source, documents' expected copies are prefix-summed, one random
offset is added, and a document is emitted once for each whole number its interval crosses. The
prefix sums run over hash buckets of bounded size, so a source with a third of all rows is no task
of its own, and equal records are one row with a count. Copies are whole numbers of ``UNIT``, so sums
are exact in any order, at any size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import bounded_broadcast, materialize

TOKENIZER_DIR = os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers")
#: Split pattern that belongs to the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: A copy as a whole number: 2^26, so that the copies of 10^10 records still fit 64 bits.
UNIT = 1 << 26


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, source, n_tokens)``; null and empty texts have no token."""
    path = vocabulary or os.path.join(TOKENIZER_DIR, "byte_bpe_multi_50k.tiktoken")

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path)
        for pdf in it:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": pd.Series(n, dtype="int64")})

    return documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInPandas(
        count, "doc_id long, source string, n_tokens long"
    )


def _plan(sized: DataFrame, targets: DataFrame, total_tokens: float | None) -> DataFrame:
    """For each source with a target: tokens at hand, tokens wanted, expected copies of a document."""
    have = sized.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("tokens"), F.sum("n").alias("docs"))
    t = targets.select("source", "target_share", "max_repeats").dropDuplicates(["source"])
    plan = t.join(have, "source", "left").select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"),
    )
    cap = F.col("tokens") * F.col("max_repeats")
    size = F.lit(float(total_tokens)) if total_tokens else F.min(F.when((cap > 0) & (F.col("target_share") > 0), cap / F.col("target_share"))).over(W.partitionBy())
    wanted = F.least(F.coalesce(size, F.lit(0.0)) * F.col("target_share"), cap.cast("double"))
    return plan.withColumn("wanted", wanted).withColumn(
        "rate", F.when(F.col("tokens") > 0, F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    )


def mix(
    documents: DataFrame,
    targets: DataFrame,
    seed: int = 0,
    total_tokens: float | None = None,
    vocabulary: str | None = None,
    bucket_rows: int = 20_000,
) -> tuple[DataFrame, DataFrame]:
    """The selection ``(doc_id, source, n_tokens, copies)`` and the report of its shares.

    Without ``total_tokens`` the size is the largest for which every source that has documents
    reaches its share without going over its ``max_repeats``. A source without documents or target
    contributes nothing, and shares are reported of what was reached: ``target_share``,
    ``reachable_share`` (targets of the sources that have tokens, scaled to 1) and
    ``actual_share``. A document id that occurs twice is two records; records equal in id, source and
    tokens are one row, whose ``copies`` are those of all of them.
    """
    # equal records first become one: copies of one record may be a third of all rows
    sized = materialize(token_counts(documents, vocabulary).groupBy("doc_id", "source", "n_tokens").agg(F.count("*").alias("n")))
    plan = materialize(_plan(sized, targets, total_tokens))
    n_buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / bucket_rows))
    rows = sized.join(bounded_broadcast(plan.select("source", "docs", "rate", "max_repeats"), 100_000), "source")
    units = F.round(F.col("rate") * UNIT).cast("long") * F.col("n")
    rows = rows.withColumns({"bucket": F.pmod(F.xxhash64("doc_id", F.lit(seed)), n_buckets), "units": units})
    sums = rows.groupBy("source", "bucket").agg(F.sum("units").alias("s"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    in_bucket = W.partitionBy("source", "bucket").orderBy("n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed + 1)), F.lit(UNIT))
    placed = rows.join(starts, ["source", "bucket"]).withColumn("end", F.col("start") + F.sum("units").over(in_bucket) + offset)
    copies = F.shiftright("end", 26) - F.shiftright(F.col("end") - F.col("units"), 26)
    chosen = (
        placed.withColumn("copies", F.least(copies, F.col("max_repeats").cast("long") * F.col("n")))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies", "n")
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max(F.ceil(F.col("copies") / F.col("n"))).alias("most"))
    report = plan.join(used, "source", "left")
    all_used = F.sum(F.coalesce("used", F.lit(0))).over(W.partitionBy())
    reachable = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    report = report.select(
        "source",
        "target_share",
        (reachable / F.sum(reachable).over(W.partitionBy())).alias("reachable_share"),
        F.when(all_used > 0, F.coalesce("used", F.lit(0)) / all_used).otherwise(0.0).alias("actual_share"),
        F.coalesce("used", F.lit(0)).cast("long").alias("tokens_used"),
        "tokens",
        "docs",
        "max_repeats",
        F.coalesce("most", F.lit(0)).cast("long").alias("most_copies"),
    )
    return chosen.drop("n"), report
