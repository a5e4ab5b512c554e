"""Findings of several scanners: categories, severities, first-wins merge, rank and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import dims


def category(rule: Column) -> Column:
    """The category of a rule; an unknown rule is its own. A literal map, folded into the plan."""
    pairs = [F.lit(x) for kv in dims.RULE_CATEGORY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), rule), rule)


def severity(cat: Column) -> Column:
    """HIGH for the listed categories, MEDIUM for all others."""
    return F.when(cat.isin(*dims.HIGH), "HIGH").otherwise("MEDIUM")


def concatenate(*scanners: DataFrame) -> DataFrame:
    """Raw findings of scanners in order of priority; ``seq`` of each follows that of the ones before."""
    out = None
    for k, s in enumerate(scanners):
        s = s.withColumn("seq", F.col("seq") + F.lit(k).cast("long") * (1 << 50))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def merge_findings(raw: DataFrame) -> DataFrame:
    """One row for each ``(file_id, line, category)``; the first finding in ``seq`` order wins.

    Empty messages and suggestions are filled from the first that has one; ``sources`` lists the
    scanners in order of first appearance. A null line counts as line 0.
    """
    if "code_snippet" not in raw.columns:
        raw = raw.withColumn("code_snippet", F.lit(None).cast("string"))
    r = raw.withColumn("line", F.coalesce("line", F.lit(0))).withColumn("rule", category(F.coalesce("rule", F.lit(""))))
    # one row for each source first, so that nothing is collected but distinct scanners
    by_source = r.groupBy("file_id", "line", "rule", "source").agg(
        F.min("seq").alias("seq"),
        F.min_by("code_snippet", "seq").alias("code_snippet"),
        F.min_by(F.nullif("message", F.lit("")), F.when(F.coalesce("message", F.lit("")) != "", F.col("seq"))).alias("message"),
        F.min(F.when(F.coalesce("message", F.lit("")) != "", F.col("seq"))).alias("message_seq"),
        F.min_by(F.nullif("suggestion", F.lit("")), F.when(F.coalesce("suggestion", F.lit("")) != "", F.col("seq"))).alias("suggestion"),
        F.min(F.when(F.coalesce("suggestion", F.lit("")) != "", F.col("seq"))).alias("suggestion_seq"),
    )
    merged = by_source.groupBy("file_id", "line", "rule").agg(
        F.min("seq").alias("seq"),
        F.coalesce(F.min_by("message", "message_seq"), F.lit("")).alias("message"),
        F.coalesce(F.min_by("suggestion", "suggestion_seq"), F.lit("")).alias("suggestion"),
        F.transform(F.sort_array(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]).alias("sources"),
        F.min_by("code_snippet", "seq").alias("code_snippet"),
    )
    return merged.withColumn("severity", severity(F.col("rule")))


def ranked(merged: DataFrame) -> DataFrame:
    """``rank`` within a file: HIGH first, then by line, ties as they were found."""
    w = W.partitionBy("file_id").orderBy(F.when(F.col("severity") == "HIGH", 0).otherwise(1), "line", "seq")
    return merged.withColumn("rank", F.row_number().over(w))


def counts(merged: DataFrame, *keys: str) -> DataFrame:
    """Total, HIGH and MEDIUM findings, by ``keys`` (none: of all)."""
    return merged.groupBy(*keys).agg(
        F.count("*").alias("total_issues"),
        F.count_if(F.col("severity") == "HIGH").alias("high_count"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium_count"),
    )
