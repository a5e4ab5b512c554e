"""Text reports and the figures a dashboard shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(files: DataFrame, metrics: DataFrame, ranked: DataFrame) -> DataFrame:
    """``(file_id, part, pos, text)``: header, metrics, severities, then HIGH and MEDIUM blocks in order."""
    sev = ranked.groupBy("file_id").agg(F.count_if(F.col("severity") == "HIGH").alias("high"), F.count_if(F.col("severity") == "MEDIUM").alias("medium"))
    head = files.select("file_id", "path").join(metrics, "file_id", "left").join(sev, "file_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    line = lambda part, *text: F.struct(F.lit(part).alias("part"), F.lit(0).alias("pos"), F.concat(*text).alias("text"))
    rows = F.array(
        line(0, F.lit("Security report: "), F.coalesce("path", F.lit("(unnamed)"))),
        line(1, F.lit("Lines "), n("lines_of_code"), F.lit(", functions "), n("function_count"), F.lit(", classes "), n("class_count"), F.lit(", imports "), n("import_count"), F.lit(", complexity "), n("max_complexity")),
        line(2, F.lit("HIGH "), n("high"), F.lit(", MEDIUM "), n("medium")),
    )
    top = head.select("file_id", F.explode(rows).alias("r")).select("file_id", "r.*")
    part = F.when(F.col("severity") == "HIGH", 3).otherwise(4)
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("["), "severity", F.lit("] line "), F.col("line").cast("string"), F.lit(": "), "rule"),
        F.concat(F.lit("  "), "message"),
        F.when(F.coalesce("suggestion", F.lit("")) != "", F.concat(F.lit("  -> "), "suggestion")),
        F.concat(F.lit("  from "), F.array_join("sources", ", ")),
        F.nullif(F.coalesce("code_snippet", F.lit("")), F.lit("")),
    )
    issues = ranked.select("file_id", part.alias("part"), F.col("rank").alias("pos"), text.alias("text"))
    return top.unionByName(issues)


def write_report(lines: DataFrame, path: str) -> None:
    """One text part for each range of files, ordered within."""
    lines.repartitionByRange("file_id").sortWithinPartitions("file_id", "part", "pos").select("text").write.mode("overwrite").text(path)


def severity_donut(findings: DataFrame) -> DataFrame:
    """Findings by severity, as spelled."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def top_rules(findings: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent rules; ties by name."""
    return findings.where("rule is not null").groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule").limit(n)


def search_findings(findings: DataFrame, severity: str | None = None, text: str = "") -> DataFrame:
    """Findings of a severity whose rule or message holds the text, ignoring case."""
    out = findings if severity is None else findings.where(F.col("severity") == severity)
    q = text.lower()
    if q:
        out = out.where(F.coalesce(F.lower("rule").contains(q), F.lit(False)) | F.coalesce(F.lower("message").contains(q), F.lit(False)))
    return out


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts by severity and rule, with sub-totals."""
    return findings.rollup("severity", "rule").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
