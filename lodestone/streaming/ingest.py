"""Continuous ingest: new files are analysed once for each content, findings appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators import merge, rules
from lodestone.operators.ast_table import ast_nodes
from lodestone.session import materialize

FILES = "file_id long, path string, code string, at timestamp"


def file_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Parquet files of ``file_id, path, code, at`` as they arrive."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", max_files).parquet(folder)


def new_contents(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content once within the watermark; the state is bounded by the delay."""
    return stream.withColumn("code_hash", F.sha2("code", 256)).withWatermark("at", delay).dropDuplicatesWithinWatermark(["code_hash"])


def analyze_batch(files: DataFrame) -> DataFrame:
    """Ranked findings of one batch, parsed once."""
    return merge.ranked(merge.merge_findings(rules.raw_findings(files, materialize(ast_nodes(files)))))


def run(stream: DataFrame, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Write each batch's findings under ``out``; a batch that is retried replaces its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        try:
            analyze_batch(batch.select("file_id", "code")).write.mode("overwrite").parquet(f"{out}/batch={n}")
        finally:
            batch.unpersist()

    w = new_contents(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def findings_per_window(findings: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Findings by window and severity, late rows within the delay counted (``at``, ``severity``)."""
    return findings.withWatermark("at", delay).groupBy(F.window("at", width), "severity").agg(F.count("*").alias("n"))
