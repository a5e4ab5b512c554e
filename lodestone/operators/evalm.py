"""Retrieval metrics: hit rate, recall, reciprocal rank and nDCG at k, and their means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_question(results: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """``(question_id, hit, recall, mrr, ndcg)`` of each question with results.

    ``results`` has ``question_id, name, rank`` (from 1), ``qrels`` has ``question_id, relevant``.
    A result listed twice counts twice; recall without relevant items is 0.
    """
    r = results.join(qrels, "question_id").withColumn("rel", F.array_contains("relevant", F.col("name")).cast("int"))
    top = (F.col("rank") <= k).cast("int") * F.col("rel")
    g = r.groupBy("question_id").agg(
        F.max(top).alias("hit"),
        F.sum(top).alias("hits"),
        F.first(F.size("relevant")).alias("n_rel"),
        F.coalesce(F.max(F.when(F.col("rel") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(top == 1, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_rel", F.lit(k)))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    return g.select(
        "question_id",
        "hit",
        F.when(F.col("n_rel") > 0, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"),
        "mrr",
        F.when(F.col("n_rel") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def summary(metrics: DataFrame) -> DataFrame:
    """One row of means over questions that returned something, with the grade of the mean hit rate."""
    m = metrics.agg(F.count("*").alias("n_questions"), *[F.avg(c).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])
    grade = F.when(F.col("hit") >= 0.9, "excellent").when(F.col("hit") >= 0.75, "good").when(F.col("hit") >= 0.5, "needs work").otherwise("poor")
    return m.withColumn("grade", grade)
