"""Hybrid retrieval: vector candidates, word scores, metadata boosts, penalties, re-rank, neighbours, cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import dims, lexical


def blended(candidates: DataFrame) -> DataFrame:
    """``score`` = weights of vector similarity and of BM25 / 10, the latter at most 1 (absent: 0)."""
    norm = F.least(F.coalesce("bm25", F.lit(0.0)) / dims.BM25_NORM, F.lit(1.0))
    return candidates.withColumn("bm25_norm", norm).withColumn("score", F.col("semantic_weight") * F.col("sim") + F.col("bm25_weight") * F.col("bm25_norm"))


def boosted(candidates: DataFrame) -> DataFrame:
    """Add the similarity times the weights of the matched ``fields``; exact matches only where asked.

    A preferred chunk type counts as a type match, a function whose name the question holds adds 0.5.
    """
    fields = F.coalesce("fields", F.array().cast("array<string>"))
    total = F.lit(0.0)
    for f in ("name", "keywords", "docstring_match", "function_calls", "type_hint_match", "decorator_match"):
        total = total + F.when(F.array_contains(fields, f), dims.BOOST[f]).otherwise(0.0)
    total = total + F.when(F.col("boost_exact") & F.array_contains(fields, "exact_match"), dims.BOOST["exact_match"]).otherwise(0.0)
    total = total + F.when(F.array_contains("prefer_types", F.col("chunk_type")), dims.BOOST["chunk_type"]).otherwise(0.0)
    total = total + F.when(F.coalesce("name_hit", F.lit(False)), dims.NAME_HIT).otherwise(0.0)
    return candidates.withColumn("score", F.col("score") + F.col("sim") * total)


def penalized(candidates: DataFrame) -> DataFrame:
    """Scores of very short and very long contents are cut."""
    return candidates.withColumn("score", F.col("score") * lexical.noise_factor(F.col("content")))


def reranked(candidates: DataFrame) -> DataFrame:
    """Add the overlap of the question's words with content and name."""
    return candidates.withColumn("score", F.col("score") + lexical.overlap_score(F.col("overlap_terms"), F.col("content"), F.coalesce("name", F.lit(""))))


def _ranked(df: DataFrame) -> DataFrame:
    w = W.partitionBy("question_id").orderBy(F.desc("score"), "knn_rank", "vec_id")
    return df.withColumn("rank", F.row_number().over(w))


def with_neighbours(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """For flow questions, chunks next to the best three, not yet present, at 0.7 of the score."""
    top = ranked.where("intent = 'flow_explanation' and rank <= 3")
    near = top.select("question_id", "file_id", F.explode(F.array(F.col("chunk_id") - 1, F.col("chunk_id") + 1)).alias("chunk_id"), F.struct(F.col("rank").alias("r"), (F.col("score") * 0.7).alias("score")).alias("p"))
    best = near.groupBy("question_id", "file_id", "chunk_id").agg(F.min("p").alias("p"))
    new = best.join(ranked.select("question_id", "file_id", "chunk_id"), ["question_id", "file_id", "chunk_id"], "left_anti")
    extra = new.join(chunks, ["file_id", "chunk_id"]).select(
        "question_id", "file_id", "chunk_id", "vec_id", "content", "name", "chunk_type", F.col("p.score").alias("score"), F.lit(1_000_000).alias("knn_rank"), F.lit(True).alias("is_neighbour")
    )
    keep = ranked.select("question_id", "file_id", "chunk_id", "vec_id", "content", "name", "chunk_type", "score", "knn_rank", F.lit(False).alias("is_neighbour"))
    return keep.unionByName(extra)


def hybrid(questions: DataFrame, candidates: DataFrame, word_scores: DataFrame, fields: DataFrame, chunks: DataFrame, k: int = dims.TOP_K) -> DataFrame:
    """The best ``k`` chunks of each question.

    ``questions``: routed (``question_id, text`` and the router's columns); ``candidates``:
    ``question_id, vec_id, sim, knn_rank``; ``word_scores``: ``question_id, vec_id, bm25``; ``fields``:
    ``question_id, file_id, chunk_id, fields``; ``chunks``: ``vec_id, file_id, chunk_id, content, name,
    chunk_type``. Equal scores keep the vector order, then the smaller id. The candidate pool of a
    question is bounded by the vector search, so no join here multiplies rows.
    """
    c = candidates.join(word_scores, ["question_id", "vec_id"], "left").join(chunks, "vec_id").join(questions, "question_id")
    c = c.join(fields, ["question_id", "file_id", "chunk_id"], "left")
    terms = lexical.overlap_terms(questions.select(F.col("question_id").alias("query_id"), "text")).toDF("question_id", "overlap_terms")
    name_hit = (F.col("chunk_type") == "function") & (F.length(F.coalesce("name", F.lit(""))) > 0) & F.lower("text").contains(F.lower("name"))
    c = c.withColumn("name_hit", name_hit).join(terms, "question_id")
    r = _ranked(reranked(penalized(boosted(blended(c)))))
    return _ranked(with_neighbours(r, chunks)).where(F.col("rank") <= k)
