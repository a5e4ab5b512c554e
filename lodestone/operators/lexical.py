"""Lexical index as plain tables (postings, document frequency, lengths) and BM25 over many queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import words
from lodestone.operators import dims
from lodestone.session import bounded_broadcast, materialize


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, tok, tf)``: words of each text, counted. Pre-aggregated before the shuffle."""
    return docs.select(F.col(id_col).alias("doc"), F.explode(words(F.col(text_col))).alias("tok")).groupBy("doc", "tok").agg(F.count("*").alias("tf"))


def document_lengths(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc, dl)``: words of each text, without a shuffle; a null text has none."""
    return docs.select(F.col(id_col).alias("doc"), F.coalesce(F.size(words(F.col(text_col))), F.lit(0)).cast("long").alias("dl"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: number of documents and mean length."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def idf_table(posts: DataFrame, stats: DataFrame) -> DataFrame:
    """``(tok, df, idf)``; the one-row statistics are a scalar side."""
    df = posts.groupBy("tok").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return df.join(F.broadcast(stats)).select("tok", "df", idf.alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, id_col: str, text_col: str, k1: float = dims.BM25_K1, b: float = dims.BM25_B, pairs: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc, bm25)`` of all documents sharing a word with a query, of ``pairs`` (``query_id, doc``) only where these are given.

    ``queries`` has ``query_id`` and ``text``. The corpus is split into words once: a text's words are
    counted in place, and only the counts of query words (broadcast while these are few) leave its task,
    together with its length, and are kept for document frequencies and scores. A query word counts as
    often as it is asked.
    """
    terms = queries.select("query_id", F.explode(words(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qf"))
    terms = materialize(terms)
    asked = materialize(terms.select("tok").distinct())
    split = docs.select(F.col(id_col).alias("doc"), words(F.col(text_col)).alias("ws"))
    n = F.coalesce(F.size("ws"), F.lit(0)).cast("long")
    stats = split.agg(F.count("*").alias("n_docs"), F.avg(F.greatest(n, F.lit(0))).alias("avgdl"))
    # words of one text stay together: repeated ones are counted before the shuffle
    used = split.select("doc", n.alias("dl"), F.explode("ws").alias("tok")).join(bounded_broadcast(asked, 500_000), "tok", "left_semi")
    tf = materialize(used.groupBy("doc", "tok", "dl").agg(F.count("*").alias("tf")))
    df = tf.groupBy("tok").agg(F.count("*").alias("df"))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    few = terms.join(df, "tok")
    if pairs is not None:
        # a candidate's words meet its own query's only; frequencies and lengths are those of all documents
        own = tf.join(pairs.distinct().hint("merge"), "doc")
        scored = own.join(materialize(few).hint("merge"), ["query_id", "tok"]).join(F.broadcast(stats))
        return scored.groupBy("query_id", "doc").agg(F.sum(F.col("qf") * idf * part).alias("bm25"))
    scored = tf.join(bounded_broadcast(materialize(few), 500_000), "tok").join(F.broadcast(stats))
    return scored.groupBy("query_id", "doc").agg(F.sum(F.col("qf") * idf * part).alias("bm25"))


def overlap_terms(queries: DataFrame) -> DataFrame:
    """``(query_id, terms)``: distinct question words longer than two that are no stop words."""
    stop = F.array(*[F.lit(w) for w in dims.STOPWORDS])
    keep = F.filter(F.array_distinct(words(F.col("text"))), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return queries.select("query_id", keep.alias("terms"))


def overlap_score(terms, content, name):
    """0.04 for each term within the content, 0.12 for each within the name, ignoring case."""
    hits = lambda text: F.aggregate(terms, F.lit(0), lambda n, t: n + F.when(F.lower(text).contains(t), 1).otherwise(0))
    return F.lit(0.04) * hits(content) + F.lit(0.12) * hits(name)


def noise_factor(content):
    """0.6 for fewer than 50 characters, 0.85 for more than 5,000, else 1."""
    n = F.length(content)
    return F.when(n < 50, 0.6).when(n > 5000, 0.85).otherwise(1.0)
