"""What a language model is shown: statistics, chunks and the prompt, as columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def listed(names: Column, limit: int = 15) -> Column:
    """The first names, and how many more there are."""
    more = F.size(names) - limit
    shown = F.array_join(F.slice(names, 1, limit), ", ")
    return F.when(more > 0, F.concat(shown, F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(shown)


def stats_block(stats: DataFrame) -> DataFrame:
    """``(file_id, stats_text)`` of :func:`lodestone.operators.graph.code_stats`."""
    text = F.concat_ws(
        "\n",
        F.format_string("Lines: %d", "n_lines"),
        F.format_string("Functions: %d", "n_functions"),
        F.concat(F.lit("  "), listed(F.col("functions"))),
        F.format_string("Classes: %d", "n_classes"),
        F.concat(F.lit("  "), listed(F.col("classes"))),
    )
    return stats.select("file_id", text.alias("stats_text"))


def chunk_context(results: DataFrame, limit: int = 5, width: int = 2000) -> DataFrame:
    """``(question_id, context)``: the best chunks with their place, decorators and hints, cut at ``width``."""
    hints = F.array_join(F.transform("hints", lambda h: F.concat(h["name"], F.lit(": "), h["hint"])), ", ")
    head = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_type"), F.lit(" "), F.coalesce("name", F.lit("")),
        F.format_string(" (lines %d-%d)", F.col("line_start") + 1, F.col("line_start") + F.col("line_count")),
    )
    body = F.concat_ws(
        "\n",
        head,
        F.when(F.size("decorators") > 0, F.concat(F.lit("decorators: "), F.array_join("decorators", ", "))),
        F.when(F.size("hints") > 0, F.concat(F.lit("types: "), hints)),
        F.substring("content", 1, width),
    )
    best = results.where(F.col("rank") <= limit).groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", body.alias("b")))).alias("c"))
    return best.select("question_id", F.array_join(F.transform("c", lambda x: x["b"]), "\n\n").alias("context"))


def prompts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(question_id, prompt)``; a question without results gets a prompt that says so.

    Statistics of the code come first where ``questions`` has a column ``stats_text``.
    """
    stats = F.concat(F.lit("Statistics:\n"), "stats_text") if "stats_text" in questions.columns else F.lit(None).cast("string")
    text = F.concat_ws(
        "\n\n",
        F.lit("Answer from the code below only. Name the functions and lines you rely on; say so if the code does not tell."),
        F.concat(F.lit("Kind of question: "), "intent"),
        stats,
        F.concat(F.lit("Code:\n"), F.coalesce("context", F.lit("(nothing found)"))),
        F.concat(F.lit("Question: "), "text"),
    )
    return questions.join(contexts, "question_id", "left").select("question_id", text.alias("prompt"))


def answers(prompts_: DataFrame, client: Callable[[str], str] | None = None) -> DataFrame:
    """``(question_id, prompt, answer, seconds)``; without a client the answer is null.

    ``client`` takes a prompt and returns text; it owns its timeouts and retries
    (see :class:`lodestone.sources.client.RetryingClient`). A failing client gives a null answer.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for pdf in it:
            out, took = [], []
            for p in pdf["prompt"]:
                t = time.monotonic()
                try:
                    out.append(client(p) if client else None)
                except Exception:  # noqa: BLE001
                    out.append(None)
                took.append(time.monotonic() - t)
            yield pdf.assign(answer=pd.Series(out, dtype=object), seconds=took)

    return prompts_.mapInPandas(run, "question_id long, prompt string, answer string, seconds double")


def log_stats(log: DataFrame) -> DataFrame:
    """One row on a query log (``seconds, answer``): queries, mean and longest time, share answered.

    Where the log has them, also ``cached`` (number and share from the cache) and ``intent`` (kinds asked).
    """
    more = []
    if "cached" in log.columns:
        more += [F.count_if(F.col("cached")).alias("n_cached"), F.avg(F.col("cached").cast("double")).alias("share_cached")]
    if "intent" in log.columns:
        more.append(F.count_distinct("intent").alias("n_intents"))
    return log.agg(
        F.count("*").alias("n_queries"),
        F.avg("seconds").alias("mean_seconds"),
        F.max("seconds").alias("longest_seconds"),
        F.avg(F.col("answer").isNotNull().cast("double")).alias("share_answered"),
        *more,
    )
