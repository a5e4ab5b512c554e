"""Small text helpers shared by the operators: visibility, roles and ordered neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A visible character: no separator, control, format or unassigned one, no blank filler letter.
VISIBLE = "[^\\p{Z}\\p{C}\\u115F\\u1160\\u2800\\u3164\\uFFA0]"


def is_blank(c: Column) -> Column:
    """True for null and for text without a visible character."""
    return ~F.coalesce(c.rlike(VISIBLE), F.lit(False))


def clean_role(c: Column) -> Column:
    """Lower case without outer white space; null stays null."""
    return F.when(c.isin("user", "assistant"), c).otherwise(F.lower(F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")))


def content_digest() -> Column:
    """MD5 of the content as 16 bytes; null of a null content."""
    return F.unhex(F.md5(F.col("content")))


def deduplicated_messages(messages: DataFrame, digest: bool = False) -> DataFrame:
    """One row for each message.

    Rows equal in ``session_id``, cleaned role, ``content`` and ``created_at`` are one message; the
    smallest id stays. Rows without a session id belong to no conversation and are left out. The
    content is compared by its MD5, so that only 16 bytes of it are shuffled; ``digest`` keeps them.
    """
    m = messages.where("session_id is not null").select(
        "session_id",
        clean_role(F.col("role")).alias("role"),
        "created_at",
        "id",
        content_digest().alias("digest"),
        is_blank(F.col("content")).alias("blank"),
    )
    out = m.groupBy("session_id", "role", "created_at", "digest", "blank").agg(F.min("id").alias("id"))
    return out if digest else out.drop("digest")


def ordered_blocks(df: DataFrame, *order: str) -> DataFrame:
    """Range-partition by ``order`` and sort within the partitions.

    The ranges are cut by sampled rows, not by key, so one session with a third of all rows is
    spread over a third of the partitions; what spans a boundary is joined again from one row for
    each partition and session.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
