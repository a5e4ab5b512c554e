"""The session store: parquet tables with appends, versions and set-based reads.

Every change is one distributed write. A parent row is written after its children, so a save that
breaks off leaves nothing visible. A table is a list of folders in a numbered version file: a change
writes its folder first and then the next version, which is created by renaming a finished file to a
name that must not exist. Readers take the highest version, so they see the old or the new state; of
two writers one finds its number taken, reads again and tries the next.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import materialize

SCHEMAS = {
    "sessions": "id long, filename string, title string, code string, code_hash string, syntax_valid boolean, high_count int, medium_count int, total_issues int, created_at timestamp",
    "security_findings": "id long, session_id long, severity string, rule string, line_number int, message string, suggestion string",
    "chat_messages": "id long, session_id long, role string, content string, query_hash string, retrieved_chunks string, created_at timestamp",
    "code_chunks": "id long, session_id long, chunk_index int, chunk_text string, start_line int, end_line int, embedding_id string",
    "analysis_cache": "id long, code_hash string, query_hash string, query string, response string, created_at timestamp",
}
CHILDREN = ("security_findings", "chat_messages", "code_chunks")


def content_hash(c: Column) -> Column:
    """SHA-256 of the exact text."""
    return F.sha2(c, 256)


# -- set-based reads over the store's tables --------------------------------------------------------


def session_list(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest sessions without their code; equal times by larger id."""
    cols = ("id", "filename", "title", "syntax_valid", "high_count", "medium_count", "total_issues", "created_at")
    return sessions.select(*cols).orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def display_title(sessions: DataFrame) -> DataFrame:
    """``(id, title)``: the file name stands in for a null or empty title."""
    return sessions.select("id", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("title"))


def load_sessions(ids: DataFrame, sessions: DataFrame, findings: DataFrame, messages: DataFrame, per_row: int = 1000) -> DataFrame:
    """Sessions of ``ids`` (column ``id``) with their findings and messages, in parts of bounded size.

    Part 0 of a session holds its columns, its findings and its first ``per_row`` messages, each further
    part the next ones; arrays are ordered by id. A batch of ids is one pair of joins. Messages of broken
    JSON keep empty metadata.
    """
    s = sessions.join(ids.select("id").distinct(), "id", "left_semi").withColumn("part", F.lit(0).cast("long"))
    want = s.select(F.col("id").alias("session_id"))
    f = findings.join(want, "session_id", "left_semi").groupBy("session_id").agg(
        F.sort_array(F.collect_list(F.struct("id", "severity", "rule", "line_number", "message", "suggestion"))).alias("findings")
    )
    m = session_messages(want.withColumnRenamed("session_id", "id"), messages, per_row).withColumnRenamed("session_id", "id")
    whole = s.join(f.withColumnRenamed("session_id", "id"), "id", "left")
    return whole.join(m.drop("n"), ["id", "part"], "full")


def session_messages(ids: DataFrame, messages: DataFrame, per_row: int = 1000) -> DataFrame:
    """``(session_id, part, n, messages)``: messages of ``ids`` in order of their ids, ``per_row`` to a part.

    A session with a third of all rows is many parts on many tasks: rows are range-sorted, numbered
    within their block, and moved on by one row for each block and session.
    """
    want = messages.join(ids.select(F.col("id").alias("session_id")).distinct(), "session_id", "left_semi")
    n = int(want.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meta = F.coalesce(F.from_json("retrieved_chunks", "map<string,string>"), F.create_map().cast("map<string,string>"))
    rows = want.select("session_id", F.struct("id", "role", "content", F.to_json(meta).alias("metadata")).alias("m"))
    placed = materialize(rows.repartitionByRange(n, "session_id", "m").withColumn("p", F.spark_partition_id()))
    local = placed.withColumn("r", F.row_number().over(W.partitionBy("session_id", "p").orderBy("m")))
    before = W.partitionBy("session_id").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("session_id", "p").agg(F.count("*").alias("n"))
    offsets = blocks.select("session_id", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    part = F.floor((F.col("r") + F.col("moved") - 1) / per_row).alias("part")
    numbered = local.join(offsets, ["session_id", "p"]).select("session_id", part, "m")
    return numbered.groupBy("session_id", "part").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("m")).alias("messages"))


def latest_responses(cache: DataFrame) -> DataFrame:
    """``(code_hash, query_hash, response)``: the newest answer of each key; null keys match nothing."""
    newest = F.max_by(F.struct("response"), F.struct("created_at", "id")).alias("r")
    return cache.where("code_hash is not null and query_hash is not null").groupBy("code_hash", "query_hash").agg(newest).select("code_hash", "query_hash", F.col("r.response").alias("response"))


def split_by_cache(questions: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (``code_hash, query_hash``) with a cached response, and those without."""
    known = latest_responses(cache).where("response is not null")
    return questions.join(known, ["code_hash", "query_hash"]), questions.join(known, ["code_hash", "query_hash"], "left_anti")


def without_sessions(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables after deleting the sessions of ``ids``, children included; the cache stays."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    out = dict(tables)
    for name in ("sessions", *CHILDREN):
        if name in out:
            key = "id" if name == "sessions" else "session_id"
            out[name] = out[name].join(gone, F.col(key) == F.col("_gone"), "left_anti")
    return out


def renamed(sessions: DataFrame, titles: DataFrame) -> DataFrame:
    """Sessions with new titles (``id, new_title``); blank ones change nothing."""
    t = titles.where(F.trim("new_title") != "").groupBy("id").agg(F.max("new_title").alias("new_title"))
    return sessions.join(t, "id", "left").withColumn("title", F.coalesce("new_title", "title")).drop("new_title").select(*sessions.columns)


def next_ids(rows: DataFrame, order: str, start: int) -> DataFrame:
    """Dense ids from ``start`` on, by ``order``, without one task that sees all rows.

    Rows are range-partitioned; the counts of the partitions (one row each) give the offsets.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = materialize(rows.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}
    total, base = start, []
    for p in sorted(counts):
        base += [F.lit(p), F.lit(total).cast("long")]
        total += counts[p]
    offsets = F.create_map(*base) if base else F.create_map(F.lit(0), F.lit(0).cast("long"))
    w = W.partitionBy("_p").orderBy(order)
    return parts.withColumn("id", F.element_at(offsets, F.col("_p")) + F.row_number().over(w) - 1).drop("_p")


# -- the store itself --------------------------------------------------------------------------------


class SessionStore:
    """Tables under one folder that all executors can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, name: str) -> list[int]:
        fs, path = self._fs()
        found = fs.globStatus(path(f"{self.root}/{name}.v*"))
        return sorted(int(f.getPath().getName().rsplit(".v", 1)[1]) for f in found or [])

    def _current(self, name: str) -> tuple[int, list[str]]:
        """Number and folders of the table's highest version; 0 and none without one."""
        fs, path = self._fs()
        versions = self._versions(name)
        if not versions:
            return 0, []
        stream = fs.open(path(f"{self.root}/{name}.v{versions[-1]:012d}"))
        try:
            return versions[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, name: str, version: int, folders: list[str]) -> bool:
        """Make ``folders`` the table's version of that number; false if another writer has it."""
        fs, path = self._fs()
        new, final = path(f"{self.root}/_{name}.{uuid.uuid4().hex}"), path(f"{self.root}/{name}.v{version:012d}")
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        done = self._claim(fs, path, name, version) and fs.rename(new, final)
        if not done:
            fs.delete(new, False)
        return done

    def _next(self, name: str, version: int) -> int:
        """The number after ``version``, past those that a writer took and then left for a minute."""
        fs, path = self._fs()
        while True:
            version += 1
            claim = path(f"{self.root}/_claims/{name}.{version:012d}")
            if not fs.exists(claim) or fs.getFileStatus(claim).getModificationTime() > (time.time() - 60) * 1000:
                return version

    def _claim(self, fs, path, name: str, version: int) -> bool:
        """Take the number: the folder of a claim is made by one writer only (create without overwrite)."""
        try:
            fs.create(path(f"{self.root}/_claims/{name}.{version:012d}"), False).close()
            return True
        except Py4JJavaError as exc:
            if "FileAlreadyExists" in str(exc.java_exception.getClass()) or "already exists" in str(exc.java_exception.getMessage()):
                return False
            raise

    def _change(self, name: str, folders_of, attempts: int = 1000) -> None:
        """Publish what ``folders_of`` makes of the current folders, again after another writer's change."""
        for _ in range(attempts):
            version, folders = self._current(name)
            if self._publish(name, self._next(name, version), folders_of(folders)):
                return
            time.sleep(0.1)
        raise OSError(f"{name}: other writers hold the next version")

    def table(self, name: str) -> DataFrame:
        """The table, or an empty one of its schema."""
        _, folders = self._current(name)
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows; they become visible at once when all are written, beside those of other writers."""
        folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
        typed = [F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMAS[name].split(", "))]
        rows.select(*typed).write.parquet(folder)
        self._change(name, lambda now: [*now, folder])

    def replace(self, name: str, rewrite) -> None:
        """Rewrite a table: ``rewrite`` takes its rows and gives the new ones.

        Folders that other writers added meanwhile are rewritten too, as the new version names exactly
        what was read.
        """
        while True:
            version, folders = self._current(name)
            folder = f"{self.root}/{name}/{uuid.uuid4().hex}"
            rewrite(self.spark.read.schema(SCHEMAS[name]).parquet(*folders)).write.parquet(folder)
            if self._publish(name, self._next(name, version), [folder]):
                return

    def next_id(self, name: str) -> int:
        return int(self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]) + 1

    def save_sessions(self, files: DataFrame, merged: DataFrame, status: DataFrame) -> DataFrame:
        """Save analysed files (``file_id, path, title, code``) with findings; always as new sessions.

        Returns ``(file_id, id)``. Findings are written first, sessions last.
        """
        from lodestone.operators.merge import counts

        ids = next_ids(files.select("file_id"), "file_id", self.next_id("sessions"))
        f = merged.join(ids.withColumnRenamed("id", "session_id"), "file_id")
        numbered = next_ids(f.withColumn("_o", F.struct("session_id", "seq")), "_o", self.next_id("security_findings")).drop("_o")
        self.append("security_findings", numbered.select("id", "session_id", "severity", "rule", F.col("line").alias("line_number"), "message", "suggestion"))
        c = counts(merged, "file_id")
        rows = (
            files.join(ids, "file_id").join(status.select("file_id", F.col("valid").alias("syntax_valid")), "file_id", "left").join(c, "file_id", "left")
            .select(
                "id", F.col("path").alias("filename"), "title", "code", content_hash(F.col("code")).alias("code_hash"), "syntax_valid",
                *[F.coalesce(x, F.lit(0)).alias(x) for x in ("high_count", "medium_count", "total_issues")], F.current_timestamp().alias("created_at"),
            )
        )
        self.append("sessions", rows)
        return ids

    def save_messages(self, rows: DataFrame) -> None:
        """Append messages (``session_id, role, content, metadata, seq``) in the order of ``seq``.

        Ids grow with ``seq`` (any type that sorts) within a session, so a conversation reads as it was
        held. Users' texts are hashed, metadata is JSON; other roles are left out.
        """
        if "seq" not in rows.columns:
            raise ValueError("messages need a column seq that orders them")
        kept = rows.where(F.col("role").isin("user", "assistant"))
        n = next_ids(kept.withColumn("_o", F.struct("seq", "session_id")), "_o", self.next_id("chat_messages")).drop("_o")
        self.append(
            "chat_messages",
            n.select(
                "id", "session_id", "role", "content", F.when(F.col("role") == "user", content_hash(F.col("content"))).alias("query_hash"),
                F.to_json("metadata").alias("retrieved_chunks"), F.current_timestamp().alias("created_at"),
            ),
        )

    def save_chunks(self, rows: DataFrame) -> None:
        """Append chunks (``session_id, chunk_index, chunk_text, start_line, end_line, embedding_id``)."""
        n = next_ids(rows.withColumn("_o", F.struct("session_id", "chunk_index")), "_o", self.next_id("code_chunks")).drop("_o")
        self.append("code_chunks", n)

    def save_cache(self, rows: DataFrame) -> None:
        """Append answers (``code_hash, query_hash, query, response``); a key may occur again."""
        n = next_ids(rows.withColumn("_o", F.struct("code_hash", "query_hash")), "_o", self.next_id("analysis_cache")).drop("_o")
        self.append("analysis_cache", n.withColumn("created_at", F.current_timestamp()))

    def delete_sessions(self, ids: DataFrame) -> None:
        """Delete sessions and what belongs to them: children first, so no child outlives its parent visibly."""
        gone = materialize(ids.select("id").distinct())
        for n in (*CHILDREN, "sessions"):
            if self._current(n)[1]:
                self.replace(n, lambda rows, n=n: without_sessions(gone, {n: rows})[n])

    def rename_sessions(self, titles: DataFrame) -> int:
        """Rename (``id, new_title``); returns how many sessions there were to rename."""
        s = self.table("sessions")
        hit = s.join(titles.where(F.trim("new_title") != "").select("id").distinct(), "id", "left_semi").count()
        if hit:
            self.replace("sessions", lambda rows: renamed(rows, titles))
        return hit


def read_jdbc(spark: SparkSession, url: str, name: str, key: str = "id", bounds: tuple[int, int] | None = None, parts: int = 8, **options: str) -> DataFrame:
    """A table of a relational server, read in key ranges where ``bounds`` are given."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if bounds:
        r = r.option("partitionColumn", key).option("lowerBound", str(bounds[0])).option("upperBound", str(bounds[1])).option("numPartitions", str(parts))
    return r.load()


def write_jdbc(rows: DataFrame, url: str, name: str, **options: str) -> None:
    """Append rows to a table of a relational server."""
    rows.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()
