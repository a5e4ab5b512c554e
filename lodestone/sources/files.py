"""Source files from disk or tables, and findings of external scanners."""

from __future__ import annotations

import json
import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = "file_id long, seq long, line int, source string, rule string, message string, suggestion string, code_snippet string"


def read_sources(spark: SparkSession, path: str, glob: str = "*.py") -> DataFrame:
    """``(file_id, path, code, code_hash)`` of the files under ``path``.

    UTF-8; undecodable bytes are dropped and line ends become ``\\n``. The id is a hash of the path,
    so it is the same in every run and needs no coordination.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            code = [bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n") for b in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "code": code})

    return raw.mapInPandas(decode, "path string, code string").select(F.xxhash64("path").alias("file_id"), "path", "code", F.sha2("code", 256).alias("code_hash"))


def session_files(sessions: DataFrame) -> DataFrame:
    """Uploaded sessions as files: ``(file_id, path, code, code_hash)``."""
    return sessions.where("code is not null").select(F.col("id").alias("file_id"), F.col("filename").alias("path"), "code", F.sha2("code", 256).alias("code_hash"))


def upload_title(title: Column, filename: Column) -> Column:
    """The trimmed title, or the file name where that is empty."""
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), filename)


def scanner_findings(report: DataFrame) -> DataFrame:
    """Findings of an external scanner from its JSON results as raw findings.

    ``report`` has ``file_id`` and ``results`` (array of ``test_id, issue_text, line_number, code``).
    The scanner has no suggestions: null, as its map is never consulted.
    """
    r = report.select("file_id", F.posexplode("results").alias("k", "r"))
    return r.select(
        "file_id",
        F.col("k").cast("long").alias("seq"),
        F.col("r.line_number").cast("int").alias("line"),
        F.lit("bandit").alias("source"),
        F.col("r.test_id").alias("rule"),
        F.col("r.issue_text").alias("message"),
        F.lit(None).cast("string").alias("suggestion"),
        F.col("r.code").alias("code_snippet"),
    )


def run_scanner(files: DataFrame, command: tuple[str, ...] = (sys.executable, "-m", "bandit", "-f", "json", "-q"), timeout: int = 30) -> DataFrame:
    """Run a scanner on each file in a subprocess; any failure gives no findings for that file."""

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for fid, code in zip(pdf["file_id"], pdf["code"]):
                with tempfile.NamedTemporaryFile("w", suffix=".py", encoding="utf-8") as f:
                    try:
                        f.write(code or "")
                        f.flush()
                        got = subprocess.run([*command, f.name], capture_output=True, text=True, timeout=timeout, check=False)
                        results = json.loads(got.stdout).get("results", [])
                    except (OSError, ValueError, subprocess.SubprocessError):
                        continue
                lines = (code or "").split("\n")
                for k, x in enumerate(results):
                    n = int(x.get("line_number") or 0)
                    near = "\n".join((">>> " if i == n else "    ") + lines[i - 1] for i in range(max(1, n - 1), min(len(lines), n + 1) + 1))
                    rows.append((fid, k, n, "bandit", x.get("test_id"), x.get("issue_text"), None, near))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FINDINGS.split(", ")])

    return files.select("file_id", "code").mapInPandas(scan, FINDINGS)


# Templates of the generated corpus: what an event's type becomes, with the row's values in its names.
TEMPLATES = {
    "error": "def f_{u}(x):\n    if x and x > {n}:\n        return eval(x)\n    return g_{u}(x)\n",
    "click": "import hashlib\ndef f_{u}(b):\n    return hashlib.md5(b)\n",
    "view": "def f_{u}(role):\n    return g_{u}(role, {n})\n",
    "purchase": 'def f_{u}(cursor, v):\n    q = "SELECT * FROM t WHERE id = " + v\n    cursor.execute(q)\n',
    "signup": "import pickle\ndef f_{u}(p):\n    for i in p:\n        if i:\n            g_{u}(pickle.loads(i))\n",
}
DEFAULT_TEMPLATE = "def f_{u}(a, b):\n    return a if a else b\n"


def generated_corpus(events: DataFrame) -> DataFrame:
    """A code file for each event, whose findings follow from the row: a corpus with a known answer."""

    def filled(t: str) -> Column:
        parts, rest = [], t
        while "{" in rest:
            head, _, tail = rest.partition("{")
            key, _, rest = tail.partition("}")
            parts += [F.lit(head), F.col("user_id").cast("string") if key == "u" else (F.col("event_id") % 7).cast("string")]
        return F.concat(*parts, F.lit(rest))

    body = F.lit(None).cast("string")
    for kind, t in TEMPLATES.items():
        body = F.when(F.col("event_type") == kind, filled(t)).otherwise(body)
    pad = F.repeat(F.lit("\n"), (F.col("user_id") % 5).cast("int"))
    code = F.concat(pad, F.coalesce(body, filled(DEFAULT_TEMPLATE)))
    return events.select(F.col("event_id").alias("file_id"), F.lit("gen.py").alias("path"), code.alias("code"), F.sha2(code, 256).alias("code_hash"))
