"""The engine as six calls on a store, with a status for each outcome; a web surface only has to pass them on.

Every call returns ``(status, body)``: 200, 400 for a bad title, 404 for an unknown session, 500 with
what went wrong. Bodies hold plain values. Calls about many sessions or questions at once are in
:mod:`lodestone.plans.analyze` and :mod:`lodestone.sources.store`.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import context
from lodestone.plans import analyze as plan
from lodestone.sources.store import SessionStore, content_hash, load_sessions, session_list


class Service:
    """Sessions in ``target``, answered by ``client`` (none: prompts only)."""

    def __init__(self, spark: SparkSession, target: SessionStore, client: Callable[[str], str] | None = None):
        self.spark, self.store, self.client = spark, target, client
        self.log: list[tuple] = []

    def _call(self, work: Callable[[], tuple[int, dict]]) -> tuple[int, dict]:
        try:
            return work()
        except Exception as exc:  # noqa: BLE001
            return 500, {"error": str(exc)}

    def analyze(self, code: str, filename: str = "uploaded.py", title: str | None = None) -> tuple[int, dict]:
        """Analyse, save, index and store the chunks of one file."""

        def work() -> tuple[int, dict]:
            shown = (title or "").strip() or filename
            files = self.spark.createDataFrame([(0, filename, shown, code)], "file_id long, path string, title string, code string")
            done, _, ids = plan.analyze_and_store(files, self.store)
            status = done.status.first().asDict()
            issues = [r.asDict(True) for r in done.findings.orderBy("rank").toLocalIterator()]
            metrics = [r.asDict() for r in done.metrics.toLocalIterator()]
            high = sum(r["severity"] == "HIGH" for r in issues)
            body = {"session_id": ids.first()["id"], "filename": filename, "title": shown, "syntax_valid": status["valid"], "issues": issues, "metrics": metrics[0] if metrics else {}}
            return 200, body | {"total": len(issues), "high": high, "medium": len(issues) - high}

        return self._call(work)

    def query(self, question: str, code: str = "", session_id: int | None = None) -> tuple[int, dict]:
        """Answer a question about a session's code, from the cache where it is known; both turns are saved."""

        def work() -> tuple[int, dict]:
            text = code
            if not text and session_id is not None:
                found = self.store.table("sessions").where(F.col("id") == session_id).select("code").first()
                if found is None:
                    return 404, {"error": "no such session"}
                text = found["code"]
            files = self.spark.createDataFrame([(0, "a.py", text)], "file_id long, path string, code string")
            asked = self.spark.createDataFrame([(0, question, text)], "question_id long, text string, code string").withColumn("code_hash", content_hash(F.col("code"))).drop("code")
            out, new = plan.answer_cached(asked, self.store.table("analysis_cache"), plan.build_index(files), self.client)
            row: Row = out.first()
            if not row["cached"] and row["answer"] is not None:
                self.store.save_cache(new)
            if session_id is not None and row["answer"] is not None:
                turns = [(session_id, "user", question, None, 1), (session_id, "assistant", row["answer"], {"cached": str(row["cached"]).lower()}, 2)]
                self.store.save_messages(self.spark.createDataFrame(turns, "session_id long, role string, content string, metadata map<string,string>, seq int"))
            return 200, {"answer": row["answer"], "cached": row["cached"]}

        return self._call(work)

    def sessions(self) -> tuple[int, dict]:
        """The newest sessions, times in ISO form."""
        return self._call(lambda: (200, {"sessions": [_plain(r) for r in session_list(self.store.table("sessions")).collect()]}))

    def session(self, session_id: int) -> tuple[int, dict]:
        """One session with its findings and messages in order."""

        def work() -> tuple[int, dict]:
            ids = self.spark.createDataFrame([(session_id,)], "id long")
            tables = [self.store.table(t) for t in ("sessions", "security_findings", "chat_messages")]
            parts = load_sessions(ids, *tables).orderBy("part").toLocalIterator()
            whole: dict | None = None
            for r in map(_plain, parts):
                if r["part"] == 0 and r["code_hash"] is not None:
                    whole = r | {"findings": r["findings"] or [], "messages": r["messages"] or []}
                elif whole is not None:
                    whole["messages"] += r["messages"] or []
            return (404, {"error": "no such session"}) if whole is None else (200, {"session": whole})

        return self._call(work)

    def rename(self, session_id: int, title: str) -> tuple[int, dict]:
        def work() -> tuple[int, dict]:
            if not title.strip():
                return 400, {"error": "the title is empty"}
            n = self.store.rename_sessions(self.spark.createDataFrame([(session_id, title.strip())], "id long, new_title string"))
            return (200, {"ok": True}) if n else (400, {"error": "nothing was renamed"})

        return self._call(work)

    def delete(self, session_id: int) -> tuple[int, dict]:
        def work() -> tuple[int, dict]:
            there = self.store.table("sessions").where(F.col("id") == session_id).limit(1).count()
            self.store.delete_sessions(self.spark.createDataFrame([(session_id,)], "id long"))
            return 200, {"ok": bool(there)}

        return self._call(work)


def _plain(row: Row) -> dict:
    out = row.asDict(True)
    return {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in out.items()}


HELP = "Ask about the code. 'stats' tells what was asked so far, 'help' shows this, 'exit' ends."


def talk(spark: SparkSession, index: plan.Index, read: Callable[[], str | None], show: Callable[[str], None], client: Callable[[str], str] | None = None) -> int:
    """A loop of questions until ``exit``, ``quit`` or the end of input; returns how many were answered."""
    log: list[tuple] = []
    show(HELP)
    while (line := read()) is not None:
        said = line.strip()
        if said.lower() in ("exit", "quit", "q"):
            break
        if said.lower() == "help":
            show(HELP)
        elif said.lower() == "stats":
            asked = spark.createDataFrame(log, "seconds double, answer string, intent string")
            show(json.dumps(context.log_stats(asked).first().asDict(), sort_keys=True))
        elif said:
            q = spark.createDataFrame([(0, said)], "question_id long, text string")
            intent = plan.router.classify(q).first()["intent"]
            r = plan.answer(q, index, client).first()
            log.append((r["seconds"], r["answer"] or r["prompt"], intent))
            show(r["answer"] or r["prompt"])
    return len(log)
