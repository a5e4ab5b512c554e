"""Sources, store, reports and streaming."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.operators.context import answers
from lodestone.plans.analyze import analyze, build_index
from lodestone.plans.service import Service, talk
from lodestone.sources import files as src
from lodestone.sources.client import Busy, HttpText, Refused, RetryingClient
from lodestone.sources.store import SessionStore, next_ids, session_list, session_messages
from lodestone.streaming import ingest


def test_read_sources_drops_bad_bytes(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"x = 1\r\ny = '\xff'\r\n")
    (tmp_path / "b.txt").write_text("no")
    r = src.read_sources(spark, str(tmp_path)).collect()
    assert [x["code"] for x in r] == ["x = 1\ny = ''\n"]


def test_scanner_report_and_missing_scanner(spark):
    rep = spark.createDataFrame([(1, [("B324", "weak", 3, "h")])], "file_id long, results array<struct<test_id:string,issue_text:string,line_number:int,code:string>>")
    r = src.scanner_findings(rep).first()
    assert (r["rule"], r["line"], r["suggestion"]) == ("B324", 3, None)
    f = spark.createDataFrame([(1, "x = 1")], "file_id long, code string")
    assert src.run_scanner(f, ("/nonexistent-scanner",)).count() == 0


def test_store_round_trip(spark, tmp_path):
    st = SessionStore(spark, str(tmp_path / "store"))
    assert st.table("sessions").count() == 0
    files = spark.createDataFrame([(7, "a.py", "t", "import pickle\n"), (9, "b.py", "", "x = eval(y)\n")], "file_id long, path string, title string, code string")
    a = analyze(files)
    ids = st.save_sessions(files, a.findings, a.status)
    ids = {r["file_id"]: r["id"] for r in ids.collect()}
    assert sorted(ids.values()) == [1, 2] and st.table("sessions").count() == 2
    st.save_messages(spark.createDataFrame([(1, "user", "hi", {"client": "web"}, 1), (1, "assistant", "yo", None, 2), (1, "robot", "?", None, 3)], "session_id long, role string, content string, metadata map<string,string>, seq int"))
    m = {r["role"]: r for r in st.table("chat_messages").collect()}
    assert set(m) == {"user", "assistant"} and m["user"]["query_hash"] and m["assistant"]["query_hash"] is None
    st.save_cache(spark.createDataFrame([("c", "q", "x", "r")], "code_hash string, query_hash string, query string, response string"))
    assert st.rename_sessions(spark.createDataFrame([(1, "new"), (2, "  ")], "id long, new_title string")) == 1
    assert {r["title"] for r in st.table("sessions").collect()} == {"new", ""}
    st.delete_sessions(spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in st.table("sessions").collect()] == [2]
    assert st.table("chat_messages").count() == 0 and st.table("analysis_cache").count() == 1
    assert session_list(st.table("sessions")).count() == 1


def test_messages_keep_their_order(spark, tmp_path):
    st = SessionStore(spark, str(tmp_path / "store"))
    schema = "session_id long, role string, content string, metadata map<string,string>, seq int"
    st.save_messages(spark.createDataFrame([(1, "assistant", "an answer", None, 2), (1, "user", "zebra?", None, 1), (2, "user", "alpha", None, 3)], schema))
    st.save_messages(spark.createDataFrame([(1, "user", "aardvark?", None, 1)], schema))
    got = [r["content"] for r in st.table("chat_messages").where("session_id = 1").orderBy("id").collect()]
    assert got == ["zebra?", "an answer", "aardvark?"]
    with pytest.raises(ValueError):
        st.save_messages(spark.createDataFrame([(1, "user", "x", None)], "session_id long, role string, content string, metadata map<string,string>"))


def test_two_writers_lose_nothing(spark, tmp_path):
    st = SessionStore(spark, str(tmp_path / "store"))
    row = lambda k: spark.createDataFrame([(k, f"c{k}", "q", "x", "r")], "id long, code_hash string, query_hash string, query string, response string")
    threads = [threading.Thread(target=st.append, args=("analysis_cache", row(k))) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(r["id"] for r in st.table("analysis_cache").collect()) == list(range(6))


def test_a_change_that_breaks_off_leaves_the_old_state(spark, tmp_path, monkeypatch):
    st = SessionStore(spark, str(tmp_path / "store"))
    st.append("analysis_cache", spark.createDataFrame([(1, "c")], "id long, code_hash string"))
    monkeypatch.setattr(st, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        st.replace("analysis_cache", lambda rows: rows.where("id > 5"))
    assert st.table("analysis_cache").count() == 1


def test_long_session_in_bounded_parts(spark):
    m = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, F.lit(2)).otherwise(1).cast("long").alias("session_id"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"), F.lit("{broken").alias("retrieved_chunks"))
    parts = session_messages(spark.createDataFrame([(1,), (2,)], "id long"), m, 100).collect()
    assert max(r["n"] for r in parts) <= 100
    for s in (1, 2):
        ids = [x["id"] for r in sorted((r for r in parts if r["session_id"] == s), key=lambda r: r["part"]) for x in r["messages"]]
        assert ids == [i for i in range(5000) if (i % 10 == 0) == (s == 2)]


def test_dense_ids(spark):
    got = sorted(r["id"] for r in next_ids(spark.range(100).select(F.col("id").alias("k")), "k", 5).collect())
    assert got == list(range(5, 105))
    assert next_ids(spark.range(0).select(F.col("id").alias("k")), "k", 5).count() == 0


def test_client_and_answers(spark):
    calls = []

    def send(prompt, timeout):
        calls.append(timeout)
        if len(calls) < 3:
            raise Busy
        return "ok " + prompt

    assert RetryingClient(send, wait=lambda s: None)("p") == "ok p" and len(calls) == 3
    p = spark.createDataFrame([(1, "p")], "question_id long, prompt string")
    assert answers(p).first()["answer"] is None
    assert answers(p, lambda x: x.upper()).first()["answer"] == "P"


def test_stream_sees_each_content_once(spark, tmp_path):
    rows = [(1, "a.py", "eval(x)\n", "2024-01-01 00:00:00"), (2, "b.py", "eval(x)\n", "2024-01-01 00:00:01")]
    df = spark.createDataFrame(rows, "file_id long, path string, code string, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.run(ingest.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_generated_corpus_is_parsed(spark):
    ev = spark.createDataFrame([(1, 3, "error"), (2, 4, "other"), (3, 5, None)], "event_id long, user_id long, event_type string")
    assert src.generated_corpus(ev).where("code is null").count() == 0


def test_service_calls(spark, tmp_path):
    sv = Service(spark, SessionStore(spark, str(tmp_path / "store")), str.upper)
    status, body = sv.analyze("import pickle\ndef load(x):\n    return eval(x)\n", "a.py", "  ")
    assert status == 200 and body["title"] == "a.py" and (body["high"], body["medium"]) == (1, 1) and body["syntax_valid"]
    sid = body["session_id"]
    assert sv.store.table("code_chunks").count() == 2
    first, again = sv.query("where is load defined?", session_id=sid), sv.query("where is load defined?", session_id=sid)
    assert first[0] == 200 and not first[1]["cached"] and again[1]["cached"] and again[1]["answer"] == first[1]["answer"]
    got = sv.session(sid)[1]["session"]
    assert [m["role"] for m in got["messages"]] == ["user", "assistant"] * 2 and len(got["findings"]) == 2
    assert sv.session(99)[0] == 404 and sv.query("x", session_id=99)[0] == 404
    assert sv.rename(sid, "  ")[0] == 400 and sv.rename(99, "x")[0] == 400 and sv.rename(sid, "new")[0] == 200
    assert [s["title"] for s in sv.sessions()[1]["sessions"]] == ["new"]
    assert sv.delete(sid) == (200, {"ok": True}) and sv.sessions()[1]["sessions"] == []
    lines, shown = iter(["help", "", "where is load defined", "stats", "exit", "never"]), []
    index = build_index(spark.createDataFrame([(1, "a.py", "def load(x):\n    return x\n")], "file_id long, path string, code string"))
    assert talk(spark, index, lambda: next(lines, None), shown.append) == 1
    assert shown[0] == shown[1] and '"n_queries": 1' in shown[3]


def test_http_client():
    class Handler(BaseHTTPRequestHandler):
        codes = iter([503, 200, 429])

        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(code := next(self.codes))
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"text": said["prompt"][::-1]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    send = HttpText(f"http://127.0.0.1:{server.server_port}", lambda p: {"prompt": p}, lambda r: r["text"])
    client = RetryingClient(send, wait=lambda s: None)
    assert client("abc") == "cba"
    with pytest.raises(Refused):
        client("abc")
    server.shutdown()
