"""Words, vectors, metadata, routing and the whole pipeline against plain Python."""

import math
from collections import Counter
from difflib import SequenceMatcher

import numpy as np

from lodestone.operators import evalm, lexical, metaindex, router, vector
from lodestone.plans.analyze import Index, ask, build_index


def test_bm25_against_python(spark):
    docs = ["a b b c", "b c d", "", None, "e e e e b"]
    queries = ["b b e", "zzz"]
    got = {
        (r["query_id"], r["doc"]): r["bm25"]
        for r in lexical.bm25(spark.createDataFrame(list(enumerate(queries)), "query_id long, text string"), spark.createDataFrame(list(enumerate(docs)), "id long, t string"), "id", "t").collect()
    }
    toks = [(d or "").split() for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    df = Counter(t for d in toks for t in set(d))
    want = {}
    for qi, q in enumerate(queries):
        for di, d in enumerate(toks):
            s = sum(math.log((len(toks) - df[t] + 0.5) / (df[t] + 0.5) + 1) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in q.split() if t in d)
            if any(t in d for t in q.split()):
                want[qi, di] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_knn_is_exact_with_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).round(1)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [1.0])], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0 and vec_id < 60").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in vector.knn(q, df, 5, block=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    f = v.astype(np.float32).astype(float)
    for i in (0, 20, 40):
        d = ((f - f[i]) ** 2).sum(axis=1)
        assert [x for _, x in sorted(got[i])] == sorted(range(60), key=lambda j: (d[j], j))[:5]


def _fuzzy(term, target):
    if term == target:
        return True
    if term in target or target in term:
        return len(term) >= 5 or (target.startswith(term) and len(term) >= 3)
    return len(term) >= 4 and len(target) >= 4 and SequenceMatcher(None, term, target).ratio() >= 0.75


def test_fuzzy_against_all_pairs(spark):
    words = "parse parser parsed load_config loadconfig x abcd axbc abyc index reader read_file file profile user username conf config configure get set gets".split()
    s = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["term"], r["target"]) for r in metaindex.fuzzy_pairs(s, s.withColumnRenamed("term", "target")).collect()}
    assert got == {(a, b) for a in words for b in words if _fuzzy(a, b)}


def test_router(spark):
    texts = ["How does `load_config` work and where is ParseFile defined?", "How many functions?", "hello", None, "fix the bug in a.b"]
    q = {r["question_id"]: r for r in router.classify(spark.createDataFrame(list(enumerate(texts)), "question_id long, text string")).collect()}
    assert q[0]["is_compound"] and "load_config" in q[0]["entities"] and "ParseFile" in q[0]["entities"]
    assert q[1]["intent"] == "counting_query" and q[1]["is_counting"] and q[1]["k"] == 5
    assert (q[2]["intent"], q[2]["confidence"], q[2]["semantic_weight"]) == ("general_query", 0.0, 0.7)
    assert q[3]["intent"] == "general_query" and q[3]["entities"] == []
    assert q[4]["intent"] == "error_analysis" and q[4]["boost_exact"] and "a.b" in q[4]["entities"]


def test_expansion(spark):
    edges = spark.createDataFrame([("load", "read"), ("main", "load")], "caller string, callee string")
    q = spark.createDataFrame([(1, "explain reload and cache"), (2, None)], "question_id long, text string")
    got = {r["question_id"]: r["expanded"] for r in router.expanded_terms(q, edges).collect()}
    assert got[1][:3] == ["explain reload and cache", "read", "main"] and "memoize" in got[1]
    assert got[2] == [""]


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1), (2, "y", 2), (2, "a", 3)], "question_id long, name string, rank int")
    qrels = spark.createDataFrame([(1, ["a", "c"]), (2, ["a"]), (3, ["q"])], "question_id long, relevant array<string>")
    m = {r["question_id"]: r for r in evalm.per_question(results, qrels, 2).collect()}
    assert set(m) == {1, 2}
    assert (m[1]["hit"], m[1]["recall"], m[1]["mrr"]) == (1, 0.5, 1.0) and abs(m[1]["ndcg"] - 1 / (1 + 1 / math.log2(3))) < 1e-9
    assert (m[2]["hit"], m[2]["recall"]) == (0, 0.0) and abs(m[2]["mrr"] - 1 / 3) < 1e-9
    assert evalm.summary(evalm.per_question(results, qrels, 2)).first()["grade"] == "needs work"


def test_pipeline_and_saved_index(spark, tmp_path):
    codes = [(1, "a.py", "def load_config(path):\n    return parse_text(open(path).read())\n"), (2, "b.py", "def draw_shape(canvas):\n    return canvas.line(1, 2)\n")]
    index = build_index(spark.createDataFrame(codes, "file_id long, path string, code string"))
    index.write(str(tmp_path / "ix"))
    q = spark.createDataFrame([(1, "where is load_config defined"), (2, "what draws a shape on the canvas")], "question_id long, text string")
    got = {r["question_id"]: r["name"] for r in ask(q, Index.read(spark, str(tmp_path / "ix"))).where("rank = 1").collect()}
    assert got == {1: "load_config", 2: "draw_shape"}


def test_cache_aside_pipeline(spark):
    from lodestone.plans.analyze import answer_cached
    from lodestone.sources.store import content_hash
    from pyspark.sql import functions as F

    index = build_index(spark.createDataFrame([(1, "a.py", "def load_config(path):\n    return open(path)\n")], "file_id long, path string, code string"))
    cache = spark.createDataFrame([(1, "h", "known?", "old", "2024-01-01"), (2, "h", "known?", "new", "2024-01-02")], "id long, code_hash string, query string, response string, created_at string")
    cache = cache.withColumn("query_hash", content_hash(F.col("query")))
    q = spark.createDataFrame([(1, "known?", "h"), (2, "where is load_config defined", "h")], "question_id long, text string, code_hash string")
    out, rows = answer_cached(q, cache, index, lambda p: "found" if "load_config" in p else "no")
    assert {(r["question_id"], r["answer"], r["cached"]) for r in out.collect()} == {(1, "new", True), (2, "found", False)}
    assert [r["response"] for r in rows.collect()] == ["found"]


def test_fuzzy_shuffles_no_candidates(spark):
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcé_"[: rng.integers(2, 6)]), rng.integers(1, 9))) for _ in range(150)} | {"x" * 70, "x" * 69 + "y"})
    s = spark.createDataFrame([(w,) for w in words], "term string")
    got = metaindex.fuzzy_pairs(s, s.withColumnRenamed("term", "target"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted((a, b) for a in words for b in words if _fuzzy(a, b))


def test_expansion_makes_the_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            made.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([("load", "read"), ("Load", "seek"), ("main", "load")], "caller string, callee string").coalesce(1).mapInPandas(count, "caller string, callee string")
    q = spark.createDataFrame([(1, "explain reload"), (2, "Reload? reload!"), (3, "none")], "question_id long, text string")
    got = {r["question_id"]: r["expanded"][1:4] for r in router.expanded_terms(q, edges).collect()}
    assert got == {1: ["seek", "read", "main"], 2: ["seek", "read", "main"], 3: []} and made.value == 3


def test_pairs_limit_what_is_scored_not_the_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "b c d")], "id long, t string")
    q = spark.createDataFrame([(1, "a c"), (2, "b")], "query_id long, text string")
    every = {(r["query_id"], r["doc"]): r["bm25"] for r in lexical.bm25(q, docs, "id", "t").collect()}
    pairs = spark.createDataFrame([(1, 2), (2, 3), (2, 2)], "query_id long, doc long")
    got = {(r["query_id"], r["doc"]): r["bm25"] for r in lexical.bm25(q, docs, "id", "t", pairs=pairs).collect()}
    assert got.keys() == {(1, 2), (2, 3)} and all(abs(got[k] - every[k]) < 1e-12 for k in got)
    index = spark.createDataFrame([("name", "load_file", 1, 1), ("exact_match", "load_file", 1, 1), ("keywords", "loads", 1, 2), ("chunk_type", "class", 1, 2)], "field string, term string, file_id long, chunk_id int")
    terms = spark.createDataFrame([(1, ["load_file", "class"]), (2, ["load"])], "question_id long, terms array<string>")
    whole = {tuple(map(str, r)) for r in metaindex.matches(terms, index).collect()}
    some = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (2, 1, 9)], "question_id long, file_id long, chunk_id int")
    part = {tuple(map(str, r)) for r in metaindex.matches(terms, index, some).collect()}
    assert part == {r for r in whole if r[:3] in {("1", "1", "1"), ("2", "1", "2")}} and len(part) == 2


def _asked_and_indexed(spark):
    rng = np.random.default_rng(5)
    words = ["load_file", "loadfile", "class", "loads", "open", "opened", "reader", "zzz", "", "File"]
    asked = [(int(rng.integers(0, 12)) or None, [words[k] for k in rng.integers(0, len(words), 3)]) for _ in range(30)] + [(50, None), (51, [None, "open"])]
    fields = [*metaindex.EXACT_FIELDS, *metaindex.FUZZY_FIELDS]
    posts = sorted({(fields[rng.integers(0, 8)], words[rng.integers(0, 9)], int(rng.integers(0, 3)), int(rng.integers(0, 9))) for _ in range(120)})
    terms = spark.createDataFrame(asked, "question_id long, terms array<string>")
    index = spark.createDataFrame([*posts, ("name", None, 0, 0), ("exact_match", "open", None, 1)], "field string, term string, file_id long, chunk_id int")
    want = {False: {}, True: {}}
    for q, ts in asked:
        for t in {t.lower() for t in ts or [] if t is not None}:
            for field, term, f, c in [*posts, ("exact_match", "open", None, 1)]:
                near = field in metaindex.FUZZY_FIELDS
                if t == term and not near or near and t and term and _fuzzy(t, term):
                    want[True].setdefault((q, f, c), set()).add(field)
                    if not near:
                        want[False].setdefault((q, f, c), set()).add(field)
    return terms, index, {k: sorted((str(x), sorted(y)) for x, y in v.items()) for k, v in want.items()}


def _hit(df):
    return sorted((str((r["question_id"], r["file_id"], r["chunk_id"])), r["fields"]) for r in df.collect())


def test_exact_hits_are_not_shuffled(spark, monkeypatch):
    terms, index, want = _asked_and_indexed(spark)
    got = metaindex.exact_matches(terms, index)
    assert "hashpartitioning(question_id" not in got._jdf.queryExecution().toString()
    assert want[False] and _hit(got) == want[False]
    monkeypatch.setattr(metaindex, "_ASKED", 7)
    assert _hit(metaindex.exact_matches(terms, index)) == want[False]
    assert _hit(metaindex.exact_matches(terms.limit(0), index)) == [] == _hit(metaindex.exact_matches(terms, index.limit(0)))


def test_alike_hits_are_not_shuffled(spark):
    terms, index, want = _asked_and_indexed(spark)
    got = metaindex.matches(terms, index)
    assert "hashpartitioning(question_id" not in got._jdf.queryExecution().toString()
    assert want[True] != want[False] and _hit(got) == want[True]


def test_keywords_come_from_the_whole_code(spark):
    code = "x = 1\n" * 200 + "def open_gate(ticket):\n    return GateKeeper(ticket)\n"
    chunk = "1L AS file_id, 2L AS chunk_id, 'f' AS name, 'a.py' AS path, 'function' AS chunk_type, CAST(NULL AS STRING) AS docstring, CAST(NULL AS ARRAY<STRUCT<name: STRING, hint: STRING>>) AS hints"
    df = spark.sql(f"SELECT {chunk}, CAST(NULL AS ARRAY<STRING>) AS decorators, CAST(NULL AS ARRAY<STRING>) AS calls, CAST(NULL AS ARRAY<STRING>) AS related").crossJoin(spark.createDataFrame([(code,)], "content string"))
    got = {r["keyword"]: float(r["weight"]) for r in metaindex.keyword_weights(df).collect()}
    assert got == {"open_gate": 0.9, "GateKeeper": 0.6, "ticket": 0.4}
    terms = spark.createDataFrame([(7, ["open_gates"]), (8, ["shut"])], "question_id long, terms array<string>")
    assert _hit(metaindex.matches(terms, metaindex.meta_postings(df))) == [("(7, 1, 2)", ["keywords"])]
    assert metaindex.keyword_weights(df, 500).count() == 0


def test_texts_and_postings_are_not_shuffled(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone import catalog_words

    texts = ["def open_gate(ticket):\n    return GateKeeper(ticket)\n", "class Reader:\n    pass\n", "x = 1\n" * 99 + "loads(path)\n", "über_maß = loads\n", ""]
    rows = [(k, k % 3, texts[k % 5]) for k in range(40)]
    rows += [rows[7], rows[7], (41, 77, "def lost(): pass"), (42, 1, None)]
    spark.createDataFrame(rows, "id long, session_id long, chunk_text string").write.parquet(f"{tmp_path}/code_chunks.parquet")
    spark.createDataFrame([(0, "a/main.py"), (1, "open_file.py"), (2, None), (1, "shut_file.py")], "id long, filename string").write.parquet(f"{tmp_path}/sessions.parquet")
    asked = [(1, "how does open_gates return"), (2, "loads the reader function"), (3, None), (4, "main gatekeeper, open close"), (5, "open_file shut_file"), (None, "Über_maß dict")]
    spark.createDataFrame(asked, "id long, query string").write.parquet(f"{tmp_path}/analysis_cache.parquet")
    d = str(tmp_path)
    q = catalog_words._questions(spark, d).select("question_id", lexical.words(F.col("text")).alias("terms"))
    want = _hit(metaindex.matches(q, metaindex.meta_postings(catalog_words._described(spark, d))))

    def got():
        df = catalog_words.metadata_matches(spark, d)
        assert "hashpartitioning(id" not in df._jdf.queryExecution().toString()
        return sorted((str((r["question_id"], r["file_id"], r["chunk_id"])), r["fields"].split(",")) for r in df.collect())

    assert len(want) > 100 and got() == want
    monkeypatch.setattr(metaindex, "_ASKED", 7)
    assert got() == want
    monkeypatch.setattr(metaindex, "_KNOWN", 3)
    assert got() == want

    def fail(*a):
        raise AssertionError("postings are made")

    monkeypatch.setattr(metaindex, "_KNOWN", 10**6)
    monkeypatch.setattr(metaindex, "meta_postings", fail)
    assert got() == want
