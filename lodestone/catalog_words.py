"""Queries on words, questions, routing, retrieval and the store, with the same in SQL."""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.catalog import _TOK, _quote, query
from lodestone.operators import context, dims, evalm, lexical, metaindex, retrieve, router, vector
from lodestone.plans import analyze as plan
from lodestone.session import arrow_batch_rows, bounded_broadcast, ensure_checkpoint_dir, materialize
from lodestone.sources import files as src
from lodestone.sources import store
from lodestone.sources.client import Busy, RetryingClient
from lodestone.sources.tables import table

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
#: Runs of word characters with a letter beyond ASCII: no word border lies within them.
_FOREIGN = r"[A-Za-z0-9_]*(?:[\x{AA}\x{B5}\x{BA}\x{C0}-\x{24F}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}][A-Za-z0-9_]*)+"
_STOP = ", ".join(map(_quote, dims.STOPWORDS))
_ASK_STOP = ", ".join(map(_quote, dims.QUESTION_STOPWORDS))


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '{_SPACE}'), lambda x: x <> '')"


def _list(xs) -> str:
    return "[" + ", ".join(map(_quote, xs)) + "]::VARCHAR[]"


def _shared_folder(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


# -- routing -----------------------------------------------------------------------------------------

_PARAMS = "(VALUES " + ", ".join(f"({_quote(i)}, {_list(t)}, {str(e).upper()}, {str(c).upper()}, CAST({s} AS DOUBLE), CAST({b} AS DOUBLE))" for i, t, e, c, s, b in dims.INTENT_PARAMS) + ") p(intent, types, exact, chk, sw, bw)"


def _routed(source: str) -> str:
    """SQL of routed questions; ``source`` is a query of ``qid, text``."""
    raw = []
    for k, i in enumerate(router.INTENTS):
        own = [(p, w) for j, p, w in dims.INTENT_PATTERNS if j == i]
        total = max(sum(w for _, w in own), 1.0)
        cases = " + ".join(f"CASE WHEN regexp_matches(q, {_quote(p)}) THEN CAST({w} AS DOUBLE) ELSE 0 END" for p, w in own)
        raw.append(f"SELECT qid, {k} AS o, {_quote(i)} AS intent, round(least(({cases}) / CAST({total!r} AS DOUBLE), 1.0), 12) AS c FROM rt")
    return f"""rq AS ({source}), rt AS (SELECT qid, text, lower(coalesce(text, '')) AS q FROM rq), rs AS ({' UNION ALL '.join(raw)}),
rb AS (SELECT qid, arg_min(intent, (-c, o)) AS intent, max(c) AS c FROM rs WHERE c > 0 GROUP BY 1),
r2 AS (SELECT rs.qid, list(rs.intent ORDER BY -rs.c, rs.o) AS secondary FROM rs JOIN rb USING (qid) WHERE rs.intent <> rb.intent AND rs.c > 0 AND rs.c >= greatest(round(rb.c - 0.3, 12), 0.4) GROUP BY 1),
r1 AS (SELECT rt.qid, rt.text, rt.q, coalesce(rb.intent, 'general_query') AS intent, coalesce(rb.c, 0) AS confidence, coalesce(r2.secondary, []::VARCHAR[]) AS secondary FROM rt LEFT JOIN rb USING (qid) LEFT JOIN r2 USING (qid)),
ri AS (SELECT qid, unnest(list_prepend(intent, secondary)) AS intent, generate_subscripts(list_prepend(intent, secondary), 1) AS n FROM r1),
rp AS (SELECT qid, bool_or(chk) AS code_check FROM ri JOIN {_PARAMS} USING (intent) GROUP BY 1),
ry AS (SELECT qid, unnest(types) AS t, n * 100 + generate_subscripts(types, 1) AS pos FROM ri JOIN {_PARAMS} USING (intent)),
rz AS (SELECT qid, list(t ORDER BY pos) AS prefer_types FROM (SELECT qid, t, min(pos) AS pos FROM ry GROUP BY ALL) GROUP BY 1),
routed AS (SELECT r1.*, coalesce(prefer_types, []::VARCHAR[]) AS prefer_types, code_check, exact AS boost_exact, sw AS semantic_weight, bw AS bm25_weight,
  regexp_matches(q, {_quote(dims.COUNTING)}) OR regexp_matches(q, {_quote(dims.LISTING)}) AS listed FROM r1 JOIN {_PARAMS} USING (intent) LEFT JOIN rz USING (qid) LEFT JOIN rp USING (qid))"""


_CACHED = "SELECT id AS qid, query AS text FROM analysis_cache"


def _questions(spark, d):
    return table(spark, d, "analysis_cache").select(F.col("id").alias("question_id"), F.col("query").alias("text"))


def _items(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), "text")


@query(
    f"WITH {_routed(_CACHED)} SELECT qid AS question_id, array_to_string(secondary, ',') AS secondary, array_to_string(prefer_types, ',') AS prefer_types, boost_exact, code_check, semantic_weight, bm25_weight, 5 AS k FROM routed"
)
def routing_parameters(spark, d):
    q = router.classify(_questions(spark, d))
    return q.select("question_id", F.array_join("secondary", ",").alias("secondary"), F.array_join("prefer_types", ",").alias("prefer_types"), "boost_exact", "code_check", "semantic_weight", "bm25_weight", "k")


@query(
    f"WITH {_routed(_CACHED)} SELECT qid AS question_id, boost_exact AND qid % 2 = 0 AS boost_exact, CASE WHEN qid % 3 = 0 THEN '' ELSE array_to_string(prefer_types, ',') END AS prefer_types FROM routed"
)
def routing_adjusted(spark, d):
    q = router.adjusted(router.classify(_questions(spark, d)), F.col("question_id") % 2 != 0, F.col("question_id") % 3 == 0)
    return q.select("question_id", "boost_exact", F.array_join("prefer_types", ",").alias("prefer_types"))


@query(
    f"""WITH {_routed(_CACHED)}, x AS (SELECT *, qid % 2 = 0 AS has FROM routed)
SELECT qid AS question_id, CAST(CASE WHEN listed THEN 0.5 WHEN intent = 'optimization' THEN 1.5 WHEN confidence > 0.8 AND has THEN 1.3 WHEN NOT has THEN 0.0 ELSE 1.0 END AS DOUBLE) AS exact_match,
  CAST(CASE WHEN listed THEN 0.7 WHEN NOT has THEN 0.6 ELSE 0.4 END AS DOUBLE) AS keywords, CAST(CASE WHEN intent IN ('definition_lookup', 'optimization') THEN 0.8 ELSE 0.5 END AS DOUBLE) AS name,
  CAST(CASE WHEN intent = 'flow_explanation' THEN 0.4 ELSE 0.2 END AS DOUBLE) AS file_context, CAST(CASE WHEN intent = 'flow_explanation' THEN 0.5 ELSE 0.35 END AS DOUBLE) AS function_calls,
  CAST(CASE WHEN listed THEN 0.6 ELSE 0.45 END AS DOUBLE) AS docstring_match, CAST(0.3 AS DOUBLE) AS chunk_type, CAST(0.4 AS DOUBLE) AS type_hint_match, CAST(0.3 AS DOUBLE) AS decorator_match FROM x"""
)
def routing_weights(spark, d):
    q = router.boost_weights(router.classify(_questions(spark, d)), F.col("question_id") % 2 == 0)
    return q.select("question_id", *[F.col("weights")[k].cast("double").alias(k) for k in dims.ROUTER_BOOST])


@query(
    rf"""
WITH t AS (SELECT id, coalesce(query, '') AS t, regexp_replace(coalesce(query, ''), '{_FOREIGN}', ' ', 'g') AS u FROM analysis_cache),
e AS (SELECT id, regexp_extract_all(t, '["'']([^"'']+)["'']', 1) AS quoted, regexp_extract_all(u, '\b([a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_.]*)\b', 1) AS dotted, regexp_extract_all(t, '`([^`]+)`', 1) AS ticked,
  list_filter(regexp_extract_all(u, '\b([A-Z][a-z]+[A-Z][a-zA-Z0-9]*|[a-z_][a-z0-9_]+)\b', 1), lambda x: lower(x) NOT IN ({_ASK_STOP}) AND length(x) > 2 AND (length(x) > 3 OR contains(x, '_') OR regexp_matches(substr(x, 2), '[A-Z]'))) AS named,
  regexp_extract_all(t, '@(\w+)', 1) AS marked FROM t),
f AS (SELECT id, quoted, list_sort(list_distinct(dotted || ticked || named || marked)) AS entities FROM e)
SELECT id AS question_id, array_to_string(quoted, '|') AS quoted, array_to_string(entities, '|') AS entities,
  array_to_string(list_sort(list_distinct(list_transform(quoted, lambda x: lower(x)) || list_transform(list_filter(entities, lambda x: length(x) > 3), lambda x: lower(x)))), '|') AS keywords FROM f
"""
)
def question_entities(spark, d):
    """Entities, quoted parts and keywords of each question, sorted (no question of the cache names a type by an arrow)."""
    q = router.classify(_questions(spark, d))
    return q.select("question_id", F.array_join("quoted", "|").alias("quoted"), *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("entities", "keywords")])


_NATIONS = "SELECT n_name AS caller, r_name AS callee FROM nation JOIN region ON n_regionkey = r_regionkey"
_TOPICS = " || ".join(f"CASE WHEN contains(q, {_quote(k)}) THEN {_list(v)} ELSE []::VARCHAR[] END" for k, v in dims.TOPIC_TERMS.items())


@query(
    rf"""
WITH e AS ({_NATIONS}), t AS (SELECT doc_id, text || ' egypt_brazil ' || n_name AS text, lower(text || ' egypt_brazil ' || n_name) AS q FROM documents JOIN nation ON doc_id % 25 = n_nationkey),
w AS (SELECT doc_id, list(DISTINCT x) AS xs FROM (SELECT doc_id, callee AS x FROM t JOIN e ON contains(q, lower(caller)) UNION ALL SELECT doc_id, caller FROM t JOIN e ON contains(q, lower(callee)) AND callee IN (SELECT caller FROM e)) GROUP BY 1)
SELECT t.doc_id AS question_id, array_to_string(list_sort(list_distinct([t.text] || coalesce(w.xs, []) || {_TOPICS})), '|') AS expanded FROM t LEFT JOIN w USING (doc_id)
"""
)
def expanded_documents(spark, d):
    """Texts widened by what the nations they name call, and by topics; sorted."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("caller"), F.col("r_name").alias("callee"))
    docs = table(spark, d, "documents").join(F.broadcast(n), F.col("doc_id") % 25 == F.col("n_nationkey"))
    q = docs.select(F.col("doc_id").alias("question_id"), F.concat("text", F.lit(" egypt_brazil "), "n_name").alias("text"))
    return router.expanded_terms(q, edges).select("question_id", F.array_join(F.array_sort("expanded"), "|").alias("expanded"))


# -- metadata index ----------------------------------------------------------------------------------


#: Characters of a chunk that the SQL of ``chunk_keywords`` and ``chunk_postings`` looks at.
_HEAD = 500


def _described(spark, d, once=True):
    """Stored chunks with the columns of an indexed one, which follow from their text and number.

    Without ``once`` rows with the same id stay, and no text is shuffled; ``version`` tells which are copies.
    """
    c = table(spark, d, "code_chunks")
    c = (c.dropDuplicates(["id"]) if once else c).where("chunk_text is not null")
    s = table(spark, d, "sessions").select(F.col("id").alias("session_id"), "filename")
    s = s if once else bounded_broadcast(s, 500_000)
    line = F.split_part("chunk_text", F.lit("\n"), F.lit(1))
    text = F.array(F.lit("")).cast("array<string>")
    hints = F.array(F.struct(F.lit("a").alias("name"), F.when(F.col("id") % 2 == 0, "list[int]").otherwise("Dict").alias("hint")))
    return c.join(s, "session_id").select(
        F.col("session_id").alias("file_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("load_part_"), (F.col("id") % 7).cast("string"), F.lit("_x")).alias("name"), F.concat(F.lit("src/"), "filename").alias("path"),
        F.col("chunk_text").alias("content"), F.when(F.col("id") % 2 == 0, "function").otherwise("class").alias("chunk_type"), line.alias("docstring"), hints.alias("hints"),
        F.array(F.lit("@app.route(x)"), F.lit("Cached")).alias("decorators"), F.when(F.col("id") % 3 == 0, F.array(F.lit("Run"), F.lit("open"))).otherwise(text).alias("calls"), F.array(F.lit("close"), F.lit("open")).alias("related"),
        F.xxhash64("session_id", "chunk_text").alias("version"),
    )


_DESCRIBED = f"""
WITH c AS (SELECT id, any_value(session_id) AS session_id, any_value(chunk_text) AS t FROM code_chunks WHERE chunk_text IS NOT NULL GROUP BY 1),
x AS (SELECT c.session_id AS file_id, c.id AS chunk_id, t, 'load_part_' || CAST(c.id % 7 AS VARCHAR) || '_x' AS name, regexp_extract('src/' || filename, '([^/]+?)(\\.[^.]*)?$', 1) AS stem, regexp_replace(substr(t, 1, 500), '{_FOREIGN}', ' ', 'g') AS h, split_part(t, chr(10), 1) AS doc FROM c JOIN sessions s ON s.id = c.session_id),
k AS (SELECT file_id, chunk_id, unnest(regexp_extract_all(name, '[A-Z]?[a-z]+', 0)) AS k, 1.0 AS w FROM x UNION ALL SELECT file_id, chunk_id, unnest(string_split(name, '_')), 1.0 FROM x
  UNION ALL SELECT file_id, chunk_id, unnest(string_split(stem, '_')), 0.7 FROM x UNION ALL SELECT file_id, chunk_id, unnest(CASE WHEN chunk_id % 2 = 0 THEN ['list', 'int'] ELSE ['Dict'] END), 0.8 FROM x
  UNION ALL SELECT file_id, chunk_id, unnest(['app.route', 'Cached']), 0.8 FROM x UNION ALL SELECT file_id, chunk_id, unnest(regexp_extract_all(h, '\\bdef\\s+(\\w+)', 1)), 0.9 FROM x
  UNION ALL SELECT file_id, chunk_id, unnest(regexp_extract_all(h, '\\bclass\\s+(\\w+)', 1)), 0.9 FROM x UNION ALL SELECT file_id, chunk_id, unnest(regexp_extract_all(h, '\\b([A-Z][a-z]+[A-Z]\\w*)', 1)), 0.6 FROM x
  UNION ALL SELECT file_id, chunk_id, unnest(list_filter(regexp_extract_all(h, '\\b([a-z_][a-z0-9_]{{3,}})\\b', 1), lambda y: y NOT IN ({_STOP}))), 0.4 FROM x),
kw AS (SELECT file_id, chunk_id, k AS keyword, CAST(max(w) AS DOUBLE) AS weight FROM k WHERE length(k) > 2 AND lower(k) NOT IN ({_STOP}) GROUP BY ALL)
""".replace("\\\\", "\\")


@query(_DESCRIBED + "SELECT * FROM kw")
def chunk_keywords(spark, d):
    return metaindex.keyword_weights(_described(spark, d), _HEAD).withColumn("weight", F.col("weight").cast("double"))


_POSTINGS = (
    _DESCRIBED
    + f""", p AS (SELECT 'name' AS field, lower(name) AS term, file_id, chunk_id FROM x UNION ALL SELECT 'exact_match', lower(name), file_id, chunk_id FROM x
  UNION ALL SELECT 'chunk_type', CASE WHEN chunk_id % 2 = 0 THEN 'function' ELSE 'class' END, file_id, chunk_id FROM x
  UNION ALL SELECT 'docstring_match', unnest(list_filter({_words('doc')}, lambda y: length(y) > 3 AND y NOT IN ({_STOP}))), file_id, chunk_id FROM x
  UNION ALL SELECT 'function_calls', unnest(CASE WHEN chunk_id % 3 = 0 THEN ['run', 'open', 'close'] ELSE ['', 'close', 'open'] END), file_id, chunk_id FROM x
  UNION ALL SELECT 'type_hint_match', unnest(CASE WHEN chunk_id % 2 = 0 THEN ['list', 'int'] ELSE ['dict'] END), file_id, chunk_id FROM x UNION ALL SELECT 'decorator_match', unnest(['app.route', 'cached']), file_id, chunk_id FROM x
  UNION ALL SELECT 'keywords', lower(keyword), file_id, chunk_id FROM kw), u AS (SELECT DISTINCT * FROM p)"""
)


@query(_POSTINGS + " SELECT * FROM u")
def chunk_postings(spark, d):
    return metaindex.meta_postings(_described(spark, d), _HEAD)


@query(
    _POSTINGS
    + f""", q AS (SELECT DISTINCT id, unnest({_words('query')}) AS term FROM analysis_cache)
SELECT id AS question_id, file_id, chunk_id, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM q JOIN u USING (term) WHERE field IN ('exact_match', 'chunk_type', 'docstring_match', 'function_calls', 'type_hint_match', 'decorator_match') GROUP BY ALL"""
)
def metadata_hits(spark, d):
    """Fields of each chunk that equal a word of a question; alike ones are in ``metadata_matches``."""
    q = _questions(spark, d).select("question_id", lexical.words(F.col("text")).alias("terms"))
    found = metaindex.grouped_exact_matches(q, metaindex.meta_postings(_described(spark, d)))
    return metaindex.listed(found.withColumn("fields", F.array_join("fields", ",")))


@query()
def metadata_matches(spark, d):
    q = _questions(spark, d).select("question_id", lexical.words(F.col("text")).alias("terms"))
    found = metaindex.grouped_chunk_matches(q, _described(spark, d, once=False))
    return metaindex.listed(found.withColumn("fields", F.array_join("fields", ",")))


@query(
    """
WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS term, lower(p_type) AS types FROM part), t AS (SELECT DISTINCT term, unnest(string_split(types, ' ') || [types, term, substr(term, 1, 3), substr(term, 2)]) AS target FROM w)
SELECT term, target, CASE WHEN term = target THEN 'yes' WHEN contains(target, term) OR contains(term, target) THEN CASE WHEN length(term) >= 5 OR (starts_with(target, term) AND length(term) >= 3) THEN 'yes' ELSE 'no' END
  WHEN length(term) < 4 OR length(target) < 4 THEN 'no' WHEN 2 * least(length(term), length(target)) < 0.75 * (length(term) + length(target)) THEN 'no' ELSE 'ratio' END AS verdict FROM t
"""
)
def fuzzy_verdicts(spark, d):
    """Which pairs of words match alike, which do not, and for which the sequence ratio decides."""
    p = table(spark, d, "part")
    w = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"), F.lower("p_type").alias("types"))
    t = w.select("term", F.explode(F.concat(F.split("types", " "), F.array(F.col("types"), F.col("term"), F.substring("term", 1, 3), F.substr("term", F.lit(2))))).alias("target")).distinct()
    v = metaindex.quick_match(F.col("term"), F.col("target"))
    return t.select("term", "target", F.when(v, "yes").when(~v, "no").otherwise("ratio").alias("verdict"))


# -- vectors and hybrid retrieval --------------------------------------------------------------------


def _embedded(source: str, name: str) -> str:
    """SQL of ``name(i, e)``: hashed embeddings of a query of ``i, text``."""
    return f"""{name}_w AS (SELECT i, CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) % 128 AS h FROM (SELECT i, unnest({_words("coalesce(text, '')")}) AS w FROM ({source}))),
{name}_c AS (SELECT i, h % 64 AS slot, CAST(sum(CASE WHEN h < 64 THEN 1 ELSE -1 END) AS DOUBLE) AS v FROM {name}_w GROUP BY ALL), {name}_n AS (SELECT i, sqrt(sum(v * v)) AS n FROM {name}_c GROUP BY 1),
{name}_s AS (SELECT i, slot, CAST(v / CASE WHEN n = 0 THEN 1 ELSE n END AS FLOAT) AS v FROM {name}_c JOIN {name}_n USING (i)),
{name} AS (SELECT i, list(coalesce(v, 0::FLOAT) ORDER BY slot) AS e FROM (SELECT i, slot, v FROM (SELECT DISTINCT i FROM ({source})) CROSS JOIN range(64) r(slot) LEFT JOIN {name}_s USING (i, slot)) GROUP BY 1)"""


_DOCS = "SELECT doc_id AS i, text FROM documents"


@query("WITH " + _embedded(_DOCS, "v") + " SELECT i AS vec_id, generate_subscripts(e, 1) AS slot, round(CAST(unnest(e) AS DOUBLE), 5) AS value FROM v")
def hashed_vectors(spark, d):
    v = vector.hashed_embedding(table(spark, d, "documents"), "doc_id", "text")
    return v.select("vec_id", F.posexplode("embedding").alias("slot", "value")).select("vec_id", (F.col("slot") + 1).cast("long").alias("slot"), F.round(F.col("value").cast("double"), 5).alias("value"))


def _hybrid(spark, d):
    """The whole chain over the documents: each a chunk whose name is its first word and whose type is that of its post."""
    arrow_batch_rows(spark, 2000)
    docs = table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.lit(0).cast("long").alias("file_id"), F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
        F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("name"), F.when(F.col("doc_type") == "question", "function").otherwise("class").alias("chunk_type"),
    )
    q = _items(spark, d).withColumn("text", F.concat(F.when(F.col("question_id") % 3 == 0, "how does it work ").when(F.col("question_id") % 3 == 1, "where is it defined ").otherwise(""), "text"))
    routed = materialize(router.classify(q))
    qv = vector.hashed_embedding(q, "question_id", "text").withColumnRenamed("vec_id", "query_id")
    near = vector.knn(qv, materialize(vector.hashed_embedding(docs, "vec_id", "content")), 15)
    candidates = near.select(F.col("query_id").alias("question_id"), "vec_id", vector.similarity(F.col("dist")).alias("sim"), F.col("rank").alias("knn_rank"))
    words = lexical.bm25(q.withColumnRenamed("question_id", "query_id"), docs, "vec_id", "content").select(F.col("query_id").alias("question_id"), F.col("doc").alias("vec_id"), "bm25")
    terms = q.select("question_id", F.explode(F.array_distinct(lexical.words(F.col("text")))).alias("name"))
    fields = terms.join(docs.select("file_id", "chunk_id", "name"), "name").select("question_id", "file_id", "chunk_id", F.array(F.lit("exact_match"), F.lit("name")).alias("fields"))
    return retrieve.hybrid(routed, candidates, words, fields, docs)


_HYBRID = (
    _TOK
    + ", "
    + _routed("SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN 'how does it work ' WHEN 1 THEN 'where is it defined ' ELSE '' END || text AS text FROM eval_items")
    + ", "
    + _embedded("SELECT qid AS i, text FROM rq", "qv")
    + ", "
    + _embedded(_DOCS, "dv")
    + f""", hx AS (SELECT qv.i AS qid, dv.i AS doc, list_sum(list_transform(list_zip(qv.e, dv.e), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) AS dist FROM qv, dv),
hk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, doc) AS knn FROM hx QUALIFY knn <= 15),
hq AS (SELECT qid, tok, count(*) AS qf FROM (SELECT qid, unnest({_words('text')}) AS tok FROM rq) GROUP BY ALL),
hb AS (SELECT qid, doc_id AS doc, sum(qf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm FROM p JOIN hq USING (tok) JOIN df USING (tok) JOIN dl USING (doc_id), s GROUP BY ALL),
hd AS (SELECT doc_id AS doc, text AS content, lower(split_part(text, ' ', 1)) AS name, CASE WHEN doc_type = 'question' THEN 'function' ELSE 'class' END AS ct FROM documents),
ht AS (SELECT qid, list_distinct({_words('text')}) AS ws FROM rq),
hc AS (SELECT qid, doc, knn, 1 / (1 + dist) AS sim, coalesce(bm, 0) AS bm, content, name, ct, r.*, list_contains(ws, name) AS hit, list_filter(ws, lambda x: length(x) > 2 AND x NOT IN ({_STOP})) AS terms
  FROM hk LEFT JOIN hb USING (qid, doc) JOIN hd USING (doc) JOIN ht USING (qid) JOIN (SELECT qid, q AS low, intent, prefer_types, boost_exact, semantic_weight, bm25_weight FROM routed) r USING (qid)),
hs AS (SELECT qid, doc, knn, intent, ((semantic_weight * sim + bm25_weight * least(bm / 10.0, 1.0)) + sim * (CASE WHEN hit THEN 2.2 + CASE WHEN boost_exact THEN 2.8 ELSE 0 END ELSE 0 END + CASE WHEN list_contains(prefer_types, ct) THEN 0.8 ELSE 0 END
  + CASE WHEN ct = 'function' AND length(name) > 0 AND contains(low, lower(name)) THEN 0.5 ELSE 0 END)) * CASE WHEN length(content) < 50 THEN 0.6 WHEN length(content) > 5000 THEN 0.85 ELSE 1.0 END
  + 0.04 * len(list_filter(terms, lambda x: contains(lower(content), x))) + 0.12 * len(list_filter(terms, lambda x: contains(lower(name), x))) AS score FROM hc),
hr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, knn, doc) AS rank FROM hs),
hn AS (SELECT qid, c AS doc, min((rank, score * 0.7)) AS p FROM (SELECT *, unnest([doc - 1, doc + 1]) AS c FROM hr WHERE rank <= 3 AND intent = 'flow_explanation') WHERE (qid, c) NOT IN (SELECT (qid, doc) FROM hr) AND c IN (SELECT doc_id FROM documents) GROUP BY ALL),
ha AS (SELECT qid, doc, score, knn, false AS is_neighbour FROM hr UNION ALL SELECT qid, doc, p[2], 1000000, true FROM hn),
hz AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, knn, doc) AS INT) AS rank FROM ha QUALIFY rank <= 5)
"""
)


@query(_HYBRID + "SELECT qid AS question_id, doc AS vec_id, round(score, 5) AS score, is_neighbour, rank FROM hz")
def hybrid_retrieval(spark, d):
    """Vectors, words, boosts, penalties, overlap, neighbours and the cut, in one chain."""
    return _hybrid(spark, d).select("question_id", "vec_id", F.round("score", 5).alias("score"), "is_neighbour", "rank")


@query(
    _HYBRID
    + """, m AS (SELECT qid, max(CASE WHEN x.lang = i.lang THEN 1 ELSE 0 END) AS hit, max(CASE WHEN x.lang = i.lang THEN 1.0 / rank ELSE 0 END) AS mrr FROM hz JOIN documents x ON x.doc_id = hz.doc JOIN eval_items i ON i.item_id = hz.qid GROUP BY 1)
SELECT count(*) AS n_questions, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, CASE WHEN avg(hit) >= 0.9 THEN 'excellent' WHEN avg(hit) >= 0.75 THEN 'good' WHEN avg(hit) >= 0.5 THEN 'needs work' ELSE 'poor' END AS grade FROM m"""
)
def evaluation_summary(spark, d):
    """Means and grade of hybrid retrieval; documents in the question's language are relevant."""
    r = _hybrid(spark, d)
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce("lang", F.lit("?")).alias("name"))
    named = r.select("question_id", "vec_id", "rank").join(lang, "vec_id")
    qrels = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), F.array("lang").alias("relevant"))
    return evalm.summary(evalm.per_question(named, qrels)).select("n_questions", F.round("hit", 6).alias("hit"), F.round("mrr", 6).alias("mrr"), "grade")


# -- prompts and answers -----------------------------------------------------------------------------


def _shouting(prompt: str, timeout: float) -> str:
    """A service that answers in capitals; it knows nothing of questions on maps."""
    if "map" in prompt:
        raise Busy
    return prompt.upper()


@query(
    """
WITH r AS (SELECT id, row_number() OVER (PARTITION BY query_hash ORDER BY id) AS rank, query_hash, response FROM analysis_cache WHERE query_hash IS NOT NULL AND response IS NOT NULL),
c AS (SELECT query_hash, string_agg('[' || rank || '] function f' || id || ' (lines ' || (id + 1) || '-' || (id + 3) || ')' || chr(10) || 'decorators: cached' || chr(10) || 'types: a: int' || chr(10) || substr(response, 1, 2000), chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 5 GROUP BY 1),
q AS (SELECT query_hash, any_value(query) AS text FROM (SELECT DISTINCT query_hash, query FROM analysis_cache WHERE query_hash IS NOT NULL AND query IS NOT NULL) GROUP BY 1 HAVING count(*) = 1)
SELECT query_hash, 'Kind of question: general' || chr(10) || chr(10) || 'Statistics:' || chr(10) || 'Lines: 3' || chr(10) || chr(10) || 'Code:' || chr(10) || coalesce(context, '(nothing found)') || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM q LEFT JOIN c USING (query_hash)
"""
)
def prompt_texts(spark, d):
    """Prompts of the cached questions with their cached answers as chunks, without the instruction that opens them."""
    a = table(spark, d, "analysis_cache").where("query_hash is not null")
    rank = F.row_number().over(W.partitionBy("query_hash").orderBy("id"))
    chunks = a.where("response is not null").select(
        F.col("query_hash").alias("question_id"), rank.alias("rank"), F.lit("function").alias("chunk_type"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.col("id").cast("int").alias("line_start"), F.lit(3).alias("line_count"),
        F.array(F.lit("cached")).alias("decorators"), F.array(F.struct(F.lit("a").alias("name"), F.lit("int").alias("hint"))).alias("hints"), F.col("response").alias("content"),
    )
    q = a.where("query is not null").select(F.col("query_hash").alias("question_id"), F.col("query").alias("text")).distinct()
    q = q.groupBy("question_id").agg(F.count("*").alias("n"), F.min("text").alias("text")).where("n = 1").select("question_id", "text", F.lit("general").alias("intent"), F.lit("Lines: 3").alias("stats_text"))
    p = context.prompts(q, context.chunk_context(chunks))
    return p.select(F.col("question_id").alias("query_hash"), F.expr("substring(prompt, locate('Kind of question', prompt))").alias("prompt"))


@query("SELECT item_id AS question_id, CASE WHEN contains(text, 'map') THEN NULL ELSE upper(text) END AS answer FROM eval_items WHERE regexp_matches(text, '^[ -~\\n\\t]*$')")
def answered(spark, d):
    """Answers of a client that retries a busy service and then gives up (texts of plain ASCII)."""
    p = _items(spark, d).where(F.col("text").rlike("^[ -~\\n\\t]*$")).select("question_id", F.col("text").alias("prompt"))
    return context.answers(p, RetryingClient(_shouting, attempts=2, wait=_no_wait)).select("question_id", "answer")


def _no_wait(seconds: float) -> None:
    pass


@query(
    """
SELECT count(*) AS n_queries, round(avg(v), 6) AS mean_seconds, round(avg(CASE WHEN response IS NULL THEN 0 ELSE 1 END), 6) AS share_answered, count(*) FILTER (WHERE id % 3 = 0) AS n_cached, round(avg(CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END), 6) AS share_cached,
  max(v) AS longest_seconds, count(DISTINCT id % 5) AS n_intents FROM (SELECT id, response, CAST(id % 10 AS DOUBLE) AS v FROM analysis_cache)"""
)
def query_log_statistics(spark, d):
    log = table(spark, d, "analysis_cache").select((F.col("id") % 10).cast("double").alias("seconds"), F.col("response").alias("answer"), (F.col("id") % 3 == 0).alias("cached"), (F.col("id") % 5).cast("string").alias("intent"))
    return context.log_stats(log).withColumns({c: F.round(c, 6) for c in ("mean_seconds", "share_answered", "share_cached")})


_NAMES = "list_sort(list(p_name))"


@query(
    f"WITH g AS (SELECT p_brand, {_NAMES} AS xs FROM part GROUP BY 1) SELECT p_brand, CAST(len(xs) AS BIGINT) AS n, "
    + ", ".join(f"array_to_string(xs[1:{n}], '|') AS {c}" for c, n in plan.SNAPSHOT_CAPS.items())
    + " FROM g"
)
def snapshots(spark, d):
    """Shortened lists of each brand's parts, with the whole count."""
    g = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), *[F.collect_list("p_name").alias(c) for c in plan.SNAPSHOT_CAPS])
    return plan.snapshot(g).withColumns({c: F.array_join(c, "|") for c in plan.SNAPSHOT_CAPS})


# -- files, scanners and what is written -------------------------------------------------------------


@query("SELECT sha256('x = 1' || chr(10) || 'name = ' || chr(39) || n_name || chr(39) || chr(10)) AS code_hash, CAST(3 AS INT) AS n_lines FROM nation")
def files_read_back(spark, d):
    """A file for each nation, written to the shared folder and read as sources."""
    folder = _shared_folder(spark)
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("x = 1\nname = '"), "n_name", F.lit("'")).alias("value"))
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    return src.read_sources(spark, folder, "*.txt").select("code_hash", F.size(F.split("code", "\n", -1)).alias("n_lines"))


@query(
    """
WITH f AS (SELECT session_id AS file_id, rule, message, line_number, row_number() OVER (PARTITION BY session_id ORDER BY id) - 1 AS seq FROM (SELECT DISTINCT * FROM security_findings))
SELECT file_id, seq, coalesce(line_number, 0) AS line, 'bandit' AS source, rule, message, CAST(NULL AS VARCHAR) AS suggestion, 'line ' || line_number AS code_snippet FROM f"""
)
def scanner_report(spark, d):
    """Stored findings as an external scanner's JSON, read as raw findings."""
    f = table(spark, d, "security_findings").distinct()
    r = F.struct("id", F.col("rule").alias("test_id"), F.col("message").alias("issue_text"), "line_number", F.concat(F.lit("line "), F.col("line_number").cast("string")).alias("code"))
    results = f.groupBy(F.col("session_id").alias("file_id")).agg(F.sort_array(F.collect_list(r)).alias("results"))
    return src.scanner_findings(results).withColumn("line", F.coalesce("line", F.lit(0)))


#: A scanner in one line: it names the lines of a file that hold a capital A.
_SCANNER = (sys.executable, "-c", "import json,sys; print(json.dumps({'results': [{'test_id': 'B1', 'issue_text': 'capital', 'line_number': k} for k, x in enumerate(open(sys.argv[1]), 1) if 'A' in x]}))")


@query("SELECT n_nationkey::BIGINT AS file_id, CAST(0 AS BIGINT) AS seq, CAST(2 AS INT) AS line, 'bandit' AS source, 'B1' AS rule, 'capital' AS message, '    x = 1' || chr(10) || '>>> ' || n_name || chr(10) || '    y = 2' AS code_snippet FROM nation WHERE contains(n_name, 'A')")
def scanner_run(spark, d):
    """An external program run on each nation's file."""
    f = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("file_id"), F.concat(F.lit("x = 1\n"), "n_name", F.lit("\ny = 2")).alias("code"))
    return src.run_scanner(f.coalesce(1), _SCANNER).drop("suggestion")


@query(
    """
SELECT 'sessions' AS t, CAST(r_regionkey + 1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS session_id, r_name AS a, sha256('x = eval(' || replace(r_name, ' ', '_') || ')') AS b FROM region
UNION ALL SELECT 'security_findings', r_regionkey + 1, r_regionkey + 1, 'HIGH', 'dangerous_eval_exec' FROM region
UNION ALL SELECT 'chat_messages', row_number() OVER (ORDER BY n_nationkey), n_regionkey + 1, n_name, CASE WHEN n_nationkey % 2 = 0 THEN sha256(n_name) END FROM nation
UNION ALL SELECT 'code_chunks', row_number() OVER (ORDER BY n_regionkey, n_nationkey), n_regionkey + 1, n_name, CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT 'analysis_cache', row_number() OVER (ORDER BY n_name), 0, n_name, sha256(n_name) FROM nation
"""
)
def store_round_trip(spark, d):
    """Sessions with findings, messages, chunks and answers saved to a new store and read back."""
    st = store.SessionStore(spark, _shared_folder(spark))
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    files = r.select(F.col("r_regionkey").cast("long").alias("file_id"), F.lit("a.py").alias("path"), F.col("r_name").alias("title"), F.concat(F.lit("x = eval("), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit(")")).alias("code"))
    a = plan.analyze(files, snippets=False)
    st.save_sessions(files, a.findings, a.status)
    sid = (F.col("n_regionkey") + 1).cast("long").alias("session_id")
    role = F.when(F.col("n_nationkey") % 2 == 0, "user").otherwise("assistant")
    st.save_messages(n.orderBy(F.desc("n_name")).select(sid, role.alias("role"), F.col("n_name").alias("content"), F.create_map(F.lit("client"), F.lit("web")).alias("metadata"), F.col("n_nationkey").alias("seq")))
    st.save_chunks(n.select(sid, F.col("n_nationkey").alias("chunk_index"), F.col("n_name").alias("chunk_text"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), F.lit(None).cast("string").alias("embedding_id")))
    h = store.content_hash(F.col("n_name"))
    st.save_cache(n.select(F.col("n_name").alias("code_hash"), h.alias("query_hash"), F.lit("q").alias("query"), F.lit("r").alias("response")))
    none = F.lit(0).cast("long")
    parts = (
        ("sessions", none, "title", F.col("code_hash")), ("security_findings", F.col("session_id"), "severity", F.col("rule")), ("chat_messages", F.col("session_id"), "content", F.col("query_hash")),
        ("code_chunks", F.col("session_id"), "chunk_text", F.col("chunk_index").cast("string")), ("analysis_cache", none, "code_hash", F.col("query_hash")),
    )
    out = [st.table(t).select(F.lit(t).alias("t"), "id", s.alias("session_id"), F.col(x).alias("a"), b.alias("b")) for t, s, x, b in parts]
    return reduce(lambda x, y: x.unionByName(y), out)


@query(
    """
SELECT t, CAST(n AS BIGINT) AS n FROM (SELECT 'version' AS t, 25 AS n UNION ALL SELECT 'chunks', 25 UNION ALL SELECT 'vectors', 25 UNION ALL SELECT 'edges', 25 UNION ALL SELECT 'posted names', count(DISTINCT lower(n_name)) FROM nation)"""
)
def index_round_trip(spark, d):
    """A retrieval index of a file for each nation, written with its version, checked and read back."""
    root = _shared_folder(spark)
    n = table(spark, d, "nation")
    name = F.regexp_replace("n_name", " ", "_")
    files = n.select(F.col("n_nationkey").cast("long").alias("file_id"), F.lit("a.py").alias("path"), F.concat(F.lit("def "), name, F.lit("(x):\n    return load(x)\n")).alias("code"))
    plan.build_index(files).write(root)
    ix = plan.Index.read(spark, root)
    version = spark.read.parquet(f"{root}/version").where(F.col("version") == plan.INDEX_VERSION).select(F.lit("version").alias("t"), F.col("n_chunks").alias("n"))
    count = lambda t, df: df.groupBy().agg(F.lit(t).alias("t"), F.count("*").alias("n"))
    names = ix.postings.where("field = 'exact_match'").select("term").distinct()
    return reduce(lambda x, y: x.unionByName(y), [version, count("chunks", ix.chunks), count("vectors", ix.vectors), count("edges", ix.edges), count("posted names", names)])
