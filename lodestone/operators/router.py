"""Question routing for many questions at once: intents, flags, entities, retrieval parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dims
from lodestone.session import bounded_broadcast, materialize

INTENTS = tuple(dict.fromkeys(i for i, _, _ in dims.INTENT_PATTERNS))


def intent_scores(question: Column) -> Column:
    """Array of ``(confidence, order, intent)`` of the intents with a matching pattern, best first.

    The confidence is the matched share of an intent's weights. The patterns are literals of the
    plan: no join, one projection.
    """
    q = F.lower(question)
    scored = []
    for k, intent in enumerate(INTENTS):
        own = [(p, w) for i, p, w in dims.INTENT_PATTERNS if i == intent]
        raw = F.lit(0.0)
        for p, w in own:
            raw = raw + F.when(q.rlike(p), F.lit(w)).otherwise(0.0)
        share = F.round(F.least(raw / max(sum(w for _, w in own), 1.0), F.lit(1.0)), 12)
        scored.append(F.struct((-share).alias("neg"), F.lit(k).alias("order"), F.lit(intent).alias("intent")))
    kept = F.filter(F.array(*scored), lambda s: s["neg"] < 0)
    return F.transform(F.sort_array(kept), lambda s: F.struct((-s["neg"]).alias("confidence"), s["order"].alias("order"), s["intent"].alias("intent")))


def entities(question: Column) -> Column:
    """Struct of ``entities``, ``quoted`` and ``keywords``, ordered and distinct."""
    every = lambda p, g=1: F.regexp_extract_all(question, F.lit(p), g)
    stop = F.array(*[F.lit(w) for w in dims.QUESTION_STOPWORDS])
    quoted = every(r"[\"']([^\"']+)[\"']")
    named = F.filter(
        every(r"\b([A-Z][a-z]+[A-Z][a-zA-Z0-9]*|[a-z_][a-z0-9_]+)\b"),
        lambda x: ~F.array_contains(stop, F.lower(x)) & (F.length(x) > 2) & ((F.length(x) > 3) | x.contains("_") | F.substr(x, F.lit(2)).rlike("[A-Z]")),
    )
    found = F.array_distinct(F.concat(every(r"\b([a-zA-Z_][a-zA-Z0-9_]*\.[a-zA-Z_][a-zA-Z0-9_.]*)\b"), every("`([^`]+)`"), named, every(r"@(\w+)")))
    hints = F.filter(
        F.flatten(F.transform(every(r"->\s*(\w[\w\[\], ]*)"), lambda t: F.regexp_extract_all(t, F.lit(r"\w+"), 0))),
        lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)),
    )
    low = lambda arr: F.transform(arr, lambda x: F.lower(x))
    keywords = F.array_distinct(F.concat(low(hints), low(quoted), low(F.filter(found, lambda e: F.length(e) > 3))))
    return F.struct(found.alias("entities"), quoted.alias("quoted"), keywords.alias("keywords"))


def _param(k: int, default) -> Column:
    pairs = [F.lit(x) for p in dims.INTENT_PARAMS for x in (p[0], p[k])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("intent")), F.lit(default))


def _types(intent: Column) -> Column:
    pairs = [x for p in dims.INTENT_PARAMS for x in (F.lit(p[0]), F.array(*[F.lit(t) for t in p[1]]).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), intent), F.array().cast("array<string>"))


def classify(questions: DataFrame) -> DataFrame:
    """Questions (``question_id, text``) with intent, confidence, secondary intents, flags, entities and parameters.

    Without a matching pattern the intent is ``general_query`` with confidence 0. Secondary intents
    reach the primary's confidence less 0.3, and 0.4 at least. Preferred types of secondary intents
    follow those of the primary. A null text has no intent, no flags and no entities.
    """
    q = F.lower("text")
    s = questions.withColumn("_s", intent_scores(F.coalesce("text", F.lit(""))))
    first = F.try_element_at("_s", F.lit(1))
    floor = F.greatest(F.round(first["confidence"] - 0.3, 12), F.lit(0.4))
    s = s.withColumns(
        {
            "intent": F.coalesce(first["intent"], F.lit("general_query")),
            "confidence": F.coalesce(first["confidence"], F.lit(0.0)),
            "secondary": F.transform(F.filter(F.slice("_s", 2, 99), lambda x: x["confidence"] >= floor), lambda x: x["intent"]),
            "is_counting": F.coalesce(q.rlike(dims.COUNTING), F.lit(False)),
            "is_listing": F.coalesce(q.rlike(dims.LISTING), F.lit(False)),
            "is_compound": F.coalesce(q.rlike(dims.COMPOUND), F.lit(False)),
            "_e": entities(F.coalesce("text", F.lit(""))),
        }
    )
    more = F.flatten(F.transform("secondary", _types))
    checks = [p[0] for p in dims.INTENT_PARAMS if p[3]]
    return s.select(
        *questions.columns,
        "intent",
        "confidence",
        "secondary",
        "is_counting",
        "is_listing",
        "is_compound",
        "_e.entities",
        "_e.quoted",
        "_e.keywords",
        F.array_distinct(F.concat(_types(F.col("intent")), more)).alias("prefer_types"),
        _param(2, False).alias("boost_exact"),
        (_param(3, False) | F.arrays_overlap("secondary", F.array(*[F.lit(c) for c in checks]))).alias("code_check"),
        _param(4, 0.7).alias("semantic_weight"),
        _param(5, 0.3).alias("bm25_weight"),
        F.lit(dims.TOP_K).alias("k"),
    )


def adjusted(classified: DataFrame, no_exact_matches: Column, all_same_type: Column) -> DataFrame:
    """Parameters after a first look at the results: no exact boost without exact matches, no preference among equals."""
    none = F.array().cast("array<string>")
    return classified.withColumns(
        {"boost_exact": F.col("boost_exact") & ~no_exact_matches, "prefer_types": F.when(all_same_type, none).otherwise(F.col("prefer_types"))}
    )


def boost_weights(classified: DataFrame, has_exact: Column) -> DataFrame:
    """The router's own weights of metadata matches for each question, as a map column ``weights``."""
    w = {k: F.lit(v) for k, v in dims.ROUTER_BOOST.items()}
    sure = (F.col("confidence") > 0.8) & has_exact
    listed = F.col("is_counting") | F.col("is_listing")
    is_ = lambda x: F.col("intent") == x
    exact = F.when(listed, 0.5).when(is_("optimization"), 1.5).when(sure, 1.3).when(~has_exact, 0.0).otherwise(w["exact_match"])
    w |= {
        "exact_match": exact,
        "keywords": F.when(listed, 0.7).when(~has_exact, 0.6).otherwise(w["keywords"]),
        "name": F.when(is_("definition_lookup") | is_("optimization"), 0.8).otherwise(w["name"]),
        "file_context": F.when(is_("flow_explanation"), 0.4).otherwise(w["file_context"]),
        "function_calls": F.when(is_("flow_explanation"), 0.5).otherwise(w["function_calls"]),
        "docstring_match": F.when(listed, 0.6).otherwise(w["docstring_match"]),
    }
    return classified.withColumn("weights", F.create_map(*[x for k, v in w.items() for x in (F.lit(k), v)]))


def expanded_terms(questions: DataFrame, edges: DataFrame) -> DataFrame:
    """``(question_id, expanded)``: the question, callees and callers of functions it names, topic terms.

    ``edges`` are distinct ``(caller, callee)`` names. A function is named when its lower-case name
    occurs in the question; since names are identifiers, the question's identifiers and their
    sub-strings, up to the length of the longest name, are matched, so it is an equi-join and not one
    of every name with every question.
    """
    edges = materialize(edges)
    longest = edges.agg(F.max(F.greatest(F.length("caller"), F.length("callee")))).first()[0] or 1
    q = F.lower(F.coalesce("text", F.lit("")))
    subs = lambda r: F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.length(r)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length(r) - i + 1)), lambda n: F.substring(r, i, n))
        )
    )
    # questions share their words: each distinct one is looked up once
    runs = materialize(questions.select("question_id", F.explode(F.array_distinct(F.regexp_extract_all(q, F.lit(r"(\w+)"), 1))).alias("run")))
    by = edges.select(F.lower("caller").alias("f"), F.col("callee").alias("t"), F.col("caller").alias("src"), F.lit(0).alias("o"))
    to = edges.select(F.lower("callee").alias("f"), F.col("caller").alias("t"), F.col("callee").alias("src"), F.lit(1).alias("o"))
    functions = edges.select(F.col("caller").alias("src")).distinct()
    near = by.unionByName(to.join(functions.hint("merge"), "src", "left_semi"))
    known = near.groupBy("f").agg(F.collect_set(F.struct("src", "o", "t")).alias("n"))
    parts = runs.select("run").distinct().select("run", F.explode(F.array_distinct(subs(F.col("run")))).alias("f"))
    found = materialize(parts.join(known.select("f").hint("merge"), "f"))
    named = runs.join(bounded_broadcast(found, 500_000), "run").select("question_id", "f").distinct()
    names = materialize(named.groupBy("question_id").agg(F.sort_array(F.collect_set("f")).alias("fs")))
    # and questions that name the same functions are told once
    sets = names.select("fs").distinct().select("fs", F.explode("fs").alias("f")).join(known.hint("merge"), "f")
    told = sets.groupBy("fs").agg(F.sort_array(F.flatten(F.collect_list("n"))).alias("n")).select("fs", F.array_distinct(F.transform("n", lambda x: x["t"])).alias("ts"))
    terms = names.join(told.hint("merge"), "fs").select("question_id", "ts")
    topics = F.flatten(F.array(*[F.when(q.contains(k), F.array(*[F.lit(t) for t in v])).otherwise(F.array().cast("array<string>")) for k, v in dims.TOPIC_TERMS.items()]))
    out = questions.join(terms.hint("merge"), "question_id", "left")
    graph = F.coalesce("ts", F.array().cast("array<string>"))
    return out.select("question_id", F.array_distinct(F.concat(F.array(F.coalesce("text", F.lit(""))), graph, topics)).alias("expanded"))
