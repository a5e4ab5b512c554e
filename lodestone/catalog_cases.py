"""Queries over the corpus of cases, whose answers SQL states row by row (``<u>`` is the file's number)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.cases import NAMES, case_corpus
from lodestone.catalog import _quote, query
from lodestone.operators import chunk, graph, merge, metrics, report, rules
from lodestone.operators.ast_table import ast_nodes, parse_status
from lodestone.session import arrow_batch_rows, materialize
from lodestone.sources.tables import table


def _files(spark, d):
    """A file for each part."""
    arrow_batch_rows(spark, 2000)
    return materialize(case_corpus(table(spark, d, "part"), "p_partkey"))


def _nodes(files, names: bool = False):
    return materialize(ast_nodes(files, names))


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    return str(x) if isinstance(x, (int, float)) else _quote(x)


def _expect(columns: dict[str, str], rows: dict[str, list[tuple]]) -> str:
    """SQL of one row for each file and expected tuple; ``columns`` maps names to types."""
    values = ", ".join("(" + ", ".join([str(NAMES.index(case)), *map(_literal, r)]) + ")" for case, rs in rows.items() for r in rs)
    out = ", ".join(f"replace({c}, '<u>', CAST(p_partkey AS VARCHAR)) AS {c}" if t == "VARCHAR" else f"CAST({c} AS {t}) AS {c}" for c, t in columns.items())
    return f"SELECT CAST(p_partkey AS BIGINT) AS file_id, {out} FROM part JOIN (VALUES {values}) v(k, {', '.join(columns)}) ON p_partkey % {len(NAMES)} = k"


# -- findings ----------------------------------------------------------------------------------------

FOUND = {
    "imports": [(1, "import_marshal"), (1, "import_subprocess"), (2, "import_shelve"), (3, "import_yaml"), (4, "import_telnetlib"), (5, "import_ftplib"), (6, "import_ctypes"), (7, "import_os")],
    "dynamic": [(1, "dangerous_eval_exec"), (2, "dynamic_import")],
    "sql_inline": [(3, "sql_injection"), (4, "sql_injection"), (5, "sql_injection"), (7, "sql_injection"), (9, "sql_injection")],
    "sql_variable": [(2, "sql_injection_variable"), (3, "sql_injection"), (6, "sql_injection_variable")],
    "shell": [(1, "import_os"), (2, "command_injection_danger"), (3, "command_injection_danger"), (4, "shell_injection"), (7, "command_injection_danger")],
    "valid_secrets": [(1, "hardcoded_password"), (2, "hardcoded_api_key"), (3, "hardcoded_secret"), (5, "hardcoded_token")],
    "hashes": [(1, "weak_hash_md5"), (2, "weak_hash_sha1"), (4, "weak_hash_md5"), (6, "weak_hash_md5")],
    "pickles": [(1, "insecure_pickle"), (2, "insecure_pickle"), (3, "insecure_yaml"), (5, "insecure_yaml")],
    "randoms": [(7, "weak_random_crypto")],
    "paths": [(1, "path_traversal"), (4, "path_traversal"), (5, "path_traversal"), (7, "path_traversal"), (8, "path_traversal"), (10, "path_traversal")],
    "xml": [(1, "xxe_vulnerability"), (3, "xxe_vulnerability"), (5, "xxe_vulnerability")],
    "races": [(1, "race_condition_toctou"), (3, "race_condition_toctou")],
    "temps": [(1, "insecure_temp_file"), (3, "insecure_temp_file"), (4, "insecure_temp_file")],
    "sizes": [(1, "integer_overflow_risk"), (2, "integer_overflow_risk")],
    "formats": [(1, "format_string_injection"), (3, "format_string_injection"), (4, "format_string_injection")],
    "redirects": [(1, "open_redirect"), (3, "open_redirect"), (4, "open_redirect")],
    "timings": [(1, "timing_attack"), (7, "timing_attack"), (13, "timing_attack")],
    "modes": [(1, "insecure_permissions"), (3, "insecure_permissions")],
    "requests": [(1, "ssrf_vulnerability"), (3, "ssrf_vulnerability")],
    "privileges": [(1, "privilege_escalation"), (10, "privilege_escalation")],
    "structure": [(1, "import_os")],
}
#: Of check 16, which runs only without parity.
LOOPS = {"loops": [(1, "resource_exhaustion"), (7, "resource_exhaustion")]}


@query(_expect({"line": "INT", "rule": "VARCHAR"}, FOUND))
def case_findings(spark, d):
    files = _files(spark, d)
    return rules.raw_findings(files, _nodes(files)).select("file_id", "line", "rule")


@query(_expect({"line": "INT", "rule": "VARCHAR"}, FOUND | LOOPS))
def case_findings_all_rules(spark, d):
    files = _files(spark, d)
    return rules.raw_findings(files, _nodes(files), parity=False).select("file_id", "line", "rule")


@query(
    _expect(
        {"line": "INT", "tainted": "BOOLEAN"},
        {"sql_inline": [(3, False), (4, True), (5, False), (7, False), (9, True)], "sql_variable": [(2, False), (3, False), (6, False)]},
    )
)
def case_tainted_sql(spark, d):
    """Whether a user's input is named among the parts of SQL text."""
    files = _files(spark, d)
    f = rules.raw_findings(files, _nodes(files)).where("rule like 'sql_injection%'")
    return f.select("file_id", "line", F.col("message").endswith(rules.TAINTED).alias("tainted"))


@query(
    "WITH s AS ("
    + _expect({"line": "INT", "rule": "VARCHAR"}, FOUND)
    + "), e AS (SELECT file_id, line, 'external' AS rule FROM s WHERE line % 2 = 1 GROUP BY ALL)"
    " SELECT file_id, line, rule, 'security' AS sources FROM s UNION ALL SELECT file_id, line, rule, 'other' FROM e"
)
def case_two_scanners(spark, d):
    """Findings of two scanners in order of priority; the second names each odd line."""
    files = _files(spark, d)
    own = rules.raw_findings(files, _nodes(files))
    other = own.where("line % 2 = 1").select("file_id", "line").distinct().select("file_id", F.lit(1).cast("long").alias("seq"), "line", F.lit("other").alias("source"), F.lit("external").alias("rule"), F.lit("m").alias("message"), F.lit("s").alias("suggestion"))
    both = merge.concatenate(own, other)
    w = both.groupBy("file_id", "line", "rule").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "source"))), lambda x: x["source"]), ",").alias("sources"))
    return w


_REPORT = {"imports": (8, 0), "dynamic": (1, 1), "sql_inline": (0, 5), "sql_variable": (0, 3), "shell": (1, 4), "valid_secrets": (0, 4), "hashes": (4, 0), "pickles": (0, 4), "randoms": (1, 0), "paths": (0, 6)}
_REPORT |= {"xml": (0, 3), "races": (2, 0), "temps": (3, 0), "sizes": (2, 0), "formats": (0, 3), "redirects": (3, 0), "timings": (3, 0), "loops": (0, 0), "modes": (2, 0), "requests": (0, 2), "privileges": (0, 2), "structure": (1, 0), "long_function": (0, 0), "broken": (0, 0)}
_REPORT |= {"secrets": (0, 0), "plain": (0, 0), "empty": (0, 0)}
# subprocess and marshal share a line and a category
_REPORT["imports"] = (7, 0)


@query(
    "WITH e AS ("
    + _expect({"medium": "INT", "high": "INT"}, {k: [v] for k, v in _REPORT.items()})
    + f"), n AS (SELECT file_id, medium, high, {'list_value(' + ', '.join(map(_quote, NAMES)) + ')'}[file_id % {len(NAMES)} + 1] AS name FROM e)"
    " SELECT file_id, 0 AS part, 'Security report: src/' || name || '.py' AS text FROM n"
    " UNION ALL SELECT file_id, 2, 'HIGH ' || high || ', MEDIUM ' || medium FROM n"
)
def case_report(spark, d):
    """Head and severity lines of the text report."""
    files = _files(spark, d)
    n = _nodes(files)
    lines = report.report_lines(files, metrics.file_metrics(files, n), merge.ranked(merge.merge_findings(rules.raw_findings(files, n))))
    return lines.where("part in (0, 2)").select("file_id", "part", "text")


# -- facts -------------------------------------------------------------------------------------------

LINES = {
    "imports": 10, "dynamic": 7, "sql_inline": 10, "sql_variable": 11, "shell": 9, "secrets": 11, "valid_secrets": 6, "hashes": 7, "pickles": 7, "randoms": 18, "paths": 11, "xml": 6, "races": 18, "temps": 5,
    "sizes": 6, "formats": 7, "redirects": 6, "timings": 16, "loops": 10, "modes": 7, "requests": 7, "privileges": 15, "structure": 43, "long_function": 66, "broken": 13, "plain": 4, "empty": 1,
}
BROKEN = {"secrets": 3, "broken": 7}


@query(_expect({"valid": "BOOLEAN", "err_line": "INT", "n_lines": "INT"}, {k: [(k not in BROKEN, BROKEN.get(k, 0), n)] for k, n in LINES.items()}))
def case_status(spark, d):
    return parse_status(_files(spark, d)).select("file_id", "valid", F.coalesce("err_line", F.lit(0)).alias("err_line"), "n_lines")


CALLS = {
    "dynamic": [(1, "exec", "exec"), (2, "__import__", "__import__"), (3, "__import__", "__import__"), (6, "evaluate", "evaluate")],
    "shell": [(2, "os.system", "system"), (3, "os.popen", "popen"), (4, "subprocess.run", "run"), (5, "subprocess.run", "run"), (6, "subprocess.run", "run"), (7, "commands.getoutput", "getoutput"), (8, "system", "system")],
    "formats": [(1, "fmt_<u>.format", "format"), (2, "format", "format"), (3, "format", "format"), (3, "get", "get"), (4, "format", "format"), (5, "self.f.format", "format"), (6, "format", "format")],
    "structure": [
        (14, "total_of", "total_of"), (24, "helper.run", "run"), (25, "lock", "lock"), (25, "open", "open"), (27, "load", "load"), (29, "recover", "recover"), (33, "inner", "inner"), (38, "get", "get"), (42, "outer_<u>", "outer_<u>"),
    ],
}


@query(_expect({"line": "INT", "name": "VARCHAR", "tail": "VARCHAR"}, CALLS))
def case_calls(spark, d):
    """Full and last name of every call, in the cases about names."""
    files = _files(spark, d)
    c = ast_nodes(files.where(F.col("path").isin(*[f"src/{n}.py" for n in CALLS]))).where("kind = 'Call'")
    return c.select("file_id", F.col("lineno").alias("line"), "name", "tail")


FUNCTIONS = {
    "dynamic": [("evaluate", 4, 2, 1, 1, 0)],
    "sql_inline": [("f_<u>", 1, 9, 3, 1, 0)],
    "sql_variable": [("g_<u>", 1, 10, 2, 1, 0)],
    "privileges": [("f_<u>", 1, 2, 2, 1, 0), ("g", 3, 3, 1, 2, 1), ("k", 8, 2, 0, 1, 0), ("m", 10, 3, 2, 1, 0), ("n", 13, 2, 1, 1, 0)],
    "structure": [("__init__", 9, 2, 3, 1, 0), ("inner", 23, 2, 1, 1, 0), ("outer_<u>", 21, 14, 1, 7, 3), ("total", 13, 2, 1, 1, 0)],
    "long_function": [("long_<u>", 4, 62, 1, 1, 0)],
}


@query(_expect({"name": "VARCHAR", "line": "INT", "length": "INT", "params": "INT", "complexity": "INT", "nesting_depth": "INT"}, FUNCTIONS))
def case_functions(spark, d):
    return metrics.function_info(_nodes(_files(spark, d)))


@query(_expect({"name": "VARCHAR", "line": "INT", "methods": "BIGINT"}, {"structure": [("Cart_<u>", 6, 2), ("Color", 17, 0)]}))
def case_classes(spark, d):
    return metrics.class_info(_nodes(_files(spark, d)))


_QUIET = ("imports", "sql_inline", "sql_variable", "timings", "loops", "privileges", "structure", "long_function", "empty")


@query(_expect({"has_main_guard": "BOOLEAN", "has_top_level_executable": "BOOLEAN"}, {k: [(k == "structure", k not in _QUIET)] for k in LINES if k not in BROKEN}))
def case_flags(spark, d):
    return metrics.file_flags(_nodes(_files(spark, d)))


@query(
    _expect(
        {"package": "VARCHAR"},
        {"imports": [(x,) for x in ("ctypes", "ftplib", "json", "marshal", "os", "shelve", "subprocess", "telnetlib", "yaml")], "shell": [("os",)], "structure": [("enum",), ("os",)], "long_function": [("re",)]},
    )
)
def case_packages(spark, d):
    return metrics.imported_packages(ast_nodes(_files(spark, d)))


VARIABLES = {
    "dynamic": [
        ("__import__", "used", "2,3"), ("a", "defined", "4"), ("a", "used", "5"), ("code_<u>", "used", "1"), ("evaluate", "used", "6"), ("exec", "used", "1"), ("m", "defined", "2"), ("n", "defined", "3"), ("name", "used", "2"), ("x", "defined", "1"),
    ],
    "sql_variable": [
        ("a", "defined", "1"), ("a", "used", "2,5,6,9"), ("cur", "defined", "1"), ("cur", "used", "3,5,8,10"), ("p", "defined", "4"), ("p", "used", "5"), ("q", "defined", "2"), ("q", "used", "3"), ("s", "defined", "6,7"), ("s", "used", "7,8"),
        ("z", "defined", "9"), ("z", "used", "10"),
    ],
    "plain": [("a", "defined", "1"), ("a", "used", "2"), ("b", "defined", "2"), ("b", "used", "3"), ("print", "used", "3")],
}


@query(_expect({"name": "VARCHAR", "how": "VARCHAR", "lines": "VARCHAR"}, VARIABLES))
def case_variables(spark, d):
    files = _files(spark, d).where(F.col("path").isin(*[f"src/{n}.py" for n in VARIABLES]))
    return metrics.variable_lines(_nodes(files, True)).withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ","))


@query(_expect({"container": "VARCHAR", "name": "VARCHAR", "line": "INT"}, {"structure": [("With", "lock", 25), ("With", "open", 25), ("Try", "load", 27)]}))
def case_guarded_calls(spark, d):
    n = _nodes(_files(spark, d))
    both = metrics.within(n, "With").withColumn("container", F.lit("With")).unionByName(metrics.within(n, "Try").withColumn("container", F.lit("Try")))
    return both.select("file_id", "container", "name", F.col("lineno").alias("line"))


EDGES = {
    "sql_inline": [("f_<u>", "execute"), ("f_<u>", "executemany"), ("f_<u>", "fetch"), ("f_<u>", "format")],
    "sql_variable": [("g_<u>", "execute")],
    "privileges": [("n", "Bad")],
    "structure": [
        ("fetch", "get"), ("inner", "run"), ("outer_<u>", "inner"), ("outer_<u>", "load"), ("outer_<u>", "lock"), ("outer_<u>", "open"), ("outer_<u>", "recover"), ("outer_<u>", "run"), ("total", "total_of"),
    ],
    "long_function": [("long_<u>", "pick")],
}


@query(_expect({"caller": "VARCHAR", "callee": "VARCHAR"}, EDGES))
def case_edges(spark, d):
    return graph.file_edges(_files(spark, d))


@query(_expect({"outer": "VARCHAR", "inner": "VARCHAR"}, {"structure": [("outer_<u>", "inner")]}).replace("outer", '"outer"').replace("inner", '"inner"').replace('"outer"_<u>', "outer_<u>").replace("'\"inner\"'", "'inner'"))
def case_nested(spark, d):
    return graph.nested_functions(_nodes(_files(spark, d)))


SYMBOLS = {
    "dynamic": [("evaluate", "function", 4, 4, 5, "", "", False, None, False)],
    "sql_inline": [("f_<u>", "function", 1, 1, 9, "", "", False, None, False)],
    "sql_variable": [("g_<u>", "function", 1, 1, 10, "", "", False, None, False)],
    "privileges": [(n, "function", a, a, z, "", "", n == "h", None, False) for n, a, z in (("f_<u>", 1, 2), ("g", 3, 5), ("h", 6, 7), ("k", 8, 9), ("m", 10, 12), ("n", 13, 14))],
    "structure": [
        ("Cart_<u>", "class", 5, 6, 14, "dataclass", "", False, "dataclass", True),
        ("Color", "class", 17, 17, 18, "", "", False, "Enum", False),
        ("__init__", "function", 9, 9, 10, "", "owner:str,limit:int", False, None, False),
        ("fetch", "function", 37, 37, 38, "", "", True, None, False),
        ("inner", "function", 23, 23, 24, "", "", False, None, False),
        ("outer_<u>", "function", 21, 21, 34, "", "return:list[int],a:int,rest:str,more:dict", False, None, False),
        ("total", "function", 12, 13, 14, "property", "return:float", False, None, False),
    ],
    "long_function": [("long_<u>", "function", 4, 4, 65, "", "", False, None, False)],
}


@query(
    _expect(
        {"name": "VARCHAR", "kind": "VARCHAR", "first_line": "INT", "line": "INT", "end_lineno": "INT", "decorators": "VARCHAR", "hints": "VARCHAR", "is_async": "BOOLEAN", "special_type": "VARCHAR", "has_init": "BOOLEAN"}, SYMBOLS
    )
)
def case_symbols(spark, d):
    s = graph.symbols(_nodes(_files(spark, d)))
    hints = F.array_join(F.transform("hints", lambda h: F.concat(h["name"], F.lit(":"), h["hint"])), ",")
    return s.withColumns({"decorators": F.array_join("decorators", ","), "hints": hints})


STATS = {
    "dynamic": (1, 0, "evaluate", "", ""), "sql_inline": (1, 0, "f_<u>", "", ""), "sql_variable": (1, 0, "g_<u>", "", ""), "privileges": (6, 0, "f_<u>,g,h,k,m,n", "", ""), "long_function": (1, 0, "long_<u>", "", ""),
    "structure": (5, 2, "__init__,fetch,inner,outer_<u>,total", "Cart_<u>,Color", "Cart_<u>.__init__,Cart_<u>.total"),
}


@query(
    _expect(
        {"n_lines": "INT", "n_functions": "BIGINT", "n_classes": "BIGINT", "functions": "VARCHAR", "classes": "VARCHAR", "methods": "VARCHAR", "n_imports": "INT"},
        {
            k: [(n, *STATS.get(k, (0, 0, "", "", "")), {"imports": 9, "dynamic": 2, "shell": 1, "structure": 2, "long_function": 1}.get(k, 0))]
            for k, n in LINES.items()
            if k not in BROKEN
        },
    )
)
def case_statistics(spark, d):
    files = _files(spark, d)
    s = graph.code_stats(files, _nodes(files))
    return s.withColumns({c: F.array_join(c, ",") for c in ("functions", "classes", "methods")}).withColumn("n_imports", F.size("import_lines")).drop("import_lines")


# -- chunks ------------------------------------------------------------------------------------------

_BLOCK = ("secrets", "valid_secrets", "hashes", "pickles", "randoms", "paths", "xml", "races", "temps", "sizes", "formats", "redirects", "timings", "loops", "modes", "requests", "plain", "empty")
_CART = "Holds what a user wants to buy.  def __init__(self, owner: str, limit: int = 5): self.owner = owner  @property def total(self) -> float: return total_of(self.items)   class Color(Enum): RED = 1   def outer_<u>("
_OUTER = "Walks all rows. def inner(x): return helper.run(x) with open('a') as f, lock(): try: load(f) except ValueError: recover(f) for i in rest: while i and a or key: if i: i = inner(i) return f   async def fetch(url): await get(url)   if __name__ == \"__main__\":"
_TO = "inner,load,lock,open,recover,run"
CHUNKS = {
    "imports": [(0, "imports", "imports", 0, 9, None, None, "", "", "", False, False)],
    "dynamic": [(0, "function", "evaluate", 3, 2, None, None, "", "", "", False, False)],
    "sql_inline": [(0, "function", "f_<u>", 0, 9, None, None, "execute,executemany,fetch,format", "", "execute,executemany,fetch,format", False, False)],
    "sql_variable": [(0, "function", "g_<u>", 0, 10, None, None, "execute", "", "execute", False, False)],
    "shell": [(0, "imports", "imports", 0, 1, None, None, "", "", "", False, False)],
    "privileges": [
        (k, "function", n, a, z, None, None, to, "", to, n == "h", False) for k, (n, a, z, to) in enumerate((("f_<u>", 0, 2, ""), ("g", 2, 3, ""), ("h", 5, 2, ""), ("k", 7, 2, ""), ("m", 9, 3, ""), ("n", 12, 2, "Bad")))
    ],
    "structure": [
        (0, "imports", "imports", 0, 2, None, None, "", "", "", False, False),
        (1, "class", "Cart_<u>", 4, 10, _CART, None, "", "", "", False, False),
        (2, "class", "Color", 16, 2, None, None, "", "", "", False, False),
        (3, "function", "outer_<u>", 20, 14, _OUTER, None, _TO, "", _TO, False, False),
        (4, "function", "inner", 22, 2, None, None, "run", "outer_<u>", "outer_<u>,run", False, False),
        (5, "function", "fetch", 36, 2, None, None, "get", "", "get", True, False),
        (6, "init_method", "Cart_<u>.__init__", 8, 4, None, "Cart_<u>", "", "", "", False, False),
        (7, "nested_function", "outer_<u>.inner", 22, 2, None, "outer_<u>", "", "", "", False, False),
    ],
    "long_function": [
        (0, "imports", "imports", 0, 1, None, None, "", "", "", False, False),
        (1, "function", "long_<u>_part0", 3, 36, None, "long_<u>", "", "", "pick", False, True),
        (2, "function", "long_<u>_part1", 36, 29, None, "long_<u>", "", "", "pick", False, True),
        (3, "function", "long_<u>_part2", 62, 3, None, "long_<u>", "", "", "pick", False, True),
        (4, "function", "long_<u>_part3", 64, 1, None, "long_<u>", "", "", "pick", False, True),
    ],
    "broken": [
        (0, "imports", "imports", 0, 1, None, None, "", "", "", False, False),
        (1, "class", "Half_<u>", 2, 4, None, None, "", "", "", False, False),
        (2, "function", "two", 6, 3, None, None, "", "", "", False, False),
        (3, "function", "three", 9, 4, "Third of them. return b", None, "", "", "", False, False),
    ],
} | {k: [(0, "code_block", "code_0", 0, LINES[k], None, None, "", "", "", False, False)] for k in _BLOCK}
_CHUNK = {
    "chunk_id": "INT", "chunk_type": "VARCHAR", "name": "VARCHAR", "line_start": "INT", "line_count": "INT", "docstring": "VARCHAR", "parent": "VARCHAR", "calls": "VARCHAR", "called_by": "VARCHAR", "related": "VARCHAR",
    "is_async": "BOOLEAN", "is_partial": "BOOLEAN",
}


@query(
    "SELECT * REPLACE (left(docstring, CASE WHEN contains(docstring, 'wants to buy') THEN 200 ELSE 300 END) AS docstring) FROM (" + _expect(_CHUNK, CHUNKS) + ")"
)
def case_chunks(spark, d):
    """All kinds of chunks with what they call; the longest docstring is compared on its first 200 characters."""
    files = _files(spark, d)
    c = chunk.related_chunks(files)
    lists = {x: F.array_join(x, ",") for x in ("calls", "called_by", "related")}
    doc = F.when(F.col("docstring").contains("wants to buy"), F.substring("docstring", 1, 200)).otherwise(F.col("docstring"))
    return c.withColumns(lists | {"docstring": doc}).select("file_id", *_CHUNK)
