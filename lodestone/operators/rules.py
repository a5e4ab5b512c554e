"""The rule catalogue as DataFrame expressions over syntax-tree nodes.

Rules that look at one call are one scan: an array of candidate findings is built per call and
exploded. The others are joins on ``file_id`` with an interval or window condition.

``seq`` orders findings as the catalogue runs: by check, then by breadth-first place. ``line``,
``rule`` pairs are kept once, first wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import dims
from lodestone.operators.ast_table import ast_nodes, calls

RAW = ["file_id", "seq", "line", "source", "rule", "message", "suggestion"]
_DYNAMIC = ("Name", "Call", "BinOp", "JoinedStr")

#: What to say of a rule, and what to do about it.
ADVICE = {
    "dangerous_eval_exec": ("runs text as code", "parse literals with ast.literal_eval"),
    "dynamic_import": ("imports a module named at run time", "import by name or check against a list"),
    "sql_injection": ("SQL text is put together from parts", "bind parameters instead"),
    "sql_injection_variable": ("a variable holding put-together SQL reaches execute", "bind parameters instead"),
    "command_injection_danger": ("runs a shell command", "use subprocess.run with a list"),
    "shell_injection": ("subprocess with a shell", "pass shell=False and a list"),
    "weak_hash_md5": ("MD5 has collisions", "use SHA-256 or BLAKE2"),
    "weak_hash_sha1": ("SHA-1 has collisions", "use SHA-256 or BLAKE2"),
    "insecure_pickle": ("unpickling runs code", "use JSON for foreign data"),
    "insecure_yaml": ("yaml.load builds any object", "use yaml.safe_load"),
    "weak_random_crypto": ("random is predictable", "use the secrets module"),
    "path_traversal": ("a path is built from a variable", "resolve and check the path"),
    "xxe_vulnerability": ("XML entities may be resolved", "use defusedxml"),
    "race_condition_toctou": ("checked first, used later", "try and handle the error"),
    "insecure_temp_file": ("a predictable temporary name", "use tempfile.mkstemp"),
    "integer_overflow_risk": ("a computed size is allocated", "bound the size"),
    "format_string_injection": ("the format string is not fixed", "keep the format string constant"),
    "open_redirect": ("redirects to a variable target", "check the target against a list"),
    "timing_attack": ("a secret is compared byte by byte", "use hmac.compare_digest"),
    "resource_exhaustion": ("an endless loop reads", "bound the loop or set a timeout"),
    "insecure_permissions": ("group or others may write", "use mode 0o600"),
    "ssrf_vulnerability": ("requests a variable address", "check the address against a list"),
    "privilege_escalation": ("a role is taken without a check", "validate the role first"),
}


#: What is added where the parts come from a user.
TAINTED = ", with a user's input among them"


def _say(rule: str, k: int) -> Column:
    return F.lit(ADVICE[rule][k])


#: Places within one check: breadth-first place, then position there, as parts of a number below this.
CHECK, PLACE = 1 << 44, 1 << 20


def _finding(check: int, order: Column, line: Column, rule: str, message: Column | None = None) -> Column:
    return F.struct(
        (F.lit(check).cast("long") * F.lit(CHECK) + order).alias("seq"),
        line.cast("int").alias("line"),
        F.lit(rule).alias("rule"),
        (_say(rule, 0) if message is None else message).alias("message"),
        _say(rule, 1).alias("suggestion"),
    )


def _call_rules(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """All checks that need one call only (1-3, 5, 6, 8, 9, 11, 13, 14, 17, 18)."""
    n, low, b, line = F.col("name"), F.lower("name"), F.col("bfs").cast("long"), F.col("lineno")
    args, arg0 = F.col("args"), F.try_element_at("args", F.lit(1))
    dynamic = lambda a: a["kind"].isin(*_DYNAMIC)
    controlled = lambda a: ((a["kind"] == "Name") & ~T.isupper(a["name"])) | a["kind"].isin("BinOp", "JoinedStr", "Call")
    # verdict of each argument in turn: the first that is not "next" decides
    verdict = lambda a: (
        F.when(a["placeholder"], "stop")
        .when(a["built"], F.when(a["tainted"], "sql_injection, tainted").otherwise("sql_injection"))
        .when((a["kind"] != "Name") | ~a["known"], "next")
        .when(a["from_placeholder"], "stop")
        .when(a["from_built"], F.when(a["from_tainted"], "sql_injection_variable, tainted").otherwise("sql_injection_variable"))
        .otherwise("next")
    )
    told = lambda rule: F.concat(_say(rule, 0), F.when(first.endswith("tainted"), TAINTED).otherwise(""))
    first = F.try_element_at(F.filter(F.transform(args, verdict), lambda v: v != "next"), F.lit(1))
    is_execute = low.contains("execute")
    mode = F.try_element_at("args", F.lit(2))["ival"]
    found = F.array_compact(
        F.array(
            F.when(n.isin("eval", "exec"), _finding(1, b, line, "dangerous_eval_exec")),
            F.when((n == "__import__") & ~F.coalesce(arg0["kind"] == "Constant", F.lit(False)), _finding(1, b, line, "dynamic_import")),
            F.when(is_execute & first.isin("sql_injection", "sql_injection, tainted"), _finding(2, b, line, "sql_injection", told("sql_injection"))),
            F.when(is_execute & first.startswith("sql_injection_variable"), _finding(2, b, line, "sql_injection_variable", told("sql_injection_variable"))),
            F.when(n.isin(*dims.SHELL_CALLS), _finding(3, b, line, "command_injection_danger")),
            F.when(n.contains("subprocess") & F.exists("keywords", lambda k: (k["arg"] == "shell") & k["truthy"]), _finding(3, b, line, "shell_injection")),
            F.when(low.contains("md5"), _finding(5, b, line, "weak_hash_md5")).when(low.contains("sha1"), _finding(5, b, line, "weak_hash_sha1")),
            F.when(n.isin(*dims.PICKLE_CALLS), _finding(6, b, line, "insecure_pickle")).when(n.isin(*dims.YAML_CALLS), _finding(6, b, line, "insecure_yaml")),
            F.when(n.isin(*dims.PATH_CALLS) & F.exists(args, controlled), _finding(8, b, line, "path_traversal")),
            F.when(T.contains_any(n, dims.XML_MODULES) & (low.contains("parse") | low.contains("fromstring")), _finding(9, b, line, "xxe_vulnerability")),
            F.when(n.isin(*dims.TEMP_CALLS), _finding(11, b, line, "insecure_temp_file")),
            F.when(F.col("value_kind").isin(*_DYNAMIC), _finding(13, b, line, "format_string_injection")),
            F.when(low.contains("redirect") & F.exists(args, dynamic), _finding(14, b, line, "open_redirect")),
            F.when(n.isin(*dims.CHMOD_CALLS) & (mode.bitwiseAND(F.lit(0o022).cast("long")) != 0), _finding(17, b, line, "insecure_permissions")),
            F.when(T.contains_any(n, dims.HTTP_CALLS) & dynamic(arg0), _finding(18, b, line, "ssrf_vulnerability")),
        )
    )
    return calls(nodes).select("file_id", F.explode(found).alias("f")).select("file_id", "f.*")


def _imports(nodes: DataFrame) -> DataFrame:
    base = F.split_part(F.col("module"), F.lit("."), F.lit(1))
    return (
        nodes.where("kind in ('Import', 'ImportFrom')")
        .select("file_id", "bfs", "lineno", F.posexplode("modules").alias("k", "module"))
        .where(base.isin(*dims.RISKY_MODULES))
        .select(
            "file_id",
            (F.col("bfs").cast("long") * PLACE + F.col("k")).alias("seq"),
            F.col("lineno").cast("int").alias("line"),
            F.concat(F.lit("import_"), base).alias("rule"),
            F.concat(base, F.lit(" is safe to import but not to misuse")).alias("message"),
            F.lit("review each use of it").alias("suggestion"),
        )
    )


def _sql_assignments(nodes: DataFrame) -> DataFrame:
    """Check 2, second stage: SQL put together into a name that a later execute takes."""
    a = nodes.where("kind = 'Assign' and built and not placeholder").select(
        "file_id", F.col("bfs").alias("a_bfs"), F.col("lineno").alias("a_line"), F.posexplode("targets").alias("k", "var")
    )
    used = F.flatten(F.transform("args", lambda x: F.when(x["kind"] == "Name", F.array(x["name"])).otherwise(F.coalesce(x["names"], F.array()))))
    e = calls(nodes).where(F.lower("name").contains("execute")).select("file_id", F.col("lineno").alias("e_line"), F.explode(F.array_distinct(used)).alias("var"))
    hit = a.join(e.groupBy("file_id", "var").agg(F.max("e_line").alias("e_line")), ["file_id", "var"]).where("e_line > a_line")
    # behind all calls of the check
    order = F.lit(CHECK // 2) + F.col("a_bfs").cast("long") * (PLACE // 2) + F.col("k")
    return hit.select("file_id", F.explode(F.array(_finding(2, order, F.col("a_line"), "sql_injection_variable"))).alias("f")).select("file_id", "f.*")


def secret_lines(files: DataFrame) -> DataFrame:
    """Check 4: literal secrets, line by line; the first pattern that fits decides."""
    rows = files.select("file_id", F.posexplode(T.lines(F.col("code"))).alias("i", "text"))
    usable = ~T.contains_any(F.lower("text"), dims.SECRET_SKIP_LOWER) & ~T.contains_any(F.col("text"), dims.SECRET_SKIP)
    key = value = None
    for name, pattern in dims.SECRET_PATTERNS:
        p = "(?i)" + pattern
        hit = F.col("text").rlike(p)
        key = F.when(hit, name) if key is None else key.when(hit, name)
        v = F.regexp_extract("text", p, 1)
        value = F.when(hit, v) if value is None else value.when(hit, v)
    # a cheap test first: most lines hold none of the names
    found = rows.where(F.lower("text").rlike("password|api[_-]?key|secret|token")).where(usable)
    found = found.select("file_id", (F.col("i") + 1).alias("line"), key.alias("key"), value.alias("value")).where("key is not null")
    found = found.where(~T.contains_any(F.lower("value"), dims.SECRET_PLACEHOLDERS))
    return found.select(
        "file_id",
        (F.lit(4 * CHECK) + F.col("line")).alias("seq"),
        F.col("line").cast("int").alias("line"),
        F.concat(F.lit("hardcoded_"), "key").alias("rule"),
        F.concat(F.lit("literal "), "key", F.lit(" '"), F.substring("value", 1, 20), F.lit("...'")).alias("message"),
        F.concat(F.lit("read the "), "key", F.lit(" from the environment or a secret store")).alias("suggestion"),
    )


def _with_lines(rows: DataFrame, files: DataFrame) -> DataFrame:
    return rows.join(files.select("file_id", T.lines(F.col("code")).alias("_lines")), "file_id")


def _weak_random(nodes: DataFrame, files: DataFrame) -> DataFrame:
    c = calls(nodes).where("name like 'random.%'").select("file_id", "bfs", "lineno")
    near = F.lower(F.array_join(F.slice("_lines", F.greatest(F.lit(1), F.col("lineno") - 3), F.least(F.lit(7), F.col("lineno") + 3)), "\n"))
    hit = _with_lines(c, files).where(T.contains_any(near, dims.CRYPTO_CONTEXT))
    return hit.select("file_id", F.explode(F.array(_finding(7, F.col("bfs").cast("long"), F.col("lineno"), "weak_random_crypto"))).alias("f")).select("file_id", "f.*")


def _toctou(nodes: DataFrame) -> DataFrame:
    """Check 10: a test for a file, then one of the next four calls uses a file close by."""
    w = W.partitionBy("file_id").orderBy("bfs")
    c = calls(nodes).select("file_id", "bfs", "lineno", "name")
    use = F.lit(False)
    for k in (1, 2, 3, 4):
        name, line = F.lead("name", k).over(w), F.lead("lineno", k).over(w)
        use = use | F.coalesce(name.isin(*dims.USE_CALLS) & (F.abs(line - F.col("lineno")) <= 5), F.lit(False))
    hit = c.withColumn("use", use).where(F.col("name").isin(*dims.CHECK_CALLS) & F.col("use"))
    return hit.select("file_id", F.explode(F.array(_finding(10, F.col("bfs").cast("long"), F.col("lineno"), "race_condition_toctou"))).alias("f")).select("file_id", "f.*")


def _overflow(nodes: DataFrame) -> DataFrame:
    """Check 12: a product or power whose first enclosing call allocates."""
    p = nodes.where("kind = 'BinOp' and ops[0] in ('Mult', 'Pow')").select("file_id", F.col("bfs").alias("p"), F.col("enter").alias("at"), "lineno")
    c = calls(nodes).select("file_id", "bfs", "enter", "exit", "name")
    first = p.join(c, (p.file_id == c.file_id) & p["at"].between(c["enter"], c["exit"])).groupBy(p.file_id, "p", "lineno").agg(F.min_by("name", "bfs").alias("call"))
    hit = first.where(F.col("call").isin(*dims.BUFFER_CALLS))
    return hit.select("file_id", F.explode(F.array(_finding(12, F.col("p").cast("long"), F.col("lineno"), "integer_overflow_risk"))).alias("f")).select("file_id", "f.*")


def _timing(nodes: DataFrame, files: DataFrame) -> DataFrame:
    secret = lambda x: T.contains_any(x, dims.SECRET_NAMES)
    c = nodes.where("kind = 'Compare' and not safe").where(F.arrays_overlap("ops", F.array(F.lit("Eq"), F.lit("NotEq")))).where(F.exists("names", secret))
    text = F.try_element_at("_lines", F.col("lineno"))
    hit = _with_lines(c.select("file_id", "bfs", "lineno"), files).where(~(F.coalesce(text.contains("compare_digest") | F.lower(text).contains("hmac"), F.lit(False))))
    return hit.select("file_id", F.explode(F.array(_finding(15, F.col("bfs").cast("long"), F.col("lineno"), "timing_attack"))).alias("f")).select("file_id", "f.*")


def _exhaustion(nodes: DataFrame) -> DataFrame:
    """Check 16: ``while True`` around a reading call."""
    w = nodes.where("kind = 'While' and const_true").select("file_id", F.col("bfs").alias("w"), F.col("enter").alias("a"), F.col("exit").alias("z"), "lineno")
    c = calls(nodes).where(T.contains_any(F.col("name"), dims.LOOP_IO)).select("file_id", "enter")
    hit = w.join(c, (w.file_id == c.file_id) & c["enter"].between(w["a"], w["z"]), "left_semi")
    return hit.select("file_id", F.explode(F.array(_finding(16, F.col("w").cast("long"), F.col("lineno"), "resource_exhaustion"))).alias("f")).select("file_id", "f.*")


def named_functions(nodes: DataFrame, sync_only: bool = True) -> DataFrame:
    """Functions by bare name: the last in breadth-first order stands for the name."""
    kinds = "kind = 'FunctionDef'" if sync_only else "kind in ('FunctionDef', 'AsyncFunctionDef')"
    keep = F.struct("bfs", "enter", "exit", "lineno", "end_lineno", "params", "decorators", "hints", "first_line", "block_depth", "is_async")
    f = nodes.where(kinds).groupBy("file_id", "name").agg(F.min("bfs").alias("first_bfs"), F.max_by(keep, "bfs").alias("v"))
    return f.select("file_id", "name", "first_bfs", "v.*")


def _privilege(nodes: DataFrame) -> DataFrame:
    """Check 19: a parameter named for a privilege that no condition in the function mentions."""
    p = named_functions(nodes).select("file_id", "name", "first_bfs", "enter", "exit", "lineno", F.posexplode("params").alias("k", "param"))
    p = p.where(T.contains_any(F.lower("param"), dims.PRIVILEGE_WORDS))
    g = nodes.where("kind in ('If', 'Assert', 'Raise')").select("file_id", F.col("enter").alias("g"), F.explode("names").alias("param"))
    hit = p.join(g, (p.file_id == g.file_id) & (p.param == g.param) & g["g"].between(p["enter"], p["exit"]), "left_anti")
    order = F.col("first_bfs").cast("long") * PLACE + F.col("k")
    return hit.select("file_id", F.explode(F.array(_finding(19, order, F.col("lineno"), "privilege_escalation"))).alias("f")).select("file_id", "f.*")


def raw_findings(files: DataFrame, nodes: DataFrame | None = None, parity: bool = True) -> DataFrame:
    """``(file_id, seq, line, source, rule, message, suggestion)`` of all files that parse.

    ``parity`` leaves out check 16, which the catalogue never reaches.
    """
    nodes = ast_nodes(files) if nodes is None else nodes
    valid = nodes.where("kind = 'Module'").select("file_id")
    parsed = files.join(valid, "file_id", "left_semi")
    parts = [
        _imports(nodes),
        _call_rules(nodes, parsed),
        _sql_assignments(nodes),
        secret_lines(parsed),
        _weak_random(nodes, parsed),
        _toctou(nodes),
        _overflow(nodes),
        _timing(nodes, parsed),
        _privilege(nodes),
    ]
    if not parity:
        parts.append(_exhaustion(nodes))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = out.groupBy("file_id", "line", "rule").agg(F.min_by(F.struct("seq", "message", "suggestion"), "seq").alias("f"))
    return first.select("file_id", "f.seq", "line", F.lit("security").alias("source"), "rule", "f.message", "f.suggestion")


def with_snippets(findings: DataFrame, files: DataFrame, context: int = 2) -> DataFrame:
    """Findings with the code around their line; files without findings are not read further."""
    return _with_lines(findings, files).withColumn("code_snippet", T.snippet(F.col("_lines"), F.col("line"), context)).drop("_lines")
