"""Rules: a positive and a negative line for each check, and the quirks that order decides."""

import ast

from lodestone.operators import merge, metrics, rules
from lodestone.operators.ast_table import ast_nodes, parse_status

CASES = {
    "dangerous_eval_exec": ("eval(x)", "ast.literal_eval(x)"),
    "dynamic_import": ("__import__(x)", "__import__('json')"),
    "sql_injection": ("cur.execute('SELECT ' + x)", "cur.execute('SELECT * FROM t WHERE a = %s', (x,))"),
    "command_injection_danger": ("os.system(x)", "shutil.copy(x, y)"),
    "shell_injection": ("subprocess.run(x, shell=True)", "subprocess.run(x, shell=False)"),
    "hardcoded_password": ("password = 'hunter2222'", "password = 'your_password'"),
    "weak_hash_md5": ("hashlib.md5(b)", "hashlib.sha256(b)"),
    "weak_hash_sha1": ("hashlib.sha1(b)", "hashlib.blake2b(b)"),
    "insecure_pickle": ("pickle.loads(b)", "json.loads(b)"),
    "insecure_yaml": ("yaml.load(b)", "yaml.safe_load(b)"),
    "weak_random_crypto": ("token = random.random()", "colour = random.random()"),
    "path_traversal": ("open(name)", "open(NAME)"),
    "xxe_vulnerability": ("xml.sax.parseString(b)", "ET.parse(b)"),
    "race_condition_toctou": ("os.path.exists(P)\nopen(P)", "os.path.exists(P)\n\n\n\n\n\n\nopen(P)"),
    "insecure_temp_file": ("tempfile.mktemp()", "tempfile.mkstemp()"),
    "integer_overflow_risk": ("bytearray(a * b)", "print(a * b)"),
    "format_string_injection": ("s.format(x)", "'{}'.format(x)"),
    "open_redirect": ("redirect(url)", "redirect('/home')"),
    "timing_attack": ("token == given", "token == None"),
    "insecure_permissions": ("os.chmod(P, 0o777)", "os.chmod(P, 0o600)"),
    "ssrf_vulnerability": ("requests.get(url)", "requests.get('https://a.example')"),
    "privilege_escalation": ("def f(role):\n    return role", "def f(role):\n    if role in ALLOWED:\n        return role"),
    "import_pickle": ("import pickle", "import json"),
}


def _frame(spark, codes):
    return spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")


def test_each_rule(spark):
    codes = [c for pair in CASES.values() for c in pair]
    files = _frame(spark, codes)
    got = {(r["file_id"], r["rule"]) for r in rules.raw_findings(files).collect()}
    for k, rule in enumerate(CASES):
        assert (2 * k, rule) in got, rule
        assert (2 * k + 1, rule) not in got, rule


def test_sql_through_variables(spark):
    codes = [
        "q = 'SELECT ' + x\ncur.execute(q)",
        "q = 'SELECT %s'\ncur.execute(q)",
        "x = x + y\ncur.execute(x)",
        "w = f\"WHERE a = '{v}'\"\ncur.execute('SELECT 1 ' + w)",
        "cur.execute(unknown)",
    ]
    rows = rules.raw_findings(_frame(spark, codes)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["file_id"], set()).add((r["line"], r["rule"]))
    assert got[0] == {(1, "sql_injection_variable"), (2, "sql_injection")}
    assert 1 not in got and 4 not in got
    assert 2 not in got
    assert got[3] >= {(1, "sql_injection_variable"), (2, "sql_injection")}


def test_unreachable_rule_is_optional(spark):
    files = _frame(spark, ["while True:\n    s.recv(1)"])
    assert not rules.raw_findings(files).count()
    assert [r["rule"] for r in rules.raw_findings(files, parity=False).collect()] == ["resource_exhaustion"]


def test_no_code_and_bad_code(spark):
    files = _frame(spark, [None, "", "def f(:\n", "x = 1"])
    status = {r["file_id"]: r for r in parse_status(files).collect()}
    assert [status[k]["valid"] for k in range(4)] == [False, True, False, True]
    assert status[2]["err_line"] == 1
    assert not rules.raw_findings(files).count()
    assert not rules.raw_findings(files.limit(0)).count()


def test_merge_keeps_first_and_lists_sources(spark):
    raw = spark.createDataFrame(
        [
            (1, 1, 5, "a", "weak_hash_md5", "", None),
            (1, 2, 5, "b", "B324", "from b", "fix"),
            (1, 3, 5, "a", "weak_hash_sha1", "later", "other"),
            (1, 4, 2, "b", "unknown_rule", "m", "s"),
            (1, 5, None, "b", "sql_injection", "m", "s"),
        ],
        "file_id long, seq long, line int, source string, rule string, message string, suggestion string",
    )
    out = {(r["line"], r["rule"]): r for r in merge.ranked(merge.merge_findings(raw)).collect()}
    first = out[5, "weak_crypto"]
    assert (first["message"], first["suggestion"], first["sources"]) == ("from b", "fix", ["a", "b"])
    assert out[2, "unknown_rule"]["severity"] == "MEDIUM" and out[0, "sql_injection"]["rank"] == 1
    again = merge.merge_findings(merge.merge_findings(raw).withColumn("source", merge.F.explode("sources")))
    assert again.count() == 3
    c = merge.counts(merge.merge_findings(raw), "file_id").first()
    assert (c["total_issues"], c["high_count"], c["medium_count"]) == (3, 1, 2)


CODE = '''import os
@deco
class A(Base):
    def m(self, x):
        if x and x or y:
            for i in x:
                pass
        return open(x)

def outer(a: int) -> str:
    def inner():
        return helper(a)
    try:
        with open(a) as f:
            return inner()
    except ValueError:
        return None

if __name__ == "__main__":
    outer(1)
'''


def test_metrics_against_ast(spark):
    files = _frame(spark, [CODE])
    nodes = ast_nodes(files).cache()
    got = {r["name"]: r["complexity"] for r in metrics.function_complexity(nodes).collect()}
    want = {}
    for f in [n for n in ast.walk(ast.parse(CODE)) if isinstance(n, ast.FunctionDef)]:
        want[f.name] = 1 + sum(
            (isinstance(c, (ast.If, ast.While, ast.For, ast.ExceptHandler))) + (len(c.values) - 1 if isinstance(c, ast.BoolOp) else 0) for c in ast.walk(f)
        )
    assert got == want
    m = metrics.file_metrics(files, nodes).first()
    assert (m["function_count"], m["class_count"], m["import_count"], m["lines_of_code"], m["max_complexity"]) == (3, 1, 1, CODE.count("\n") + 1, max(want.values()))
    assert metrics.class_info(nodes).first()["methods"] == 1
    flags = metrics.file_flags(nodes).first()
    assert flags["has_main_guard"] and not flags["has_top_level_executable"]
    assert {r["name"] for r in metrics.within(nodes, "With").collect()} == {"open"}
    assert {r["name"] for r in metrics.within(nodes, "Try").collect()} == {"open", "inner"}
    lines = {(r["name"], r["how"]): r["lines"] for r in metrics.variable_lines(ast_nodes(files, names=True)).collect()}
    assert lines["x", "defined"] == [4] and 8 in lines["x", "used"]


def test_snippet_edges(spark):
    f = spark.createDataFrame([(0, 1), (0, 3), (0, 0), (0, 99)], "file_id long, line int")
    files = _frame(spark, ["a\nb\nc"])
    got = {r["line"]: r["code_snippet"] for r in rules.with_snippets(f, files).collect()}
    assert got == {1: ">>> a\n    b\n    c", 3: "    a\n    b\n>>> c", 0: "", 99: ""}
