"""Call graph, symbols and chunks against walks of the tree and of the lines."""

import ast

from lodestone.operators import chunk, graph
from lodestone.operators.ast_table import ast_nodes

CODE = '''import os
from abc import ABC


@dataclass
class Shape(ABC):
    """A shape."""

    def __init__(self, n: int):
        self.n = n

    def area(self):
        return compute(self.n)


async def run(a: str, *rest: int) -> bool:
    """Run it.

    Twice.
    """
    def step(k):
        return other(k)
    return step(a)
'''


def _files(spark, *codes):
    return spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")


def test_edges_and_symbols(spark):
    nodes = ast_nodes(_files(spark, CODE)).cache()
    want = set()
    for f in ast.walk(ast.parse(CODE)):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for c in ast.walk(f):
                if isinstance(c, ast.Call):
                    want.add((f.name, c.func.id if isinstance(c.func, ast.Name) else c.func.attr))
    assert {(r["caller"], r["callee"]) for r in graph.call_edges(nodes).collect()} == want
    assert {(r["outer"], r["inner"]) for r in graph.nested_functions(nodes).collect()} == {("run", "step")}
    s = {r["name"]: r for r in graph.symbols(nodes).collect()}
    assert s["Shape"]["special_type"] == "ABC" and s["Shape"]["has_init"] and s["Shape"]["first_line"] == 5
    assert s["run"]["is_async"] and [h["name"] for h in s["run"]["hints"]] == ["return", "a", "rest"]
    stats = graph.code_stats(_files(spark, CODE), nodes).first()
    assert stats["methods"] == ["Shape.__init__", "Shape.area"]


def test_fallback(spark):
    got = {(r["kind"], r["name"]) for r in graph.fallback_symbols(_files(spark, "import a\ndef f(:\nclass B:\n")).collect()}
    assert got == {("import", "a"), ("function", "f"), ("class", "B")}


def test_chunks_of_parsed_code(spark):
    c = chunk.enriched(chunk.code_chunks(_files(spark, CODE)), graph.call_edges(ast_nodes(_files(spark, CODE)))).collect()
    by = {(r["chunk_type"], r["name"]): r for r in c}
    assert set(by) == {("imports", "imports"), ("class", "Shape"), ("function", "run"), ("function", "step"), ("init_method", "Shape.__init__"), ("nested_function", "run.step")}
    assert by["class", "Shape"]["line_start"] == 4 and by["function", "run"]["docstring"] == "Run it.  Twice."
    assert by["function", "run"]["calls"] == ["other", "step"] and by["function", "step"]["called_by"] == ["run"]
    assert by["nested_function", "run.step"]["line_count"] == 2


def test_chunks_without_parse_and_plain(spark):
    bad = "import os\n@d\ndef f(x):\n    return (\n\nclass C:\n    def m(self):\n        pass\n"
    got = [(b["chunk_type"], b["name"]) for b in chunk.chunks_of(bad)]
    assert ("function", "f") in got and ("class", "C") in got and ("imports", "imports") in got
    assert [x["chunk_type"] for x in chunk.chunks_of("x = 1\ny = 2")] == ["code_block"]
    assert chunk.code_chunks(_files(spark, None, "")).count() == 1


def test_packing_covers_all_lines():
    lines = [f"line {i} " + "x" * (i % 60) for i in range(400)]
    seen = set()
    for start, part in chunk.packed(lines):
        assert part == lines[start : start + len(part)]
        seen.update(range(start, start + len(part)))
    assert seen == set(range(400))
    for start, part in chunk.plain_chunks(lines):
        assert part == lines[start : start + len(part)] and (len("\n".join(part)) <= 2500 or len(part) == 1)
    assert [len(p) for _, p in chunk.packed(["y" * 39] * 100)] == [62, 41, 3, 1]


ODD = ["", None, "def f(:\n", "x = 1\n", "class A:\n    def a(self):\n        return g(h(1))(2)\n\n    @wrap(deep())\n    async def b(self, x=make()):\n        def a():\n            b().c()\n        return lambda: k(x)\n"]


def _joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join" in plan


def test_edges_of_files_need_no_join(spark):
    files = _files(spark, CODE, *ODD, CODE)
    got = graph.file_edges(files)
    assert not _joins(got)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in graph.call_edges(ast_nodes(files)).collect()}
    assert {"deep", "make", "k", "c", "g", "h"} <= {r[2] for r in rows}


def test_registered_edges_need_no_join(spark):
    import __spark_entry__

    for name in ("case_edges", "generated_call_edges"):
        assert not _joins(__spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR)), name


def test_related_chunks_equal_joined_ones_without_a_join(spark):
    import __spark_entry__
    from pyspark.sql import functions as F

    files = _files(spark, CODE, *ODD).withColumn("path", F.lit("a.py"))
    want = chunk.enriched(chunk.code_chunks(files), graph.call_edges(ast_nodes(files)))
    got = chunk.related_chunks(files)
    assert not _joins(got) and got.columns == [*want.columns, "path"]
    assert sorted(map(str, got.drop("path").collect())) == sorted(map(str, want.collect()))
    for name in ("case_chunks", "structure_chunks"):
        assert not _joins(__spark_entry__.queries()[name](spark, __spark_entry__.SMOKE_DIR)), name
