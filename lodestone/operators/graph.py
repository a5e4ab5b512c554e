"""Code structure: symbols, call edges, nesting, and what to fall back on without a parse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import dims
from lodestone.operators.ast_table import file_structure
from lodestone.operators.rules import named_functions


def call_edges(nodes: DataFrame) -> DataFrame:
    """``(file_id, caller, callee)``: every call anywhere within a function, by last name, distinct."""
    f = nodes.where("kind in ('FunctionDef', 'AsyncFunctionDef')").select("file_id", F.col("name").alias("caller"), "enter", "exit")
    c = nodes.where("kind = 'Call' and tail is not null").select("file_id", F.col("tail").alias("callee"), F.col("enter").alias("at"))
    return f.join(c, (f.file_id == c.file_id) & (c["at"] > f["enter"]) & (c["at"] <= f["exit"])).select(f.file_id, "caller", "callee").distinct()


def file_edges(files: DataFrame) -> DataFrame:
    """:func:`call_edges` of files, parsed for it: no nodes are made, and only the distinct edges are shuffled."""
    return file_structure(files).select("file_id", F.inline("edges")).distinct()


def nested_functions(nodes: DataFrame) -> DataFrame:
    """``(file_id, outer, inner)``: every function anywhere within another."""
    f = nodes.where("kind in ('FunctionDef', 'AsyncFunctionDef')").select("file_id", "name", "enter", "exit")
    o = f.select("file_id", F.col("name").alias("outer"), F.col("enter").alias("a"), F.col("exit").alias("z"))
    i = f.select("file_id", F.col("name").alias("inner"), F.col("enter").alias("at"))
    return o.join(i, (o.file_id == i.file_id) & (i["at"] > o["a"]) & (i["at"] <= o["z"])).select(o.file_id, "outer", "inner")


def symbols(nodes: DataFrame) -> DataFrame:
    """Functions and classes by bare name with line range, decorators, hints and special kind.

    The last definition in breadth-first order stands for the name, so a method hides a function.
    """
    f = named_functions(nodes, sync_only=False).select(
        "file_id", "name", F.lit("function").alias("kind"), "first_line", F.col("lineno").alias("line"), "end_lineno", "decorators", "hints", "is_async",
        F.lit(None).cast("string").alias("special_type"), F.lit(False).alias("has_init"),
    )
    special = F.array(*[F.lit(x) for x in dims.SPECIAL_CLASSES])
    last = lambda c: F.try_element_at(F.filter(c, lambda x: F.array_contains(special, x)), F.lit(-1))
    keep = F.struct("bfs", "first_line", "lineno", "end_lineno", "decorators", F.coalesce(last(F.col("bases")), last(F.col("decorators"))).alias("special_type"))
    c = nodes.where("kind = 'ClassDef'").groupBy("file_id", "name").agg(F.max_by(keep, "bfs").alias("v")).select("file_id", "name", "v.*")
    init = nodes.where("kind = 'FunctionDef' and name = '__init__' and field = 'body'").select("file_id", F.col("parent").alias("bfs")).distinct()
    owners = nodes.where("kind = 'ClassDef'").join(init, ["file_id", "bfs"], "left_semi").select("file_id", "name").distinct().withColumn("has_init", F.lit(True))
    c = c.join(owners, ["file_id", "name"], "left").select(
        "file_id", "name", F.lit("class").alias("kind"), "first_line", F.col("lineno").alias("line"), "end_lineno", "decorators",
        F.array().cast("array<struct<name:string,hint:string>>").alias("hints"), F.lit(False).alias("is_async"), "special_type", F.coalesce("has_init", F.lit(False)).alias("has_init"),
    )
    return f.unionByName(c)


def fallback_symbols(files: DataFrame) -> DataFrame:
    """Names by pattern, for files that do not parse: ``(file_id, kind, name)`` distinct."""
    parts = []
    for kind, pattern in (("function", r"def\s+(\w+)"), ("class", r"class\s+(\w+)"), ("import", r"import\s+(\w+)")):
        parts.append(files.select("file_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(pattern), 1))).alias("name")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def code_stats(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Counts and sorted name lists of each parsed file, with methods as ``Class.method``."""
    s = symbols(nodes)
    lists = s.groupBy("file_id").agg(
        F.count_if(F.col("kind") == "function").alias("n_functions"),
        F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "function", F.col("name")))).alias("functions"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "class", F.col("name")))).alias("classes"),
    )
    c = nodes.where("kind = 'ClassDef'").select("file_id", F.col("bfs").alias("parent"), F.col("name").alias("cls"))
    m = nodes.where("kind in ('FunctionDef', 'AsyncFunctionDef') and field = 'body'").join(c, ["file_id", "parent"])
    methods = m.groupBy("file_id").agg(F.sort_array(F.collect_set(F.concat_ws(".", "cls", "name"))).alias("methods"))
    lines = files.select("file_id", F.size(F.split("code", "\n", -1)).alias("n_lines"), F.filter(F.split("code", "\n", -1), lambda x: x.contains("import")).alias("import_lines"))
    out = nodes.where("kind = 'Module'").select("file_id").join(lists, "file_id", "left").join(methods, "file_id", "left").join(lines, "file_id")
    none = F.array().cast("array<string>")
    return out.select(
        "file_id",
        "n_lines",
        F.coalesce("n_functions", F.lit(0)).alias("n_functions"),
        F.coalesce("n_classes", F.lit(0)).alias("n_classes"),
        F.coalesce("functions", none).alias("functions"),
        F.coalesce("classes", none).alias("classes"),
        F.coalesce("methods", none).alias("methods"),
        "import_lines",
    )
