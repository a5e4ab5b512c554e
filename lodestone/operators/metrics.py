"""Code metrics and function and class facts over syntax-tree nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.rules import named_functions


def function_complexity(nodes: DataFrame) -> DataFrame:
    """Cyclomatic complexity of each function name: 1 + branches + extra operands, nested ones included.

    An interval join within a file: hash-partitioned on ``file_id``, the interval is its condition.
    """
    f = named_functions(nodes)
    b = nodes.where("kind in ('If', 'While', 'For', 'ExceptHandler', 'BoolOp')").select(
        "file_id", F.col("enter").alias("at"), F.when(F.col("kind") == "BoolOp", F.col("n_values") - 1).otherwise(1).alias("weight")
    )
    g = f.select("file_id", "name", "enter", "exit")
    inside = g.join(b, (g.file_id == b.file_id) & b["at"].between(g["enter"], g["exit"])).groupBy(g.file_id, "name").agg(F.sum("weight").alias("w"))
    return f.join(inside, ["file_id", "name"], "left").select("file_id", "name", (F.lit(1) + F.coalesce("w", F.lit(0))).cast("int").alias("complexity"))


def imported_packages(nodes: DataFrame) -> DataFrame:
    """Distinct top packages of each file; relative imports without a module are passed over."""
    return (
        nodes.where("kind in ('Import', 'ImportFrom')")
        .select("file_id", F.explode("modules").alias("m"))
        .select("file_id", F.split_part(F.col("m"), F.lit("."), F.lit(1)).alias("package"))
        .distinct()
    )


def file_metrics(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Functions, classes, packages (distinct), lines, and the largest complexity of each parsed file."""
    defs = nodes.where("kind in ('FunctionDef', 'ClassDef', 'Module')").groupBy("file_id").agg(
        F.count_distinct(F.when(F.col("kind") == "FunctionDef", F.col("name"))).alias("function_count"),
        F.count_distinct(F.when(F.col("kind") == "ClassDef", F.col("name"))).alias("class_count"),
    )
    packages = imported_packages(nodes).groupBy("file_id").agg(F.count("*").alias("import_count"))
    top = function_complexity(nodes).groupBy("file_id").agg(F.max("complexity").alias("max_complexity"))
    size = files.select("file_id", F.size(T.lines(F.col("code"))).alias("lines_of_code"))
    return (
        defs.join(packages, "file_id", "left")
        .join(top, "file_id", "left")
        .join(size, "file_id")
        .select(
            "file_id",
            "function_count",
            "class_count",
            F.coalesce("import_count", F.lit(0)).alias("import_count"),
            "lines_of_code",
            F.coalesce("max_complexity", F.lit(0)).alias("max_complexity"),
        )
    )


def function_info(nodes: DataFrame) -> DataFrame:
    """Name, line, length, number of parameters, complexity and block depth of each function name."""
    f = named_functions(nodes).join(function_complexity(nodes), ["file_id", "name"])
    return f.select(
        "file_id",
        "name",
        F.col("lineno").alias("line"),
        (F.coalesce("end_lineno", "lineno") - F.col("lineno") + 1).alias("length"),
        F.size("params").alias("params"),
        "complexity",
        F.col("block_depth").alias("nesting_depth"),
    )


def class_info(nodes: DataFrame) -> DataFrame:
    """Name, line and number of direct methods of each class name (the last stands for the name)."""
    c = nodes.where("kind = 'ClassDef'").groupBy("file_id", "name").agg(F.max_by(F.struct("bfs", "lineno"), "bfs").alias("v")).select("file_id", "name", "v.*")
    m = nodes.where("kind = 'FunctionDef' and field = 'body'").groupBy("file_id", F.col("parent").alias("bfs")).agg(F.count("*").alias("methods"))
    return c.join(m, ["file_id", "bfs"], "left").select("file_id", "name", F.col("lineno").alias("line"), F.coalesce("methods", F.lit(0)).alias("methods"))


def file_flags(nodes: DataFrame) -> DataFrame:
    """Whether a file has a main guard, and whether it runs statements at its top level."""
    root = nodes.where("kind = 'Module'").select("file_id", F.col("bfs").alias("root"))
    top = (F.col("parent") == 0) & (F.col("field") == "body") & ((F.col("kind") == "Assign") | ((F.col("kind") == "Expr") & ~F.coalesce("safe", F.lit(False))))
    flags = nodes.groupBy("file_id").agg(
        F.bool_or((F.col("kind") == "If") & F.coalesce("main_guard", F.lit(False))).alias("has_main_guard"), F.bool_or(top).alias("has_top_level_executable")
    )
    return root.join(flags, "file_id").select("file_id", "has_main_guard", "has_top_level_executable")


def variable_lines(nodes_with_names: DataFrame) -> DataFrame:
    """Lines where each name is defined (assignments, parameters of functions) and used.

    Needs nodes made with ``names=True``.
    """
    n = nodes_with_names
    by_assign = n.where("kind in ('Assign', 'AnnAssign')").select("file_id", F.explode("names").alias("name"), "lineno", F.lit("defined").alias("how"))
    by_param = n.where("kind = 'FunctionDef'").select("file_id", F.explode("params").alias("name"), "lineno", F.lit("defined").alias("how"))
    used = n.where("kind = 'Name' and value_kind = 'Load'").select("file_id", "name", "lineno", F.lit("used").alias("how"))
    return by_assign.unionByName(by_param).unionByName(used).groupBy("file_id", "name", "how").agg(F.sort_array(F.collect_set("lineno")).alias("lines"))


def within(nodes: DataFrame, container: str, field: str | None = None) -> DataFrame:
    """Calls that lie in a ``With`` item or a ``Try`` body: ``(file_id, bfs, name, lineno)``.

    ``container`` is ``With`` or ``Try``; for ``Try`` only statements of the body count.
    """
    c = nodes.where("kind = 'Call'").select("file_id", "bfs", "name", "lineno", F.col("enter").alias("at"), "parent")
    if container == "With":
        items = nodes.where("kind = 'withitem'").select("file_id", F.col("bfs").alias("parent"))
        return c.join(items, ["file_id", "parent"], "left_semi").select("file_id", "bfs", "name", "lineno")
    t = nodes.where("kind = 'Try'").select("file_id", F.col("bfs").alias("parent"))
    body = nodes.where("field = 'body'").join(t, ["file_id", "parent"], "left_semi").select("file_id", "enter", "exit")
    return c.join(body, (c.file_id == body.file_id) & c["at"].between(body["enter"], body["exit"]), "left_semi").select("file_id", "bfs", "name", "lineno")
