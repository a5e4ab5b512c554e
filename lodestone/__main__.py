"""``python -m lodestone PATH``: analyse the Python files under PATH and print the report."""

from __future__ import annotations

import argparse
import sys

from lodestone.operators.report import report_lines, write_report
from lodestone.plans.analyze import Index, analyze, answer, ask, build_index
from lodestone.plans.service import talk
from lodestone.session import get_spark
from lodestone.sources.files import read_sources


def main(argv: list[str] | None = None) -> int:
    """1 if there is a finding, 2 if there is no file, else 0."""
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("path")
    p.add_argument("--report", help="folder to write the report to")
    p.add_argument("--index", help="folder of a retrieval index, built if missing")
    p.add_argument("--ask", action="append", default=[], help="a question about the code (repeatable)")
    p.add_argument("--talk", action="store_true", help="then read questions until 'exit'")
    a = p.parse_args(argv)
    spark = get_spark("lodestone", "local[*]")
    files = read_sources(spark, a.path)
    if not files.limit(1).count():
        print("no Python files", file=sys.stderr)
        return 2
    result = analyze(files)
    lines = report_lines(files, result.metrics, result.findings)
    if a.report:
        write_report(lines, a.report)
    for r in lines.orderBy("file_id", "part", "pos").toLocalIterator():
        print(r["text"])
    if a.ask or a.talk:
        index = build_index(files, result.nodes)
        if a.index:
            index.write(a.index)
            index = Index.read(spark, a.index)
    if a.ask:
        q = spark.createDataFrame(list(enumerate(a.ask)), "question_id long, text string")
        for r in ask(q, index).orderBy("question_id", "rank").toLocalIterator():
            print(f"{r['question_id']}.{r['rank']} {r['name']} (line {r['line_start'] + 1})")
        for r in answer(q, index).orderBy("question_id").toLocalIterator():
            print(r["answer"] or r["prompt"])
    if a.talk:
        talk(spark, index, lambda: next(iter(sys.stdin.readline, ""), None), print)
    return int(bool(result.findings.limit(1).count()))


if __name__ == "__main__":
    sys.exit(main())
