"""Column expressions over text: tokens, lines, snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(c: Column) -> Column:
    """Lower-case words split at Unicode white space, without empty ones."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")


def lines(c: Column) -> Column:
    """Lines split at ``\\n``; a trailing newline gives a last empty line."""
    return F.split(c, "\n", -1)


def snippet(code_lines: Column, line: Column, context: int = 2) -> Column:
    """Lines around ``line`` (from 1), marked ``>>> `` at the line itself, four blanks elsewhere.

    Taken from the line array in place: no explode, no range join.
    """
    n = F.size(code_lines)
    first = F.greatest(F.lit(1), line - context)
    last = F.least(n, line + context)
    numbered = F.transform(
        F.sequence(first, F.greatest(first, last)),
        lambda i: F.concat(F.when(i == line, ">>> ").otherwise("    "), F.element_at(code_lines, i.cast("int"))),
    )
    return F.when((line >= 1) & (first <= last), F.array_join(numbered, "\n")).otherwise("")


def isupper(c: Column) -> Column:
    """Python's ``str.isupper`` for letters with case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def contains_any(c: Column, needles) -> Column:
    """Whether ``c`` contains one of the fixed strings."""
    out = F.lit(False)
    for x in needles:
        out = out | c.contains(x)
    return out
