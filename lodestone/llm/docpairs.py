"""Problem 1: functions paired with their documentation.

Signatures are found with regular expressions outside of strings and comments, bodies are delimited
by an indentation stack (or by ``end`` keywords where a signature has no colon), and documentation is
the literal that opens the body, or the comment lines at distance one above the ``def`` or its
decorators.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOUND = (
    "src_table string, row_id long, def_line int, name string, kind string, documentation string, "
    "start_line int, end_line int, source string, digest long"
)

#: What can hide or start a definition: a string, a comment, the word def.
_TOKEN = re.compile(
    r'"""(?:[^\\"]|\\.|"(?!""))*(?:"""|\Z)'
    r"|'''(?:[^\\']|\\.|'(?!''))*(?:'''|\Z)"
    r'|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)'
    r"|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)"
    r"|#[^\n]*"
    r"|def[ \t]+[^\W\d]\w*",
    re.S,
)
_SIMPLE = re.compile(r"[ \t]*\([^()\n\"'#]*\)[ \t]*(?:->[^:\n\"'#]*)?:")
_STEP = re.compile(r'"""|\'\'\'|["\'#()\[\]{}:]|\n')
_LITERAL = re.compile(
    r'[rRuU]?(?:"""(?P<a>(?:[^\\"]|\\.|"(?!""))*)"""|\'\'\'(?P<b>(?:[^\\\']|\\.|\'(?!\'\'))*)\'\'\''
    r'|"(?P<c>(?:[^"\\\n]|\\.)*)"|\'(?P<d>(?:[^\'\\\n]|\\.)*)\')',
    re.S,
)
_GAP = re.compile(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*[ \t\f]*")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_A-Za-z]+")

#: Comment prefixes that speak to tools (fixed values).
_DIRECTIVE = re.compile(
    r"(?i)^(?:!|-\*-|noqa\b|type:|pylint:|pragma\b|fmt:|yapf:|isort:|flake8\b|mypy:|ruff:|nosec\b|pyright:|pytype:|"
    r"coding[:=]|vim:|ex:|cython:|distutils:|sourcery\b|skylos\b|noinspection\b|region\b|endregion\b|eslint\b|coverage:|bandit:|black:|doctest:|%%)"
)
#: Notes that documentation is still to be written (fixed values).
_TODO = re.compile(
    r"(?i)^[\W_]*(?:todo|fixme|xxx|tbd|hack)\b"
    r"|^[\W_]*(?:no|missing|needs?)\b[^.]{0,20}\b(?:docs?|docstrings?|documentation|description)\b"
    r"|^[\W_]*(?:add|write|insert|fill in|put)\b[^.]{0,20}\b(?:docs|docstrings?|documentation)\b"
    r"|\b(?:docs|docstrings?|documentation|description)\b[^.]{0,20}\b(?:todo|missing|pending|tbd|goes here|to follow|to be (?:written|added|done)|(?:will|must|should) (?:be (?:written|added)|follow)|not (?:yet )?written)\b"
    r"|\b(?:docs|docstrings?|documentation)\b[^.]{0,20}\blater\b"
    r"|\b(?:still|yet|left|need(?:s|ed)?|remains?) to (?:be )?(?:document|describe)|\bto be (?:documented|described)\b"
    r"|\b(?:document|describe) (?:this|me|it)\b[^.]*\b(?:later|soon|some day)\b"
    r"|\bundocumented\b|\b(?:dokumentation|beschreibung|doku)\b[^.]{0,20}\b(?:fehlt|folgt|erg[äa]nzen|nachtragen)\b"
    r"|\b(?:documentaci[óo]n|descripci[óo]n)\b[^.]{0,20}\b(?:pendiente|falta|por escribir)\b|\b(?:pendiente de|por|falta) documentar\b"
    r"|\b(?:documentation|description)\b[^.]{0,20}\b(?:[àa] (?:faire|[ée]crire|compl[ée]ter)|manquante?)|[àa] documenter\b"
    r"|документ\w*[^.]{0,20}(?:позже|потом|добавить|нет)|(?:написать|добавить)[^.]{0,15}(?:документ|описан)"
)
_CODE = re.compile(
    r"^(?:@[\w.]+(?:\(.*\))?|[\w.\[\]'\"]+\s*(?:[-+*/%|&^]|//|\*\*|<<|>>)?=\s*\S.*|[\w.]+\(.*\)|"
    r"(?:return|raise|import|from|del|assert|yield|await|global|nonlocal|pass|break|continue|print)\b.*|"
    r"(?:if|elif|else|for|while|with|try|except|finally|def|class|async)\b.*:|[)\]}]+,?)\s*(?:#.*)?$"
)


def _is_code(line: str) -> bool:
    """Whether a comment line is a statement that was commented out."""
    if not _CODE.match(line):
        return False
    probe = line
    if line.endswith(":"):
        head = line.split(None, 1)[0].rstrip(":")
        if head in ("elif", "else"):
            probe = ("if x: pass\n" if head == "elif" else "if x: pass\n") + line + " pass"
        elif head in ("except", "finally"):
            probe = "try: pass\n" + line + " pass"
        elif head == "try":
            probe = line + " pass\nfinally: pass"
        else:
            probe = line + " pass"
    elif line[0] == "@":
        probe = line + "\ndef f(): pass"
    elif line[0] in ")]}":
        return True
    elif line.split(None, 1)[0] in ("return", "yield", "await"):
        probe = "async def f():\n " + line
    try:
        ast.parse(probe)
        return True
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return False


def _own_words(name: str) -> set[str]:
    return {p.lower() for part in name.split("_") for p in _NAME_PART.findall(part)} | {name.lower()}


def _enough(lines: list[str], name: str, comment: bool, least: int) -> bool:
    """Whether the lines, without notes, directives, rulers and code, say ``least`` words of their own."""
    own = _own_words(name)
    n = 0
    for raw in lines:
        line = raw.strip()
        if not line or _TODO.search(line):
            continue
        if comment and (_DIRECTIVE.match(line) or _is_code(line)):
            continue
        n += sum(w.lower() not in own for w in _WORD.findall(line))
        if n >= least:
            return True
    return False


def _begins_inside(text: str) -> bool:
    """Whether a piece of a file begins inside a triple-quoted string, told by its first quotes."""
    m = re.search(r'"""|\'\'\'', text)
    if not m:
        return False
    if text.count(m[0], m.start()) % 2 == 0:
        return False
    line_start = text.rfind("\n", 0, m.start()) + 1
    before = text[line_start : m.start()]
    if re.fullmatch(r"\s*[rRuUbBfF]{0,2}", before):
        above = text[:line_start].rstrip()
        rest = text[m.end() : text.find("\n", m.end()) if "\n" in text[m.end() :] else len(text)]
        if above.endswith((":", "(", "=", "[", ",", "{")) or (not above and rest.strip()):
            return False
        return not rest.strip()
    return not re.search(r"(?:[=(\[{,:+]|\breturn|\bin|\bnot|\bis|\band|\bor)\s*[rRuUbBfF]{0,2}$", before) and "#" not in before


def _signature_end(text: str, at: int) -> tuple[int, bool]:
    """Offset behind the colon that ends a signature (True), or the end of its line (False)."""
    m = _SIMPLE.match(text, at)
    if m:
        return m.end(), True
    depth, pos, line_end = 0, at, -1
    while m := _STEP.search(text, pos):
        c = m[0]
        pos = m.end()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                break
        elif c == ":":
            if depth == 0:
                return pos, True
        elif c == "\n":
            if line_end < 0:
                line_end = m.start()
            if depth == 0:
                break
            if re.match(r"[ \t]*(?:async[ \t]+def|def|class|return|import|@)[ \t(\w]", text[pos : pos + 40]) and not re.match(r"[ \t]*\w+[ \t]*[,:=)]", text[pos : pos + 60]):
                break  # a bracket left open: the next statement is no parameter
        else:
            t = _TOKEN.match(text, m.start())
            if t:
                pos = t.end()
    if line_end < 0:
        line_end = text.find("\n", at)
    return (line_end if line_end >= 0 else len(text)), False


def _docstring(text: str, at: int, indent: int) -> str | None:
    """The plain string literal that is the first statement behind a signature."""
    m = _GAP.match(text, at)
    p = m.end()
    if "\n" in m[0] and p - (text.rfind("\n", 0, p) + 1) <= indent:
        return None
    parts = []
    while True:
        lit = _LITERAL.match(text, p)
        if not lit:
            break
        parts.append(next(g for g in lit.groups() if g is not None))
        p = lit.end()
        while p < len(text) and text[p] in " \t\f":
            p += 1
    if not parts:
        return None
    if p < len(text) and text[p] not in "\r\n#;":
        return None
    return " ".join(parts)


def _above(text: str, line_start: int, comments: set[int]) -> tuple[list[str], int]:
    """Comment lines directly above a line (or above the decorators there), and where they start."""
    at = line_start
    out: list[str] = []
    while at > 0:
        prev = text.rfind("\n", 0, at - 1) + 1
        line = text[prev : at - 1].strip()
        if line.startswith("@") and not out:
            at = prev
            continue
        if line.startswith("#"):
            hash_at = text.index("#", prev)
            if hash_at not in comments:
                break
            out.append(line.lstrip("#").strip())
            at = prev
            continue
        if not out and line.endswith((")", ",", "(")) and line:
            top = _decorator_start(text, prev, at)
            if top is not None:
                at = top
                continue
        break
    return out[::-1], at


def _decorator_start(text: str, prev: int, end: int) -> int | None:
    """Start of a decorator of several lines that ends on the line at ``prev``, however far above."""
    at = prev
    while True:
        line = text[at : text.find("\n", at)].strip()
        if line.startswith(("def ", "async def ", "class ", "return")):
            return None
        if line.startswith("@"):
            return at if _one_call(text, at, end) else None
        if at == 0:
            return None
        at = text.rfind("\n", 0, at - 1) + 1


def _one_call(text: str, at: int, end: int) -> bool:
    """Whether ``text[at:end]`` is one expression in brackets that closes on its last line."""
    depth, pos = 0, at
    while pos < end and (m := _STEP.search(text, pos, end)):
        c, pos = m[0], m.end()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "\n":
            if depth <= 0:
                return depth == 0 and not text[pos:end].strip()
        elif c != ":" and (t := _TOKEN.match(text, m.start(), end)):
            pos = t.end()
    return depth == 0


def _body_end(text: str, at: int, indent: int, colon: bool, inside: list[tuple[int, int]]) -> int:
    """Offset where the body ends: at a line indented no deeper, or behind the matching ``end``."""
    pos = text.find("\n", at)
    last = len(text) if pos < 0 else pos
    depth = 1
    k = 0
    while pos >= 0 and pos + 1 < len(text):
        start = pos + 1
        pos = text.find("\n", start)
        stop = len(text) if pos < 0 else pos
        while k < len(inside) and inside[k][1] <= start:
            k += 1
        if k < len(inside) and inside[k][0] < start:
            last = stop
            continue
        line = text[start:stop]
        body = line.strip()
        if not body:
            continue
        if not colon:
            if re.match(r"(?:def|class|module|if|unless|while|until|case|begin|for|do)\b", body) or re.search(r"\bdo\b(?:\s*\|[^|]*\|)?$", body):
                depth += 1
            elif re.match(r"end\b", body):
                depth -= 1
                if not depth:
                    return stop
            continue
        width = len(line) - len(line.lstrip(" \t"))
        if width <= indent and not body.startswith("#") and not body.startswith((")", "]", "}")):
            return last
        if width > indent or not body.startswith("#"):
            last = stop
    return last


def documented(text: str, least_words: int = 5, chunk: bool = False, with_source: bool = True) -> list[tuple]:
    """``(def_line, name, kind, documentation, start_line, end_line, source)`` of one text."""
    if "def" not in text:
        return []
    offset = 0
    if chunk and _begins_inside(text):
        m = re.search(r'"""|\'\'\'', text)
        offset = m.end()
    strings: list[tuple[int, int]] = []
    comments: set[int] = set()
    heads = []
    for m in _TOKEN.finditer(text, offset):
        s = m.start()
        c = text[s]
        if c == "#":
            comments.add(s)
        elif c == "d":
            line_start = text.rfind("\n", 0, s) + 1
            before = text[line_start:s]
            if not before.strip() or before.strip() == "async":
                heads.append((s, line_start, m[0].split()[1], m.end()))
        elif m.end() - s > 5:
            strings.append((s, m.end()))
    out = []
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect_right(breaks, at - 1) + 1
    for s, line_start, name, end in heads:
        indent = len(text[line_start:s]) - len(text[line_start:s].lstrip())
        sig, colon = _signature_end(text, end)
        doc = _docstring(text, sig, indent)
        kind = None
        lines, top = _above(text, line_start, comments)
        if doc is not None and _enough(doc.split("\n"), name, False, least_words):
            kind, said = "docstring", doc.strip()
        elif lines and _enough(lines, name, True, least_words):
            kind, said = "comment", "\n".join(lines)
        if kind is None:
            continue
        stop = _body_end(text, sig, indent, colon, strings)
        begin = top if kind == "comment" else line_start
        out.append((line_of(s), name, kind, said, line_of(begin), line_of(stop), text[begin:stop] if with_source else None))
    return out


def documented_functions(
    df: DataFrame, id_col: str, text_col: str, src_table: str, chunk: bool = False, least_words: int = 5, with_source: bool = True
) -> DataFrame:
    """One row for each documented function or method of every text.

    Null texts and texts without a definition give no row, a text that does not parse is read as far
    as its lines tell. A row delivered twice (same id and text) gives its functions once; rows
    without an id are told apart by their texts. ``chunk`` allows a text to begin inside a string.
    Without ``with_source`` the bodies are delimited but not carried along.
    """
    src = df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")).where(F.col("text").contains("def"))
    cols = [c.split()[0] for c in FOUND.split(", ")]

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rid, text, digest in zip(pdf["row_id"], pdf["text"], pdf["digest"]):
                rid = None if pd.isna(rid) else int(rid)
                for hit in documented(text, least_words, chunk, with_source):
                    rows.append((src_table, rid, *hit, digest))
            out = pd.DataFrame(rows, columns=cols)
            yield out.astype({"row_id": "Int64", "start_line": "Int32", "end_line": "Int32"})

    found = src.mapInPandas(scan, FOUND)
    return found.dropDuplicates(["src_table", "row_id", "digest", "def_line"]).drop("digest")
