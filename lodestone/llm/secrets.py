"""Problem 5: credentials embedded in source code and configuration.

Literals next to an assignment are segmented into dictionary words by Viterbi. What the words do not
explain decides, by how telling the context is: under a credential's name a short residual makes a
secret, elsewhere only a known token format does. Digests, identifiers and other encoded data under
neutral names are no secrets, whatever their residual; nor is a value in a known hash format (with
the name of its algorithm, or the digest of nothing) under any name.
"""

from __future__ import annotations

import ast
import json
import math
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY = os.path.join(os.environ.get("LODESTONE_TOKENIZERS", "/opt/tokenizers"), "word_bpe_49k.json")
FOUND = "src_table string, row_id long, line_no int, kind string, start int, end int, digest long"

# Names of credentials, by the strength of what they say, in several languages.
_PASSWORD = ("password", "passwd", "passphrase", "passcode", "pwd", "pass", "passwort", "kennwort", "contrasena", "contraseña", "motdepasse", "mdp", "senha", "пароль", "parol", "pw", "psw")
_TOKEN = ("secret", "token", "apikey", "bearer", "credential", "credentials", "auth", "authorization", "sid", "jwt", "pat")
_KEY_BEFORE = ("api", "access", "signing", "secret", "private", "encryption", "auth", "master", "shared", "service", "client", "session", "webhook", "hmac", "deploy", "license", "account", "storage", "consumer", "app", "signature")
_NO_KEY_BEFORE = ("public", "primary", "foreign", "cache", "sort", "partition", "row", "index", "unique", "lookup", "dict", "group", "hash", "join", "natural", "composite", "order", "registry", "key")
_SESSION = ("session", "sessionid", "session_id", "sid", "auth", "csrftoken", "remember", "connect.sid", "phpsessid", "jsessionid")

#: Formats of tokens that tell themselves (fixed values).
_FORMAT = re.compile(
    r"^(?:gh[pousr]_[A-Za-z0-9]{16,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{10,}|(?:AKIA|ASIA)[A-Z0-9]{12,}"
    r"|xox[abprs]-[\w-]{10,}|AIza[\w-]{30,}|npm_\w{30,}|pypi-\w{16,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}|ya29\.[\w-]{20,}|dop_v1_\w{20,}|hf_\w{20,}|whsec_\w{16,})"
)
#: Values that stand for a value to be filled in (fixed values).
_PLACEHOLDER = re.compile(
    r"(?i)^(?:\W*|<[^<>]*>|\[[^\[\]]*\]|\*+|x{3,}|\.{2,}|change[-_ ]?(?:me|it|this)\w{0,4}|replace[-_ ]?(?:me|this)?.{0,24}|your[-_ ].*|my[-_ ]?(?:secret|password|token|api[-_ ]?key)"
    r"|(?:insert|enter|put|add|set|fill)[-_ ].*|todo\w*|tbd|fixme|none|null|nil|true|false|undefined|empty|example\w*|dummy\w*|sample|placeholder.*|redacted.*|removed|hidden|default|unset|n/?a"
    r"|pass(?:word|wd|phrase)?|secret|token|api[-_]?key|key|.*(?:-|_)(?:here|goes[-_]here)|foo(?:bar)?|bar|baz|test|123456?)$"
)
_INSERTED = re.compile(r"\$\{|\$\(|\{\{|%\(\w+\)|^%[sdr]$|<%|\$(?:[A-Z_][A-Z0-9_]*|[a-z_]+\d?)$|^env\.|^vault:|^ssm:|^arn:|^secretsmanager|^\{\w*\}$|^@[A-Za-z_./:-]*$")
#: Values that say by which algorithm they were hashed, and the digests of the empty text (fixed values).
_HASHED = re.compile(
    r"(?i)^(?:\{?(?:md5|sha-?(?:1|224|256|384|512)|ssha\d*|bcrypt|pbkdf2[\w-]*|scrypt|argon2\w*)[:$}]|\$(?:1|2[abxy]|5|6|y|argon2\w*)\$"
    r"|d41d8cd98f00b204e9800998ecf8427e$|da39a3ee5e6b4b0d3255bfef95601890afd80709$|e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855$)"
)
#: Words of labels, hints and types that stand where a password would (fixed values).
_LABEL = re.compile(
    r"(?i)\b(?:enter|your|please|must|should|invalid|wrong|missing|required|optional|forgot|reset|confirm|repeat|new|old|current|type|here|for|the|string|str|text|field|input|label|hidden|bytes|varchar|char|object|any|"
    r"password|passwd|passphrase|passcode|pwd|passwort|kennwort|contraseña|contrasena|senha|secret|token|key|user|username|login|name|email|value)\b"
)
#: What makes a line worth reading (fixed values); letters in lower case.
_QUICK = (
    "pass", "pwd", "secret", "token", "_key", "apikey", "api-key", "api key",
    "accesskey", "access key", "access-key", "signingkey", "signing key", "signing-key", "session", "secretkey", "privatekey", "auth", "bearer", "credential", "login", "cookie", "kennwort", "contrase", "mot_de_passe",
    "mot de passe", "mdp", "senha", "\u043f\u0430\u0440\u043e\u043b\u044c", "jwt", 'sid"', "sid'", "sid=", "sid =", "session_id", "sessionid", "psw", "_pw", "pw =", "pw=", "://", "private key", "ghp_", "gho_", "ghs_",
    "ghu_", "ghr_", "sk_live_", "sk_test_", "rk_live_", "rk_test_", "akia", "asia", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "eyj", "aiza", "glpat-", "github_pat_", "npm_", "hf_", "whsec_", "ya29.",
)
#: Last parts of the names that :func:`_key_kind` accepts; no letter follows them.
_QUICK_LAST = tuple(k for k in (*_PASSWORD, *_TOKEN, "key") if not any(q in k for q in _QUICK))


def _worth_reading(text: str) -> Iterator[int]:
    """Places at which a line of ``text`` may hold a credential, in order."""
    for at, last in _automaton().iter(_lower(text)):
        if not (last and _LETTER.match(text, at + 1)):
            yield at


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in _QUICK:
        a.add_word(k, False)
    for k in _QUICK_LAST:
        a.add_word(k, True)
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case without a change of length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


_STR = r"(?P<{p}pre>[rRbBuUfF]{{0,2}})(?P<{p}q>\"\"\"|\'\'\'|[\"'])(?P<{p}v>(?:\\.|(?!(?P={p}q))[^\\\n])*)(?P={p}q)"
_ASSIGN = re.compile(
    r"(?<![\w.\-])(?P<key>[^\W\d][\w.\-]*+)[\"']?\s*\]?\s*(?::\s*[A-Za-z_][\w\[\] |.]*)?(?:=(?!=)|[=!]=|:=|:|=>|,)\s*\(?\s*" + _STR.format(p="")
)
_TUPLE = re.compile(r"(?i)\b(?P<key>auth|credentials?|login|basic_auth)\s*[=(:]\s*\(\s*" + r"[rRbBuU]{0,2}(?P<uq>[\"'])[^\"'\n]*(?P=uq)\s*,\s*" + _STR.format(p=""))
_HEADER = re.compile(
    r"(?i)\b(?P<key>authorization|x-api-key|x-auth-token|proxy-authorization)[\"']?\s*\]?\s*[:=,]\s*" + r"(?P<pre>[rRbBuUfF]{0,2})(?P<q>[\"']?)(?:(?:bearer|basic|token|apikey|digest|key)\s+)?(?P<v>[^\"'\s,;)}]+)"
)
_URL = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.\-]{0,30}://(?P<user>[^\s/\"'@:]*):(?P<v>[^\s/\"'@]+)@")
_OPEN = re.compile(r"(?<![\w.\-])(?P<key>[^\W\d][\w.\-]*+)[\"']?\s*(?:=|:)\s*\(\s*$")
_PLAIN = re.compile(r"^\s*(?:export\s+|set\s+|-\s+)?(?P<key>[\"']?[^\W\d][\w.\- ]*?[\"']?)\s*[=:]\s*(?P<v>[^\s\"'][^\s]*(?:\s+[^\s#;][^\s]*)*)\s*(?:\s[#;].*)?$")
_REMARK = re.compile(
    r"(?i)(?:^|[^\w])(?P<key>" + "|".join((*_PASSWORD, "secret", "token", "api[ _-]?key", "apikey", "access[ _-]?key", "signing[ _-]?key", "client[ _-]?secret", "mot de passe")) + r")\s*(?:is|=|:|->|ist|es|est)?\s+[\"'`]?(?P<v>[^\s\"'`]{6,})"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_LONE = re.compile(r"[\"'=\s]((?:gh[pousr]_|sk_live_|sk_test_|AKIA|ASIA|xox[abprs]-|AIza|glpat-|eyJ)[\w.\-]{10,})")
_CAMEL = re.compile(r"[A-ZА-Я]+(?![a-zа-я])|[A-ZА-Я]?[a-zа-яßäöüñéèç]+|\d+")
_LETTER = re.compile(r"[A-ZА-Яa-zа-яßäöüñéèç]")


@lru_cache(maxsize=2)
def dictionary(path: str = DICTIONARY) -> dict[str, float]:
    """Whole lower-case words of a public vocabulary with a cost from their rank (at most 49,408)."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    out = {}
    for token, rank in vocab.items():
        word = token[:-4] if token.endswith("</w>") else ""
        if word.isalpha() and word.isascii() and (len(word) >= 4 or (len(word) == 3 and rank < 4000)):
            out[word] = math.log(rank + 10)
    return out


@lru_cache(maxsize=2)
def _longest(path: str = DICTIONARY) -> int:
    return max(map(len, dictionary(path)), default=0)


def residual(value: str, words: dict[str, float]) -> int:
    """Letters and digits of ``value`` that the cheapest segmentation leaves without a word.

    Viterbi over the letters: a dictionary word costs the logarithm of its rank, an unexplained
    character 7.
    """
    left, longest = 0, _longest()
    for run in re.findall(r"[^\W_]+", value):
        low = run.lower()
        n = len(low)
        cost = [0.0] * (n + 1)
        rest = [0] * (n + 1)
        for i in range(1, n + 1):
            best, r = cost[i - 1] + 7.0, rest[i - 1] + 1
            for j in range(max(0, i - longest), i - 2):
                c = words.get(low[j:i])
                if c is not None and cost[j] + c < best:
                    best, r = cost[j] + c, rest[j]
            cost[i], rest[i] = best, r
        left += rest[n]
    return left


def _key_kind(key: str) -> str | None:
    """What a name says of its value: ``password``, ``token``, ``weak`` (some key), or nothing."""
    parts = [p.lower() for p in _CAMEL.findall(re.sub(r"(?i)mot_?de_?passe", "motdepasse", key))]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return None
    last = parts[-1]
    if last in _PASSWORD or parts[-1:] == ["secret"] and "client" not in parts or "".join(parts[-2:]) in ("passphrase", "password", "loginpwd"):
        return "password"
    if last in _TOKEN:
        return "token"
    if last == "key":
        before = parts[-2] if len(parts) > 1 else ""
        if before in _KEY_BEFORE:
            return "token"
        return None if before in _NO_KEY_BEFORE or not before else "weak"
    if last == "id" and len(parts) > 1 and parts[-2] == "session":
        return "token"
    return None


def _secret(kind: str, value: str, words: dict[str, float], pre: str = "") -> bool:
    """Whether ``value`` under a name of ``kind`` is a literal credential."""
    v = value.strip()
    if "f" in pre.lower() and "{" in v:
        return False
    if len(v) < 4 or _PLACEHOLDER.match(v) or _INSERTED.search(v) or _HASHED.match(v):
        return False
    if _FORMAT.match(v):
        return True
    if kind == "password" and not re.fullmatch(r"[\d.:]+", v):
        if " " in v:
            # a phrase: several words, none of a label's, with a number or without a sentence's marks
            return v.count(" ") >= 2 and not _LABEL.search(v) and (bool(re.search(r"\d", v)) or v.islower() and not re.search(r"[.,:;!?%{}<>]", v))
        # words alone are a password too, unless they name something
        return len(v) >= 5 and (residual(v, words) >= 1 or (v.isalpha() and len(v) >= 6 and not v.isupper() and not _LABEL.search(v)))
    if " " in v or kind == "password":
        return False
    if v.startswith(("http://", "https://", "/")) or re.fullmatch(r"[\d.,:/-]+", v):
        return False
    left = residual(v, words)
    if kind == "token":
        if left >= 6 or (left >= 4 and left * 3 >= len(v)):
            return len(v) >= 8
        # a phrase of words with a digit at its end is how people write secrets
        return len(v) >= 10 and left >= 1 and bool(re.search(r"[a-z].*\d|\d.*[a-z]", v, re.I)) and bool(re.search(r"[^\w]|_", v) or re.search(r"[a-z][A-Z]|[A-Z]{3}", v))
    return len(v) >= 16 and left * 2 >= len(v)


_STATEMENT = re.compile(r"(?:async\s+)?(?:def|class|import|from|return|raise|if|elif|else|for|while|with|try|except|finally|assert)\b(?!\s*[=:]\s*\S)")
_SETTING = re.compile(r"(?:export\s+|set\s+|-\s+)?[\"']?[\w.\- ]+[\"']?\s*[=:]|\[[^\]]+\]$|[{}\]],?$|-\s+\S")


def _is_config(text: str) -> bool:
    """Whether a text is configuration: nearly all lines are settings, hardly one is a statement."""
    lines = [x for x in (y.strip() for y in text.split("\n")) if x and not x.startswith(("#", ";", "//"))]
    if not lines or sum(bool(_STATEMENT.match(x)) for x in lines) > max(1, len(lines) // 50):
        return False
    return sum(bool(_SETTING.match(x)) for x in lines) >= 0.95 * len(lines)


def _config_around(text: str, start: int, end: int) -> bool:
    """Whether the six lines before and after are settings, and some of them no Python."""
    before = text[:start].rsplit("\n", 7)[-7:-1]
    after = text[end + 1 :].split("\n", 6)[:6]
    lines = [x for x in (y.strip() for y in before + after) if x and not x.startswith(("#", ";", "["))]
    if len(lines) < 3 or not all(_SETTING.match(x) and not _STATEMENT.match(x) for x in lines):
        return False
    for x in lines:
        try:
            ast.parse(x)
        except (SyntaxError, ValueError):
            return True
    return False


def scan(text: str, words: dict[str, float]) -> list[tuple[int, str, int, int]]:
    """``(line_no, kind, start, end)`` of each credential: its value's line from 1 and its offsets."""
    config: bool | None = None
    out: dict[int, tuple[int, str, int, int]] = {}
    seen_line = -1
    line_no, counted = 1, 0

    def add(start: int, end: int, kind: str) -> None:
        if not any(a < end and start < b for _, _, a, b in out.values()):
            out[start] = (0, kind, start, end)

    for at in _worth_reading(text):
        if at < seen_line:
            continue
        s = text.rfind("\n", 0, at) + 1
        e = text.find("\n", at)
        e = len(text) if e < 0 else e
        seen_line = e
        line = text[s:e].rstrip("\r")
        if _PEM.search(line):
            m = _PEM.search(line)
            stop = _PEM_END.search(text, s + m.end())
            add(s + m.start(), stop.end() if stop else e, "private_key")
            continue
        found = False
        for m in _URL.finditer(line):
            v = m["v"]
            if not _PLACEHOLDER.match(v) and not _INSERTED.search(v) and "{" not in v:
                add(s + m.start("v"), s + m.end("v"), "url")
            found = True
        if found:
            continue
        for m in _HEADER.finditer(line):
            v = m["v"]
            scheme = re.search(r"(?i)(?:bearer|basic|token|apikey|digest|key)\s+$", line[: m.start("v")])
            if m["q"] and not _PLACEHOLDER.match(v) and not _INSERTED.search(v) and "{" not in v and len(v) >= 8 and (scheme or residual(v, words) >= 4):
                add(s + m.start("v"), s + m.end("v"), "header")
                found = True
        for m in _TUPLE.finditer(line):
            if _secret("password", m["v"], words, m["pre"]):
                add(s + m.start("v"), s + m.end("v"), "password")
                found = True
        pos = 0
        while m := _ASSIGN.search(line, pos):
            kind = _key_kind(m["key"])
            if kind and _secret(kind, m["v"], words, m["pre"]):
                add(s + m.start("v"), s + m.end("v"), kind)
                found = True
            # the next name may be this literal itself: set("name", "value")
            pos = m.end("key") if not kind else m.end()
        if found:
            continue
        m = _OPEN.search(line)
        if m and (kind := _key_kind(m["key"])):
            _open_literal(text, e, kind, words, add)
            continue
        for m in _LONE.finditer(line):
            if _FORMAT.match(m[1]):
                add(s + m.start(1), s + m.end(1), "token")
                found = True
        if found:
            continue
        h = line.find("#")
        if h < 0:
            h = line.find("//")
        if h >= 0 and (m := _REMARK.search(line, h)):
            v = m["v"].rstrip(".,;)")
            kind = _key_kind(re.sub(r"[ -]", "_", m["key"])) or "token"
            if re.search(r"\d", v) and _secret(kind, v, words) and residual(v, words) >= 1:
                add(s + m.start("v"), s + m.start("v") + len(v), kind)
                continue
        m = _PLAIN.match(line)
        if m and (kind := _key_kind(m["key"].strip("\"'"))):
            if config is None:
                config = _is_config(text)
            if (config or _config_around(text, s, e)) and _secret(kind, m["v"], words):
                add(s + m.start("v"), s + m.start("v") + len(m["v"].rstrip()), kind)
    hits = sorted(out.values(), key=lambda x: x[2])
    res = []
    for _, kind, a, b in hits:
        line_no += text.count("\n", counted, a)
        counted = a
        res.append((line_no, kind, a, b))
    return res


def _open_literal(text: str, at: int, kind: str, words: dict[str, float], add) -> None:
    """A literal that begins on the line behind ``name = (`` and may go on over several lines."""
    lit = re.compile(r"\s*[rRbBuU]{0,2}([\"'])((?:\\.|(?!\1)[^\\\n])*)\1[ \t]*(?:#[^\n]*)?")
    spans, p = [], at
    while m := lit.match(text, p):
        spans.append((m.start(2), m.end(2)))
        p = m.end()
    if spans and _secret(kind, "".join(text[a:b] for a, b in spans), words):
        for a, b in spans[:1]:
            add(a, b, kind)
        for a, b in spans[1:]:
            add(a, b, "continued")


def redact(text: str, hits: list[tuple[int, str, int, int]], mark: str = "REDACTED") -> str:
    """``text`` with each credential replaced; of a key block only the lines within are replaced."""
    out, at = [], 0
    for _, kind, a, b in hits:
        if kind == "private_key":
            body = re.match(r"(-----BEGIN[^\n]*?-----)(.*?)(-----END[^\n]*|\Z)", text[a:b], re.S)
            if body:
                inner = re.sub(r"[A-Za-z0-9+/=]+", mark, body[2], count=1)
                inner = inner[: inner.find(mark) + len(mark)] + re.sub(r"[A-Za-z0-9+/=]", "", inner[inner.find(mark) + len(mark) :]) if mark in inner else inner
                out += [text[at:a], body[1], inner, body[3]]
                at = b
                continue
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest")).where("text is not null")


def find_secrets(df: DataFrame, id_col: str, text_col: str, src_table: str, path: str = DICTIONARY) -> DataFrame:
    """Places of credentials: table, row, line (from 1) where the value starts, kind, offsets.

    Null and empty texts have none. A row delivered twice (same id and text) is reported once; rows
    without an id are told apart by their texts. Parts of a literal that
    goes on over several lines are one place, at its first line.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(path)
        for pdf in it:
            rows = []
            for rid, text, digest in zip(pdf["row_id"], pdf["text"], pdf["digest"]):
                rid = None if pd.isna(rid) else int(rid)
                rows += [(src_table, rid, n, k, a, b, digest) for n, k, a, b in scan(text, words) if k != "continued"]
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "line_no", "kind", "start", "end", "digest"]).astype({"row_id": "Int64"})

    return _source(df, id_col, text_col).mapInPandas(run, FOUND).dropDuplicates(["src_table", "row_id", "digest", "start"]).drop("digest")


def redact_secrets(df: DataFrame, id_col: str, text_col: str, src_table: str, path: str = DICTIONARY) -> DataFrame:
    """``(src_table, row_id, n_secrets, text)`` of the rows with a credential, with all replaced."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = dictionary(path)
        for pdf in it:
            rows = []
            for rid, text, digest in zip(pdf["row_id"], pdf["text"], pdf["digest"]):
                hits = scan(text, words)
                if hits:
                    rows.append((src_table, None if pd.isna(rid) else int(rid), sum(k != "continued" for _, k, _, _ in hits), redact(text, hits), digest))
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "n_secrets", "text", "digest"]).astype({"row_id": "Int64"})

    out = _source(df, id_col, text_col).mapInPandas(run, "src_table string, row_id long, n_secrets int, text string, digest long")
    return out.dropDuplicates(["src_table", "row_id", "digest"]).drop("digest")
