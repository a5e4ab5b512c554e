"""Problem 3: broken prompt and response pairs.

Messages are ordered and paired over range-sorted blocks, so no conversation is collected. Of each
pair the language posteriors of prompt and response are compared, from a naive Bayes model over
character n-grams; truncation is what :mod:`lodestone.llm.truncation` finds by length spikes and the
end-of-text n-gram model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import clean_role, is_blank, ordered_blocks
from lodestone.llm.truncation import cut_rows, message_rows
from lodestone.session import bounded_broadcast, materialize

SLOTS = 1 << 14
#: Labelled rows the language model is fitted on, at most, for each language.
FIT_ROWS = 2000
#: Rows delivered again under one id that may be left to the sorted pass.
COPIES = 1000
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_SPANS = re.compile(r"`[^`\n]*`")
_MARKUP = re.compile(r"<code>.*?(?:</code>|\Z)|<[^<>\n]{1,80}>", re.S)
_LINKS = re.compile(r"https?://\S+")
_CODE_LINES = re.compile(r"^(?:>>>|\$ | {4}|\t).*$", re.M)
_MARKS = ".,;:!?…()[]{}<>\"“”„«»¿¡-–—*_/|"


def tokens(text: str) -> list[str]:
    """What stands between blanks in a text, outside of code, links and markup."""
    if "`" in text:
        text = _SPANS.sub(" ", _FENCED.sub(" ", text))
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if "://" in text:
        text = _LINKS.sub(" ", text)
    if "\n" in text or text.startswith((" ", "\t", ">>>", "$ ")):
        text = _CODE_LINES.sub(" ", text)
    return text.replace("'", " ").replace("’", " ").split()


def word_of(token: str) -> str:
    """The word of a token in lower case, or nothing: digits, underscores and humps make an identifier."""
    w = token.strip(_MARKS)
    return w.lower() if w.isalpha() and (w.islower() or w.istitle() or w.isupper()) else ""


def prose(text: str) -> list[str]:
    """Words of a text outside of code, links, markup and identifiers, in lower case."""
    return [w for w in map(word_of, tokens(text)) if w]


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of the 3-grams of words, each closed in by blanks, and the word of each."""
    joined = " ".join(["", *words, ""])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])[: len(h)]
    # a gram with its blank in the middle spans two words
    inside = c[1:-1] != 32
    return (h >> np.uint64(50)).astype(np.int64)[inside], owner[inside]


class LanguageModel:
    """Naive Bayes over hashed character 3-grams of words; fixed size for each language."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in samples})
        self.log = np.zeros((SLOTS, len(self.languages)), np.float32)
        for i, lang in enumerate(self.languages):
            slots, _ = _grams([w for l, text in samples if l == lang for w in prose(text)])
            n = np.bincount(slots, minlength=SLOTS) + 0.05
            self.log[:, i] = np.log(n / n.sum())
        self._forget()

    def _forget(self) -> None:
        # the first row is that of a token that is no word
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, len(self.languages)), np.float32)

    def _learn(self, tokens_: set[str]) -> None:
        """Log-likelihoods of new tokens; each distinct token of a worker is looked at once."""
        if len(self.known) > 500_000:
            self._forget()
        new = [(t, w) for t in tokens_ if t not in self.known for w in (word_of(t),)]
        self.known.update((t, 0) for t, w in new if not w)
        new = [(t, w) for t, w in new if w]
        if new:
            slots, owner = _grams([w for _, w in new])
            got = np.zeros((len(new), len(self.languages)), np.float32)
            np.add.at(got, owner, self.log[slots])
            self.known.update(zip((t for t, _ in new), range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, got])

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Log-likelihoods of texts given as :func:`tokens`, a row for each; zeros without a word."""
        out = np.zeros((len(texts), len(self.languages)))
        full = [k for k, t in enumerate(texts) if t]
        if full and self.languages:
            flat = list(chain.from_iterable(texts[k] for k in full))
            try:
                at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            except KeyError:
                self._learn(set(flat))
                at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
            starts = np.cumsum([0, *(len(texts[k]) for k in full)])[:-1]
            out[full] = np.add.reduceat(self.table[at], starts, axis=0, dtype=np.float64)
        return out


def fit_languages(documents: DataFrame, rows_per_language: int = FIT_ROWS) -> LanguageModel:
    """Fit on the whole texts of at most ``rows_per_language`` labelled rows of each of at most 16 languages.

    The tag's first two letters name the language; rows without a tag are not used. Which rows are
    taken depends on a hash of their id only.
    """
    lang = F.lower(F.substring(F.regexp_replace("lang", r"^\s+", ""), 1, 2))
    tagged = documents.where("lang is not null and text is not null").select(lang.alias("lang"), "text", F.xxhash64("doc_id").alias("h"))
    common = [r["lang"] for r in tagged.groupBy("lang").count().where("count >= 5").orderBy(F.desc("count"), "lang").limit(16).collect()]
    if not common:
        return LanguageModel([])
    sizes = {r["lang"]: r["count"] for r in tagged.where(F.col("lang").isin(common)).groupBy("lang").count().collect()}
    # a share of the hash range for each language, so that no group is sorted
    keep = F.lit(False)
    for x in common:
        share = min(1.0, rows_per_language / sizes[x])
        keep = keep | ((F.col("lang") == x) & (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))))
    return LanguageModel([(r["lang"], r["text"]) for r in tagged.where(keep).select("lang", "text").collect()])


# How answers decline, in four languages; and what only looks so.
_REFUSAL = re.compile(
    r"\bi(?:'m| am)? (?:can(?:no|')t|cannot|can not|won't|will not|am not able to|'m not able to|not able to|am unable to|unable to|must decline|have to decline|need to decline|decline|refuse|would rather not|'d rather not|prefer not|'m not allowed|am not allowed|not allowed|'m not permitted|am not permitted|shouldn't|am not going to|'m not going to|not going to)"
    r"(?: to)?(?: \w+){0,2}? ?(?:help|assist|answer|comment|describe|discuss|explain|go into|talk|say|share|provide|reveal|respond|comply|fulfil|continue|support|give|decline|this request|that request|do that|do this|disclose|speak)\b"
    r"|\b(?:must|have to|need to) (?:decline|refuse)\b|\bi (?:decline|refuse) (?:to|this|that)\b"
    r"|\bno answer can be given\b|\b(?:isn't|is not|not) possible for me to (?:comment|answer|help|say|discuss|explain|talk)\b"
    r"|\boutside (?:of )?what i (?:may|can|am allowed)\b|\bnot something i (?:can|may|am able|am allowed)\b|\b(?:guidelines|policy|policies|rules) (?:keep|prevent|stop|forbid|do not allow|don't allow|prohibit)\b"
    r"|\bagainst (?:my|our|the) (?:guidelines|policy|policies|rules)\b|\bwithout me\b(?=[^.]*[.]|$)|\bi(?:'d| would) rather not\b|\bask (?:a colleague|someone else|somebody else) instead\b"
    r"|\bi (?:won't|will not) (?:describe|explain|discuss|answer|help|comment|say)\b"
    r"|\b(?:kann|darf|möchte|werde|will) (?:ich|dir|ihnen|euch)\b[^.]{0,60}\b(?:nicht (?:weiter)?helfen|nicht (?:be)?antworten|nicht (?:weiter)?(?:geben|sagen|besprechen|erklären|äußern|eingehen|unterstützen)|nichts sagen|nichts dazu|keine (?:antwort|auskunft|hilfe))"
    r"|\bich (?:kann|darf|möchte|werde|will)\b[^.]{0,60}\b(?:nicht (?:weiter)?helfen|nicht (?:be)?antworten|nicht (?:weiter)?(?:geben|sagen|besprechen|erklären|äußern|eingehen)|nichts sagen|keine (?:antwort|auskunft|hilfe))"
    r"|\bmuss ich\b[^.]{0,60}\b(?:ablehnen|verweigern)|\bich (?:muss|lehne|verweigere)\b[^.]{0,60}\b(?:ablehnen|verweigern|ab\b)|\bist mir nicht (?:erlaubt|gestattet|möglich)\b|\bbitte frage? (?:jemand|jemanden) ander"
    r"|\bno (?:puedo|podemos|me es posible|voy a|debo|quiero) (?:\w+ )?(?:ayudar\w*|responder\w*|hablar|contestar\w*|comentar|explicar\w*|dar(?:te)?|decir\w*|discutir)|\bno me está permitido\b|\b(?:debo|tengo que) (?:rechazar|declinar|negarme)|\bme (?:niego|veo obligad[oa]) a\b|\bprefiero no (?:hablar|responder|comentar)"
    r"|\bje ne (?:peux|puis|dois|veux|vais|suis) pas (?:\w+ ){0,3}?(?:aider|répondre|parler|commenter|expliquer|dire|discuter|autorisée?|en mesure)|\bje ne (?:peux|puis) (?:rien|vous aider|t'aider)|\bil m'est (?:impossible|interdit) de (?:parler|répondre|commenter|vous|t'|dire|discuter|donner|aider)|\bje (?:dois|suis obligée?? de) (?:refuser|décliner)|\bil ne m'est pas (?:permis|possible)|\bje (?:refuse|préfère ne pas)\b"
)
#: Statements about things that open like a refusal.
_NO_REFUSAL = re.compile(
    r"\bi (?:can(?:no|')t|cannot|can not) (?:see|find|tell|reproduce|spot|recall|detect)\b|\bnot able to (?:tell|see|find|reproduce|spot)\b|\bunable to (?:reproduce|find|see)\b|\b(?:you|it|this|that|they|we) (?:can'?t|cannot|won'?t)\b"
    r"|\bsorry for\b|\bsorry about\b|`[^`]+` refuses\b"
)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")


#: One of these is in every sentence that declines (fixed values).
_DECLINES = (
    "can't", "cannot", "can not", "won't", "will not", "able to", "unable", "declin", "refus", "rather not", "prefer not", "not allowed", "permi", "shouldn't", "going to", "no answer",
    "possible for me", "outside", "not something", "guideline", "polic", "rules", "without me", "ask a colleague", "ask some", "nicht", "keine", "ablehn", "lehne", "verweiger", "frag", "no puedo",
    "no podemos", "no me", "no voy", "no debo", "no quiero", "rechaz", "negarme", "niego", "obligad", "prefiero no", "je ne", "m'est", "je dois", "je suis oblig", "je préfère",
)


@lru_cache(maxsize=1)
def _declines():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k in _DECLINES:
        a.add_word(k, True)
    a.make_automaton()
    return a


def is_refusal(answer: str) -> bool:
    """Whether a sentence of an answer's prose declines to answer."""
    text = answer.replace("’", "'").lower()
    if next(_declines().iter(text), None) is None:
        return False
    text = re.sub(r"```.*?(?:```|\Z)", " ", text, flags=re.S)
    for sentence in _SENTENCE.split(re.sub(r"`[^`\n]*`", "it", text)):
        sentence = " ".join(sentence.split())
        if next(_declines().iter(sentence), None) and _REFUSAL.search(sentence) and not _NO_REFUSAL.search(sentence):
            return True
    return False


_WORDS = re.compile(r"[^\W_]+")


def is_copy(question: str, answer: str, lead: int = 8) -> bool:
    """Whether an answer only gives the question back.

    Letter case and everything between words is ignored; the question may come several times, behind
    a lead-in of at most ``lead`` words (each time), and may have lost words at its end by a cut.
    """
    low = answer.lower()
    first = _WORDS.search(question.lower())
    # the question's first word comes early: a cheap look before all words are taken
    if first is None or first[0] not in low:
        return False
    q = _WORDS.findall(question.lower())
    a = _WORDS.findall(low)
    if len(q) < 2 or len(a) < len(q):
        return False
    at, n = 0, len(q)
    while True:
        start = next((i for i in range(at, min(at + lead, len(a) - n) + 1) if a[i : i + n] == q), None)
        if start is None:
            break
        at = start + n
    # what is left over may be the beginning of one more repetition, or a short closing
    rest = a[at:]
    return at > 0 and (rest == q[: len(rest)] or len(rest) <= 2)


# Names of languages in the four, for requests to answer in one of them.
_NAMES = {
    "en": r"english|englisch\w*|inglés|inglesa?|anglais\w*",
    "de": r"german|deutsch\w*|alemán|alemana|allemand\w*",
    "es": r"spanish|spanisch\w*|español\w*|castellano|espagnol\w*",
    "fr": r"french|französisch\w*|francés|francesa|français\w*",
    "pt": r"portuguese|portugiesisch\w*|portugués|portugais\w*|português",
    "ru": r"russian|russisch\w*|ruso|russe|русск\w*",
}
_ASK = re.compile(
    r"(?i)\b(?:answer|reply|respond|write|explain|say|translate|antwort\w*|schreib\w*|erklär\w*|übersetz\w*|respond\w*|contest\w*|escrib\w*|explic\w*|traduc\w*|répond\w*|écri\w*|expliqu\w*|tradui\w*)\b[^.?!\n]{0,60}\b(?:in|into|auf|ins?|en|al|em|на)\s+(?:the\s+)?(?P<x>\w+)"
    r"|\b(?:in|into|auf|en)\s+(?P<y>\w+)[,]?\s+(?:please|bitte|por favor|s'il (?:te|vous) pla[iî]t|antworten|beantworten)"
)


def asked_language(question: str) -> str | None:
    """The language a question asks to be answered in."""
    for m in _ASK.finditer(question):
        word = (m["x"] or m["y"] or "").lower()
        for code, names in _NAMES.items():
            if re.fullmatch(names, word):
                return code
    return None


def language_differs(model: LanguageModel, pairs: list[tuple[str, str]], margin: float = 10.0) -> list[bool]:
    """For each question and answer, whether their prose is surely in two different languages.

    A language is sure when it leads the other's by ``margin`` nats; the language that the question
    asks for is never wrong, and without prose nothing differs.
    """
    if not pairs or len(model.languages) < 2:
        return [False] * len(pairs)
    texts = [tokens(t) for pair in pairs for t in pair]
    s = model.scores(texts)
    q, a = s[0::2], s[1::2]
    i, j = q.argmax(axis=1), a.argmax(axis=1)
    k = np.arange(len(pairs))
    sure = (i != j) & (q[k, i] - q[k, j] >= margin) & (a[k, j] - a[k, i] >= margin)
    return [bool(x) and asked_language(pairs[n][0]) != model.languages[j[n]] for n, x in enumerate(sure)]


def _deduplicated(messages: DataFrame) -> DataFrame:
    """One row for each message, as :func:`lodestone.llm.text.deduplicated_messages` has it.

    Contents stay where they are: keys and ids alone are aggregated, and what was sent again is
    taken out by a join with the keys that occur more than once (broadcast while these are few).
    Up to ``COPIES`` rows of one id are left in and follow each other when sorted.
    """
    role = clean_role(F.col("role"))
    keys = [F.xxhash64("session_id", role, "created_at", "content", F.col("content").isNull(), F.lit(s)).alias(f"k{s}") for s in (1, 2)]
    m = messages.where("session_id is not null").select("session_id", role.alias("role"), "created_at", "id", "content", *keys)
    again = materialize(m.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1"))
    left = m.join(bounded_broadcast(again, 500_000), ["k1", "k2"], "left").where("first is null or first <=> id")
    if again.where(F.col("n") > COPIES).limit(1).count():
        # more copies under one id than may fall to one block
        left = left.where(F.coalesce("n", F.lit(0)) <= COPIES).unionByName(left.where(F.col("n") > COPIES).dropDuplicates(["k1", "k2"]))
    return left.select("session_id", "role", "created_at", "id", "content")


_PAIR = "kind string, session_id long, at long, id long, role string, content string, answer_id long, defect string"


def answer_defects(messages: DataFrame, documents: DataFrame, margin: float = 10.0) -> DataFrame:
    """``(answer_id, defect)`` of every defective pair, one row for each defect it has.

    A pair is a user message directly followed by an assistant's, order and repeated rows as in
    problem 2; pairs of dropped conversations count. Null and blank answers are ``empty`` and nothing
    else, a refusal is no copy and in no wrong language; a blank question cannot be copied and has no language. Empty tables give no row.
    """
    spark = messages.sparkSession
    model = spark.sparkContext.broadcast(fit_languages(documents))
    rows = _deduplicated(messages).select(
        "session_id", F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at"), "id", "role", "content"
    )

    def judge(pairs: list[tuple]) -> list[tuple]:
        """Rows for ``(question, answer, row)``: one for the pair, one for each of its defects."""
        out, talk = [], []
        for q, a, row in pairs:
            found = []
            if not _visible(a):
                found = ["empty"]
            else:
                if is_refusal(a):
                    found.append("refusal")
                elif _visible(q):
                    if is_copy(q, a):
                        found.append("copy")
                    else:
                        talk.append((q, a, row))
            out += _told(row, found)
        differs = language_differs(model.value, [(q, a) for q, a, _ in talk], margin)
        return out + [t for (_, _, row), d in zip(talk, differs) if d for t in _told(row, ["language"])[1:]]

    columns = [c.split()[0] for c in _PAIR.split(", ")]

    fields = ("session_id", "at", "id", "role", "content")

    def pairs(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs within the sorted block, and the block's first and last row for its neighbours."""
        before = None
        for pdf in it:
            out, met = [], []
            for row in zip(*(pdf[c] for c in fields)):
                if before is None:
                    out.append(("first", *row, None, None))
                elif before[2:4] == row[2:4] and before[:2] == row[:2] and before[4] == row[4]:
                    continue  # delivered again
                elif before[0] == row[0] and before[3] == "user" and row[3] == "assistant":
                    met.append((before[4], row[4], row))
                before = row
            yield _frame(out + judge(met), columns)
        if before is not None:
            yield _frame([("last", *before, None, None)], columns)

    def bridge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of one block's last row and the next block's first."""
        before = None
        for pdf in it:
            met = []
            for row in zip(*(pdf[c] for c in (*fields, "kind"))):
                if before is not None and before[5] == "last" and row[5] == "first" and before[0] == row[0] and before[3] == "user" and row[3] == "assistant":
                    met.append((before[4], row[4], row))
                before = row
            yield _frame(judge(met), columns)

    found = materialize(ordered_blocks(rows, "session_id", "at", "id").mapInPandas(pairs, _PAIR))
    # two rows for each block, whatever the input: joined in one small task
    edges = found.where("kind <> 'pair'").select(*fields, "kind").coalesce(1).sortWithinPartitions("session_id", "at", "id", "kind")
    both = found.where("kind = 'pair'").unionByName(edges.mapInPandas(bridge, _PAIR)).select("answer_id", "defect")
    answers = both.where("defect is null").select("answer_id").distinct()
    cut = cut_rows(message_rows(messages)).select(F.col("row_id").alias("answer_id"))
    truncated = cut.join(answers, "answer_id", "left_semi").select("answer_id", F.lit("truncated").alias("defect"))
    return both.where("defect is not null").unionByName(truncated).distinct()


def _told(row: tuple, defects: list[str]) -> list[tuple]:
    """A row for the pair, without a defect, and one for each of its defects."""
    return [("pair", row[0], None, None, None, None, row[2], d) for d in (None, *defects)]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.astype({"session_id": "Int64", "at": "Int64", "id": "Int64", "answer_id": "Int64"})


_SEEN = regex.compile(r"[^\p{Z}\p{C}\u115F\u1160\u2800\u3164\uFFA0]")


def _visible(text: str | None) -> bool:
    return text is not None and _SEEN.search(text) is not None
