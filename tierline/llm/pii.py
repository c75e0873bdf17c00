"""Personal data in texts: plain identifiers, and disguised ones found by an offset-preserving deobfuscation.

The plain patterns run over the text itself. A text that shows signs of disguise also goes through a chain
of transducers. Each rewrites a text with two arrays of offsets, the start and end of the source characters
that each character stands for: homoglyphs and foreign digits become ASCII, spelled digits become
digits, at/dot in words or brackets become signs. Identifiers found in the result are mapped back to the
source characters and added where they overlap no plain one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# Plain identifiers. All run in linear time on texts of any length.

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the first digit of a run fails from the later ones too.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_IP_CORE = re.compile(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches of local part, @ and dotted domain. The local part reaches back from the @ as far as
    its characters and the match before allow."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL))
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[Span]:
    if not _IP_CORE.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m.group().split(".")):
            yield m.span()


_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[d] for d in values[1::2])) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def plain_spans(text: str) -> dict[str, list[Span]]:
    return {
        "email": list(emails(text)),
        "ip": list(ips(text)),
        "card": list(cards(text)),
        "phone": list(phones(text)) if "+" in text else [],
    }


# Disguised identifiers.

#: Letters of other scripts that look like ASCII ones, and the ASCII ones they look like.
HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁһӏԛԝАВЕКМНОРСТУХІЈЅαοινκρτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɡ",
        "aeopcyxijsdhlqwABEKMHOPCTYXIJSaoivkptuxABEZHIKMNOPTYXig",
    )
)
#: Signs that stand for @, the full stop, the plus sign and the hyphen.
SIGNS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "－": "-", " ": " ", " ": " ", " ": " "}
#: Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
#: Digits in words, by language, and o for 0 beside them.
SPELLED = {
    word: str(n)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, word in enumerate(words.split())
}
_AT = "at|arobase|arroba"
_DOT = "dot|punkt|point|punto"
# Blanks before a bracket are read from their first one only, so that long runs of them take linear time.
_BRACKETED = re.compile(rf"(?:(?<![ \t])[ \t]++)?+[\[({{<][ \t]*(?:({_AT}|@)|({_DOT}|\.))[ \t]*[\])}}>][ \t]*", re.IGNORECASE)
#: Endings of an address that is written in plain words.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|ai|app|dev|co|eu|uk|us|ca|au|de|fr|es|it|nl|ch|at|be|pl|pt|se|no|dk|fi|ie|br|mx|ar|cl|in|jp|cn|kr|ru"
# In plain words the whole address must be there: name at host dot ending.
_WORDED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( (?:{_AT}) |@)[A-Za-z0-9-]++(?:(?: (?:{_DOT}) |\.)[A-Za-z0-9-]+)*?(?: (?:{_DOT}) |\.)(?:{ENDINGS})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_WORDED_PART = re.compile(rf" ({_AT}) | ({_DOT}) ", re.IGNORECASE)
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:\+|plus[ -])?(?:(?:{'|'.join(sorted(SPELLED, key=len, reverse=True))}|[0-9]+)(?:[ ,-]+(?:dot |point )?|[.](?=\w)|(?!\w))){{4,}}",
    re.IGNORECASE,
)
_SPELLED_PART = re.compile(rf"plus|dot|point|{'|'.join(sorted(SPELLED, key=len, reverse=True))}", re.IGNORECASE)
_GAP = re.compile("[ ,]+")
# Signs of disguise, looked for in lower case; most texts show none and are done with one pass of each. Every
# text that a transducer would change shows one of them.
_ANY_DIGIT = "|".join(sorted(SPELLED, key=len, reverse=True))
_BRACKET_SIGN = re.compile(rf"[\[({{<][ \t]*(?:{_AT}|{_DOT}|@|\.)[ \t]*[\])}}>]")
_WORD_SIGNS = tuple(f" {w} " for w in _DOT.split("|"))
_AT_SIGN = re.compile(rf" (?:{_AT}) [a-z0-9-]++(?:\.| (?:{_DOT}) )")
_DIGIT_SIGN = re.compile(rf"\b(?:{_ANY_DIGIT})(?:[ ,-]+(?:dot |point )?|\.)(?:{_ANY_DIGIT}|[0-9])")

@dataclass
class Marked:
    """A rewritten text; the source characters start[i] to end[i] stand behind its character i."""

    text: str
    start: np.ndarray
    end: np.ndarray


@lru_cache(maxsize=4096)
def _plain_char(c: str) -> str:
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS or c in SIGNS:
        return HOMOGLYPHS.get(c) or SIGNS[c]
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def fold(text: str) -> Marked:
    """Homoglyphs, full-width characters and digits of any script to ASCII; characters without width go."""
    at = np.arange(len(text))
    if text.isascii():
        return Marked(text, at, at + 1)
    plain = {c: _plain_char(c) for c in set(text) if not c.isascii()}
    gone = [ord(c) for c, p in plain.items() if not p]
    if gone:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.flatnonzero(~np.isin(codes, gone))
    return Marked(text.translate({ord(c): p for c, p in plain.items()}), at, at + 1)


def _replace(marked: Marked, cuts: list[tuple[int, int, str]]) -> Marked:
    """`cuts`: places of the marked text and what takes their place; it stands for all of them."""
    if not cuts:
        return marked
    texts, starts, ends = [], [], []
    at = 0
    for a, b, text in cuts:
        texts += [marked.text[at:a], text]
        starts += [marked.start[at:a], np.full(len(text), marked.start[a])]
        ends += [marked.end[at:a], np.full(len(text), marked.end[b - 1])]
        at = b
    return Marked("".join([*texts, marked.text[at:]]), np.concatenate([*starts, marked.start[at:]]), np.concatenate([*ends, marked.end[at:]]))


def signs(marked: Marked) -> Marked:
    """at and dot in brackets, or in words where they make up a whole address."""
    marked = _replace(marked, [(m.start(), m.end(), "@" if m[1] else ".") for m in _BRACKETED.finditer(marked.text)])
    cuts = []
    for m in _WORDED.finditer(marked.text):
        cuts += [(p.start(), p.end(), "@" if p[1] else ".") for p in _WORDED_PART.finditer(marked.text, m.start(), m.end())]
    return _replace(marked, cuts)


def digits(marked: Marked) -> Marked:
    """Runs of four or more spelled digits to digits, without the blanks between them."""
    text = marked.text
    cuts = []
    for m in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, m.start(), m.end()))
        if sum(p[0].lower() in SPELLED for p in parts) < 4:
            continue
        for p in parts:
            word = p[0].lower()
            cuts.append((p.start(), p.end(), SPELLED.get(word) or ("+" if word == "plus" else ".")))
        for gap in _GAP.finditer(text, m.start(), m.end() - 1):
            cuts.append((gap.start(), gap.end(), ""))
    return _replace(marked, sorted(cuts))


def disguised_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the source characters of identifiers that show after deobfuscation."""
    marked = digits(signs(fold(text)))
    return {k: [(int(marked.start[a]), int(marked.end[b - 1])) for a, b in v] for k, v in plain_spans(marked.text).items()}


def suspicious(text: str) -> bool:
    """Whether a transducer may change the text. Where none does, the chain finds the plain identifiers only."""
    # the dotted capital I matches i without being i in lower case
    if not text.isascii() and any(c == "İ" or _plain_char(c) != c for c in set(text) if not c.isascii()):
        return True
    low = text.lower()
    if _BRACKET_SIGN.search(low) or any(w in low for w in _WORD_SIGNS) or _AT_SIGN.search(low):
        return True
    return bool(_DIGIT_SIGN.search(low) and _SPELLED_RUN.search(text))


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans and all spans by kind; those added overlap no plain span of any kind and no other added."""
    text = text or ""
    base = plain_spans(text)
    if not suspicious(text):
        return base, base
    taken: list[Span] = []  # apart from each other and in order
    for a, b in sorted(s for v in base.values() for s in v):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    every = {k: list(v) for k, v in base.items()}
    for kind, spans in disguised_spans(text).items():
        for a, b in spans:
            # of all that begin before b only the last can reach beyond a
            before = bisect_left(taken, (b, b))
            if before == 0 or taken[before - 1][1] <= a:
                insort(taken, (a, b))
                every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def _text(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            base, every = find(text)
            counts = [len(base[k]) for k in KINDS]
            listed = _text(base)
            rows.append((*counts, hashlib.sha256(listed.encode()).hexdigest(), _text(every), sum(map(len, every.values())) - sum(counts)))
        cols = list(zip(*rows)) if rows else [()] * 7
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
        names = [f"n_{k}" for k in KINDS] + ["base_sha256", "spans", "n_added"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", *names]
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of `docs` (doc_id, text).

    Counts and hash are of the plain spans; `spans` lists the disguised ones too (`n_added` of them). Offsets
    count code points, ends are exclusive. A null or empty text has no spans: the hash is that of the empty
    text, `spans` is empty. Null and repeated doc_ids are rows like others. No documents give no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan, _SCHEMA)
