"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text itself.  Then transducers rewrite the
text: look-alike characters to their plain letters, spelled digits to digits,
at/dot disguises to ``@`` and ``.``.  Each rewrite keeps a list of edits, so a
span found in the rewritten text maps back through them to code points of the
source.  Only spans that a rewrite touched are added, where they overlap no
plain span or reach beyond the ones within them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

# ---- plain identifiers

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# All starts in a run of digits fail alike, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[Span]:
    """Every match holds one ``@``: take the run of local characters before it
    (after the last match) and the longest domain behind it; linear time."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def plain(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches per kind; failing ones are dropped."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = emails(text)
    if _DIGIT.search(text):
        found["ip"], found["card"] = ips(text), cards(text)
        if "+" in text:
            found["phone"] = phones(text)
    return found


# ---- transducers

#: Letters of other scripts that look like plain ones, and marks of no width.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "С": "C", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "З": "3",
    "α": "a", "γ": "y", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɡ": "g", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ",
    "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
_ODD = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "①-⑳！-～\U0001d400-\U0001d7ff]")

#: Digits as they are spelled in English, Spanish, German and French.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "fuenf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
#: How a plus sign, a dot and an at sign are spelled in them.
_PLUS, _DOT_WORD, _AT_WORD = "plus|más", "dot|point|punto|punkt", "at|ät|arroba|arobase|klammeraffe"
_AT_ONLY = ("arroba", "arobase", "klammeraffe")
_DIGITS = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = f"(?:{_DIGITS}|{_PLUS}|[0-9])"
_SPELLED_RUN = re.compile(rf"(?i)(?<![^\W_])(?:{_PLUS}|{_DIGITS})(?:(?:[ ,-]{{1,2}}|[ ]?(?:{_DOT_WORD})[ ]|\.)(?:{_NUMBER}))+(?![^\W_])")
_SPELLED_PART = re.compile(rf"(?i)({_DIGITS}|{_PLUS})|([0-9])|([ ]?(?:{_DOT_WORD})[ ]|\.)|([ ,-]+)")
#: A run has four spelled digits, with signs at most between them.
_FOUR = re.compile("d(?:s*d){3}")
_KINDS = dict.fromkeys(SPELLED, "d") | dict.fromkeys(f"{_PLUS}|{_DOT_WORD}".split("|"), "s")


def may_spell(low: str) -> bool:
    """Whether four spelled digits follow each other among the words."""
    for c in ",-.()[]{}<>\"':;!?+/_*|=#&%~":
        low = low.replace(c, " ")
    words = low.split()
    return not _KINDS.keys().isdisjoint(words) and _FOUR.search("".join(map(_KINDS.get, words, repeat(" ")))) is not None


_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_AT_SIGN, _DOT_SIGN = r"(?:@|&\#0*64;|&\#x0*40;|&commat;)", r"(?:\.|&\#0*46;|&\#x0*2e;|&period;)"
_AT = rf"(?:[ ]?{_OPEN}[ ]?(?:{_AT_WORD}|a[ ]t|{_AT_SIGN})[ ]?{_CLOSE}[ ]?|[ ](?:{_AT_WORD})[ ]|_(?:{_AT_WORD})_|[ ]?{_AT_SIGN}[ ]?)"
_DOT = rf"(?:[ ]?{_OPEN}[ ]?(?:{_DOT_WORD}|d[ ]o[ ]t|{_DOT_SIGN})[ ]?{_CLOSE}[ ]?|[ ](?:{_DOT_WORD})[ ]|_(?:{_DOT_WORD})_|{_DOT_SIGN})"
# Underscores within a name end where a spelled sign between two of them begins.
_NAME, _LABEL = rf"(?:(?!_(?:{_AT_WORD}|{_DOT_WORD})_)[A-Za-z0-9_%+-]){{1,64}}", r"[A-Za-z0-9-]{1,63}"
_MAIL = re.compile(rf"(?i)(?<![A-Za-z0-9_%+-])({_NAME}(?:{_DOT}{_NAME}){{0,6}}+)({_AT})({_LABEL}(?:{_DOT}{_LABEL}){{1,6}})")
_DOTS = re.compile(rf"(?i){_DOT}")
_MAIL_HINT = re.compile(rf"(?i){_OPEN}[ ]?(?:{_AT_WORD}|{_DOT_WORD}|@|\.|a[ ]t|d[ ]o[ ]t)[ ]?{_CLOSE}|[ ](?:{_DOT_WORD})[ ]|_(?:{_AT_WORD})_|[ ](?:{'|'.join(_AT_ONLY)})[ ]|[ ]@|@[ ]|&(?:\#0*64|\#x0*40|commat);")

_MAIL_SIGNS = "[({<_@&"
_MAIL_WORDS = tuple(f" {w} " for w in (*_DOT_WORD.split("|"), *_AT_ONLY))


def may_hide_mail(text: str, low: str) -> bool:
    return (any(c in text for c in _MAIL_SIGNS) or any(w in low for w in _MAIL_WORDS)) and _MAIL_HINT.search(text) is not None


class Rewrite:
    """Edits (begin, end, replacement) of a text, in order; maps spans back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, at, out = [], 0, 0
        self.begin, self.stop, self.source = [], [], []
        for a, b, new in edits:
            parts += (text[at:a], new)
            out += a - at
            self.begin.append(out)
            out += len(new)
            self.stop.append(out)
            self.source.append((a, b))
            at = b
        parts.append(text[at:])
        self.text = "".join(parts)

    def place(self, p: int) -> Span:
        """Source span of the character at ``p`` of the new text."""
        i = bisect_right(self.begin, p) - 1
        if i < 0:
            return p, p + 1
        a, b = self.source[i]
        if p < self.stop[i]:
            return a, b
        return p - self.stop[i] + b, p - self.stop[i] + b + 1

    def back(self, span: Span) -> Span:
        return self.place(span[0])[0], self.place(span[1] - 1)[1]


def plain_letters(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _ODD.finditer(text):
        c = m[0]
        new = LOOKALIKES[c] if c in LOOKALIKES else unicodedata.normalize("NFKC", c)
        out.append((m.start(), m.end(), new))
    return out


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in _SPELLED_RUN.finditer(text):
        parts = list(_SPELLED_PART.finditer(text, run.start(), run.end()))
        if sum(bool(m[1]) for m in parts) < 4:
            continue
        for m in parts:
            out.append((m.start(), m.end(), SPELLED.get(m[1].lower(), "+") if m[1] else m[2] or ("." if m[3] else "")))
    return out


def at_and_dot(text: str) -> list[tuple[int, int, str]]:
    """A bare ``at``, or a sign between blanks, counts only where a dot is
    disguised as well; words that mean nothing else count by themselves."""
    out = []
    for m in _MAIL.finditer(text):
        dots = [(d.start(), d.end()) for g in (1, 3) for d in _DOTS.finditer(text, *m.span(g))]
        hidden = any(b - a > 1 for a, b in dots)
        shown = m[2].strip()
        bare = m[2] != "@" and (shown == "@" or re.fullmatch(_AT_WORD, shown, re.I))
        if not hidden and (m[2] == "@" or bare and shown.lower() not in _AT_ONLY):
            continue
        if shown.lower() == "at" and m[2] != "at" and all(text[a:b].strip().lower() in ("point", ".") for a, b in dots):
            continue  # "look at that point in time"
        if not re.search(r"[A-Za-z]{2,24}$", m[3]):
            continue
        out += sorted([(*m.span(2), "@"), *((a, b, ".") for a, b in dots)])
    return out


def disguised(text: str, base: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    """What only the rewritten text shows, in the source's code points."""
    odd = not text.isascii() and _ODD.search(text)
    low = text.lower()
    spelled = may_spell(low) or odd and may_spell(Rewrite(text, plain_letters(text)).text.lower())
    if not (odd or spelled or may_hide_mail(text, low)):
        return []
    steps: list[Rewrite] = []
    for rule in (plain_letters, *([spelled_digits] if spelled else []), at_and_dot):
        now = steps[-1].text if steps else text
        if edits := rule(now):
            steps.append(Rewrite(now, edits))
    if not steps:
        return []
    taken = sorted(s for spans in base.values() for s in spans)
    out = []
    for kind, spans in plain(steps[-1].text).items():
        for span in spans:
            shown = steps[-1].text[span[0] : span[1]]
            for step in reversed(steps):
                span = step.back(span)
            clash = any(a < span[1] and span[0] < b and not (span[0] <= a and b <= span[1] and b - a < span[1] - span[0]) for a, b in taken)
            if text[span[0] : span[1]] == shown or clash:
                continue
            out.append((kind, *span))
    return out


def find(text: str) -> tuple[dict[str, list[Span]], list[tuple[str, int, int]]]:
    """Plain spans by kind, and the added ones."""
    base = plain(text)
    return base, disguised(text, base)


def written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of
    overlapping spans the first kind names the whole."""
    base, more = find(text)
    spans = sorted([(a, b, k) for k, found in base.items() for a, b in found] + [(a, b, k) for k, a, b in more])
    if not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += (text[at:a], f"<{kind}>")
        at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone (plain
    matches), n_added, base_sha256, spans.

    A narrow map over whole texts, in time linear in their length.  A null
    text counts as empty (no spans, the hash of the empty string); null ids
    and repeated rows stay; an empty table gives none; other columns are not
    read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = find(text)
                flat = [(k, a, b) for k in KINDS for a, b in base[k]]
                rows.append((*(len(base[k]) for k in KINDS), len(more), hashlib.sha256(written(flat).encode()).hexdigest(), written(flat + more)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.string()), pa.array(cols[6], pa.string())], ["id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).mapInArrow(run, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, n_added long, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)


def redact_texts(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in its texts, all columns kept.

    Null texts stay null; a length column, where there is one, follows.
    """

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else redact(t))

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
