"""Text transforms as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the paragraph rules: least paragraph, target of a sentence
#: group and shortest fragment, in characters.
PARAGRAPH_MIN, GROUP_TARGET, FRAGMENT_MIN = 80, 600, 20

#: All blanks that count at the ends of a text, by code point.
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    """Strip all Unicode blanks, not only spaces."""
    return F.btrim(_col(c), F.lit(BLANKS))


def collapse_blanks(c: Column | str) -> Column:
    """Runs of spaces and tabs become one space; ends are stripped."""
    return trim_ws(F.regexp_replace(_col(c), "[ \t]+", " "))


def clean_page(c: Column | str) -> Column:
    """Line ends unified, hyphenated words joined, single line breaks folded."""
    t = F.replace(_col(c), F.lit("\r"), F.lit("\n"))
    t = F.regexp_replace(t, r"(?U)(\w)-\n(\w)", "$1$2")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    return collapse_blanks(t)


def present(parts: Column) -> Column:
    return F.filter(F.transform(parts, trim_ws), lambda x: x != "")


def blank_line_parts(c: Column | str) -> Column:
    return present(F.split(_col(c), r"(?U)\n\s*\n"))


def sentences(c: Column | str) -> Column:
    """Split at blanks between an end mark and an ASCII capital."""
    return F.split(_col(c), r"(?U)(?<=[.!?])\s+(?=[A-Z])")


def sentence_groups(c: Column | str, target: int = GROUP_TARGET, least: int = PARAGRAPH_MIN) -> Column:
    """Greedy groups of sentences: closed at ``target``, dropped below ``least``."""
    empty = F.array().cast("array<string>")

    def kept(groups: Column, text: Column) -> Column:
        return F.when(F.length(text) >= least, F.concat(groups, F.array(text))).otherwise(groups)

    def step(state: Column, s: Column) -> Column:
        text = F.when(state["open"] == "", s).otherwise(F.concat(state["open"], F.lit(" "), s))
        full = F.length(text) + 1 >= target
        return F.struct(F.when(full, kept(state["groups"], text)).otherwise(state["groups"]).alias("groups"), F.when(full, F.lit("")).otherwise(text).alias("open"))

    return F.aggregate(present(sentences(c)), F.struct(empty.alias("groups"), F.lit("").alias("open")), step, lambda s: kept(s["groups"], s["open"]))


def paragraphs(c: Column | str) -> Column:
    """Paragraphs of a page: by blank lines if the original has any, else by
    sentence groups; short ones are dropped.  Null and blank pages have none."""
    raw = F.coalesce(_col(c), F.lit(""))
    cleaned = clean_page(raw)
    by_lines = F.filter(blank_line_parts(cleaned), lambda p: F.length(p) >= PARAGRAPH_MIN)
    return F.when(F.contains(raw, F.lit("\n\n")), by_lines).otherwise(sentence_groups(cleaned))


def merged_paragraphs(c: Column | str, least: int = FRAGMENT_MIN) -> Column:
    """Blank-line paragraphs on one line each; a shorter fragment joins the one before."""
    pages = F.split(F.replace(F.coalesce(_col(c), F.lit("")), F.lit("\r"), F.lit("")), r"(?U)\n\s*\n+")

    def one_line(part: Column) -> Column:
        lines = F.filter(F.transform(F.split(part, "\n"), collapse_blanks), lambda x: x != "")
        return collapse_blanks(F.array_join(lines, " "))

    found = F.filter(F.transform(pages, one_line), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("last"))

    def step(state: Column, p: Column) -> Column:
        join = state["last"].isNotNull() & (F.length(p) < least)
        done = F.when(join | state["last"].isNull(), state["done"]).otherwise(F.concat(state["done"], F.array(state["last"])))
        return F.struct(done.alias("done"), F.when(join, F.concat(state["last"], F.lit(" "), p)).otherwise(p).alias("last"))

    return F.aggregate(found, start, step, lambda s: F.when(s["last"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["last"]))))


def truncate(c: Column | str, most: int = 500) -> Column:
    t = _col(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most), F.lit("...")))


def quoted(token: Column) -> Column:
    """A token as a literal pattern."""
    return F.regexp_replace(token, r"([^\p{L}\p{N}_])", r"\\$1")


def query_tokens(query: Column | str, least: int = 3) -> Column:
    return F.filter(F.split(trim_ws(query), r"(?U)\s+"), lambda t: F.length(t) >= least)


def highlight(text: Column | str, query: Column | str, escape: bool = False) -> Column:
    """Mark each query token, one after the other, whatever its case.

    With ``escape`` the text is HTML-escaped first, so only marks are markup.
    """
    t = _col(text)
    if escape:
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            t = F.replace(t, F.lit(plain), F.lit(entity))
    return F.aggregate(query_tokens(query), t, lambda acc, token: F.regexp_replace(acc, F.concat(F.lit("(?iu)"), quoted(token)), F.lit("<mark>$0</mark>")))


def terms(c: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
