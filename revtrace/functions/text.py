"""Text normalisation as Column expressions (JVM side; entity decoding is the one Arrow UDF)."""
from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

MIN_QUOTE_CHARS = 15
SENTENCE_BREAK = r"(?U)(?<=[.!?])\s+(?=[A-Z\[(])"


def let(value: Column, body) -> Column:
    """Bind a value to a name: body(value) with the value computed once. Without it, a Column used in several places is
    copied into each of them, and nested uses grow the expression exponentially."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def strip(c: Column) -> Column:
    """Remove whitespace of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm(c: Column) -> Column:
    """Lower case; runs of non-alphanumerics become one space; trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def squash(c: Column) -> Column:
    """Lower-case alphanumerics only."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")


@pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Decode named and numeric character references."""
    return s.map(lambda v: html.unescape(v) if v is not None and "&" in v else v)


def clean_text(c: Column) -> Column:
    """Record text: decode entities, then delete tags (no space is left), collapse, strip; empty becomes null."""
    return blank_to_null(strip(collapse(F.regexp_replace(unescape_html(c), "<[^>]+>", ""))))


def plain(c: Column) -> Column:
    """Full-text markup: every tag becomes a space, then entities are decoded and whitespace collapsed."""
    return collapse(unescape_html(F.regexp_replace(c, "<[^>]+>", " ")))


def sentence_array(c: Column) -> Column:
    """Sentences of a text: split at whitespace after . ! ? before a capital or an opening bracket."""
    parts = F.transform(F.split(c, SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: s != "")


def quote_in(quote: Column, text: Column) -> Column:
    """A quote stands in a text: at least 15 normalised characters, contained with spaces or with none."""
    return F.coalesce(let(norm(quote), lambda q: (F.length(q) >= MIN_QUOTE_CHARS) & (
        F.contains(norm(text), q) | F.contains(squash(text), squash(quote)))), F.lit(False))


def content_words(c: Column, stop: list[str]) -> Column:
    """Lower-case alphanumeric words without stop words, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stop))


def find_all(text: Column, pattern: Column, first: int | None = None) -> Column:
    """Non-overlapping matches of a pattern (it may differ per row): array of (start, end, match), start from 0.

    With `first`, only that many. Gap lengths and match lengths come from two regexp_extract_all calls, so no row-wise Python is needed."""
    # \G ties each gap to the match before it; without it the text behind the last match is scanned from every position
    scan = F.concat(F.lit(r"\G([\s\S]*?)("), pattern, F.lit(")"))
    gaps = F.regexp_extract_all(text, scan, F.lit(1))
    hits = F.regexp_extract_all(text, scan, F.lit(2))
    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    if first is not None:
        both = F.slice(both, 1, first)
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string>>")
    fold = F.aggregate(
        both,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: let(acc["at"] + F.length(x["gap"]), lambda start: F.struct(
            (start + F.length(x["hit"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("match")))).alias("out"))),
    )
    return fold["out"]


def before(text: Column, start: Column, n: int) -> Column:
    """Up to n characters in front of a position."""
    return let(F.greatest(start - F.lit(n), F.lit(0)), lambda lo: F.substring(text, lo + 1, start - lo))


def after(text: Column, end: Column, n: int | None = None) -> Column:
    """The text from a position on (at most n characters)."""
    return F.substring(text, end + 1, F.lit(n) if n else F.length(text))


def escape_regex(c: Column) -> Column:
    """Escape regex metacharacters of a literal."""
    return F.regexp_replace(c, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")
