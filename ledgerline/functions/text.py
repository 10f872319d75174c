"""Column -> Column functions over whole document texts.

Per-line work inside a document uses array higher-order functions
(``transform``/``filter``), so a document never leaves its row: no
shuffle, and the work is spread by how the documents are partitioned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X
from .items import contains_any, strip


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _alt(words: list[str]) -> str:
    """Alternation of literal words (only regex metacharacters escaped)."""
    return "|".join(re.sub(r"([.()\[\]{}?*+|^$\\])", r"\\\1", w) for w in words)


def count_matching(c: Column, char_class: str) -> Column:
    """Number of characters of ``c`` inside ``char_class`` (a regex class body)."""
    return F.length(F.regexp_replace(c, f"[^{char_class}]", ""))


# ---------------------------------------------------------------- cleaning (O-31, O-38)

def _keep_line(x: Column) -> Column:
    n = F.length(x)
    alnum = count_matching(x, r"\p{L}\p{N}\s")
    return (x != "") & ((n < X.CLEAN_MIN_LENGTH) | (F.try_divide(alnum, n) > X.CLEAN_MIN_ALNUM_RATIO))


def clean_text(text: Column | str) -> Column:
    """Drop control characters, squeeze spaces/tabs, strip lines, drop blank
    lines and lines with at most 40 % letters/digits/spaces (unless shorter
    than 5).  (Collapsing runs of blank lines is implied by dropping blank
    lines, so it is not a separate pass.)"""
    return F.array_join(clean_lines(text), "\n")


def clean_lines(text: Column | str) -> Column:
    """The lines of ``clean_text``; none for blank text."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), X.CONTROL_CHARS, "")
    t = F.regexp_replace(t, r"[ \t]{2,}|\t", " ")     # a space by itself stays as it is
    return F.filter(F.transform(F.split(t, "\n"), strip), _keep_line)


def raw_text_confidence(text: Column | str) -> Column:
    """0 for empty text, else min(.8, 1.2 * alnum ratio) (O-38)."""
    t = _c(text)
    n = F.length(t)
    ratio = F.try_divide(count_matching(t, r"\p{L}\p{N}"), n)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.least(F.lit(X.RAW_CONFIDENCE_CAP), ratio * X.RAW_CONFIDENCE_FACTOR))


# ---------------------------------------------------------------- suppliers (O-39, O-40)

def normalize_supplier(name: Column | str) -> Column:
    """Upper-case, remove legal/common words, squeeze whitespace (O-40)."""
    n = F.upper(strip(F.coalesce(_c(name), F.lit(""))))
    n = F.regexp_replace(n, X.SUPPLIER_LEGAL_WORDS, "")
    n = F.regexp_replace(n, X.SUPPLIER_COMMON_WORDS, "")
    return strip(F.regexp_replace(n, r"\s+", " "))


def _labelled(header: Column, k: int, low: Column | None = None) -> Column:
    """The supplier after a label, '' when there is none (a scan for the
    labels' words goes before the regex); ``low`` is the lower-cased header
    where that is at hand."""
    g = F.when(contains_any(F.lower(header) if low is None else low, _LABELS[k]), F.regexp_extract(header, _LABELLED[k], 1)).otherwise(F.lit(""))
    v = F.regexp_replace(strip(g), r"[,.\s]+$", "")
    return F.upper(F.regexp_extract(v, r"(?s)^.{4,}$", 0))


def _given_as(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


_LABELLED = [X.SUPPLIER_LABELLED[0].replace("(?id)(?:", "(?id)(?=[svfb])(?:", 1),
             X.SUPPLIER_LABELLED[1].replace("(?id)(?:", "(?id)(?=[cb])(?:", 1)]
_LABELS = [["sold", "vendor", "supplier", "from"], ["company", "business"]]
_LEGAL = X.SUPPLIER_LEGAL_LINE.replace("{3,50}(?:", "{3,50}(?=[LICEDTS])(?:", 1)
#: One of these is in every match; "co" stands for the words that begin with it.
_LEGAL_WORDS = ["llc", "inc", "ltd", "limited", "co", "enterprises", "trading", "distributors", "supplies", "supply"]


def _legal(header: Column, low: Column | None = None) -> Column:
    """The first line that ends in a legal form; with ``low``, the lower-cased
    header, a scan for their words goes before the regex."""
    found = F.regexp_extract(header, _LEGAL, 1)
    return F.upper(strip(found if low is None else F.when(contains_any(low, _LEGAL_WORDS), found).otherwise(F.lit(""))))


# In both, the tests that are cheap and fail most lines go first; the regex alternation and the counts, which build
# strings, run on what is left.

def _tier3_ok(s: Column) -> Column:
    n = F.length(s)
    return ((n > 5) & s.rlike(r"^\p{Lu}")
            & contains_any(F.upper(s), X.SUPPLIER_TIER3_MARKERS)
            & ~(count_matching(s, r"\p{Nd}") > n * 0.5)
            & (F.try_divide(count_matching(s, r"\p{L}"), n) > 0.6)
            & ~s.rlike(X.SUPPLIER_TIER3_SKIP))


def _tier4_ok(s: Column) -> Column:
    n = F.length(s)
    return ((n > 8) & s.rlike(r"^\p{Lu}")
            & ~contains_any(F.lower(s), X.SUPPLIER_TIER4_SKIP)
            & (F.try_divide(count_matching(s, r"\p{L}\s"), n) > 0.7))


def supplier_header(lines: Column) -> Column:
    return F.array_join(F.slice(lines, 1, X.SUPPLIER_HEADER_LINES), "\n")


def supplier_from_lines(lines: Column, header: Column | None = None) -> Column:
    """Four tiers over the first 30 lines (O-39); null when none applies.
    Pass ``header`` as a staged column to build it once per document."""
    header = supplier_header(lines) if header is None else header
    return F.coalesce(*[_given_as(c) for c in (_labelled(header, 0), _labelled(header, 1), _legal(header))],
                      *_by_line(lines))


def _by_line(lines: Column) -> list[Column]:
    """The third and fourth tier."""
    def first_line(n: int, ok) -> Column:
        return F.upper(F.get(F.filter(F.transform(F.slice(lines, 1, n), strip), ok), 0))

    return [first_line(X.SUPPLIER_TIER3_LINES, _tier3_ok), first_line(X.SUPPLIER_TIER4_LINES, _tier4_ok)]


def stage_supplier(df, header: str, low: str, asked: Column):
    """Adds the first three tiers as columns ``_sup1..3``, one projection
    each: a tier's regex runs once per document, and only when the earlier
    ones failed (and ``asked``).  ``low`` is the column of the lower-cased
    header, which every word of every tier is looked for in."""
    none, missing = F.lit(""), asked
    text = F.col(header), F.col(low)
    for k, tier in enumerate((_labelled(text[0], 0, text[1]), _labelled(text[0], 1, text[1]), _legal(*text)), 1):
        df = df.select("*", F.when(missing, tier).otherwise(none).alias(f"_sup{k}"))
        missing = missing & (F.col(f"_sup{k}") == "")
    return df


def supplier_from_stages(lines: Column) -> Column:
    """``supplier_from_lines`` from the staged tiers."""
    return F.coalesce(*[_given_as(F.col(f"_sup{k}")) for k in (1, 2, 3)], *_by_line(lines))


def extract_supplier(text: Column | str) -> Column:
    return supplier_from_lines(F.split(_c(text), "\n"))


def with_supplier(df, text: str, out: str = "supplier_name"):
    """``df`` plus ``extract_supplier`` of its column ``text``: lines, header
    and tiers are columns, so that each is made once for a document."""
    lines = df.select("*", F.split(text, "\n").alias("_lines"))
    head = lines.select("*", supplier_header(F.col("_lines")).alias("_header"))
    head = head.select("*", F.lower("_header").alias("_low"))
    return stage_supplier(head, "_header", "_low", F.lit(True)).select(
        *df.columns, supplier_from_stages(F.col("_lines")).alias(out))


# ---------------------------------------------------------------- table (O-36, O-41, O-11)

def header_slice(lines: Column, n: int) -> Column:
    """First ``n`` lines (O-36)."""
    return F.slice(lines, 1, n)


def _count_newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def footer_region(lowered: Column) -> Column:
    """Lower-cased text up to the end of the first line holding a footer
    word, '' when there is none (one lazy scan; the lookahead rejects most
    positions before the alternation is tried)."""
    words = _alt(X.TABLE_FOOTER_WORDS)
    return F.regexp_extract(lowered, r"(?s)^(.*?(?=[sctgi])(?:%s)[^\n]*)" % words, 1)


def table_end(lowered: Column, region: Column) -> Column:
    """Index of the first footer line, else the line count (O-41)."""
    return F.when(region != "", _count_newlines(region)).otherwise(_count_newlines(lowered) + 1)


def table_start(lowered: Column, region: Column) -> Column:
    """1 + the last line at or before the footer line holding a header
    word, else 0 (O-41)."""
    return start_after(header_prefix(lowered, region))


def header_prefix(lowered: Column, region: Column) -> Column:
    """The text up to the end of the last header word at or before the footer
    line (the greedy prefix ends there), '' when there is none."""
    scope = F.when(region != "", region).otherwise(lowered)
    return F.regexp_extract(scope, r"(?s)^(.*(?=[sidpr])(?:%s))" % _alt(X.TABLE_HEADER_WORDS), 1)


def start_after(prefix: Column) -> Column:
    return F.when(prefix != "", _count_newlines(prefix) + 1).otherwise(F.lit(0))


def table_bounds(text: Column) -> Column:
    """struct<start, end> of the item table in ``text`` (O-41): positions of
    the footer and header words and newline counts, no per-line lambda."""
    lowered = F.lower(text)
    region = footer_region(lowered)
    return F.struct(table_start(lowered, region).alias("start"), table_end(lowered, region).alias("end"))


def is_candidate_line(s: Column, low: Column | None = None) -> Column:
    """Stripped line of length >=5 with a digit and no skip word (O-11);
    ``low`` is its lower-cased form where that is at hand."""
    return ((F.length(s) >= X.LINE_MIN_LENGTH) & ~contains_any(F.lower(s) if low is None else low, X.LINE_SKIP_WORDS)
            & s.rlike(r"\d"))


def candidate_lines(lines: Column, start: Column, end: Column) -> Column:
    """array<struct<line_no int, line string>> of in-table candidate lines
    (array form; the job explodes the slice and filters with columns)."""
    numbered = F.transform(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))),
                           lambda x, i: F.struct((i + start).alias("line_no"), strip(x).alias("line")))
    return F.filter(numbered, lambda s: is_candidate_line(s["line"]))
