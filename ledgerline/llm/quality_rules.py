"""Quality rules: a threshold table compiled into one projection.

``measures`` are columns computed from a document's text; ``RULES`` is a
table of (name, numerator, denominator, comparison, threshold).  A rule
fails a document when ``numerator <comparison> threshold * denominator``,
compared in whole numbers (thresholds are in thousandths).  All rules become
boolean columns of one projection; there is no shuffle and no user function.

Per document: word, line and window counts come from arrays of the words.
Repeated 3-word windows are first tested by their hashes; only documents
with a repeated hash sort their windows, and equality is then decided on the
words themselves.

Defined results: a null or empty text has no words, all counts are 0 and it
fails ``too_short``; repeated rows each get their own result; very long texts
are counted whole (a row's arrays grow with its text); an empty table gives an
empty one; other input columns are kept, whatever their names, but those named
like an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside, table

SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served.
STOP_WORDS = {
    "en": ["the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "on", "for", "as", "was", "are",
           "by", "this", "a", "an", "from", "or", "not", "at"],
    "de": ["der", "die", "das", "und", "ist", "in", "zu", "den", "von", "mit", "ein", "eine", "auf", "nicht", "des",
           "im", "sich", "dem", "es", "auch"],
    "fr": ["le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "dans", "pour", "par", "sur",
           "est", "ou", "au", "aux"],
    "es": ["el", "la", "los", "las", "de", "del", "y", "un", "una", "que", "en", "con", "para", "por", "se", "su",
           "al", "es", "no", "lo"],
}


@dataclass(frozen=True)
class Rule:
    """Fails when ``over`` <, > ``per_mille`` / 1000 * ``under``."""
    name: str
    over: str
    sign: str
    per_mille: int
    under: str


#: The base rules decide ``base_failed``; the others are the method's own.
BASE_RULES = [
    Rule("too_short", "n_words", "<", 50_000, "one"),
    Rule("repeated_words", "n_repeat_words", ">", 500, "n_words"),
]
RULES = [
    Rule("many_symbols", "n_symbols", ">", 200, "n_words"),
    Rule("many_shouts", "n_shouts", ">", 300, "n_words"),
    Rule("few_stop_words", "n_stop_words", "<", 60, "n_words"),
    Rule("duplicate_lines", "n_dup_lines", ">", 500, "n_lines"),
    Rule("long_words", "word_chars", ">", 14_000, "n_words"),
    Rule("short_words", "word_chars", "<", 2_000, "n_words"),
]


def _failed(rule: Rule) -> Column:
    left, right = F.col(rule.over) * 1000, F.col(rule.under) * rule.per_mille
    return left < right if rule.sign == "<" else left > right


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def measures(df: DataFrame, text: str = "text", stop_words: dict[str, list[str]] = STOP_WORDS) -> DataFrame:
    """``df`` plus the counts that rules speak of."""
    df, there, back = set_aside(df, ("_words", "_lines", "_flat", "_hashes", "_sorted"))
    text = there.get(text, text)
    added = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines", "n_dup_lines",
             "n_repeat_words", "one")
    keep = [c for c in df.columns if c not in added]
    stops = sorted({w for ws in stop_words.values() for w in ws})
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(F.translate(whole, "\t\n\x0b\x0c\r", "     "), " "), "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*keep, words.alias("_words"), lines.alias("_lines"))
    df = df.select(
        *keep, "_words", "_lines", F.size("_words").cast("long").alias("n_words"),
        F.array_join("_words", "").alias("_flat"),
        F.when(F.size("_words") >= 3, F.transform(
            F.sequence(F.lit(0), F.size("_words") - 3),
            lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
        .otherwise(F.array().cast("array<bigint>")).alias("_hashes"))
    df = df.select(
        *keep, "_words", "n_words", F.length("_flat").cast("long").alias("word_chars"),
        (F.length("_flat") - F.length(F.translate("_flat", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _count_of(F.col("_flat"), "!").cast("long").alias("n_shouts"),
        F.size(F.filter("_words", lambda w: w.isin(*stops))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.sort_array(F.transform(
            "_hashes", lambda h, i: F.struct(
                h.alias("h"), F.concat_ws(" ", F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
                .alias("w"), i.alias("i"))))).alias("_sorted"))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))
    again = F.filter("_sorted", lambda x, j: same(x, F.get("_sorted", j - 1)) | same(x, F.get("_sorted", j + 1)))
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    made = df.select(*keep, "n_words", "word_chars", "n_symbols", "n_shouts", "n_stop_words", "n_lines",
                     "n_dup_lines", F.coalesce(F.size(covered), F.lit(0)).cast("long").alias("n_repeat_words"))
    return made.withColumnsRenamed(back)


def apply_rules(measured: DataFrame, base: list[Rule] = BASE_RULES, rules: list[Rule] = RULES) -> DataFrame:
    """Adds ``failed`` (names of failed rules), ``base_failed`` and ``kept``."""
    keep = [c for c in measured.columns if c not in ("failed", "base_failed", "kept", "one")]
    df = measured.withColumn("one", F.lit(1))
    names = F.array_compact(F.array(*[F.when(_failed(r), F.lit(r.name)) for r in [*base, *rules]]))
    return df.select(*keep, names.alias("failed"), _any([_failed(r) for r in base]).alias("base_failed")).select(
        *keep, "failed", "base_failed", (F.size("failed") == 0).alias("kept"))


def _any(conds: list[Column]) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | c
    return out


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(measures(docs).drop("text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    fails = " OR ".join(f"{r.over} * 1000 {r.sign} {r.under} * {r.per_mille}" for r in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i,
  unnest(list_transform(range(1, len(words) - 1), lambda k: words[k] || ' ' || words[k+1] || ' ' || words[k+2])) AS g
  FROM w WHERE len(words) >= 3),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
  length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
  length(text) - length(replace(text, '!', '')) AS n_shouts,
  len(list_filter(words, lambda x: x IN ({stops}))) AS n_stop_words,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR {fails}) AS kept FROM b"""


SQL = _sql()
