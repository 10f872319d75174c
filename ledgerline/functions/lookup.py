"""Column functions for unit resolution (O-53, O-54, O-56, O-57, O-18)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X

ANSWER_SCHEMA = "uom string, pack_quantity bigint, confidence double, reasoning string"
RESULT_FIELDS = ["success", "uom", "pack_quantity", "confidence", "source", "reasoning", "error"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def search_terms(mpn: Column, description: Column, hsn: Column, sac: Column) -> Column:
    """array<string>: part number, up to 5 words of the de-noised lower-cased
    description, HSN, SAC (O-53)."""
    desc = F.lower(F.coalesce(description, F.lit("")))
    for w in X.SEARCH_NOISE_WORDS:           # sequential, as in the rule
        desc = F.replace(desc, F.lit(w), F.lit(""))
    words = F.slice(F.regexp_extract_all(desc, F.lit(X.SEARCH_WORD), F.lit(0)), 1, X.SEARCH_MAX_WORDS)
    first = F.when(_present(mpn), F.array(mpn)).otherwise(F.array().cast("array<string>"))
    codes = F.concat(F.when(_present(hsn), F.array(hsn)).otherwise(F.array().cast("array<string>")),
                     F.when(_present(sac), F.array(sac)).otherwise(F.array().cast("array<string>")))
    return F.concat(first, words, codes)


def confidence_level(c: Column | str) -> Column:
    """high / medium / low / very_low (O-54)."""
    c = _c(c)
    out = None
    for bound, name in X.CONFIDENCE_LEVELS:
        out = F.when(c >= bound, F.lit(name)) if out is None else out.when(c >= bound, F.lit(name))
    return out.otherwise(F.lit("very_low"))


def result(success, uom=None, qty=None, conf=0.0, source=None, reasoning=None, error=None) -> Column:
    """A lookup-result struct with the fields of ``RESULT_FIELDS``."""
    def lit(v, t):
        return v if isinstance(v, Column) else F.lit(v).cast(t)
    return F.struct(lit(success, "boolean").alias("success"), lit(uom, "string").alias("uom"),
                    lit(qty, "bigint").alias("pack_quantity"), lit(conf, "double").alias("confidence"),
                    lit(source, "string").alias("source"), lit(reasoning, "string").alias("reasoning"),
                    lit(error, "string").alias("error"))


# ------------------------------------------------------------------ catalogue (O-18)

def _escape(w: str) -> str:
    return re.sub(r"([.()\[\]{}?*+|^$\\])", r"\\\1", w)


def rules_case(description: Column, rules: list[tuple]) -> Column:
    """First rule (by priority) with a keyword contained in the lower-cased
    description -> success result; no rule -> failure result.  The rules are
    a bounded dimension, inlined as one ``CASE`` (codegen'd, no join)."""
    desc = F.lower(F.coalesce(description, F.lit("")))
    out = None
    for _prio, words, uom, qty, conf, reasoning, _tag in sorted(rules, key=lambda r: r[0]):
        hit = desc.rlike("|".join(_escape(w.lower()) for w in words))
        val = result(True, uom, qty, conf, X.SOURCE_ONLINE, reasoning)
        out = F.when(hit, val) if out is None else out.when(hit, val)
    fail = result(False, conf=0.0, source=X.SOURCE_ONLINE, error=X.MSG_NO_RULE)
    return fail if out is None else out.otherwise(fail)


def rule_tag_case(description: Column, rules: list[tuple]) -> Column:
    desc = F.lower(F.coalesce(description, F.lit("")))
    out = None
    for _prio, words, *_rest, tag in sorted(rules, key=lambda r: r[0]):
        hit = desc.rlike("|".join(_escape(w.lower()) for w in words))
        out = F.when(hit, F.lit(tag)) if out is None else out.when(hit, F.lit(tag))
    return out


# ------------------------------------------------------------------ model answers (O-56)

def validate_answer(answer: Column | str) -> Column:
    """Answer JSON -> lookup-result struct (source llm_inferred).

    Not an object -> failure; ``uom`` outside the 13 codes (or present but
    null) -> failure; missing fields default to UNK / 1 / 0.0 / ''; a present
    but non-numeric confidence -> failure; confidence clamped to [0, 1]."""
    a = _c(answer)
    keys = F.json_object_keys(a)
    p = F.from_json(a, ANSWER_SCHEMA)

    def has(k: str) -> Column:
        return F.coalesce(F.array_contains(keys, k), F.lit(False))

    uom = F.when(has("uom"), p["uom"]).otherwise(F.lit("UNK"))
    qty = F.when(has("pack_quantity"), p["pack_quantity"]).otherwise(F.lit(1).cast("bigint"))
    conf = F.when(has("confidence"), p["confidence"]).otherwise(F.lit(0.0))
    reasoning = F.when(has("reasoning"), p["reasoning"]).otherwise(F.lit(""))
    ok_uom = uom.isin(*X.UOM_CODES)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))
    return (F.when(a.isNull(), result(False, source=X.SOURCE_LLM, error=X.MSG_NO_ANSWER))
            .when(keys.isNull(), result(False, source=X.SOURCE_LLM, error="LLM answer is not a JSON object"))
            .when(~F.coalesce(ok_uom, F.lit(False)), result(False, source=X.SOURCE_LLM, error=X.MSG_BAD_UOM))
            .when(conf.isNull(), result(False, source=X.SOURCE_LLM, error="LLM answer has an invalid confidence"))
            .otherwise(result(True, uom, qty, clamped, X.SOURCE_LLM, reasoning)))


# ------------------------------------------------------------------ prompts (O-57)

PROMPT_HEAD = "Find the unit of measure and the pack size of this invoice line."
PROMPT_TAIL = [
    "",
    "Answer as JSON with the keys uom, pack_quantity, confidence and reasoning.",
    "uom is one of " + ", ".join(X.UOM_CODES) + " (UNK when unsure).",
    "pack_quantity is the number of base units in one pack, from 1 to 10000.",
    "confidence is between 0 and 1; keep it low when the line says little.",
    "Use only what the line states; do not guess missing facts.",
]


def build_prompt(description: Column, mpn: Column, supplier: Column, hsn: Column, sac: Column,
                 raw_line: Column) -> Column:
    """Prompt text per item; optional parts are left out when empty (O-57)."""
    def opt(label: str, c: Column) -> Column:
        return F.when(_present(c), F.concat(F.lit(label), c))
    code = F.coalesce(F.when(_present(hsn), hsn), F.when(_present(sac), sac))
    return F.concat_ws(
        "\n", F.lit(PROMPT_HEAD), F.lit(""),
        F.concat(F.lit("Description: "), F.coalesce(F.when(_present(description), description), F.lit("N/A"))),
        opt("Part number: ", mpn), opt("Supplier: ", supplier), opt("HSN/SAC: ", code),
        opt("Line: ", raw_line), *[F.lit(t) for t in PROMPT_TAIL])
