"""Column -> Column functions for one invoice line.

All are native Spark expressions (regexes, ``CaseWhen``, ``Coalesce``), so
they run inside whole-stage codegen; nothing here calls Python per row.

Each regular expression over the line is evaluated at most once per row:
fallback chains are staged one projection per step (``stage_line_matches``),
a step running only when the earlier ones failed, and a short match is then
taken apart with cheap regexes.  The single-column helpers (``extract_pack``,
``extract_mpn``, ...) give the same results for ad-hoc use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as X


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _nz(c: Column) -> Column:
    """Python truthiness of a number: present and non-zero."""
    return c.isNotNull() & (c != 0)


WHITESPACE = " \t\n\x0b\f\r"   # the characters of Java's \s


def strip(c: Column | str) -> Column:
    """``str.strip()`` over ASCII whitespace: ``trim`` with that set (a
    codegen'd scan, no regex)."""
    return F.trim(_c(c), F.lit(WHITESPACE))


def contains_any(c: Column, words: list[str]) -> Column:
    """Substring test for a word list as OR-ed ``contains`` (byte scans; far
    cheaper than a regex alternation tried at every position)."""
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


# Spark-side forms of three alternation patterns: a leading character-class
# lookahead lets Java reject most start positions before trying every
# alternative.  The set of matches is unchanged.
GUARDED = {
    X.PACK_BARE: X.PACK_BARE.replace(r"\b(?:", r"\b(?=[ECPBDSRMKL])(?:", 1),
    X.MPN_EXPLICIT: X.MPN_EXPLICIT.replace("(?i)(?:", "(?i)(?=[MP])(?:", 1),
    X.AMOUNT_CURRENCY: X.AMOUNT_CURRENCY.replace("(?:", "(?=[₹IRUEG])(?:", 1),
}


# ---------------------------------------------------------------- units

def uom_alias_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in X.UOM_ALIASES.items() for x in kv])


def uom_multiplier_map() -> Column:
    return F.create_map(*[F.lit(x) for kv in X.UOM_MULTIPLIERS.items() for x in kv])


def normalize_uom(c: Column | str) -> Column:
    """Unit text -> code; blank or unknown -> 'UNK' (O-47 / O-16)."""
    key = F.upper(strip(_c(c)))
    return F.coalesce(F.try_element_at(uom_alias_map(), key), F.lit("UNK"))


def pack_multiplier(code: Column | str) -> Column:
    """Code -> units per pack; anything else 1 (O-17)."""
    return F.coalesce(F.try_element_at(uom_multiplier_map(), _c(code)), F.lit(1)).cast("bigint")


def pack_match(line: Column | str) -> Column:
    """Tagged first-branch match: '1'+slash, '2'+prefix, '3'+suffix, '4'+bare."""
    line = _c(line)
    branches = [X.PACK_SLASH, X.PACK_PREFIX, X.PACK_SUFFIX, GUARDED[X.PACK_BARE]]
    return F.coalesce(*[
        F.concat(F.lit(str(i + 1)), F.nullif(F.regexp_extract(line, p, 0), F.lit("")))
        for i, p in enumerate(branches)
    ])


def pack_unit(tagged: Column | str) -> Column:
    """The unit's code in a tagged match, which has one run of letters (and of digits, after the tag) whatever its branch."""
    return normalize_uom(F.regexp_extract(_c(tagged), "[A-Za-z]+", 0))


def pack_from_match(tagged: Column | str, unit: Column | None = None) -> Column:
    """struct<quantity bigint, unit string, confidence double, source string> or null (O-46).
    Pass ``unit`` as a staged column (``pack_unit``) to look it up once."""
    t = _c(tagged)
    tag = F.substring(t, 1, 1)
    unit = pack_unit(t) if unit is None else unit
    qty = F.when(tag == "4", pack_multiplier(unit)).otherwise(F.regexp_extract(t, r"^\d\D*(\d+)", 1).try_cast("bigint"))
    conf = (F.when(tag == "1", F.lit(X.PACK_CONFIDENCE["slash"]))
            .when(tag == "2", F.lit(X.PACK_CONFIDENCE["prefix"]))
            .when(tag == "3", F.lit(X.PACK_CONFIDENCE["suffix"]))
            .otherwise(F.lit(X.PACK_CONFIDENCE["bare"])))
    pack = F.struct(qty.alias("quantity"), unit.alias("unit"), conf.alias("confidence"),
                    F.lit(X.SOURCE_PATTERN).alias("source"))
    return F.when(t.isNotNull(), pack)


def extract_pack(line: Column | str) -> Column:
    return pack_from_match(pack_match(line))


# ---------------------------------------------------------------- codes

_VALID_MPN = r"^(?![0-9]+$).{%d,}$" % X.MPN_MIN_LENGTH


def extract_mpn(line: Column | str) -> Column:
    """First pattern whose first match is >=4 chars and not all digits (O-45)."""
    line = _c(line)
    return F.coalesce(*[
        F.nullif(F.regexp_extract(F.regexp_extract(line, p, 1), _VALID_MPN, 0), F.lit(""))
        for p in (GUARDED[X.MPN_EXPLICIT], X.MPN_EMBEDDED, X.MPN_ALNUM)
    ])


def tax_code(line: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_c(line), X.TAX_CODE, 1), F.lit(""))


def hsn_code(code: Column) -> Column:
    return F.when(F.length(code) < X.SAC_MIN_LENGTH, code)


def sac_code(code: Column) -> Column:
    return F.when(F.length(code) >= X.SAC_MIN_LENGTH, code)


# ---------------------------------------------------------------- description

def description_ok(part: Column) -> Column:
    return ((F.length(part) > 5) & ~part.rlike(X.DESC_NUMERIC_ONLY)
            & (~part.rlike(X.DESC_CODE_LIKE) | (F.length(part) > 15)))


def split_parts(line: Column | str) -> Column:
    """Split on 2+ whitespace or tab, strip, drop empties (O-42)."""
    return F.filter(F.transform(F.split(_c(line), X.PART_SPLIT), strip), lambda p: p != "")


def extract_description(line: Column | str) -> Column:
    """First part that looks like a description, or null (O-43).  A line
    without a separator is a single part, so the array path is taken only
    when a separator exists."""
    line = _c(line)
    single = F.when(description_ok(line), line)
    multi = F.get(F.filter(split_parts(line), description_ok), 0)
    return F.when(has_separator(line), multi).otherwise(single)


def has_separator(line: Column) -> Column:
    """Same as ``rlike('\\s{2,}|\\t')``: a tab, or two whitespace in a row."""
    return line.contains("\t") | line.rlike(r"\s\s")


# ---------------------------------------------------------------- amounts

def extract_amounts(line: Column | str) -> Column:
    """array<double> of currency amounts, else of plain numbers in range (O-48)."""
    line = _c(line)

    def parse(arr: Column) -> Column:
        return F.filter(F.transform(arr, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")),
                        lambda x: x.isNotNull())

    cur = parse(F.regexp_extract_all(line, F.lit(GUARDED[X.AMOUNT_CURRENCY]), F.lit(1)))
    num = F.filter(parse(F.regexp_extract_all(line, F.lit(X.AMOUNT_NUMERIC), F.lit(1))),
                   lambda x: (x >= X.AMOUNT_NUMERIC_MIN) & (x <= X.AMOUNT_NUMERIC_MAX))
    return F.when(F.size(cur) > 0, cur).otherwise(num)


def assign_amounts(amounts: Column | str) -> Column:
    """struct<quantity, unit_price, total_amount, taxable_amount> (O-49)."""
    a = _c(amounts)
    n = F.size(a)
    a0, a1, a2 = F.get(a, 0), F.get(a, 1), F.get(a, 2)
    last = F.get(a, n - 1)
    two_is_qty = (n == 2) & (a0 < 1000) & (a1 > a0)
    quantity = F.when(n >= 3, a0).when(two_is_qty, a0)
    unit_price = F.when(n >= 3, a1).when((n == 2) & ~two_is_qty, a0)
    total = F.when(n >= 1, last)
    taxable = F.when(n >= 4, a2)
    return F.struct(quantity.alias("quantity"), unit_price.alias("unit_price"),
                    total.alias("total_amount"), taxable.alias("taxable_amount"))


def price_per_base_unit(pack_qty: Column, has_pack: Column, unit_price: Column,
                        total: Column, quantity: Column) -> Column:
    """Unit price / pack quantity, else unit price, else total / quantity (O-50).
    Zero counts as missing; a zero pack quantity gives null (D-1)."""
    return (F.when(has_pack & _nz(unit_price), F.try_divide(unit_price, pack_qty.cast("double")))
            .when(_nz(unit_price), unit_price)
            .when(_nz(total) & _nz(quantity) & (quantity > 0), F.try_divide(total, quantity)))


# ---------------------------------------------------------------- score / escalation

def confidence_score(supplier: Column, description: Column, pack_conf: Column, uom: Column,
                     base_price: Column, unit_price: Column, mpn: Column) -> Column:
    """Mean of the field scores, the MPN term only when present (O-51)."""
    s_len, s_hi, s_lo = X.SCORE_SUPPLIER
    (d1, v1), (d2, v2), v3 = X.SCORE_DESCRIPTION
    sup = (F.when(supplier.isNull() | (supplier == ""), F.lit(0.0))
           .when(F.length(supplier) > s_len, F.lit(s_hi)).otherwise(F.lit(s_lo)))
    desc = (F.when(description.isNull() | (description == ""), F.lit(0.0))
            .when(F.length(description) > d1, F.lit(v1))
            .when(F.length(description) > d2, F.lit(v2)).otherwise(F.lit(v3)))
    um = (F.when(pack_conf.isNotNull(), pack_conf)
          .when(uom.isNotNull() & (uom != ""), F.lit(X.SCORE_UOM_ONLY)).otherwise(F.lit(0.0)))
    pr = (F.when(_nz(base_price) & (base_price > 0), F.lit(X.SCORE_BASE_PRICE))
          .when(_nz(unit_price) & (unit_price > 0), F.lit(X.SCORE_UNIT_PRICE)).otherwise(F.lit(0.0)))
    has_mpn = mpn.isNotNull() & (mpn != "")
    total = sup + desc + um + pr
    return F.when(has_mpn, (total + F.lit(X.SCORE_MPN)) / 5.0).otherwise(total / 4.0)


def escalation_reasons(uom: Column, has_pack: Column, score: Column, description: Column,
                       base_price: Column, pack_conf: Column, zero_pack_price: Column,
                       threshold: float = X.ESCALATE_BELOW, missing_uom: bool = True) -> Column:
    """Ordered reasons (O-29); ``zero_pack_price`` marks D-1 rows."""
    no_uom = (uom.isNull() | (uom == "")) & ~has_pack
    empty = F.array().cast("array<string>")
    reasons = [
        (no_uom, X.MISSING_UOM) if missing_uom else None,
        (score < threshold, X.LOW_CONFIDENCE),
        (description.isNull() | (description == ""), X.LOW_CONFIDENCE),
        ((_nz(base_price) & (base_price <= 0)) | zero_pack_price, X.INVALID_PRICE),
        (has_pack & (pack_conf < X.AMBIGUOUS_PACK_BELOW), X.AMBIGUOUS_PACK),
    ]
    # concatenation of 0/1-element arrays: ordered, codegen'd, no lambda
    return F.concat(*[F.when(F.coalesce(c, F.lit(False)), F.array(F.lit(r))).otherwise(empty)
                      for c, r in (x for x in reasons if x is not None)])


# ---------------------------------------------------------------- staged chains

def parse_amounts(arr: Column) -> Column:
    return F.filter(F.transform(arr, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")),
                    lambda x: x.isNotNull())


def stage_line_matches(df, line: str = "raw_line"):
    """Adds the per-line regex results as columns, one projection per
    fallback step: a step's regex runs only when the earlier steps failed,
    and each runs at most once per row (a column, not a repeated
    expression).  Columns: ``_code``, ``_mpn1..3``, ``_pk1..4``, ``_cur``,
    ``_num``."""
    ln = F.col(line)
    # a part number that does not pass is '' at once, so the steps after it don't test it again
    valid = lambda p: F.regexp_extract(F.regexp_extract(ln, p, 1), _VALID_MPN, 0)
    none = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    # necessary conditions (byte scans) in front of three regexes: a line
    # without a slash has no slash pack, one without a label word no labelled
    # part number, one without a currency token no currency amount
    low = F.lower(ln)
    may_label = contains_any(low, ["mpn", "part", "p/n", "model"])
    may_cur = contains_any(ln, ["₹", "INR", "Rs", "USD", "EUR", "GBP"])
    empty = F.array().cast("array<double>")
    df = df.select("*", tax_code(ln).alias("_code"),
                   F.when(may_label, valid(GUARDED[X.MPN_EXPLICIT])).otherwise(F.lit("")).alias("_mpn1"),
                   F.when(ln.contains("/"), F.regexp_extract(ln, X.PACK_SLASH, 0)).otherwise(F.lit("")).alias("_pk1"),
                   F.when(may_cur, parse_amounts(F.regexp_extract_all(ln, F.lit(GUARDED[X.AMOUNT_CURRENCY]), F.lit(1))))
                   .otherwise(empty).alias("_cur"))
    df = df.select("*", F.when(none("_mpn1"), valid(X.MPN_EMBEDDED)).alias("_mpn2"),
                   F.when(F.col("_pk1") == "", F.regexp_extract(ln, X.PACK_PREFIX, 0)).alias("_pk2"),
                   F.when(F.size("_cur") == 0, F.filter(
                       parse_amounts(F.regexp_extract_all(ln, F.lit(X.AMOUNT_NUMERIC), F.lit(1))),
                       lambda x: (x >= X.AMOUNT_NUMERIC_MIN) & (x <= X.AMOUNT_NUMERIC_MAX))).alias("_num"))
    no2 = F.coalesce(F.col("_pk2"), F.lit("")) == ""
    df = df.select("*", F.when(none("_mpn1") & none("_mpn2"), valid(X.MPN_ALNUM)).alias("_mpn3"),
                   F.when((F.col("_pk1") == "") & no2, F.regexp_extract(ln, X.PACK_SUFFIX, 0)).alias("_pk3"))
    no3 = F.coalesce(F.col("_pk3"), F.lit("")) == ""
    df = df.select("*", F.when((F.col("_pk1") == "") & no2 & no3,
                               F.regexp_extract(ln, GUARDED[X.PACK_BARE], 0)).alias("_pk4"))
    return df


def mpn_from_stages() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("_mpn1", "_mpn2", "_mpn3")])


def pack_tag_from_stages() -> Column:
    """The tagged match ``pack_from_match`` expects, from the staged steps."""
    return F.coalesce(*[F.concat(F.lit(str(i)), F.when(F.col(f"_pk{i}") != "", F.col(f"_pk{i}")))
                        for i in (1, 2, 3, 4)])


def amounts_from_stages() -> Column:
    """Stage it as a column before ``assign_amounts``, which refers to it a dozen times."""
    return F.when(F.size("_cur") > 0, F.col("_cur")).otherwise(F.col("_num"))
