"""DuckDB SQL for the correctness check.

Written independently of the Spark code: patterns are applied with their
capture groups as stated (the Spark side takes the whole match apart), and
every step is plain SQL over the pre-registered test tables.  Shared
inputs come from ``fixtures`` so both engines read the same rendered rows.
"""

from __future__ import annotations

from ..functions import fixed as X
from . import fixtures as FX

S = "varchar"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def alt(words: list[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in words)


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def count_class(e: str, cls: str) -> str:
    return f"length(regexp_replace({e}, '[^{cls}]', '', 'g'))"


# ------------------------------------------------------------------ inputs

def cte_lines() -> str:
    return f"""rlines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {FX.sql(FX.LINE_SQL, 'duckdb')} AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cte_invoices() -> str:
    return f"""{cte_lines()},
invoices AS (
  SELECT o_orderkey, o_custkey,
    concat_ws(chr(10), {FX.sql(FX.HEADER_SQL, 'duckdb')}, {FX.sql(FX.TABLE_HEAD_SQL, 'duckdb')},
      string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey),
      {FX.sql(FX.FOOTER_SQL, 'duckdb')}) AS txt
  FROM rlines JOIN orders ON l_orderkey = o_orderkey
  GROUP BY o_orderkey, o_custkey, o_totalprice)"""


def cte_jobs() -> str:
    cols = ", ".join(f"{FX.sql(e, 'duckdb')} AS {k}" for k, e in FX.JOB_SQL.items())
    return f"jobs AS (SELECT o_orderkey, {cols} FROM orders)"


def cte_dirty() -> str:
    return f"dirty AS (SELECT doc_id, {FX.DIRTY_SQL} AS text FROM documents)"


def cte_tokens() -> str:
    cols = ", ".join(f"{e} AS {k}" for k, e in FX.TOKEN_SQL.items())
    return f"""tok0 AS (
  SELECT doc_id, unnest(w) AS text, unnest(generate_series(0, len(w) - 1)) AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)),
tokens AS (SELECT doc_id, pos AS token_idx, {cols}, text FROM tok0)"""


def cte_candidates() -> str:
    methods = ", ".join(f"({i}, {q(m)})" for i, m in enumerate(X.OCR_METHODS))
    cols = ", ".join(f"{e} AS {k}" for k, e in FX.CANDIDATE_SQL.items())
    return f"""meth(m, method) AS (VALUES {methods}),
candidates AS (
  SELECT doc_id, 1 AS page_no, method, m AS priority, {cols}
  FROM documents CROSS JOIN meth
  WHERE NOT (method = 'openai_vision' AND doc_id % 3 = 0))"""


def cte_answers() -> str:
    return f"""answers AS (
  SELECT concat('job_', cast(l_orderkey AS varchar)) AS job_id,
    cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 1 AS integer) AS line_no,
    {FX.answer_sql('varchar')} AS answer
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cte_observations() -> str:
    cols = ", ".join(f"{FX.sql(e, 'duckdb')} AS {k}" for k, e in FX.OBS_SQL.items())
    return f"observations AS (SELECT event_id, {cols} FROM events)"


# ------------------------------------------------------------------ text

def clean_text(e: str) -> str:
    t = f"regexp_replace(coalesce({e}, ''), '{X.CONTROL_CHARS}', '', 'g')"
    t = f"regexp_replace({t}, '[ \\t]+', ' ', 'g')"
    keep = (f"x <> '' AND (length(x) < 5 OR {count_class('x', '\\p{L}\\p{N}\\s')} / length(x) > 0.4)")
    return (f"array_to_string(list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), "
            f"lambda x: {keep}), chr(10))")


def raw_text_confidence(e: str) -> str:
    return (f"CASE WHEN coalesce(length({e}), 0) = 0 THEN 0.0::DOUBLE ELSE "
            f"least(0.8::DOUBLE, {count_class(e, '\\p{L}\\p{N}')} / length({e}) * 1.2::DOUBLE) END")


def normalize_supplier(e: str) -> str:
    n = "upper(" + strip(f"coalesce({e}, '')") + ")"
    n = f"regexp_replace({n}, '\\b(?i:LTD|LIMITED|PVT|PRIVATE|CORP|CORPORATION|INC|INCORPORATED)\\b', '', 'g')"
    n = f"regexp_replace({n}, '\\b(?i:CO|COMPANY|ENTERPRISES|TRADERS|SUPPLIERS)\\b', '', 'g')"
    return strip(f"regexp_replace({n}, '\\s+', ' ', 'g')")


T1A = r"(?i)(?:sold\s*by|vendor|supplier|from|bill\s*from|ship\s*from)[:\s]+([A-Z][A-Za-z0-9\s&,.\-']+?)(?:\n|$)"
T1B = r"(?i)(?:company|business\s*name)[:\s]+([A-Z][A-Za-z0-9\s&,.\-']+?)(?:\n|$)"
T2 = (r"(?im)^([A-Z][A-Z0-9\s&,.\-']{3,50}(?:LLC|INC|CORP|LTD|LIMITED|CO\.?|COMPANY|"
      r"ENTERPRISES|TRADING|DISTRIBUTORS|SUPPLIES|SUPPLY)\.?)\s*$")


def supplier(ls: str) -> str:
    header = f"array_to_string({ls}[1:30], chr(10))"

    def labelled(p: str) -> str:
        v = f"regexp_replace({strip(f'regexp_extract({header}, {q(p)}, 1)')}, '[,.\\s]+$', '')"
        return f"CASE WHEN length({v}) > 3 THEN upper({v}) END"

    legal = f"nullif(regexp_extract({header}, {q(T2)}, 1), '')"
    t3 = (f"upper(list_filter(list_transform({ls}[1:10], lambda x: {strip('x')}), lambda s: "
          f"length(s) >= 5 AND NOT regexp_matches(s, {q(X.SUPPLIER_TIER3_SKIP)}) "
          f"AND NOT ({count_class('s', '\\p{Nd}')} > length(s) * 0.5) "
          f"AND regexp_matches(s, '^\\p{{Lu}}') AND length(s) > 5 "
          f"AND {count_class('s', '\\p{L}')} / length(s) > 0.6 "
          f"AND regexp_matches(upper(s), {q(alt(X.SUPPLIER_TIER3_MARKERS))}))[1])")
    t4 = (f"upper(list_filter(list_transform({ls}[1:5], lambda x: {strip('x')}), lambda s: "
          f"length(s) > 8 AND regexp_matches(s, '^\\p{{Lu}}') "
          f"AND {count_class('s', '\\p{L}\\s')} / length(s) > 0.7 "
          f"AND NOT regexp_matches(lower(s), {q(alt(X.SUPPLIER_TIER4_SKIP))}))[1])")
    return f"coalesce({labelled(T1A)}, {labelled(T1B)}, upper({strip(legal)}), {t3}, {t4})"


def cte_candidate_lines(src: str, keys: list[str], text: str, clean: bool,
                        supplier_col: str | None = None, name: str = "cand") -> str:
    """CTE ``name``(keys, supplier_name, line_no, line) over documents in ``src``."""
    k = ", ".join(keys)
    body = clean_text(text) if clean else f"coalesce({text}, '')"
    sup = supplier("ls")
    if supplier_col:
        sup = f"coalesce(nullif({supplier_col}, ''), {sup})"
    given = f", {supplier_col}" if supplier_col else ""
    return f"""{name}_s AS (SELECT {k}, string_split({body}, chr(10)) AS ls{given} FROM {src}),
{name}_e AS (SELECT *, coalesce(list_filter(generate_series(0, len(ls) - 1),
      lambda i: regexp_matches(lower(ls[i + 1]), {q(alt(X.TABLE_FOOTER_WORDS))}))[1], len(ls)) AS t_end
  FROM {name}_s),
{name}_b AS (SELECT *, coalesce(list_max(list_filter(generate_series(0, t_end),
      lambda i: i < len(ls) AND regexp_matches(lower(ls[i + 1]), {q(alt(X.TABLE_HEADER_WORDS))}))) + 1, 0) AS t_start
  FROM {name}_e),
{name}_u AS (SELECT {k}, {sup} AS supplier_name,
    unnest(list_filter(list_transform(ls, lambda x, i: {{'line_no': cast(i - 1 AS integer), 'line': {strip('x')}}}),
      lambda s: s.line_no >= t_start AND s.line_no < t_end AND length(s.line) >= 5
        AND NOT regexp_matches(lower(s.line), {q(alt(X.LINE_SKIP_WORDS))})
        AND regexp_matches(s.line, '\\d'))) AS c
  FROM {name}_b),
{name} AS (SELECT {k}, supplier_name, c.line_no AS line_no, c.line AS line FROM {name}_u)"""


# ------------------------------------------------------------------ per line

def norm_uom(e: str) -> str:
    cases = " ".join(f"WHEN {q(a)} THEN {q(c)}" for a, c in X.UOM_ALIASES.items())
    return f"(CASE upper({strip(e)}) {cases} ELSE 'UNK' END)"


def multiplier(e: str) -> str:
    return f"(CASE {e} WHEN 'DZ' THEN 12 WHEN 'PR' THEN 2 ELSE 1 END)"


SLASH = r"(?i)(\d+)\s*/\s*([A-Z]{2,4})"
PREFIX = r"(?i)([A-Z]{2,4})\s*(\d+)"
SUFFIX = r"(?i)(\d+)\s+([A-Z]{2,4})"
BARE = r"(?i)\b(EA|CS|PK|BX|DZ|PR|SET|RL|SH|M|KG|L|EACH|CASE|PACK|BOX|DOZEN)\b"


def cte_items(src: str, name: str = "items") -> str:
    """Per-line extraction over ``src``(…, supplier_name, line_no, line).
    Output: the input key columns plus the flattened item columns."""
    L = "raw_line"
    desc = (f"list_filter(list_filter(list_transform(regexp_split_to_array({L}, '\\s{{2,}}|\\t'), "
            f"lambda p: {strip('p')}), lambda p: p <> ''), lambda p: length(p) > 5 "
            f"AND NOT regexp_full_match(p, '[\\d,.₹]+') "
            f"AND (NOT regexp_full_match(p, '[A-Z0-9\\-/]+') OR length(p) > 15))[1]")

    def mpn(p: str) -> str:
        m = f"regexp_extract({L}, {q(p)}, 1)"
        return f"CASE WHEN length({m}) >= 4 AND NOT regexp_full_match({m}, '[0-9]+') THEN {m} END"

    def parse_list(e: str) -> str:
        return f"list_filter(list_transform({e}, lambda x: try_cast(replace(x, ',', '') AS double)), lambda x: x IS NOT NULL)"

    cur = parse_list(f"regexp_extract_all({L}, {q(X.AMOUNT_CURRENCY)}, 1)")
    num = (f"list_filter({parse_list(f'regexp_extract_all({L}, {q(X.AMOUNT_NUMERIC)}, 1)')}, "
           f"lambda x: x >= 0.01 AND x <= 1000000)")
    return f"""{name}_1 AS (
  SELECT * EXCLUDE (line), line AS raw_line FROM {src}),
{name}_2 AS (
  SELECT *, {desc} AS item_description FROM {name}_1),
{name}_3 AS (
  SELECT *,
    nullif(regexp_extract({L}, '\\b(\\d{{4,8}})\\b', 1), '') AS _code,
    coalesce({mpn(X.MPN_EXPLICIT)}, {mpn(X.MPN_EMBEDDED)}, {mpn(X.MPN_ALNUM)}) AS manufacturer_part_number,
    regexp_extract({L}, {q(SLASH)}, 1) AS s_q, regexp_extract({L}, {q(SLASH)}, 2) AS s_u,
    regexp_extract({L}, {q(PREFIX)}, 1) AS p_u, regexp_extract({L}, {q(PREFIX)}, 2) AS p_q,
    regexp_extract({L}, {q(SUFFIX)}, 1) AS x_q, regexp_extract({L}, {q(SUFFIX)}, 2) AS x_u,
    regexp_extract({L}, {q(BARE)}, 1) AS b_u,
    CASE WHEN len({cur}) > 0 THEN {cur} ELSE {num} END AS a
  FROM {name}_2 WHERE item_description IS NOT NULL),
{name}_4 AS (
  SELECT *,
    CASE WHEN s_q <> '' THEN {norm_uom('s_u')} WHEN p_q <> '' THEN {norm_uom('p_u')}
         WHEN x_q <> '' THEN {norm_uom('x_u')} WHEN b_u <> '' THEN {norm_uom('b_u')} END AS pack_unit,
    CASE WHEN s_q <> '' THEN try_cast(s_q AS bigint) WHEN p_q <> '' THEN try_cast(p_q AS bigint)
         WHEN x_q <> '' THEN try_cast(x_q AS bigint) WHEN b_u <> '' THEN {multiplier(norm_uom('b_u'))} END AS pack_quantity,
    CASE WHEN s_q <> '' THEN 0.9::DOUBLE WHEN p_q <> '' THEN 0.85::DOUBLE WHEN x_q <> '' THEN 0.8::DOUBLE WHEN b_u <> '' THEN 0.7::DOUBLE END AS pack_confidence,
    len(a) AS n
  FROM {name}_3),
{name}_5 AS (
  SELECT *,
    CASE WHEN pack_confidence IS NOT NULL THEN 'pattern_matched' END AS pack_source,
    CASE WHEN n >= 3 THEN a[1] WHEN n = 2 AND a[1] < 1000 AND a[2] > a[1] THEN a[1] END AS quantity,
    CASE WHEN n >= 3 THEN a[2] WHEN n = 2 AND NOT (a[1] < 1000 AND a[2] > a[1]) THEN a[1] END AS unit_price,
    CASE WHEN n >= 1 THEN a[n] END AS total_amount,
    CASE WHEN n >= 4 THEN a[3] END AS taxable_amount
  FROM {name}_4),
{name}_6 AS (
  SELECT *,
    CASE WHEN pack_confidence IS NOT NULL AND unit_price <> 0 THEN unit_price / nullif(pack_quantity, 0)
         WHEN unit_price <> 0 THEN unit_price
         WHEN total_amount <> 0 AND quantity <> 0 AND quantity > 0 THEN total_amount / quantity END AS price_per_base_unit,
    pack_confidence IS NOT NULL AND pack_quantity = 0 AND unit_price <> 0 AS zero_pack
  FROM {name}_5),
{name}_7 AS (
  SELECT *,
    ((CASE WHEN supplier_name IS NULL OR supplier_name = '' THEN 0.0::DOUBLE WHEN length(supplier_name) > 5 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END)
     + (CASE WHEN length(item_description) > 20 THEN 0.9::DOUBLE WHEN length(item_description) > 10 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END)
     + (CASE WHEN pack_confidence IS NOT NULL THEN pack_confidence ELSE 0.0::DOUBLE END)
     + (CASE WHEN price_per_base_unit <> 0 AND price_per_base_unit > 0 THEN 0.8::DOUBLE
             WHEN unit_price <> 0 AND unit_price > 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END)
     + (CASE WHEN manufacturer_part_number IS NOT NULL THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END))
    / (CASE WHEN manufacturer_part_number IS NOT NULL THEN 5.0::DOUBLE ELSE 4.0::DOUBLE END) AS confidence_score
  FROM {name}_6),
{name} AS (
  SELECT * EXCLUDE (_code, s_q, s_u, p_u, p_q, x_q, x_u, b_u, a, n, zero_pack, reasons), reasons AS escalation_reasons,
    reasons <> '' AS escalation_flag
  FROM (SELECT *,
    pack_unit AS original_uom, pack_quantity AS detected_pack_quantity, 'EA' AS canonical_base_uom,
    CASE WHEN length(_code) < 6 THEN _code END AS hsn_code,
    CASE WHEN length(_code) >= 6 THEN _code END AS sac_code,
    concat_ws(',',
      CASE WHEN pack_unit IS NULL THEN 'missing_uom' END,
      CASE WHEN confidence_score < 0.5 THEN 'low_confidence' END,
      CASE WHEN item_description IS NULL THEN 'low_confidence' END,
      CASE WHEN (price_per_base_unit <> 0 AND price_per_base_unit <= 0) OR coalesce(zero_pack, false) THEN 'invalid_price' END,
      CASE WHEN pack_confidence IS NOT NULL AND pack_confidence < 0.6 THEN 'ambiguous_pack' END) AS reasons
  FROM {name}_7))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def cte_pages() -> str:
    cols = ", ".join(f"{e} AS {k}" for k, e in FX.PAGE_SQL.items())
    return f"""pg0 AS (
  SELECT doc_id, unnest(w) AS para, unnest(generate_series(0, len(w) - 1)) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents)),
pages_r AS (SELECT doc_id, cast(pos + 1 AS integer) AS page_no, {cols} FROM pg0)"""
