"""Registered resolution queries (O-13, O-18, O-21, O-37, O-53..O-58)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import lookup as LK
from ..operators import jobs as J
from ..operators import resolve as R
from . import fixtures as FX
from . import oracle as O
from .catalog import _sql_items, line_items_table, register

# ------------------------------------------------------------------ DuckDB side

_DESC = "lower(coalesce(item_description, ''))"


def _clean_desc() -> str:
    d = _DESC
    for w in X.SEARCH_NOISE_WORDS:
        d = f"replace({d}, '{w}', '')"
    return d


_TERMS = (f"list_concat(CASE WHEN manufacturer_part_number <> '' THEN [manufacturer_part_number] ELSE [] END, "
          f"regexp_extract_all({_clean_desc()}, '\\b[a-z0-9]{{3,}}\\b')[1:5], "
          f"CASE WHEN hsn_code <> '' THEN [hsn_code] ELSE [] END, "
          f"CASE WHEN sac_code <> '' THEN [sac_code] ELSE [] END)")


def _rule_case(field: str) -> str:
    parts = []
    for _p, words, uom, qty, conf, reasoning, tag in X.DEFAULT_RULES:
        cond = " OR ".join(f"contains({_DESC}, '{w}')" for w in words)
        val = {"uom": f"'{uom}'", "qty": f"{qty}::BIGINT", "conf": f"{conf}::DOUBLE",
               "reason": O.q(reasoning), "tag": f"'{tag}'", "ok": "true"}[field]
        parts.append(f"WHEN {cond} THEN {val}")
    other = {"uom": "NULL", "qty": "NULL::BIGINT", "conf": "0.0::DOUBLE", "reason": "NULL",
             "tag": "NULL", "ok": "false"}[field]
    return f"(CASE {' '.join(parts)} ELSE {other} END)"


def _answer(field: str, a: str = "answer") -> str:
    keys = f"json_keys({a})"
    return {
        "uom": f"CASE WHEN list_contains({keys}, 'uom') THEN json_extract_string({a}, '$.uom') ELSE 'UNK' END",
        "qty": f"CASE WHEN list_contains({keys}, 'pack_quantity') THEN try_cast(json_extract({a}, '$.pack_quantity') AS BIGINT) ELSE 1::BIGINT END",
        "conf": f"CASE WHEN list_contains({keys}, 'confidence') THEN try_cast(json_extract({a}, '$.confidence') AS DOUBLE) ELSE 0.0::DOUBLE END",
        "reason": f"CASE WHEN list_contains({keys}, 'reasoning') THEN json_extract_string({a}, '$.reasoning') ELSE '' END",
    }[field]


CODES = ", ".join(f"'{c}'" for c in X.UOM_CODES)


def _cte_answers_checked() -> str:
    return f"""answers_v AS (
  SELECT job_id, line_no, answer,
    {_answer('uom')} AS a_uom, {_answer('qty')} AS a_qty, {_answer('conf')} AS a_conf0, {_answer('reason')} AS a_reason
  FROM answers),
answers_c AS (
  SELECT *, a_uom IN ({CODES}) AND a_conf0 IS NOT NULL AS a_ok,
    greatest(0.0::DOUBLE, least(1.0::DOUBLE, a_conf0)) AS a_conf,
    CASE WHEN NOT a_uom IN ({CODES}) THEN '{X.MSG_BAD_UOM}'
         WHEN a_conf0 IS NULL THEN 'LLM answer has an invalid confidence' END AS a_err
  FROM answers_v)"""


def _sql_resolved(mode: str = "worker", enabled: bool = False) -> str:
    gate = ("(pack_unit IS NULL OR pack_confidence < 0.6 OR pack_unit = 'UNK')" if mode == "worker"
            else "(escalation_flag OR pack_unit IS NULL)")
    if enabled:
        gate += (" AND coalesce((SELECT coalesce(json_extract(options, '$.enable_agentic_lookup')::BOOLEAN, true) "
                 "FROM jobs WHERE jobs.job_id = it.job_id), false)")
    return _sql_items(True).rstrip() + (",\n" + O.cte_jobs() if enabled else "") + f""",
{O.cte_answers()},
{_cte_answers_checked()},
it AS (SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, * EXCLUDE (o_orderkey) FROM items),
r1 AS (
  SELECT it.*, a.answer, a.a_uom, a.a_qty, a.a_conf, a.a_reason, a.a_ok, a.a_err,
    {gate} AND NOT coalesce(pack_confidence > 0.7, false) AS _try,
    {_TERMS} AS _terms
  FROM it LEFT JOIN answers_c a USING (job_id, line_no)),
r2 AS (
  SELECT *,
    CASE WHEN _try THEN (len(_terms) > 0 AND {_rule_case('ok')}) END AS on_ok0,
    CASE WHEN _try AND len(_terms) > 0 THEN {_rule_case('uom')} END AS on_uom,
    CASE WHEN _try AND len(_terms) > 0 THEN {_rule_case('qty')} END AS on_qty,
    CASE WHEN _try THEN (CASE WHEN len(_terms) > 0 THEN {_rule_case('conf')} ELSE 0.0::DOUBLE END) END AS on_conf,
    CASE WHEN _try AND len(_terms) > 0 THEN {_rule_case('reason')} END AS on_reason,
    CASE WHEN _try THEN (CASE WHEN len(_terms) = 0 THEN '{X.MSG_NO_TERMS}'
                              WHEN NOT {_rule_case('ok')} THEN '{X.MSG_NO_RULE}' END) END AS on_err
  FROM r1),
r3 AS (
  SELECT *, coalesce(on_ok0 AND on_conf > 0.6, false) AS on_accept FROM r2),
r4 AS (
  SELECT *,
    _try AND NOT on_accept AS llm_tried,
    _try AND NOT on_accept AND coalesce(a_ok, false) AS llm_accept
  FROM r3),
r5 AS (
  SELECT *,
    CASE WHEN NOT _try THEN NULL WHEN on_accept OR llm_accept THEN true ELSE false END AS lookup_success,
    CASE WHEN on_accept THEN on_uom WHEN llm_accept THEN a_uom END AS f_uom,
    CASE WHEN on_accept THEN on_qty WHEN llm_accept THEN a_qty END AS f_qty,
    CASE WHEN NOT _try THEN NULL WHEN on_accept THEN on_conf WHEN llm_accept THEN a_conf ELSE 0.0::DOUBLE END AS lookup_confidence,
    CASE WHEN on_accept THEN 'online_lookup' WHEN llm_accept THEN 'llm_inferred' END AS lookup_source,
    CASE WHEN on_accept THEN on_reason WHEN llm_accept THEN a_reason WHEN _try THEN {O.q(X.MSG_ALL_FAILED_REASON)} END AS lookup_reasoning,
    CASE WHEN _try AND NOT on_accept AND NOT llm_accept THEN '{X.MSG_ALL_FAILED}' END AS lookup_error
  FROM r4),
resolved AS (
  SELECT *,
    coalesce(lookup_success AND lookup_confidence > 0.3, false) AS applied,
    coalesce(_try AND (NOT lookup_success OR lookup_confidence < 0.5), false) AS escalate
  FROM r5)
"""


# ------------------------------------------------------------------ Spark side

def _items(spark, sf_dir):
    return line_items_table(spark, sf_dir)


def _resolved(spark, sf_dir, mode="worker"):
    answers = FX.render_answers(spark, sf_dir)
    return R.resolve_uom(_items(spark, sf_dir), answers=answers, mode=mode)


@register("search_terms", _sql_items(True).rstrip() + f"\nSELECT o_orderkey, line_no, array_to_string({_TERMS}, '|') AS search_terms FROM items")
def q_search_terms(spark, sf_dir):
    from .catalog import invoice_items
    it = invoice_items(spark, sf_dir)
    t = LK.search_terms(F.col("manufacturer_part_number"), F.col("item_description"), F.col("hsn_code"),
                        F.col("sac_code"))
    return it.select("o_orderkey", "line_no", F.array_join(t, "|").alias("search_terms"))


_LEVEL_SQL = ("CASE WHEN {c} >= 0.8 THEN 'high' WHEN {c} >= 0.5 THEN 'medium' "
              "WHEN {c} >= 0.2 THEN 'low' ELSE 'very_low' END")


@register("confidence_level", _sql_items(True).rstrip()
          + f"\nSELECT o_orderkey, line_no, {_LEVEL_SQL.format(c='confidence_score')} AS level FROM items")
def q_confidence_level(spark, sf_dir):
    from .catalog import invoice_items
    return invoice_items(spark, sf_dir).select("o_orderkey", "line_no",
                                               LK.confidence_level("confidence_score").alias("level"))


_CATALOG_SQL = (_sql_items(True).rstrip() + f"""
SELECT o_orderkey, line_no, {_rule_case('ok')} AS matched, {_rule_case('uom')} AS uom,
  {_rule_case('qty')} AS pack_quantity, {_rule_case('conf')} AS confidence, {_rule_case('tag')} AS tag
FROM items""")


def _catalog_out(df):
    return df.select("o_orderkey", "line_no", F.col("catalog_result.success").alias("matched"),
                     F.col("catalog_result.uom").alias("uom"),
                     F.col("catalog_result.pack_quantity").alias("pack_quantity"),
                     F.col("catalog_result.confidence").alias("confidence"), F.col("catalog_tag").alias("tag"))


@register("catalog_rule_join", _CATALOG_SQL)
def q_catalog_rule_join(spark, sf_dir):
    from .catalog import invoice_items
    return _catalog_out(R.catalog_match(invoice_items(spark, sf_dir)))


@register("catalog_rule_join_large", _CATALOG_SQL)
def q_catalog_rule_join_large(spark, sf_dir):
    """The same catalogue through the large-catalogue equi-join path."""
    from .catalog import invoice_items
    rules = spark.createDataFrame(
        [tuple(r) for r in X.DEFAULT_RULES],
        "priority int, keywords array<string>, uom string, pack_quantity int, confidence double, "
        "reasoning string, tag string")
    return _catalog_out(R.catalog_match_join(invoice_items(spark, sf_dir), rules))


#: A catalogue of one rule a part: whole names, names with a suffix, part numbers, beginnings shorter than a q-gram.
_PART_WORD = ("case p_partkey % 5 when 0 then upper(p_name) when 1 then concat(p_name, ' sheet') when 2 then concat(p_name, ' carton') "
              "when 3 then lpad(cast(p_partkey as {s}), 5, '0') else substring(p_name, 1, cast(2 + p_partkey % 3 as int)) end")


@register("catalog_part_join", _sql_items(True).rstrip() + f""",
rules AS (SELECT lower({FX.sql(_PART_WORD, 'duckdb')}) AS word, min((p_partkey, p_size)) AS rule FROM part GROUP BY 1),
texts AS (SELECT DISTINCT lower(coalesce(item_description, '')) AS text FROM items),
hits AS (SELECT text, min(rule) AS rule FROM texts JOIN rules ON contains(text, word) GROUP BY text)
SELECT o_orderkey, line_no, h.text IS NOT NULL AS matched, CASE WHEN h.text IS NOT NULL THEN 'PK' END AS uom,
  h.rule[2]::BIGINT AS pack_quantity, CASE WHEN h.text IS NULL THEN 0.0::DOUBLE ELSE 0.7::DOUBLE END AS confidence,
  CASE WHEN h.text IS NOT NULL THEN concat('part ', cast(h.rule[1] AS varchar)) END AS tag
FROM items LEFT JOIN hits h ON h.text = lower(coalesce(item_description, ''))""")
def q_catalog_part_join(spark, sf_dir):
    """Every description against a catalogue that grows with the parts."""
    from .catalog import invoice_items
    rules = FX.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("int").alias("priority"), F.array(F.expr(FX.sql(_PART_WORD))).alias("keywords"),
        F.lit("PK").alias("uom"), F.col("p_size").cast("int").alias("pack_quantity"), F.lit(0.7).alias("confidence"),
        F.lit("part catalogue").alias("reasoning"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("tag"))
    # what is matched, as items are stored
    items = invoice_items(spark, sf_dir).select("o_orderkey", "line_no", "item_description")
    return _catalog_out(R.catalog_match_join(items, rules))


@register("validate_llm_answers", "WITH " + O.cte_answers() + ",\n" + _cte_answers_checked() + """
SELECT job_id, line_no, a_ok AS success, CASE WHEN a_ok THEN a_uom END AS uom,
  CASE WHEN a_ok THEN a_qty END AS pack_quantity, CASE WHEN a_ok THEN a_conf ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN a_ok THEN a_reason END AS reasoning, a_err AS error FROM answers_c""")
def q_validate_llm_answers(spark, sf_dir):
    v = R.validate_llm_answers(FX.render_answers(spark, sf_dir))
    return v.select("job_id", "line_no", "success", "uom", "pack_quantity", "confidence", "reasoning", "error")


@register("needs_lookup", _sql_items(True).rstrip() + """
SELECT o_orderkey, line_no,
  (pack_unit IS NULL OR pack_confidence < 0.6 OR pack_unit = 'UNK') AS worker_gate,
  (escalation_flag OR pack_unit IS NULL) AS cli_gate,
  (pack_unit IS NULL OR pack_confidence < 0.6 OR pack_unit = 'UNK') AND NOT coalesce(pack_confidence > 0.7, false) AS worker_attempt,
  (escalation_flag OR pack_unit IS NULL) AND NOT coalesce(pack_confidence > 0.7, false) AS cli_attempt
FROM items""")
def q_needs_lookup(spark, sf_dir):
    from .catalog import invoice_items
    it = invoice_items(spark, sf_dir)
    return it.select("o_orderkey", "line_no", R.needs_lookup("worker").alias("worker_gate"),
                     R.needs_lookup("cli").alias("cli_gate"), R.attempted("worker").alias("worker_attempt"),
                     R.attempted("cli").alias("cli_attempt"))


def _prompt_sql() -> str:
    def opt(label, c):
        return f"CASE WHEN {c} <> '' THEN concat('{label}', {c}) END"
    code = "coalesce(CASE WHEN hsn_code <> '' THEN hsn_code END, CASE WHEN sac_code <> '' THEN sac_code END)"
    tail = ", ".join(O.q(t) for t in LK.PROMPT_TAIL)
    return (f"concat_ws(chr(10), {O.q(LK.PROMPT_HEAD)}, '', concat('Description: ', coalesce(CASE WHEN item_description <> '' THEN item_description END, 'N/A')), "
            f"{opt('Part number: ', 'manufacturer_part_number')}, {opt('Supplier: ', 'supplier_name')}, "
            f"{opt('HSN/SAC: ', code)}, {opt('Line: ', 'raw_line')}, {tail})")


@register("build_prompts", _sql_items(True).rstrip() + f"""
SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, line_no, {_prompt_sql()} AS prompt FROM items
WHERE (pack_unit IS NULL OR pack_confidence < 0.6 OR pack_unit = 'UNK') AND NOT coalesce(pack_confidence > 0.7, false)""")
def q_build_prompts(spark, sf_dir):
    return R.build_prompts(_items(spark, sf_dir))


#: What resolution reads and updates of an item; it stores its items, so other columns would be written for nothing.
_LOOKUP_INPUT = ["job_id", "line_no", "item_description", "manufacturer_part_number", "hsn_code", "sac_code", "unit_price",
                 "original_uom", "detected_pack_quantity", "price_per_base_unit", "escalation_flag", "escalation_reasons", "pack_info"]


@register("resolve_uom", _sql_resolved() + """
SELECT job_id, line_no, lookup_success, lookup_source, lookup_confidence, lookup_reasoning, lookup_error
FROM resolved WHERE _try""")
def q_resolve_uom(spark, sf_dir):
    r = R.resolve_uom(_items(spark, sf_dir).select(*_LOOKUP_INPUT), answers=FX.render_answers(spark, sf_dir))
    return r.where(F.col("lookup_success").isNotNull()).select(
        "job_id", "line_no", "lookup_success", "lookup_source", "lookup_confidence", "lookup_reasoning",
        "lookup_error")


_LOOKUP_COLUMNS = ["job_id", "line_no", "lookup_success", "lookup_source", "lookup_confidence", "lookup_reasoning",
                   "lookup_error"]
_LOOKUP_SQL = f"\nSELECT {', '.join(_LOOKUP_COLUMNS)} FROM resolved WHERE _try"


@register("resolve_uom_cli", _sql_resolved("cli") + _LOOKUP_SQL)
def q_resolve_uom_cli(spark, sf_dir):
    """Resolution with the command line's gate: escalated items too."""
    return _resolved(spark, sf_dir, "cli").where(F.col("lookup_success").isNotNull()).select(*_LOOKUP_COLUMNS)


@register("resolve_uom_enabled", _sql_resolved(enabled=True) + _LOOKUP_SQL)
def q_resolve_uom_enabled(spark, sf_dir):
    """Resolution only where the job's options ask for it (by default they do)."""
    jobs = J.json_options(FX.render_jobs(spark, sf_dir)).select("job_id", "enable_agentic_lookup")
    items = _items(spark, sf_dir).select(*_LOOKUP_INPUT).join(jobs, "job_id", "left")
    r = R.resolve_uom(items, answers=FX.render_answers(spark, sf_dir), enabled=F.col("enable_agentic_lookup"))
    return r.where(F.col("lookup_success").isNotNull()).select(*_LOOKUP_COLUMNS)


def _part_rules(spark, sf_dir):
    """A catalogue of two keywords per part: too large to inline from 1,000 parts on."""
    return FX.table(spark, sf_dir, "part").selectExpr(
        "cast(p_partkey as int) as priority", "array(lower(p_name), concat('no-such-', p_partkey)) as keywords",
        "case p_partkey % 3 when 0 then 'CS' when 1 then 'BX' else 'EA' end as uom",
        "cast(1 + p_partkey % 12 as int) as pack_quantity", "cast(0.7 as double) as confidence",
        "'by part' as reasoning", "'part' as tag")


@register("resolve_uom_large_catalogue", _sql_items(True).rstrip() + f""",
tried AS (SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, line_no, lower(coalesce(item_description, '')) AS d,
    {_TERMS} AS terms FROM items
  WHERE (pack_unit IS NULL OR pack_confidence < 0.6 OR pack_unit = 'UNK') AND NOT coalesce(pack_confidence > 0.7, false)),
ds AS (SELECT DISTINCT d FROM tried),
hit AS (SELECT d, min(p_partkey) AS k FROM ds JOIN part ON contains(d, lower(p_name)) GROUP BY d)
SELECT job_id, line_no, k IS NOT NULL AND len(terms) > 0 AS lookup_success,
  CASE WHEN len(terms) > 0 THEN CASE k % 3 WHEN 0 THEN 'CS' WHEN 1 THEN 'BX' WHEN 2 THEN 'EA' END END AS uom,
  CASE WHEN len(terms) > 0 THEN 1 + k % 12 END AS pack_quantity
FROM tried LEFT JOIN hit USING (d)""")
def q_resolve_uom_large_catalogue(spark, sf_dir):
    """Resolution by a catalogue built from the part table, joined or inlined
    by its size."""
    r = R.resolve_uom(_items(spark, sf_dir), rules=_part_rules(spark, sf_dir))
    ok = F.col("lookup_success")
    return r.where(ok.isNotNull()).select("job_id", "line_no", "lookup_success", F.when(ok, F.col("pack_info.unit")).alias("uom"),
                                          F.when(ok, F.col("pack_info.quantity")).alias("pack_quantity"))


_APPLIED_SQL = _sql_resolved() + """
SELECT job_id, line_no,
  CASE WHEN applied THEN f_uom ELSE original_uom END AS original_uom,
  CASE WHEN applied THEN f_qty ELSE detected_pack_quantity END AS detected_pack_quantity,
  CASE WHEN applied AND unit_price <> 0 AND f_qty <> 0 THEN unit_price / f_qty ELSE price_per_base_unit END AS price_per_base_unit,
  CASE WHEN escalate AND NOT list_contains(string_split(escalation_reasons, ','), 'missing_uom')
       THEN (CASE WHEN escalation_reasons = '' THEN 'missing_uom' ELSE escalation_reasons || ',missing_uom' END)
       ELSE escalation_reasons END AS escalation_reasons,
  escalation_flag OR escalate AS escalation_flag,
  CASE WHEN applied THEN lookup_source ELSE pack_source END AS pack_source,
  CASE WHEN applied THEN lookup_confidence ELSE pack_confidence END AS pack_confidence,
  confidence_score
FROM resolved"""


def applied_columns(r):
    return r.select("job_id", "line_no", "original_uom", "detected_pack_quantity", "price_per_base_unit",
                    F.array_join("escalation_reasons", ",").alias("escalation_reasons"), "escalation_flag",
                    F.col("pack_info.source").alias("pack_source"),
                    F.col("pack_info.confidence").alias("pack_confidence"), "confidence_score")


@register("apply_resolution", _APPLIED_SQL)
def q_apply_resolution(spark, sf_dir):
    return applied_columns(_resolved(spark, sf_dir))


_AUDIT_SQL = _sql_resolved() + f""",
aud AS (
  SELECT job_id, line_no, 0 AS attempt_no, 'online_lookup' AS lookup_source, array_to_string(_terms, ' ') AS lookup_query,
    coalesce(on_ok0, false) AS success, on_uom AS resolved_uom, on_qty AS resolved_pack_quantity,
    on_conf AS confidence, on_reason AS reasoning, on_err AS error_message, NULL::VARCHAR AS raw_response
  FROM resolved WHERE _try
  UNION ALL
  SELECT job_id, line_no, 1 AS attempt_no, 'llm_inferred', array_to_string(_terms, ' '),
    coalesce(a_ok, false), CASE WHEN a_ok THEN a_uom END, CASE WHEN a_ok THEN a_qty END,
    CASE WHEN a_ok THEN a_conf ELSE 0.0::DOUBLE END, CASE WHEN a_ok THEN a_reason END,
    CASE WHEN answer IS NULL THEN '{X.MSG_NO_ANSWER}' ELSE a_err END, answer
  FROM resolved WHERE llm_tried)
"""


@register("lookup_audit", _AUDIT_SQL + "SELECT * FROM aud")
def q_lookup_audit(spark, sf_dir):
    return R.lookup_audit(_resolved(spark, sf_dir))


@register("audit_join_items", _AUDIT_SQL + """
SELECT a.job_id, a.line_no, a.attempt_no, a.lookup_source, a.success, i.item_description, i.raw_line
FROM aud a JOIN it i USING (job_id, line_no)""")
def q_audit_join_items(spark, sf_dir):
    from ..sources.sinks import materialize
    # feeds both sides of the join, which read these columns
    items = _items(spark, sf_dir).select(*_LOOKUP_INPUT, "raw_line")
    resolved = R.resolve_uom(items, answers=FX.render_answers(spark, sf_dir)).select(
        "job_id", "line_no", "item_description", "raw_line", "lookup_attempts")
    resolved = materialize(resolved, "resolved")
    audit = R.lookup_audit(resolved).select("job_id", "line_no", "attempt_no", "lookup_source", "success")
    items = resolved.select("job_id", "line_no", "item_description", "raw_line")
    return R.audit_join_items(audit, items)
