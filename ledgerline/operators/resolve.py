"""Unit resolution for items without a reliable pack (O-13, O-18, O-21,
O-37, O-53..O-58).

Plan shape: a narrow projection over the item table.  A keyword catalogue
of up to ``MAX_INLINE_KEYWORDS`` words is inlined as one ``CASE``; a larger
one is joined, with the same result.  With model answers, the items are
stored once: those that still need an answer (a few per cent) are joined to
the answers on ``(job_id, line_no)``, the others pass by without an
exchange.  Each lookup attempt is kept in the ``lookup_attempts`` column, so
the audit table (O-37) is an explode of the already-resolved rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import lookup as LK
from ..session import compiled_methods
from ..sources.sinks import materialize
from .bloom import possible_matches
from .metrics import observed
from .substrings import substring_pairs

MAX_INLINE_KEYWORDS = 2000


def _nz(c: Column) -> Column:
    return c.isNotNull() & (c != 0)


def needs_lookup(mode: str = "worker") -> Column:
    """Items handed to the lookup (O-13).  worker: no pack, pack confidence
    below .6 or unit UNK; cli: escalated or no pack."""
    pack = F.col("pack_info")
    if mode == "worker":
        return (pack.isNull() | (pack["confidence"] < X.LOOKUP_GATE_BELOW) | (pack["unit"] == "UNK"))
    if mode == "cli":
        return F.col("escalation_flag") | pack.isNull()
    raise ValueError(f"mode must be 'worker' or 'cli', not {mode!r}")


def attempted(mode: str = "worker") -> Column:
    """Gate, minus items whose pack is already trusted (confidence > .7)."""
    trusted = F.coalesce(F.col("pack_info.confidence") > X.LOOKUP_SKIP_ABOVE, F.lit(False))
    return F.coalesce(needs_lookup(mode), F.lit(False)) & ~trusted


RULE_FIELDS = ["priority", "uom", "pack_quantity", "confidence", "reasoning", "tag"]
RULE_SCHEMA = ("priority int, keywords array<string>, uom string, pack_quantity int, confidence double, "
               "reasoning string, tag string")


def inline_rules(rules) -> list[tuple] | None:
    """Catalogue rows (priority, keywords, uom, pack_quantity, confidence,
    reasoning, tag) as a list, or None if they have too many keywords to be
    inlined.  Rules of equal priority rank by their other fields, as in the
    join."""
    if not isinstance(rules, list):
        n = rules.select(F.sum(F.size("keywords"))).first()[0] or 0
        if n > MAX_INLINE_KEYWORDS:
            return None
        rules = [tuple(r) for r in rules.select("priority", "keywords", *RULE_FIELDS[1:]).collect()]
    rules = [(r[0], [w for w in r[1] if w], *r[2:]) for r in rules if any(r[1])]
    if sum(len(r[1]) for r in rules) > MAX_INLINE_KEYWORDS:
        return None
    null_first = lambda x: (x is not None, x if x is not None else 0)
    return sorted(rules, key=lambda r: [null_first(r[0]), *map(null_first, r[2:])])


def catalog_match(items: DataFrame, rules=None, description: str = "item_description") -> DataFrame:
    """Adds ``catalog_result`` (lookup-result struct) and ``catalog_tag``
    (O-18), inlined or joined by the catalogue's size."""
    rules = rules if rules is not None else X.DEFAULT_RULES
    rl = inline_rules(rules)
    if rl is None:
        table = items.sparkSession.createDataFrame(rules, RULE_SCHEMA) if isinstance(rules, list) else rules
        return catalog_match_join(items, table, description)
    d = F.col(description)
    return items.select("*", LK.rules_case(d, rl).alias("catalog_result"),
                        LK.rule_tag_case(d, rl).alias("catalog_tag"))


def catalog_match_join(items: DataFrame, rules: DataFrame, description: str = "item_description") -> DataFrame:
    """Same answer as the inlined catalogue for catalogues of any size: the
    distinct descriptions give out the keywords they hold (``substrings``),
    and the least rule wins per description (partial aggregation before the
    shuffle).  No pairs are enumerated, repeated descriptions are matched
    once, and the items, which feed both sides, are made once."""
    rule = F.struct(*RULE_FIELDS)
    items = materialize(items, "catalog-items")
    kw = rules.select(F.explode("keywords").alias("kw"), rule.alias("rule")).select(
        F.lower("kw").alias("word"), "rule").where(F.length("word") > 0).groupBy("word").agg(F.min("rule").alias("rule"))
    kw = materialize(kw, "catalog-words")
    d = F.lower(F.coalesce(F.col(description), F.lit("")))
    pairs = substring_pairs(items.select(d.alias("text")), kw)
    hit = pairs.join(kw, "word").groupBy(F.col("text").alias("_d")).agg(F.min("rule").alias("_rule"))
    r = F.col("_rule")
    res = F.when(r.isNotNull(), LK.result(True, r["uom"], r["pack_quantity"].cast("bigint"),
                                          r["confidence"].cast("double"), X.SOURCE_ONLINE, r["reasoning"])
                 ).otherwise(LK.result(False, conf=0.0, source=X.SOURCE_ONLINE, error=X.MSG_NO_RULE))
    return (items.withColumn("_d", d).join(hit, "_d", "left")
            .select(*items.columns, res.alias("catalog_result"), r["tag"].alias("catalog_tag")))


def resolve_uom(items: DataFrame, keys: list[str] | None = None, rules=None,
                answers: DataFrame | None = None, online: bool = True, llm: bool = True,
                mode: str = "worker", enabled: Column | None = None) -> DataFrame:
    """Resolve and apply units for items that need it (O-55 + O-58).

    Adds ``lookup_success``, ``lookup_source``, ``lookup_confidence``,
    ``lookup_reasoning``, ``lookup_error`` and ``lookup_attempts`` (one struct
    per attempt, for ``lookup_audit``); updates ``pack_info``,
    ``original_uom``, ``detected_pack_quantity``, ``price_per_base_unit``,
    ``escalation_reasons`` and ``escalation_flag`` as the rule says (score
    and earlier reasons are left as they were).  ``enabled`` is a condition
    on the item's row (its job's option).  Of several answers to an item the
    least counts."""
    compiled_methods(items.sparkSession)
    keys = keys or ["job_id", "line_no"]
    base_cols = items.columns
    df = items
    use_llm = llm and answers is not None
    gate = attempted(mode)
    if enabled is not None:
        gate = gate & F.coalesce(enabled, F.lit(False))
    terms = LK.search_terms(F.col("manufacturer_part_number"), F.col("item_description"),
                            F.col("hsn_code"), F.col("sac_code"))
    # terms only for the items that are looked up
    s1 = df.select("*", gate.alias("_try")).select("*", F.when(F.col("_try"), terms).alias("_terms"))
    rl = inline_rules(rules if rules is not None else X.DEFAULT_RULES)
    if rl is None:
        # only the items that are looked up meet the catalogue
        s1 = materialize(s1, "catalog-gate")
        met = catalog_match(s1.where("_try"), rules).withColumnRenamed("catalog_result", "_by_rule").drop("catalog_tag")
        s1 = met.unionByName(s1.where("NOT _try").withColumn("_by_rule", F.lit(None).cast(met.schema["_by_rule"].dataType)))
    by_rule = F.col("_by_rule") if rl is None else LK.rules_case(F.col("item_description"), rl)
    no_terms = LK.result(False, conf=0.0, source=X.SOURCE_ONLINE, error=X.MSG_NO_TERMS)
    online_res = (F.when(F.col("_try") & F.lit(online),
                         F.when(F.size("_terms") == 0, no_terms)
                         .otherwise(by_rule)))
    s2 = s1.select("*", online_res.alias("_online"))
    if rl is None:
        s2 = s2.drop("_by_rule")
    online_ok = F.coalesce(F.col("_online.success") & (F.col("_online.confidence") > X.CATALOG_ACCEPT_ABOVE),
                           F.lit(False))
    s3 = s2.select("*", online_ok.alias("_online_ok"))
    none = F.lit(None).cast(s2.schema["_online"].dataType)
    if use_llm:
        s3 = materialize(s3, "resolve")
        asked = F.col("_try") & ~F.col("_online_ok")
        if all(s3.schema[k].dataType == answers.schema[k].dataType for k in keys):
            # of the answers only what the asked items can match is shuffled
            answers = possible_matches(answers, s3.where(asked).select(*keys), [keys])
        one = answers.groupBy(*keys).agg(F.min("answer").alias("_answer"))
        needing = s3.where(asked).join(one, keys, "left").select("*", LK.validate_answer(F.col("_answer")).alias("_llm"))
        others = s3.where(~asked).select("*", F.lit(None).cast("string").alias("_answer"), none.alias("_llm"))
        s3 = needing.unionByName(others)
    else:
        s3 = s3.select("*", none.alias("_llm"))
    fail = LK.result(False, conf=0.0, error=X.MSG_ALL_FAILED, reasoning=X.MSG_ALL_FAILED_REASON)
    final = (F.when(F.col("_online_ok"), F.col("_online"))
             .when(F.coalesce(F.col("_llm.success"), F.lit(False)), F.col("_llm"))
             .otherwise(fail))
    s4 = s3.select("*", F.when(F.col("_try"), final).alias("_final"))
    fin = F.col("_final")
    applied = F.coalesce(F.col("_try") & fin["success"] & (fin["confidence"] > X.APPLY_ABOVE), F.lit(False))
    escalate = F.coalesce(F.col("_try") & (~fin["success"] | (fin["confidence"] < X.LOOKUP_ESCALATE_BELOW)),
                          F.lit(False))
    new_pack = F.struct(fin["pack_quantity"].alias("quantity"), fin["uom"].alias("unit"),
                        fin["confidence"].alias("confidence"), fin["source"].alias("source"))
    reasons = F.col("escalation_reasons")
    add_missing = escalate & ~F.array_contains(reasons, X.MISSING_UOM)
    query = F.array_join("_terms", " ")

    def attempt(res: str, source: str, raw: Column) -> Column:
        r = F.col(res)
        return F.when(r.isNotNull(), F.struct(
            F.lit(source).alias("lookup_source"), query.alias("lookup_query"), r["success"].alias("success"),
            r["uom"].alias("resolved_uom"), r["pack_quantity"].alias("resolved_pack_quantity"),
            r["confidence"].alias("confidence"), r["reasoning"].alias("reasoning"),
            r["error"].alias("error_message"), raw.alias("raw_response")))

    attempts = F.filter(F.array(attempt("_online", X.SOURCE_ONLINE, F.lit(None).cast("string")),
                                attempt("_llm", X.SOURCE_LLM, F.col("_answer") if use_llm
                                        else F.lit(None).cast("string"))),
                        lambda a: a.isNotNull())
    updated = {
        "pack_info": F.when(applied, new_pack).otherwise(F.col("pack_info")),
        "original_uom": F.when(applied, fin["uom"]).otherwise(F.col("original_uom")),
        "detected_pack_quantity": F.when(applied, fin["pack_quantity"]).otherwise(F.col("detected_pack_quantity")),
        "price_per_base_unit": F.when(applied & _nz(F.col("unit_price")) & _nz(fin["pack_quantity"]),
                                      F.try_divide(F.col("unit_price"), fin["pack_quantity"].cast("double")))
                                .otherwise(F.col("price_per_base_unit")),
        "escalation_reasons": F.when(add_missing, F.array_append(reasons, F.lit(X.MISSING_UOM))).otherwise(reasons),
        "escalation_flag": F.when(escalate, F.lit(True)).otherwise(F.col("escalation_flag")),
    }
    extra = [
        F.when(F.col("_try"), fin["success"]).alias("lookup_success"),
        F.when(F.col("_try") & fin["success"], fin["source"]).alias("lookup_source"),
        F.when(F.col("_try"), fin["confidence"]).alias("lookup_confidence"),
        F.when(F.col("_try"), fin["reasoning"]).alias("lookup_reasoning"),
        F.when(F.col("_try"), fin["error"]).alias("lookup_error"),
        F.when(F.col("_try"), attempts).otherwise(F.array().cast(
            "array<struct<lookup_source:string,lookup_query:string,success:boolean,resolved_uom:string,"
            "resolved_pack_quantity:bigint,confidence:double,reasoning:string,error_message:string,"
            "raw_response:string>>")).alias("lookup_attempts"),
    ]
    out_cols = [updated[c].alias(c) if c in updated else F.col(c) for c in base_cols]
    return observed(s4.select(*out_cols, *extra), "resolve_uom",
                    F.count_if(F.col("lookup_success").isNotNull()).alias("attempted"),
                    F.count_if(F.col("lookup_success")).alias("resolved"))


def lookup_audit(resolved: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per lookup attempt (O-37), numbered within the item."""
    keys = keys or ["job_id", "line_no"]
    return resolved.select(*keys, F.posexplode("lookup_attempts").alias("attempt_no", "a")).select(
        *keys, "attempt_no", "a.*")


def audit_join_items(audit: DataFrame, items: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Audit rows with their line item (O-21): equi-join on the item key.  Of
    the items, which are many, only those are shuffled that an audit row can
    match."""
    keys = keys or ["job_id", "line_no"]
    audit = materialize(audit, "audit")
    if all(audit.schema[k].dataType == items.schema[k].dataType for k in keys):
        items = possible_matches(items, audit.select(*keys), [keys])
    return audit.join(items, keys, "inner")


def build_prompts(items: DataFrame, keys: list[str] | None = None, mode: str = "worker") -> DataFrame:
    """Prompt export for items the lookup would try (O-57)."""
    keys = keys or ["job_id", "line_no"]
    return items.where(attempted(mode)).select(
        *keys, LK.build_prompt(F.col("item_description"), F.col("manufacturer_part_number"),
                               F.col("supplier_name"), F.col("hsn_code"), F.col("sac_code"),
                               F.col("raw_line")).alias("prompt"))


def validate_llm_answers(answers: DataFrame) -> DataFrame:
    """Answers table -> validated lookup results, one row per answer (O-56)."""
    r = LK.validate_answer(F.col("answer"))
    return answers.select("*", r.alias("_r")).select(
        *answers.columns, *[F.col(f"_r.{f}").alias(f) for f in LK.RESULT_FIELDS])
