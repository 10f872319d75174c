"""Invoice text -> line-item table (O-11, O-12, O-29, O-39..O-52).

Plan shape: one narrow stage.  Each document row is cleaned, split into
lines and bounded with array functions, the in-table candidate lines are
exploded once (the array is filtered *before* the explode), and every
per-line field is a codegen'd Spark expression.  There is no shuffle, so
the job scales with the number of document partitions; a very long
document costs one task proportionally more, never a group or the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import items as I
from ..functions import text as T
from ..session import compiled_methods
from ..sources.sinks import materialize
from .metrics import observed
from .positions import positions

ITEM_COLUMNS = [
    "supplier_name", "item_description", "manufacturer_part_number", "original_uom",
    "detected_pack_quantity", "canonical_base_uom", "price_per_base_unit", "confidence_score",
    "escalation_flag", "escalation_reasons", "raw_line", "hsn_code", "sac_code", "quantity",
    "unit_price", "total_amount", "taxable_amount", "pack_info",
]


def explode_candidate_lines(docs: DataFrame, keys: list[str], text: str = "text",
                            supplier: str | None = None, clean: bool = True) -> DataFrame:
    """Document rows -> (keys, supplier_name, line_no, line) for every in-table
    candidate line (O-41 + O-11 + O-39).

    Per-document values (lines, header, table end, table start) are staged
    as columns one projection at a time, so each is computed once per
    document even where a lambda refers to it for every line.  A line's
    stripped and lower-cased forms are fields of what is exploded: a filter on
    a projection's column would be pushed below it and make them again for
    every word it looks for."""
    compiled_methods(docs.sparkSession)
    body = T.clean_text(F.col(text)) if clean else F.coalesce(F.col(text), F.lit(""))
    given = [F.col(supplier).alias("_given")] if supplier else []
    s1 = docs.select(*keys, body.alias("_text"), *given)
    s2 = s1.select("*", F.lower("_text").alias("_lt"), F.split("_text", "\n").alias("_lines"))
    s3 = s2.select("*", T.footer_region(F.col("_lt")).alias("_region"),
                   T.supplier_header(F.col("_lines")).alias("_header"),
                   F.lower(T.supplier_header(F.col("_lines"))).alias("_low"))
    asked = F.coalesce(F.col("_given"), F.lit("")) == "" if supplier else F.lit(True)
    s3 = T.stage_supplier(s3, "_header", "_low", asked).select(
        "*", T.header_prefix(F.col("_lt"), F.col("_region")).alias("_upto"))
    found = T.supplier_from_stages(F.col("_lines"))
    sup = F.coalesce(F.nullif(F.col("_given"), F.lit("")), found) if supplier else found
    s4 = s3.select(*keys, "_lines", sup.alias("supplier_name"),
                   T.start_after(F.col("_upto")).alias("_start"),
                   T.table_end(F.col("_lt"), F.col("_region")).alias("_end"))
    table = F.slice("_lines", F.col("_start") + 1, F.greatest(F.col("_end") - F.col("_start"), F.lit(0)))
    stripped = table if clean else F.transform(table, I.strip)   # cleaned lines are
    table = F.transform(stripped, lambda x: F.struct(x.alias("line"), F.lower(x).alias("low")))
    # posexplode_outer: no size>0 filter is inferred and pushed below the
    # projection (which would build the slice twice)
    s5 = s4.select(*keys, "supplier_name", "_start", F.posexplode_outer(table).alias("_pos", "_raw"))
    s6 = s5.where(F.col("_pos").isNotNull() & T.is_candidate_line(F.col("_raw.line"), F.col("_raw.low")))
    return s6.select(*keys, "supplier_name", (F.col("_pos") + F.col("_start")).alias("line_no"),
                     F.col("_raw.line").alias("line"))


def extract_from_lines(lines: DataFrame, line: str = "line", supplier: str = "supplier_name",
                       threshold: float = X.ESCALATE_BELOW, missing_uom: bool = True) -> DataFrame:
    """Per-line extraction (O-42..O-51, O-29); keeps the input columns,
    drops lines without a description (O-12).  The lines are counted between
    description and filter, so that the filter reads the description and
    doesn't make it again."""
    compiled_methods(lines.sparkSession)
    keep = [c for c in lines.columns if c not in (line, supplier)]
    ln = F.col(line)
    s1 = observed(lines.select(
        *keep, F.col(supplier).alias("supplier_name"), ln.alias("raw_line"),
        I.extract_description(ln).alias("item_description"),
    ), "candidate_lines", F.count(F.lit(1)).alias("lines")).where(F.col("item_description").isNotNull())
    staged = I.stage_line_matches(s1, "raw_line")
    drop = {"_code", "_mpn1", "_mpn2", "_mpn3", "_pk1", "_pk2", "_pk3", "_pk4", "_cur", "_num"}
    # what is taken apart below is a column first: as an expression it would be made again for every part
    s2 = staged.select(
        *[c for c in staged.columns if c not in drop],
        I.hsn_code(F.col("_code")).alias("hsn_code"),
        I.sac_code(F.col("_code")).alias("sac_code"),
        I.mpn_from_stages().alias("manufacturer_part_number"),
        I.pack_tag_from_stages().alias("_pack"),
        I.amounts_from_stages().alias("_amounts"),
    )
    s2 = s2.select("*", I.pack_unit("_pack").alias("_unit"))
    s3 = s2.select(
        *[c for c in s2.columns if c not in ("_pack", "_amounts", "_unit")],
        I.pack_from_match("_pack", F.col("_unit")).alias("pack_info"),
        I.assign_amounts("_amounts").alias("_amt"),
    )
    pack = F.col("pack_info")
    amt = F.col("_amt")
    has_pack = pack.isNotNull()
    s4 = s3.select(
        *[c for c in s3.columns if c != "_amt"],
        pack["unit"].alias("original_uom"),
        pack["quantity"].alias("detected_pack_quantity"),
        F.lit("EA").alias("canonical_base_uom"),
        amt["quantity"].alias("quantity"), amt["unit_price"].alias("unit_price"),
        amt["total_amount"].alias("total_amount"), amt["taxable_amount"].alias("taxable_amount"),
    )
    unit_price = F.col("unit_price")
    s5 = s4.withColumn("price_per_base_unit", I.price_per_base_unit(
        pack["quantity"], has_pack, unit_price, F.col("total_amount"), F.col("quantity")))
    score = I.confidence_score(F.col("supplier_name"), F.col("item_description"), pack["confidence"],
                               F.col("original_uom"), F.col("price_per_base_unit"), unit_price,
                               F.col("manufacturer_part_number"))
    s6 = s5.withColumn("confidence_score", score)
    zero_pack = has_pack & (pack["quantity"] == 0) & unit_price.isNotNull() & (unit_price != 0)
    reasons = I.escalation_reasons(F.col("original_uom"), has_pack, F.col("confidence_score"),
                                   F.col("item_description"), F.col("price_per_base_unit"),
                                   pack["confidence"], F.coalesce(zero_pack, F.lit(False)),
                                   threshold=threshold, missing_uom=missing_uom)
    s7 = s6.withColumn("escalation_reasons", reasons)
    s8 = s7.withColumn("escalation_flag", F.size("escalation_reasons") > 0)
    return observed(s8.select(*keep, *ITEM_COLUMNS), "line_items", F.count(F.lit(1)).alias("items"),
                    F.count_if("escalation_flag").alias("escalated"))


def extract_line_items(docs: DataFrame, keys: list[str], text: str = "text",
                       supplier: str | None = None, clean: bool = True,
                       threshold: float = X.ESCALATE_BELOW, missing_uom: bool = True) -> DataFrame:
    """Documents -> one row per line item (O-52): keys, ``line_no`` (0-based
    line index in the document) and the item columns (SURVEY 2.7.2).

    ``clean=True`` cleans the text first, as pages are cleaned before
    extraction; ``clean=False`` is the direct-text form that keeps column
    splitting on double spaces."""
    lines = explode_candidate_lines(docs, keys, text=text, supplier=supplier, clean=clean)
    return extract_from_lines(lines, threshold=threshold, missing_uom=missing_uom)


def number_items(items: DataFrame, keys: list[str]) -> DataFrame:
    """1-based item counter per document in line order (O-34), by two-level
    ranks: the items of a document of any length are numbered by many tasks.
    They are stored before they are dealt out by ranges, as the sample for the
    ranges would extract them once more."""
    items = materialize(items, "items")
    made = positions(items, keys, [F.col("line_no")], "item_no", name="item-numbers")
    return made.withColumn("item_no", (F.col("item_no") + 1).cast("int"))


def flatten_items(items: DataFrame) -> DataFrame:
    """Scalar-only projection of an item table (arrays joined, struct split)."""
    cols = [c for c in items.columns if c not in ("pack_info", "escalation_reasons")]
    return items.select(
        *cols,
        F.array_join("escalation_reasons", ",").alias("escalation_reasons"),
        F.col("pack_info.unit").alias("pack_unit"),
        F.col("pack_info.quantity").alias("pack_quantity"),
        F.col("pack_info.confidence").alias("pack_confidence"),
        F.col("pack_info.source").alias("pack_source"),
    )
