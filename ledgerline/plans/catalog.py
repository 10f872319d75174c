"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None).

Every query reads the given tables (or rows Spark renders from them) in
full, so its work grows with the scale factor.  Column names are the same
on both sides; arrays are emitted as joined strings and averages rounded so
the order-insensitive value hash compares like with like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import items as I
from ..functions import text as T
from ..operators import extract as E
from ..session import compiled_methods
from . import fixtures as FX
from . import oracle as O

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ------------------------------------------------------------------ shared Spark inputs

def invoice_items(spark: SparkSession, sf_dir: str, clean: bool = True, invoices: DataFrame | None = None) -> DataFrame:
    inv = FX.render_invoices(spark, sf_dir) if invoices is None else invoices
    return E.extract_line_items(inv, ["o_orderkey"], text="txt", clean=clean)


def line_items_table(spark: SparkSession, sf_dir: str, invoices: DataFrame | None = None) -> DataFrame:
    """Item table keyed like the job tables: (job_id, line_no, ...), of
    ``invoices`` where they are at hand."""
    items = invoice_items(spark, sf_dir, invoices=invoices)
    return items.select(F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"),
                        *[c for c in items.columns if c != "o_orderkey"])


ITEM_OUT = ["line_no", "supplier_name", "item_description", "manufacturer_part_number", "original_uom",
            "detected_pack_quantity", "canonical_base_uom", "price_per_base_unit", "confidence_score",
            "escalation_flag", "escalation_reasons", "raw_line", "hsn_code", "sac_code", "quantity",
            "unit_price", "total_amount", "taxable_amount", "pack_unit", "pack_quantity",
            "pack_confidence", "pack_source"]


def _sql_items(clean: bool = True) -> str:
    return O.with_(O.cte_invoices(),
                   O.cte_candidate_lines("invoices", ["o_orderkey"], "txt", clean),
                   O.cte_items("cand"))


def _sql_lines_items() -> str:
    """Items extracted from the rendered lines directly (no document)."""
    return O.with_(O.cte_lines(),
                   "lcand AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
                   "CAST(NULL AS varchar) AS supplier_name, 0 AS line_no, line FROM rlines)",
                   O.cte_items("lcand"))


def line_level_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = FX.render_lines(spark, sf_dir).withColumn("supplier_name", F.lit(None).cast("string"))
    return E.extract_from_lines(lines)


# ------------------------------------------------------------------ M0: flagship

FLAGSHIP_SQL = _sql_items() + """
SELECT coalesce(original_uom, 'NONE') AS uom, count(*) AS items,
  count(price_per_base_unit) AS priced_items,
  round(avg(price_per_base_unit), 6) AS avg_price_per_base_unit,
  round(sum(total_amount), 2) AS total_amount,
  sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS escalated
FROM items GROUP BY 1"""


@register("avg_price_by_uom", FLAGSHIP_SQL)
def avg_price_by_uom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average price per base unit by detected unit over all invoice items."""
    items = invoice_items(spark, sf_dir)
    return (items.groupBy(F.coalesce("original_uom", F.lit("NONE")).alias("uom"))
            .agg(F.count(F.lit(1)).alias("items"),
                 F.count("price_per_base_unit").alias("priced_items"),
                 F.round(F.avg("price_per_base_unit"), 6).alias("avg_price_per_base_unit"),
                 F.round(F.sum("total_amount"), 2).alias("total_amount"),
                 F.count_if("escalation_flag").alias("escalated")))


# ------------------------------------------------------------------ O-52 and parts

@register("extract_line_items", _sql_items(True) + "SELECT o_orderkey, " + ", ".join(ITEM_OUT) + " FROM items")
def q_extract_line_items(spark, sf_dir):
    return E.flatten_items(invoice_items(spark, sf_dir, clean=True)).select("o_orderkey", *ITEM_OUT)


@register("extract_line_items_raw", _sql_items(False) + "SELECT o_orderkey, " + ", ".join(ITEM_OUT) + " FROM items")
def q_extract_line_items_raw(spark, sf_dir):
    return E.flatten_items(invoice_items(spark, sf_dir, clean=False)).select("o_orderkey", *ITEM_OUT)


_LKEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LKEY_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@register("extract_pack", _sql_lines_items() +
          f"SELECT {_LKEYS}, pack_unit, pack_quantity, pack_confidence, pack_source FROM items")
def q_extract_pack(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir)
    p = I.extract_pack(F.col("line"))
    return lines.where(I.extract_description(F.col("line")).isNotNull()).select(
        *_LKEY_COLS, p["unit"].alias("pack_unit"), p["quantity"].alias("pack_quantity"),
        p["confidence"].alias("pack_confidence"), p["source"].alias("pack_source"))


@register("extract_amounts", _sql_lines_items() +
          f"SELECT {_LKEYS}, quantity, unit_price, total_amount, taxable_amount FROM items")
def q_extract_amounts(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir).where(I.extract_description(F.col("line")).isNotNull())
    a = I.assign_amounts(I.extract_amounts(F.col("line")))
    return lines.select(*_LKEY_COLS, a["quantity"].alias("quantity"), a["unit_price"].alias("unit_price"),
                        a["total_amount"].alias("total_amount"), a["taxable_amount"].alias("taxable_amount"))


@register("extract_mpn", _sql_lines_items() +
          f"SELECT {_LKEYS}, manufacturer_part_number, hsn_code, sac_code FROM items")
def q_extract_mpn(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir).where(I.extract_description(F.col("line")).isNotNull())
    code = I.tax_code(F.col("line"))
    return lines.select(*_LKEY_COLS, I.extract_mpn(F.col("line")).alias("manufacturer_part_number"),
                        I.hsn_code(code).alias("hsn_code"), I.sac_code(code).alias("sac_code"))


@register("price_per_base_unit", _sql_lines_items() +
          f"SELECT {_LKEYS}, item_description, price_per_base_unit, confidence_score, "
          f"escalation_flag, escalation_reasons FROM items")
def q_price_per_base_unit(spark, sf_dir):
    items = line_level_items(spark, sf_dir)
    return items.select(*_LKEY_COLS, "item_description", "price_per_base_unit", "confidence_score",
                        "escalation_flag", F.array_join("escalation_reasons", ",").alias("escalation_reasons"))


@register("extract_supplier", O.with_(
    O.cte_invoices(),
    f"sp AS (SELECT o_orderkey, string_split({O.clean_text('txt')}, chr(10)) AS ls FROM invoices)")
    + f"SELECT o_orderkey, {O.supplier('ls')} AS supplier_name, "
      f"{O.normalize_supplier(O.supplier('ls'))} AS normalized_supplier FROM sp")
def q_extract_supplier(spark, sf_dir):
    compiled_methods(spark)
    inv = FX.render_invoices(spark, sf_dir).select("o_orderkey", T.clean_text("txt").alias("_text"))
    return T.with_supplier(inv, "_text").select(
        "o_orderkey", "supplier_name", T.normalize_supplier("supplier_name").alias("normalized_supplier"))


_NAMES_SQL = ("concat(s_name, CASE s_suppkey % 5 WHEN 0 THEN ' Pvt. Ltd.' WHEN 1 THEN ' Trading Co.' "
              "WHEN 2 THEN '  enterprises  inc' WHEN 3 THEN ' Coastal Suppliers Corporation' ELSE '' END)")


@register("normalize_supplier", f"SELECT s_suppkey, {_NAMES_SQL} AS name, "
          f"{O.normalize_supplier(_NAMES_SQL)} AS normalized FROM supplier")
def q_normalize_supplier(spark, sf_dir):
    sup = FX.table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_NAMES_SQL} as name")
    return sup.select("s_suppkey", "name", T.normalize_supplier("name").alias("normalized"))


@register("table_bounds", O.with_(
    O.cte_invoices(), O.cte_candidate_lines("invoices", ["o_orderkey"], "txt", True))
    + "SELECT o_orderkey, t_start AS table_start, t_end AS table_end, len(ls) AS n_lines FROM cand_b")
def q_table_bounds(spark, sf_dir):
    inv = FX.render_invoices(spark, sf_dir).select("o_orderkey", T.clean_text("txt").alias("t"))
    low = inv.select("o_orderkey", "t", F.lower("t").alias("lt"))
    reg = low.select("*", T.footer_region(F.col("lt")).alias("r"))
    return reg.select("o_orderkey", T.table_start(F.col("lt"), F.col("r")).alias("table_start"),
                      T.table_end(F.col("lt"), F.col("r")).alias("table_end"),
                      F.size(F.split("t", "\n")).alias("n_lines"))


@register("candidate_lines", O.with_(
    O.cte_invoices(), O.cte_candidate_lines("invoices", ["o_orderkey"], "txt", False))
    + "SELECT o_orderkey, line_no, line FROM cand")
def q_candidate_lines(spark, sf_dir):
    inv = FX.render_invoices(spark, sf_dir)
    return E.explode_candidate_lines(inv, ["o_orderkey"], text="txt", clean=False).select(
        "o_orderkey", "line_no", "line")


@register("split_parts", O.with_(O.cte_lines())
          + f"SELECT {_LKEYS}, array_to_string(list_filter(list_transform(regexp_split_to_array(line, "
            f"'\\s{{2,}}|\\t'), lambda p: {O.strip('p')}), lambda p: p <> ''), '|') AS parts, "
            f"len(list_filter(list_transform(regexp_split_to_array(line, '\\s{{2,}}|\\t'), "
            f"lambda p: {O.strip('p')}), lambda p: p <> '')) AS n_parts FROM rlines")
def q_split_parts(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir)
    parts = I.split_parts("line")
    return lines.select(*_LKEY_COLS, F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


@register("extract_description", _sql_lines_items() + f"SELECT {_LKEYS}, item_description FROM items")
def q_extract_description(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir)
    d = I.extract_description(F.col("line"))
    return lines.select(*_LKEY_COLS, d.alias("item_description")).where(F.col("item_description").isNotNull())


@register("clean_text", O.with_(O.cte_dirty())
          + f"SELECT doc_id, {O.clean_text('text')} AS text FROM dirty")
def q_clean_text(spark, sf_dir):
    return FX.dirty_documents(spark, sf_dir).select("doc_id", T.clean_text("text").alias("text"))


@register("raw_text_confidence", O.with_(O.cte_dirty())
          + f"SELECT doc_id, round({O.raw_text_confidence(O.clean_text('text'))}, 12) AS confidence FROM dirty")
def q_raw_text_confidence(spark, sf_dir):
    docs = FX.dirty_documents(spark, sf_dir)
    return docs.select("doc_id", F.round(T.raw_text_confidence(T.clean_text("text")), 12).alias("confidence"))


@register("header_slices", O.with_(O.cte_invoices())
          + "SELECT o_orderkey, array_to_string(string_split(txt, chr(10))[1:30], chr(10)) AS head30, "
            "array_to_string(string_split(txt, chr(10))[1:10], chr(10)) AS head10, "
            "array_to_string(string_split(txt, chr(10))[1:5], chr(10)) AS head5 FROM invoices")
def q_header_slices(spark, sf_dir):
    inv = FX.render_invoices(spark, sf_dir).select("o_orderkey", F.split("txt", "\n").alias("ls"))
    return inv.select("o_orderkey", *[F.array_join(T.header_slice(F.col("ls"), n), "\n").alias(f"head{n}")
                                      for n in (30, 10, 5)])


@register("number_items", _sql_items(True)
          + "SELECT o_orderkey, line_no, row_number() OVER (PARTITION BY o_orderkey ORDER BY line_no) AS item_no FROM items")
def q_number_items(spark, sf_dir):
    items = invoice_items(spark, sf_dir).select("o_orderkey", "line_no")   # what the numbers need, as items are stored
    return E.number_items(items, ["o_orderkey"]).select("o_orderkey", "line_no", "item_no")


def all_queries() -> dict[str, Builder]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


def _load_all() -> None:
    # the other families register themselves on import
    from . import catalog_resolve, catalog_jobs, catalog_ocr, catalog_stream  # noqa: F401


# ------------------------------------------------------------------ named scalar operators

@register("drop_undescribed", _sql_lines_items() + f"SELECT {_LKEYS} FROM items")
def q_drop_undescribed(spark, sf_dir):
    """Rendered lines that keep a description (O-12)."""
    return line_level_items(spark, sf_dir).select(*_LKEY_COLS)


@register("extract_tax_code", _sql_lines_items() + f"SELECT {_LKEYS}, hsn_code, sac_code FROM items")
def q_extract_tax_code(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir).where(I.extract_description(F.col("line")).isNotNull())
    code = I.tax_code(F.col("line"))
    return lines.select(*_LKEY_COLS, I.hsn_code(code).alias("hsn_code"), I.sac_code(code).alias("sac_code"))


@register("assign_amounts", _sql_lines_items()
          + f"SELECT {_LKEYS}, quantity, unit_price, total_amount, taxable_amount FROM items")
def q_assign_amounts(spark, sf_dir):
    return line_level_items(spark, sf_dir).select(*_LKEY_COLS, "quantity", "unit_price", "total_amount",
                                                  "taxable_amount")


@register("confidence_score", _sql_lines_items() + f"SELECT {_LKEYS}, confidence_score FROM items")
def q_confidence_score(spark, sf_dir):
    return line_level_items(spark, sf_dir).select(*_LKEY_COLS, "confidence_score")


@register("escalation_reasons", _sql_lines_items()
          + f"SELECT {_LKEYS}, escalation_reasons, escalation_flag FROM items")
def q_escalation_reasons(spark, sf_dir):
    return line_level_items(spark, sf_dir).select(
        *_LKEY_COLS, F.array_join("escalation_reasons", ",").alias("escalation_reasons"), "escalation_flag")


@register("project_item", _sql_items(True) + "SELECT o_orderkey, line_no, coalesce(escalation_reasons, '') AS "
          "escalation_reasons, coalesce(canonical_base_uom, 'EA') AS canonical_base_uom FROM items")
def q_project_item(spark, sf_dir):
    from ..operators.jobs import project_item
    p = project_item(invoice_items(spark, sf_dir))
    return p.select("o_orderkey", "line_no", F.array_join("escalation_reasons", ",").alias("escalation_reasons"),
                    "canonical_base_uom")


_WORDS_SQL = O.with_(O.cte_lines(), """words AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(w) AS token, unnest(generate_series(0, len(w) - 1)) AS pos
  FROM (SELECT *, string_split(line, ' ') AS w FROM rlines))""")


def _words(spark, sf_dir):
    lines = FX.render_lines(spark, sf_dir)
    return lines.select(*_LKEY_COLS, F.posexplode(F.split("line", " ")).alias("pos", "token"))


@register("normalize_uom", _WORDS_SQL + f"SELECT {_LKEYS}, pos, {O.norm_uom('token')} AS uom_code FROM words")
def q_normalize_uom(spark, sf_dir):
    """Every word of every rendered line through the unit dictionary (O-47)."""
    return _words(spark, sf_dir).select(*_LKEY_COLS, "pos", I.normalize_uom("token").alias("uom_code"))


@register("join_uom_alias", _WORDS_SQL + f"SELECT {_LKEYS}, pos, {O.norm_uom('token')} AS uom_code FROM words")
def q_join_uom_alias(spark, sf_dir):
    """Table form of O-16: words joined to the broadcast alias dimension."""
    from ..operators.units import join_uom_alias
    return join_uom_alias(_words(spark, sf_dir), "token").select(*_LKEY_COLS, "pos", "uom_code")


@register("join_uom_multiplier", _WORDS_SQL + f"SELECT {_LKEYS}, pos, {O.norm_uom('token')} AS uom_code, "
          f"{O.multiplier(O.norm_uom('token'))} AS multiplier FROM words")
def q_join_uom_multiplier(spark, sf_dir):
    """Table form of O-17: unit codes joined to the broadcast multiplier dimension."""
    from ..operators.units import join_uom_alias, join_uom_multiplier
    codes = join_uom_alias(_words(spark, sf_dir), "token")
    return join_uom_multiplier(codes, "uom_code").select(*_LKEY_COLS, "pos", "uom_code",
                                                         F.col("multiplier").cast("int"))
