"""Line items page by page (O-30 + O-52): a document is never one row.

A document is the join of its pages (``ocr.concat_pages``), and its item table
lies between two lines that may stand on any of them.  What a page says about
them is a small state:

* how many lines it has,
* its first footer line, if any,
* its last header line at or before that (in the whole page, if it has none).

These states combine in page order: line numbers are running sums of the
lines before a page (``positions.running``: a document of any length is spread
over ranges), the end of the table is the least footer line, and its start
follows the greatest header line not behind the end.  Both are plain
aggregates.  The supplier comes from the first 30 lines, which at most 30 pages
share.  Then every page extracts its own lines.

Work on texts: one pass that cleans and splits the pages, written once; the
first pages again for the suppliers; and one join of pages with their bounds
on the page itself, so no key holds more than a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import items as I
from ..functions import text as T
from ..sources.sinks import materialize
from .extract import extract_from_lines
from .positions import RANGE, attach, running


def _between(style: str, clean: bool) -> list[str]:
    """Lines that the separator of ``concat_pages`` puts between two pages."""
    if style not in ("worker", "cli"):
        raise ValueError("style is 'worker' or 'cli'")
    lines = (X.PAGE_BREAK_WORKER if style == "worker" else X.PAGE_BREAK_CLI).split("\n")[1:-1]
    return [x for x in lines if x] if clean else lines


def page_states(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text",
                style: str = "worker", clean: bool = True) -> DataFrame:
    """One row per page that counts (worker: those with text): ``key``,
    ``page``, ``page_row`` (its number in this table), ``n_lines``, ``footer``
    and ``after_header`` (line numbers in the page, from 0; null: none),
    ``head`` (the first lines) and ``candidates`` (place and text of the lines
    that may be items, O-11).  Written once: the numbers of rows stay as they
    are, and later steps read the columns they need."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(key, page, body.alias("_t"))
    if style == "worker":
        rows = rows.where("_t <> ''")
    lines = T.clean_lines(F.col("_t")) if clean else F.split("_t", "\n", -1)
    s = rows.select(key, page, lines.alias("lines"))
    s = s.select("*", F.lower(F.array_join("lines", "\n")).alias("_low"))
    s = s.select("*", T.footer_region(F.col("_low")).alias("_region"))
    none = F.size("lines") == 0
    header = T.table_start(F.col("_low"), F.col("_region"))
    stripped = F.transform("lines", lambda x, i: F.struct(i.alias("i"), (x if clean else I.strip(x)).alias("line")))
    s = s.select(
        key, page, F.monotonically_increasing_id().alias("page_row"), F.size("lines").alias("n_lines"),
        F.when(~none & (F.col("_region") != ""), T.table_end(F.col("_low"), F.col("_region"))).alias("footer"),
        F.nullif(header, F.lit(0)).alias("after_header"), F.slice("lines", 1, X.SUPPLIER_HEADER_LINES).alias("head"),
        F.filter(stripped, lambda c: T.is_candidate_line(c["line"])).alias("candidates"))
    return materialize(s.select("*", F.size("candidates").alias("n_candidates")), "pages")


def page_bounds(states: DataFrame, key: str = "doc_id", page: str = "page_no", between: int = 0,
                partitions: int | None = None) -> DataFrame:
    """(key, page_row, page_at, first_line, n_lines, table_start, table_end) of
    each page: where its lines stand in the document, and the document's item
    table (O-41).  ``between`` lines separate two pages."""
    narrow = states.select(key, page, "page_row", "n_lines", "footer", "after_header")
    placed = running(narrow, [key], [F.col(page), F.col("page_row")], number="page_at", sums={"_lines_before": "n_lines"},
                     keep_range=True, partitions=partitions, name="page-order")
    placed = materialize(placed.withColumn("first_line", F.col("_lines_before") + F.col("page_at") * between).drop("_lines_before"),
                         "page-places")
    ends = placed.groupBy(key).agg(F.min(F.col("first_line") + F.col("footer")).alias("_footer"),
                                   F.max(F.col("first_line") + F.col("n_lines")).alias("_length"))
    placed = attach(placed, [key], ends)
    # a page behind the first footer line says nothing about the header
    seen = F.when(F.col("_footer").isNull() | (F.col("first_line") <= F.col("_footer")), F.col("first_line") + F.col("after_header"))
    starts = placed.groupBy(key).agg(F.coalesce(F.max(seen), F.lit(0)).alias("table_start"))
    return attach(placed, [key], starts).select(
        key, page, "page_row", "page_at", "first_line", "n_lines", "table_start",
        F.coalesce("_footer", "_length").alias("table_end"), RANGE)


def page_suppliers(states: DataFrame, bounds: DataFrame, key: str = "doc_id", page: str = "page_no",
                   between: list[str] | None = None) -> DataFrame:
    """(key, supplier_name) from the first lines of each document (O-39)."""
    between = between or []
    first = bounds.where((F.col("first_line") - len(between) < X.SUPPLIER_HEADER_LINES)
                         & ((F.col("n_lines") > 0) | F.lit(bool(between)))).select("page_row", "page_at", "first_line")
    first = materialize(first.join(bounds.select("page_row", page), "page_row"), "first-pages")
    # a number that no page of these exceeds prunes the scan of the lines
    last = first.agg(F.max(page)).first()[0]
    heads = states.where((F.col(page) <= F.lit(last)) | F.col(page).isNull()).select(key, "page_row", "head")
    before = F.when(F.col("page_at") > 0, F.array(*[F.lit(x) for x in between]).cast("array<string>")).otherwise(
        F.array().cast("array<string>"))
    heads = heads.join(first, "page_row").select(key, F.struct("page_at", F.concat(before, "head").alias("l")).alias("_h"))
    lines = heads.groupBy(key).agg(F.array_sort(F.collect_list("_h")).alias("_h")).select(
        key, F.slice(F.flatten(F.transform("_h", lambda h: h["l"])), 1, X.SUPPLIER_HEADER_LINES).alias("_lines"))
    lines = lines.select("*", T.supplier_header(F.col("_lines")).alias("_header"))
    return lines.select(key, T.supplier_from_lines(F.col("_lines"), F.col("_header")).alias("supplier_name"))


def page_candidate_lines(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text",
                         style: str = "worker", clean: bool = True, given: DataFrame | None = None,
                         partitions: int | None = None) -> DataFrame:
    """Pages -> (key, page, supplier_name, line_no, line) for the candidate
    lines of each document's item table; ``line_no`` is the line of the
    document.  Equal to ``explode_candidate_lines`` of the joined pages.  Pages
    of one document with one number stand in the order of their rows.
    ``given`` (key, supplier_name) overrides the supplier that is found, where
    it has a name."""
    between = _between(style, clean)
    states = page_states(pages, key, page, text, style, clean)
    bounds = materialize(page_bounds(states, key, page, len(between), partitions), "page-bounds")
    names = page_suppliers(states, bounds, key, page, between)
    if given is not None:
        known = given.select(F.col(key).alias("_k"), F.nullif("supplier_name", F.lit("")).alias("_s")).groupBy("_k").agg(
            F.min("_s").alias("_s"))
        names = names.join(known, names[key].eqNullSafe(known["_k"]), "left").select(
            names[key], F.coalesce("_s", "supplier_name").alias("supplier_name"))
    bounds = attach(bounds, [key], names)
    inside = bounds.where((F.col("first_line") < F.col("table_end")) & (F.col("first_line") + F.col("n_lines") > F.col("table_start")))
    inside = inside.select("page_row", "supplier_name", "first_line", "table_start", "table_end")
    rows = states.where("n_candidates > 0").select(key, page, "page_row", "candidates").join(inside, "page_row")
    return (rows.select(key, page, "supplier_name", "table_start", "table_end", "first_line", F.explode("candidates").alias("_c"))
            .select(key, page, "supplier_name", (F.col("first_line") + F.col("_c.i")).cast("int").alias("line_no"),
                    F.col("_c.line").alias("line"), "table_start", "table_end")
            .where((F.col("line_no") >= F.col("table_start")) & (F.col("line_no") < F.col("table_end")))
            .drop("table_start", "table_end"))


def extract_page_items(pages: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text",
                       style: str = "worker", clean: bool = True, given: DataFrame | None = None,
                       partitions: int | None = None, **rules) -> DataFrame:
    """Pages -> one row per line item: ``key``, ``page`` (where the item
    stands), ``line_no`` and the item columns; the items of
    ``extract_line_items`` over the joined pages."""
    return extract_from_lines(page_candidate_lines(pages, key, page, text, style, clean, given, partitions), **rules)
