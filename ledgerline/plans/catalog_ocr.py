"""Registered OCR-table queries (O-02, O-03, O-25..O-28, O-30, O-32, O-38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import ocr as OC
from ..session import shared_dir
from ..sources import tables as TB
from ..sources.sinks import sink_text_files
from . import fixtures as FX
from . import oracle as O
from .catalog import ITEM_OUT, register

_KEEP = f"conf > 40 AND {O.strip('text')} <> ''"


@register("assemble_lines", "WITH " + O.cte_tokens() + f""",
kept AS (SELECT *, {O.strip('text')} AS w FROM tokens WHERE {_KEEP}),
ln AS (SELECT doc_id, page_no, concat(cast(block_num AS varchar), '_', cast(line_num AS varchar)) AS k,
         string_agg(w, ' ' ORDER BY lft, token_idx) AS line, sum(conf) AS s, count(*) AS n
       FROM kept GROUP BY ALL),
pg AS (SELECT doc_id, page_no, string_agg(line, chr(10) ORDER BY k) AS txt, sum(s) / sum(n) / 100.0::DOUBLE AS c
       FROM ln GROUP BY ALL),
allp AS (SELECT DISTINCT doc_id, page_no FROM tokens)
SELECT a.doc_id, a.page_no, {O.clean_text('coalesce(pg.txt, ' + "''" + ')')} AS text, coalesce(pg.c, 0.0::DOUBLE) AS confidence
FROM allp a LEFT JOIN pg USING (doc_id, page_no)""")
def q_assemble_lines(spark, sf_dir):
    return OC.assemble_lines(FX.render_tokens(spark, sf_dir))


@register("assemble_detected_lines", "WITH " + O.cte_tokens() + f""",
det AS (SELECT doc_id, page_no, token_idx AS idx, text, cast(conf AS double) / 100 AS conf FROM tokens),
pg AS (SELECT doc_id, page_no,
         string_agg(CASE WHEN conf > 0.5 AND text <> '' THEN text END, chr(10) ORDER BY idx) AS txt,
         avg(CASE WHEN conf > 0.5 AND text <> '' THEN conf END) AS c
       FROM det GROUP BY ALL)
SELECT doc_id, page_no, {O.clean_text('coalesce(txt, ' + "''" + ')')} AS text, round(coalesce(c, 0.0::DOUBLE), 9) AS confidence FROM pg""")
def q_assemble_detected_lines(spark, sf_dir):
    """Mean of doubles: rounded, as summation order differs between engines."""
    d = OC.assemble_detected_lines(FX.render_detections(spark, sf_dir))
    return d.withColumn("confidence", F.round("confidence", 9))


@register("token_confidence_stats", "WITH " + O.cte_tokens() + """,
v AS (SELECT doc_id, page_no, CASE WHEN regexp_full_match(cast(conf AS varchar), '[0-9]+') THEN conf END AS c FROM tokens)
SELECT doc_id, page_no, round_even(avg(c), 2) AS mean_confidence, round_even(quantile_cont(c, 0.5), 2) AS median_confidence,
  min(c) AS min_confidence, max(c) AS max_confidence,
  count(CASE WHEN c < 60 THEN 1 END) AS low_confidence_words, count(CASE WHEN c > 80 THEN 1 END) AS high_confidence_words,
  count(c) AS total_words, count(CASE WHEN c < 40 THEN 1 END) AS very_low,
  count(CASE WHEN c >= 40 AND c < 60 THEN 1 END) AS low, count(CASE WHEN c >= 60 AND c < 80 THEN 1 END) AS medium,
  count(CASE WHEN c >= 80 THEN 1 END) AS high,
  CASE WHEN count(c) = 0 THEN 'No confidence data available' END AS error
FROM v GROUP BY ALL""")
def q_token_confidence_stats(spark, sf_dir):
    s = OC.token_confidence_stats(FX.render_tokens(spark, sf_dir))
    return s.withColumn("min_confidence", F.col("min_confidence").cast("int")) \
            .withColumn("max_confidence", F.col("max_confidence").cast("int"))


def _pass_sql() -> str:
    parts = []
    for m, (n, c) in X.OCR_ACCEPT.items():
        cond = f"length(text) > {n}" + ("" if c is None else f" AND confidence > {c}")
        parts.append(f"WHEN method = '{m}' THEN {cond}")
    return f"CASE {' '.join(parts)} WHEN method = 'tesseract_raw' THEN true ELSE false END"


@register("select_ocr_candidate", "WITH " + O.cte_candidates() + f""",
ok AS (SELECT *, {_pass_sql()} AS pass FROM candidates),
best AS (SELECT doc_id, page_no, arg_min(method, priority) AS method, arg_min(text, priority) AS text,
           arg_min(confidence, priority) AS confidence FROM ok WHERE pass GROUP BY ALL)
SELECT doc_id, page_no, method, text, confidence, CASE WHEN text = '' THEN 'All advanced methods failed' END AS error FROM best""")
def q_select_ocr_candidate(spark, sf_dir):
    return OC.select_ocr_candidate(FX.render_candidates(spark, sf_dir))


_PSM = f"""runs AS (SELECT doc_id, 1 AS page_no, psm, {FX.PSM_SQL} AS text
  FROM documents CROSS JOIN (VALUES (6), (4), (3)) v(psm)),
sc AS (SELECT *, CASE WHEN length(text) > 50 THEN
         length(text) * 0.3::DOUBLE + {O.count_class('text', '\\p{L}\\p{N}')} / greatest(length(text), 1) * 2000.0::DOUBLE
         + len(string_split(text, chr(10))) * 50.0::DOUBLE END AS score,
         CASE psm WHEN 6 THEN 0 WHEN 4 THEN 1 ELSE 2 END AS o FROM runs)"""


@register("best_psm", f"WITH {_PSM},\n" + f"""best AS (SELECT doc_id, page_no, arg_max(psm, (score, -o)) AS psm, arg_max(text, (score, -o)) AS text,
  max(score) AS score FROM sc WHERE score IS NOT NULL GROUP BY ALL),
allp AS (SELECT DISTINCT doc_id, page_no FROM runs)
SELECT a.doc_id, a.page_no, b.psm, coalesce({O.clean_text('b.text')}, '') AS text,
  coalesce(least(0.9::DOUBLE, b.score / 3000.0::DOUBLE), 0.0::DOUBLE) AS confidence
FROM allp a LEFT JOIN best b USING (doc_id, page_no)""")
def q_best_psm(spark, sf_dir):
    return OC.best_psm(FX.render_psm_runs(spark, sf_dir))


@register("concat_pages", "WITH " + O.cte_pages() + """
SELECT doc_id, coalesce(string_agg(CASE WHEN text <> '' THEN text END, chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no), '') AS text,
  count(*) AS total_pages FROM pages_r GROUP BY doc_id""")
def q_concat_pages(spark, sf_dir):
    return OC.concat_pages(FX.render_pages(spark, sf_dir), style="worker")


@register("concat_pages_cli", "WITH " + O.cte_pages() + """
SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text, count(*) AS total_pages
FROM pages_r GROUP BY doc_id""")
def q_concat_pages_cli(spark, sf_dir):
    return OC.concat_pages(FX.render_pages(spark, sf_dir), style="cli")


@register("scan_tokens", "WITH " + O.cte_tokens() + "\nSELECT doc_id, page_no, token_idx, conf FROM tokens")
def q_scan_tokens(spark, sf_dir):
    """Write the token table as Parquet and scan it back (O-03)."""
    path = shared_dir(spark, "tokens") + "/t"
    FX.render_tokens(spark, sf_dir).write.parquet(path)
    return TB.scan_tokens(spark, path).select("doc_id", "page_no", "token_idx", "conf")


@register("scan_pages", "WITH " + O.cte_pages() + "\nSELECT doc_id, page_no, length(text) AS n_chars, method FROM pages_r")
def q_scan_pages(spark, sf_dir):
    """Write page rows as Parquet partitioned by method and scan them back (O-02)."""
    path = shared_dir(spark, "pages") + "/t"
    FX.render_pages(spark, sf_dir).write.partitionBy("method").parquet(path)
    p = TB.scan_pages(spark, path)
    return p.select("doc_id", "page_no", F.length("text").alias("n_chars"), "method")


@register("scan_page_files", "WITH " + O.cte_pages() + "\nSELECT cast(doc_id AS varchar) AS doc_id, page_no, text FROM pages_r")
def q_scan_page_files(spark, sf_dir):
    """Page texts, one file per document (O-02, text source): written with
    form feeds between pages and read back with ``wholetext``."""
    base = shared_dir(spark, "pagefiles")
    docs = FX.render_pages(spark, sf_dir).groupBy(F.col("doc_id").cast("string").alias("doc")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\f")
        .alias("text"))
    sink_text_files(docs, base + "/files", "doc")
    return TB.scan_page_files(spark, base + "/files", glob="*.txt", doc_pattern=r"/doc=([^/]+?)(?:\.txt|/[^/]+)$")


# ------------------------------------------------------------------ pages -> items, end to end

_PAGE_CONF = "CASE WHEN page_no % 2 = 0 THEN 0.75 ELSE 0.65 END"


def _invoice_candidates(spark, sf_dir, invoices=None):
    """Each line of a rendered invoice is an OCR page, read by two engines;
    an engine cleans its text before it is judged."""
    inv = FX.render_invoices(spark, sf_dir) if invoices is None else invoices
    pages = inv.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(F.split("txt", "\n")).alias("pos", "text"))
    pages = pages.select("doc_id", (F.col("pos") + 1).alias("page_no"), T.clean_text("text").alias("text"))
    candidate = lambda method, conf: F.struct(F.lit(method).alias("method"), F.col("text").alias("text"),
                                              conf.alias("confidence"))
    return pages.select("doc_id", "page_no", F.inline(F.array(
        candidate("paddle_ocr", F.expr(_PAGE_CONF).cast("double")),
        candidate("tesseract_raw", T.raw_text_confidence(F.col("text"))))))


_DOCUMENT_ITEMS = "WITH " + O.cte_invoices() + f""",
pg0 AS (SELECT o_orderkey AS doc_id, unnest(w) AS text, unnest(generate_series(1, len(w))) AS page_no
        FROM (SELECT o_orderkey, string_split(txt, chr(10)) AS w FROM invoices)),
pg1 AS (SELECT *, {O.clean_text('text')} AS clean FROM pg0),
pg AS (SELECT *, length(clean) > 50 AND {_PAGE_CONF} > 0.7 AS paddle_ok FROM pg1),
docs AS (SELECT doc_id, coalesce(string_agg(CASE WHEN clean <> '' THEN clean END,
           chr(10) || chr(10) || '--- PAGE BREAK ---' || chr(10) || chr(10) ORDER BY page_no), '') AS text,
           sum(CASE WHEN paddle_ok THEN 1 ELSE 0 END) AS paddle_pages, count(*) AS total_pages
         FROM pg GROUP BY doc_id),
{O.cte_candidate_lines('docs', ['doc_id'], 'text', True)},
{O.cte_items('cand')}"""


@register("document_line_items", _DOCUMENT_ITEMS + """,
per_doc AS (SELECT doc_id, count(*) AS items, round(sum(total_amount), 2) AS total_amount,
              sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS escalated FROM items GROUP BY doc_id)
SELECT d.doc_id, d.total_pages, d.paddle_pages, coalesce(p.items, 0) AS items, p.total_amount,
  coalesce(p.escalated, 0) AS escalated
FROM docs d LEFT JOIN per_doc p USING (doc_id)""")
def q_document_line_items(spark, sf_dir):
    """Cleaned OCR candidates (O-31) -> chosen page text (O-26) -> document
    text (O-30) -> line items (O-52) -> per-document summary."""
    from ..operators import extract as E
    from ..sources.sinks import materialize
    chosen = OC.select_ocr_candidate(_invoice_candidates(spark, sf_dir))
    pages = chosen.select("doc_id", "page_no", "text", (F.col("method") == "paddle_ocr").alias("_paddle"))
    # feeds the extraction and the summary
    docs = materialize(OC.concat_pages(pages, style="worker", extra=[F.count_if("_paddle").alias("paddle_pages")]), "docs")
    items = E.extract_line_items(docs, ["doc_id"], text="text", clean=True)
    per_doc = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("items"),
                                          F.round(F.sum("total_amount"), 2).alias("total_amount"),
                                          F.count_if("escalation_flag").alias("escalated"))
    return (docs.join(per_doc, "doc_id", "left")
            .select("doc_id", F.col("total_pages").cast("bigint"), F.col("paddle_pages").cast("bigint"),
                    F.coalesce("items", F.lit(0)).cast("bigint").alias("items"), "total_amount",
                    F.coalesce("escalated", F.lit(0)).cast("bigint").alias("escalated")))


@register("page_line_items", _DOCUMENT_ITEMS + "\nSELECT doc_id, " + ", ".join(ITEM_OUT) + " FROM items")
def q_page_line_items(spark, sf_dir):
    """The items of the same documents, extracted page by page: no document
    becomes one row (O-30 + O-52)."""
    from ..operators import extract as E
    from ..operators import pages as PG
    chosen = OC.select_ocr_candidate(_invoice_candidates(spark, sf_dir)).select("doc_id", "page_no", "text")
    return E.flatten_items(PG.extract_page_items(chosen)).select("doc_id", *ITEM_OUT)
