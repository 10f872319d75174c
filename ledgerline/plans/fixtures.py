"""Inputs derived from the given tables.

The test tables hold no invoices, so invoices, jobs, OCR tokens, OCR
candidates, model answers and file observations are *rendered* from them
by plain column arithmetic.  The expression texts below are shared by the
Spark side (``selectExpr``) and the DuckDB oracle (``{s}`` is the string
type name), so both engines read byte-identical inputs.  Every rendered
table grows with the table it comes from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- rendered invoice line, one per lineitem row (needs part columns) ----
# Some lines reach the rules that ordinary ones never do: no digit or a skipped word (no candidates), nothing that
# describes an item, a pack of zero, only a name (low confidence where the supplier is unknown too).
RARE_LINE_SQL = """case l_partkey % 8
   when 0 then 'freight and handling as agreed'
   when 1 then concat('Rounding amount ', cast(l_linenumber as {s}), '.50')
   when 2 then concat(cast(l_partkey as {s}), cast(1000000 + l_suppkey as {s}))
   when 3 then concat(p_name, '  PK0  INR ', cast(cast(l_quantity as int) as {s}), '  INR 10.00  INR 40.00')
   when 4 then concat('nut ', cast(l_linenumber as {s}), 'x')
   when 5 then concat(p_name, chr(160), 'type ', cast(p_size as {s}), ' GRS')
   when 6 then concat('INVOICE ', cast(l_orderkey as {s}))
   else concat('a', cast(l_linenumber as {s})) end"""
LINE_SQL = """case when (l_orderkey + l_linenumber) % 37 = 0 then """ + RARE_LINE_SQL + """ else concat(p_name,
  case p_size % 5 when 0 then ' sheet' when 1 then ' carton' else '' end,
  case (l_linenumber + l_partkey) % 7
   when 0 then concat('  ', cast(cast(l_quantity as int) as {s}), '/CS')
   when 1 then concat('  PK', cast(p_size as {s}))
   when 2 then concat('  (', cast(p_size as {s}), ') 40 EA')
   when 3 then '  DZ' when 4 then concat('  BX/', cast(p_size as {s}))
   when 5 then '' else '  12/DOZEN' end,
  case l_suppkey % 3 when 0 then concat('  MPN: AB-', lpad(cast(l_partkey as {s}), 5, '0'))
   when 1 then concat('  ZX', lpad(cast(l_suppkey as {s}), 4, '0')) else '' end,
  case l_partkey % 4
   when 0 then concat('  INR ', cast(cast(l_quantity as int) as {s}), '  INR ', cast(cast(p_retailprice as decimal(18,2)) as {s}), '  INR ', cast(cast(l_extendedprice as decimal(18,2)) as {s}))
   when 1 then concat('  @INR ', cast(cast(p_retailprice as decimal(18,2)) as {s}), '  @INR ', cast(cast(l_extendedprice as decimal(18,2)) as {s}))
   when 2 then concat('  USD', cast(cast(l_extendedprice as decimal(18,2)) as {s}))
   else concat('  (', cast(cast(l_quantity as int) as {s}), ')  @ ', cast(cast(p_retailprice as decimal(18,2)) as {s})) end) end"""

# ---- invoice header and footer, one per order ------------------------------
HEADER_SQL = """case when o_orderkey % 23 = 4 then 'to whom it may concern' else case o_orderkey % 4 when 0 then concat('Sold By: Acme Trading ', cast(o_custkey as {s}))
 when 1 then 'NORTHERN SUPPLY LLC' when 2 then 'Northern Tools Group' else 'Plain Workshop Name' end end"""
# nothing in these invoices names a supplier: no line begins with a capital
TABLE_HEAD_SQL = "case when o_orderkey % 23 = 4 then 'description  pack  rate  amount' else 'Description  Pack  Rate  Amount' end"
FOOTER_SQL = "concat('Subtotal  INR ', cast(cast(o_totalprice as decimal(18,2)) as {s}))"

# ---- jobs, one per order -----------------------------------------------------
JOB_SQL = {
    "job_id": "concat('job_', cast(o_orderkey as {s}))",
    "file_name": "concat(cast(o_orderkey as {s}), '.pdf')",
    "file_path": "concat('/in/', cast(o_orderkey as {s}), '.pdf')",
    "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'pending' end",
    "created_at": "o_orderdate",
    "options": "concat('{{\"enable_agentic_lookup\": ', case when o_orderkey % 2 = 0 then 'true' else 'false' end, "
               "', \"supplier_name\": null, \"batch_id\": \"batch_', cast(o_custkey % 50 as {s}), '\"}}')",
}

# ---- dirty text for cleaning -------------------------------------------------
DIRTY_SQL = ("replace(text, '. ', concat('.', chr(7), chr(9), '  ', chr(10), ' ', chr(10), "
             "'$$#%^&*!', chr(10), 'a?', chr(10)))")

# ---- OCR tokens: every word of every document ------------------------------------
TOKEN_SQL = {
    "page_no": "cast(floor(pos / 500) + 1 as int)",
    "block_num": "cast(floor(pos / 60) + 1 as int)",
    "line_num": "cast(cast(floor(pos / 5) as bigint) % 12 + 1 as int)",
    "lft": "cast((pos * 37) % 200 as int)",
    "conf": "cast((doc_id * 31 + pos * 17) % 101 as int)",
}

# ---- OCR candidates: document x method ------------------------------------------
CANDIDATE_SQL = {
    "text": ("case (doc_id * 13 + m * 29) % 5 when 0 then '' "
             "when 1 then replace(text, '. ', chr(10)) else text end"),
    "confidence": "cast((doc_id * 7 + m * 31) % 100 as double) / 100",
}

# ---- model answers from part rows -------------------------------------------------
ANSWER_UOMS = ["EA", "CS", "PK", "BX", "DZ", "PR", "SET", "RL", "SH", "M", "KG", "L", "UNK", "XX"]


def answer_sql(s: str) -> str:
    uoms = " ".join(f"when {i} then '{u}'" for i, u in enumerate(ANSWER_UOMS))
    return ("concat('{{\"uom\": \"', case p_size % 14 " + uoms + " end, '\"', "
            "case when p_partkey % 11 = 0 then '' else concat(', \"pack_quantity\": ', cast(p_size as {s})) end, "
            "', \"confidence\": ', cast(cast(cast(p_partkey % 16 - 2 as double) / 10 as decimal(4,1)) as {s}), "
            "', \"reasoning\": \"size ', cast(p_size as {s}), '\"}}')").format(s=s)


# ---- file observations from events --------------------------------------------------
OBS_SQL = {
    "path": "concat('/in/', cast(user_id as {s}), '.pdf')",
    "observed_at": "ts",
    "size": "cast(get_json_object(props, '$.k') as bigint)",
    "content": "props",
}


def sql(expr: str, dialect: str = "spark") -> str:
    if dialect == "spark":
        return expr.format(s="string")
    return expr.format(s="varchar").replace("get_json_object(", "json_extract_string(")


# ======================================================================= Spark side

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """Pruned scan of a table feeding CPU-bound work, spread over the cores."""
    from ..sources.tables import spread
    return spread(table(spark, sf_dir, name).select(*columns))


def render_lines(spark: SparkSession, sf_dir: str, spread_out: bool = True) -> DataFrame:
    """lines(l_orderkey, l_linenumber, l_partkey, l_suppkey, line): one per lineitem."""
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    li = wide(spark, sf_dir, "lineitem", cols) if spread_out else table(spark, sf_dir, "lineitem").select(*cols)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{sql(LINE_SQL)} as line")


def render_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoices(o_orderkey, o_custkey, txt): one document per order with lines.

    Lines are joined to their order first and grouped on the same key, so
    the join's hash partitioning on the order key is reused by the group
    (one exchange per side).  An order holds a bounded number of lines."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    lines = render_lines(spark, sf_dir)
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    body = (joined.groupBy("o_orderkey")
            .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "line")))
                 .alias("ls"), F.any_value("o_custkey").alias("o_custkey"),
                 F.any_value("o_totalprice").alias("o_totalprice")))
    return body.select(
        "o_orderkey", "o_custkey",
        F.concat_ws("\n", F.expr(sql(HEADER_SQL)), F.expr(sql(TABLE_HEAD_SQL)),
                    F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
                    F.expr(sql(FOOTER_SQL))).alias("txt"))


def render_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.selectExpr("o_orderkey", *[f"{sql(e)} as {k}" for k, e in JOB_SQL.items()])


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide(spark, sf_dir, "documents", ["doc_id", "text"]).selectExpr(
        "doc_id", f"{sql(DIRTY_SQL)} as text")


def render_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(doc_id, token_idx, page_no, block_num, line_num, lft, conf, text):
    every word of every document; 500 words to a page."""
    docs = wide(spark, sf_dir, "documents", ["doc_id", "text"])
    words = docs.select("doc_id", F.posexplode(F.split("text", " "))
                        .alias("pos", "text"))
    return words.selectExpr("doc_id", "pos as token_idx", *[f"{e} as {k}" for k, e in TOKEN_SQL.items()], "text")


def render_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """candidates(doc_id, page_no, method, priority, text, confidence)."""
    from ..functions.fixed import OCR_METHODS
    docs = wide(spark, sf_dir, "documents", ["doc_id", "text"])
    methods = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("method"))
                        for i, n in enumerate(OCR_METHODS)])
    rows = docs.select("doc_id", "text", F.inline(methods))
    rows = rows.where(~((F.col("method") == "openai_vision") & (F.col("doc_id") % 3 == 0)))
    return rows.selectExpr("doc_id", "1 as page_no", "method", "m as priority",
                           *[f"{e} as {k}" for k, e in CANDIDATE_SQL.items()])


def render_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """answers(job_id, line_no, answer): one model answer per rendered line.
    ``line_no`` is the 0-based line in the invoice (two lines precede the table)."""
    from pyspark.sql import Window
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return (li.join(part, li.l_partkey == part.p_partkey)
            .select(F.concat(F.lit("job_"), F.col("l_orderkey").cast("string")).alias("job_id"),
                    (F.row_number().over(w) + 1).cast("int").alias("line_no"),
                    F.expr(answer_sql("string")).alias("answer")))


def render_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.selectExpr("event_id", *[f"{sql(e)} as {k}" for k, e in OBS_SQL.items()])


# ---- OCR pages: each paragraph of a document is a page ------------------------------
PAGE_SQL = {
    "text": "case when (doc_id + pos) % 7 = 0 then '' else para end",
    "method": "case (doc_id + pos) % 5 " + " ".join(
        f"when {i} then '{m}'" for i, m in enumerate(
            ["tesseract_layout", "tesseract_multi_psm", "paddle_ocr", "openai_vision", "tesseract_raw"])) + " end",
    "confidence": "cast((doc_id * 7 + pos * 13) % 100 as double) / 100",
}


def render_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages(doc_id, page_no, text, method, confidence): page k of a document
    is its k-th paragraph; some pages are blank (OCR found nothing)."""
    docs = wide(spark, sf_dir, "documents", ["doc_id", "text"])
    paras = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "para"))
    return paras.selectExpr("doc_id", "cast(pos + 1 as int) as page_no",
                            *[f"{e} as {k}" for k, e in PAGE_SQL.items()])


def render_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """detections(doc_id, page_no, idx, text, conf): each token as a detected
    line with a confidence in [0, 1]."""
    return render_tokens(spark, sf_dir).selectExpr(
        "doc_id", "page_no", "token_idx as idx", "text", "cast(conf as double) / 100 as conf")


PSM_SQL = ("case psm when 6 then text when 4 then replace(text, '. ', concat('.', chr(10))) "
           "else case when doc_id % 4 = 0 then '' else concat(text, chr(10), '###') end end")


def render_psm_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """psm_runs(doc_id, page_no, psm, text): three page-segmentation runs per document."""
    docs = wide(spark, sf_dir, "documents", ["doc_id", "text"])
    runs = docs.select("doc_id", "text", F.explode(F.array(F.lit(6), F.lit(4), F.lit(3))).alias("psm"))
    return runs.selectExpr("doc_id", "1 as page_no", "psm", f"{PSM_SQL} as text")
