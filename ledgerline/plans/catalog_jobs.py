"""Registered job-table queries (O-04..O-10, O-14, O-15, O-20, O-22..O-24,
O-35, O-60)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed as X
from ..operators import jobs as J
from ..operators import rescue as RS
from ..operators import variant as VR
from ..session import shared_dir
from ..sources import sinks as SK
from . import fixtures as FX
from . import oracle as O
from .catalog import ITEM_OUT, _sql_items, line_items_table, register

# ------------------------------------------------------------------ shared SQL

_JOB_ITEMS = _sql_items(True).rstrip() + ",\n" + O.cte_jobs() + """,
it AS (SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, * EXCLUDE (o_orderkey) FROM items)
"""

_OPTS = ("coalesce(json_extract(options, '$.enable_agentic_lookup')::BOOLEAN, {d}) AS enable_agentic_lookup, "
         "json_extract_string(options, '$.supplier_name') AS option_supplier_name, "
         "json_extract_string(options, '$.batch_id') AS batch_id")

#: Some documents hold white space alone.
_TEXT = "CASE WHEN {key} % 50 = 7 THEN concat(chr(10), ' ', chr(9), chr(10)) ELSE {text} END"
_BLANK = f"coalesce({O.strip('d.txt')}, '') = ''"

_RESULTS = _JOB_ITEMS.rstrip() + f""",
inv_docs AS (SELECT j.job_id, {_TEXT.format(key='j.o_orderkey', text='i.txt')} AS txt FROM jobs j LEFT JOIN invoices i ON j.o_orderkey = i.o_orderkey),
cnt AS (SELECT job_id, count(*) AS n, sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS e FROM it GROUP BY job_id),
results AS (
  SELECT d.job_id,
    CASE WHEN {_BLANK} THEN 'failed' ELSE 'completed' END AS status,
    CASE WHEN {_BLANK} THEN {O.q(X.MSG_NO_TEXT)} END AS error_message,
    CASE WHEN {_BLANK} THEN 0 ELSE coalesce(c.n, 0) END AS total_line_items,
    CASE WHEN {_BLANK} THEN 0 ELSE coalesce(c.e, 0) END AS escalation_count
  FROM inv_docs d LEFT JOIN cnt c USING (job_id))
"""


def _jobs(spark, sf_dir):
    return FX.render_jobs(spark, sf_dir)


def _results(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    inv = FX.render_invoices(spark, sf_dir)
    docs = jobs.join(inv.select("o_orderkey", "txt"), "o_orderkey", "left").select(
        "job_id", F.expr(_TEXT.format(key="o_orderkey", text="txt")).alias("text"))
    return J.job_result_rows(docs, line_items_table(spark, sf_dir))


@register("json_options", "WITH " + O.cte_jobs() + f"\nSELECT job_id, {_OPTS.format(d='true')} FROM jobs")
def q_json_options(spark, sf_dir):
    return J.json_options(_jobs(spark, sf_dir)).select(
        "job_id", "enable_agentic_lookup", "option_supplier_name", "batch_id")


@register("filter_jobs_by_status", "WITH " + O.cte_jobs()
          + "\nSELECT job_id, file_name, status, cast(created_at AS varchar) AS created_at FROM jobs WHERE status = 'completed'")
def q_filter_jobs_by_status(spark, sf_dir):
    return J.filter_jobs_by_status(_jobs(spark, sf_dir), "completed").select(
        "job_id", "file_name", "status", F.col("created_at").cast("string").alias("created_at"))


@register("list_jobs_page", "WITH " + O.cte_jobs() + """
SELECT job_id, status, cast(created_at AS varchar) AS created_at,
  (SELECT count(*) FROM jobs WHERE status = 'processing') AS total
FROM jobs WHERE status = 'processing' ORDER BY created_at DESC, job_id LIMIT 20 OFFSET 20""")
def q_list_jobs_page(spark, sf_dir):
    """Second page of 20 of the jobs in processing, newest first."""
    rows, total = J.list_jobs(_jobs(spark, sf_dir), status="processing", page=2, page_size=20)
    return rows.select("job_id", "status", F.col("created_at").cast("string").alias("created_at"),
                       F.lit(total).cast("bigint").alias("total"))


@register("filter_line_items", _JOB_ITEMS + "SELECT job_id, line_no, confidence_score FROM it WHERE confidence_score >= 0.75")
def q_filter_line_items(spark, sf_dir):
    return J.filter_line_items(line_items_table(spark, sf_dir), min_confidence=0.75).select(
        "job_id", "line_no", "confidence_score")


@register("filter_line_items_escalated", _JOB_ITEMS
          + "SELECT job_id, line_no, escalation_reasons FROM it WHERE escalation_flag")
def q_filter_line_items_escalated(spark, sf_dir):
    df = J.filter_line_items(line_items_table(spark, sf_dir), escalation_only=True, min_confidence=0.0)
    return df.select("job_id", "line_no", F.array_join("escalation_reasons", ",").alias("escalation_reasons"))


@register("delete_job_cascade", _JOB_ITEMS + """
SELECT i.job_id, i.line_no FROM it i
WHERE i.job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'pending')""")
def q_delete_job_cascade(spark, sf_dir):
    """Delete every pending job and its items; the remaining items."""
    jobs = _jobs(spark, sf_dir)
    _, items = J.delete_jobs(jobs, line_items_table(spark, sf_dir), jobs.where(F.col("status") == "pending"))
    return items.select("job_id", "line_no")


@register("job_with_items", _JOB_ITEMS + """
SELECT j.job_id, j.status, i.line_no, i.item_description
FROM jobs j LEFT JOIN it i ON j.job_id = i.job_id AND j.status = 'completed'""")
def q_job_with_items(spark, sf_dir):
    items = line_items_table(spark, sf_dir).select("job_id", "line_no", "item_description")
    return J.job_with_items(_jobs(spark, sf_dir).select("job_id", "status"), items)


@register("zip_jobs_paths", "WITH " + O.cte_jobs() + """,
a AS (SELECT o_orderkey % 500 AS grp, job_id, row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY job_id) AS pos
      FROM jobs WHERE status = 'completed'),
b AS (SELECT o_orderkey % 500 AS grp, file_path, row_number() OVER (PARTITION BY o_orderkey % 500 ORDER BY file_path) AS pos
      FROM jobs)
SELECT grp, pos, job_id, file_path FROM a JOIN b USING (grp, pos)""")
def q_zip_jobs_paths(spark, sf_dir):
    """Per upload group, completed job ids paired by position with all paths."""
    jobs = _jobs(spark, sf_dir).withColumn("grp", F.col("o_orderkey") % 500)
    ids = jobs.where(F.col("status") == "completed").select("grp", "job_id")
    return J.zip_jobs_paths(ids, jobs.select("grp", "file_path"), "grp").select("grp", "pos", "job_id", "file_path")


#: A third of all jobs are one upload.
_BULK_GROUP = "case when o_orderkey % 3 = 0 then 0 else o_orderkey % 500 end"


@register("bulk_summary", _RESULTS.rstrip() + f""",
paths AS (SELECT {_BULK_GROUP} AS grp, o_orderkey, job_id, status, file_path FROM jobs),
a AS (SELECT grp, job_id, row_number() OVER (PARTITION BY grp ORDER BY o_orderkey) AS pos FROM paths WHERE o_orderkey % 11 <> 3),
b AS (SELECT grp, file_path, row_number() OVER (PARTITION BY grp ORDER BY o_orderkey DESC) AS pos FROM paths),
p AS (SELECT grp, pos, job_id, file_path FROM a JOIN b USING (grp, pos)),
ok AS (SELECT grp, count(*) AS n, sum(total_line_items) AS items, max(pos) AS last_pos, min(file_path) AS least_path
       FROM p JOIN results USING (job_id) WHERE status = 'completed' GROUP BY grp),
tot AS (SELECT grp, count(*) AS total_files FROM paths GROUP BY grp)
SELECT grp, total_files, coalesce(n, 0) AS successful_files, total_files - coalesce(n, 0) AS failed_files,
  coalesce(items, 0) AS total_line_items, round(coalesce(n, 0) / total_files, 9) AS success_rate,
  round(coalesce(items / n, 0.0), 9) AS avg_items_per_file, last_pos, least_path
FROM tot LEFT JOIN ok USING (grp)""")
def q_bulk_summary(spark, sf_dir):
    """Bulk requests with fewer ids than paths, in the order of the request;
    their totals count every path."""
    jobs = _jobs(spark, sf_dir).withColumn("grp", F.expr(_BULK_GROUP)).withColumn("_back", -F.col("o_orderkey"))
    results = SK.materialize(_results(spark, sf_dir), "results")
    pairs = SK.materialize(J.zip_jobs_paths(jobs.where("o_orderkey % 11 <> 3"), jobs, "grp", id_order="o_orderkey",
                                            path_order="_back"), "pairs")
    done = pairs.join(results.where("status = 'completed'"), "job_id").groupBy("grp").agg(
        F.max("pos").cast("bigint").alias("last_pos"), F.min("file_path").alias("least_path"))
    s = J.bulk_summary(pairs, jobs, results, "grp").join(done, "grp", "left")
    return s.select("grp", "total_files", "successful_files", "failed_files", "total_line_items",
                    F.round("success_rate", 9).alias("success_rate"), F.round("avg_items_per_file", 9).alias("avg_items_per_file"),
                    "last_pos", "least_path")


@register("list_jobs_keyset", "WITH " + O.cte_jobs() + """,
p AS (SELECT job_id, cast(created_at AS varchar) AS created_at, row_number() OVER (ORDER BY created_at DESC, job_id) - 1 AS place
      FROM jobs WHERE status = 'processing')
SELECT job_id, created_at, cast(floor(place / 50) + 1 AS BIGINT) AS page FROM p WHERE floor(place / 50) + 1 IN (1, 2, 3, 60)""")
def q_list_jobs_keyset(spark, sf_dir):
    """Three pages, each by the last job of the one before, and a jump to a
    later one."""
    jobs = SK.materialize(_jobs(spark, sf_dir).select("job_id", "created_at", "status"), "jobs")
    out, after = [], None
    for page in (1, 2, 3):
        rows = J.page_after(jobs, after, "processing", 50)
        out.append(rows.withColumn("page", F.lit(page).cast("bigint")))
        last = rows.tail(1)
        after = (last[0]["created_at"], last[0]["job_id"]) if last else after
    out.append(J.jump_to_page(jobs, 60, "processing", 50, skip_rows=100).withColumn("page", F.lit(60).cast("bigint")))
    made = out[0]
    for rows in out[1:]:
        made = made.unionByName(rows)
    return made.select("job_id", F.col("created_at").cast("string").alias("created_at"), "page")


@register("ocr_summary", "WITH " + O.cte_pages() + """
SELECT doc_id, count(*) AS total_pages, sum(CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END) AS successful_pages,
  round(avg(confidence), 9) AS avg_confidence, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods_used,
  arg_min(method, page_no) AS ocr_method
FROM pages_r GROUP BY doc_id""")
def q_ocr_summary(spark, sf_dir):
    s = J.ocr_summary(FX.render_pages(spark, sf_dir))
    return s.select("doc_id", "total_pages", "successful_pages", F.round("avg_confidence", 9).alias("avg_confidence"),
                    F.array_join("methods_used", ",").alias("methods_used"), "ocr_method")


@register("extraction_summary", _JOB_ITEMS.rstrip() + f""",
agg AS (SELECT job_id, count(*) AS total_line_items,
  sum(CASE WHEN coalesce(original_uom, '') <> '' THEN 1 ELSE 0 END) AS items_with_uom,
  sum(CASE WHEN coalesce(manufacturer_part_number, '') <> '' THEN 1 ELSE 0 END) AS items_with_mpn,
  sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS items_requiring_escalation,
  avg(confidence_score) AS a FROM it GROUP BY job_id)
SELECT j.job_id, coalesce(total_line_items, 0) AS total_line_items, coalesce(items_with_uom, 0) AS items_with_uom,
  coalesce(items_with_mpn, 0) AS items_with_mpn, coalesce(items_requiring_escalation, 0) AS items_requiring_escalation,
  round(coalesce(a, 0.0), 9) AS avg_confidence,
  coalesce(json_extract(options, '$.enable_agentic_lookup')::BOOLEAN, false) AS agentic_lookup_used
FROM jobs j LEFT JOIN agg USING (job_id)""")
def q_extraction_summary(spark, sf_dir):
    s = J.extraction_summary(line_items_table(spark, sf_dir), _jobs(spark, sf_dir))
    return s.withColumn("avg_confidence", F.round("avg_confidence", 9))


@register("job_result_rows", _RESULTS + "SELECT * FROM results")
def q_job_result_rows(spark, sf_dir):
    return _results(spark, sf_dir)


@register("batch_summary", _RESULTS.rstrip() + f""",
rb AS (SELECT r.*, json_extract_string(j.options, '$.batch_id') AS batch_id FROM results r JOIN jobs j USING (job_id))
SELECT batch_id, count(*) AS total_files, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS successful_files,
  count(*) - sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) AS failed_files,
  coalesce(sum(CASE WHEN status = 'completed' THEN total_line_items END), 0) AS total_line_items,
  round(coalesce(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / nullif(count(*), 0), 0.0), 9) AS success_rate,
  round(coalesce(sum(CASE WHEN status = 'completed' THEN total_line_items END) / nullif(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END), 0), 0.0), 9) AS avg_items_per_file
FROM rb GROUP BY batch_id""")
def q_batch_summary(spark, sf_dir):
    res = _results(spark, sf_dir).join(J.json_options(_jobs(spark, sf_dir)).select("job_id", "batch_id"), "job_id")
    s = J.batch_summary(res, ["batch_id"])
    return s.select("batch_id", "total_files", "successful_files", "failed_files", "total_line_items",
                    F.round("success_rate", 9).alias("success_rate"),
                    F.round("avg_items_per_file", 9).alias("avg_items_per_file"))


@register("upsert_jobs", _RESULTS + """
SELECT j.job_id, coalesce(r.status, j.status) AS status, r.total_line_items, r.escalation_count, r.error_message
FROM jobs j LEFT JOIN results r ON j.job_id = r.job_id AND j.status <> 'pending'""")
def q_upsert_jobs(spark, sf_dir):
    """Results overwrite the jobs that were picked up (not pending)."""
    jobs = _jobs(spark, sf_dir).select("job_id", "status").withColumn("total_line_items", F.lit(None).cast("int")) \
        .withColumn("escalation_count", F.lit(None).cast("int")).withColumn("error_message", F.lit(None).cast("string"))
    picked = jobs.where(F.col("status") != "pending").select("job_id")
    upd = _results(spark, sf_dir).join(picked, "job_id", "left_semi")
    out = J.upsert_jobs(jobs, upd)
    return out.select("job_id", "status", F.col("total_line_items").cast("bigint"),
                      F.col("escalation_count").cast("bigint"), "error_message")


@register("sink_line_items", _JOB_ITEMS + "SELECT job_id, line_no, escalation_flag, confidence_score FROM it")
def q_sink_line_items(spark, sf_dir):
    """Write the item table as partitioned Parquet and read it back."""
    path = shared_dir(spark, "items") + "/t"
    items = line_items_table(spark, sf_dir)
    SK.sink_line_items(items, path)
    return spark.read.parquet(path).select("job_id", "line_no", F.col("escalation_flag").cast("boolean").alias("escalation_flag"),
                                           "confidence_score")


@register("sink_json_documents", _JOB_ITEMS.rstrip() + """,
agg AS (SELECT job_id, count(*) AS n_items, min(line_no) AS first_line_no,
  list(item_description ORDER BY line_no)[1] AS first_description, list(unit_price ORDER BY line_no)[1] AS first_price,
  sum(CASE WHEN coalesce(original_uom, '') <> '' THEN 1 ELSE 0 END)::BIGINT AS items_with_uom,
  sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END)::BIGINT AS items_requiring_escalation FROM it GROUP BY job_id)
SELECT j.job_id, j.file_name, j.status, coalesce(n_items, 0) AS n_items, first_line_no, first_description, first_price,
  coalesce(items_with_uom, 0) AS items_with_uom, coalesce(items_requiring_escalation, 0) AS items_requiring_escalation,
  coalesce(json_extract(options, '$.enable_agentic_lookup')::BOOLEAN, false) AS agentic_lookup_used
FROM jobs j LEFT JOIN agg USING (job_id)""")
def q_sink_json_documents(spark, sf_dir):
    """One JSON document per job (header, extraction summary, line items),
    written and read back; compared on fields parsed from the written JSON."""
    items = SK.materialize(line_items_table(spark, sf_dir), "json-items")   # feeds the items and the summary
    jobs = _jobs(spark, sf_dir)
    docs = SK.json_documents(jobs.select("job_id", "file_name", "status"), items, summary=J.extraction_summary(items, jobs))
    path = shared_dir(spark, "jsondocs") + "/t"
    SK.sink_json_documents(docs, path)
    schema = ("job_id string, file_name string, status string, extraction_summary struct<items_with_uom:bigint,"
              "items_requiring_escalation:bigint,agentic_lookup_used:boolean>, "
              "line_items array<struct<line_no:int,item_description:string,unit_price:double>>")
    d = spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")
    first = F.get("line_items", F.lit(0))
    return d.select("job_id", "file_name", "status", F.coalesce(F.size("line_items"), F.lit(0)).cast("bigint").alias("n_items"),
                    first["line_no"].alias("first_line_no"), first["item_description"].alias("first_description"),
                    first["unit_price"].alias("first_price"), "extraction_summary.*")


_BATCHED = _RESULTS.rstrip() + f""",
opts AS (SELECT job_id, json_extract_string(options, '$.batch_id') AS batch_id FROM jobs),
batched AS (SELECT r.*, o.batch_id FROM results r JOIN opts o USING (job_id))
"""


def _batched(spark, sf_dir):
    return _results(spark, sf_dir).join(J.json_options(_jobs(spark, sf_dir)).select("job_id", "batch_id"), "job_id")


@register("sink_batch_summary", _BATCHED + """
SELECT batch_id, count(*) AS total_files, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END)::BIGINT AS successful_files,
  sum(CASE WHEN status = 'completed' THEN 0 ELSE 1 END)::BIGINT AS failed_files,
  sum(CASE WHEN status = 'completed' THEN total_line_items ELSE 0 END)::BIGINT AS total_line_items,
  round(coalesce(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END) / nullif(count(*), 0), 0.0), 9) AS success_rate,
  round(coalesce(sum(CASE WHEN status = 'completed' THEN total_line_items END) / nullif(sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END), 0), 0.0), 9) AS avg_items_per_file
FROM batched GROUP BY batch_id""")
def q_sink_batch_summary(spark, sf_dir):
    """Batch summaries with their rates, written and read back."""
    path = shared_dir(spark, "batch") + "/t"
    SK.sink_batch_summary(J.batch_summary(_batched(spark, sf_dir), ["batch_id"]), path)
    back = spark.read.schema("batch_id string, total_files bigint, successful_files bigint, failed_files bigint, "
                             "total_line_items bigint, success_rate double, avg_items_per_file double").json(path)
    return back.select("batch_id", "total_files", "successful_files", "failed_files", "total_line_items",
                       F.round("success_rate", 9).alias("success_rate"),
                       F.round("avg_items_per_file", 9).alias("avg_items_per_file"))


@register("sink_batch_details", _BATCHED + """
SELECT batch_id, job_id, status, total_line_items::BIGINT AS total_line_items, escalation_count::BIGINT AS escalation_count,
  error_message FROM batched""")
def q_sink_batch_details(spark, sf_dir):
    """Per-file results and failures written as two tables and read back."""
    path = shared_dir(spark, "details") + "/t"
    SK.sink_batch_details(_batched(spark, sf_dir), path)
    schema = "batch_id string, job_id string, status string, total_line_items bigint, escalation_count bigint, error_message string"
    return spark.read.schema(schema).json(path + "/results").unionByName(spark.read.schema(schema).json(path + "/failures"))


# ------------------------------------------------------------------ dead letters (O-08)

_BAD_OPTIONS = ("case when o_orderkey % 89 = 3 then substring(options, 1, 20) "
                "when o_orderkey % 83 = 7 then replace(replace(options, 'true', '\"yes\"'), 'false', '\"no\"') else options end")
_STAGES = {"content": ("content_error", "content"), "options": ("typed_error", "options")}


@register("dead_letters", _JOB_ITEMS.rstrip() + f""",
d AS (SELECT j.job_id, j.o_orderkey, i.txt, CASE WHEN j.o_orderkey % 97 = 5 AND i.txt IS NOT NULL THEN {O.q(RS.MSG_NOT_TEXT)}
    WHEN j.o_orderkey % 89 = 3 THEN {O.q(RS.MSG_NOT_OBJECT.format('options'))}
    WHEN j.o_orderkey % 83 = 7 THEN {O.q(RS.MSG_WRONG_TYPE.format('options'))} END AS bad
  FROM jobs j LEFT JOIN invoices i ON j.o_orderkey = i.o_orderkey),
cnt AS (SELECT job_id, count(*) AS n, sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS e FROM it GROUP BY job_id)
SELECT d.job_id, CASE WHEN bad IS NOT NULL OR {_BLANK} THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN bad IS NOT NULL THEN bad WHEN {_BLANK} THEN {O.q(X.MSG_NO_TEXT)} END AS error_message,
  CASE WHEN bad IS NULL AND NOT {_BLANK} THEN coalesce(n, 0) ELSE 0 END AS total_line_items,
  CASE WHEN bad IS NULL AND NOT {_BLANK} THEN coalesce(e, 0) ELSE 0 END AS escalation_count
FROM d LEFT JOIN cnt c USING (job_id)""")
def q_dead_letters(spark, sf_dir):
    """Jobs whose file is no text or whose options are no JSON fail by
    themselves; the others are extracted."""
    from ..operators import extract as E
    jobs = _jobs(spark, sf_dir).withColumn("options", F.expr(_BAD_OPTIONS))
    inv = FX.render_invoices(spark, sf_dir).select("o_orderkey", F.col("txt").cast("binary").alias("content"))
    docs = jobs.join(inv, "o_orderkey", "left").withColumn(
        "content", F.when(F.col("o_orderkey") % 97 == 5, F.concat("content", F.unhex(F.lit("FF")))).otherwise(F.col("content")))
    text, error = RS.decoded_text(F.col("content"))
    docs = RS.checked_json(docs.select("job_id", "options", "content", text.alias("text"), error.alias("content_error")),
                           "options", J.OPTIONS_SCHEMA, "typed")
    docs = SK.materialize(docs, "checked-documents")
    work = RS.intact(docs, _STAGES)
    results = J.job_result_rows(work, E.extract_line_items(work, ["job_id"], text="text"))
    return RS.with_failures(results, RS.failures(docs, "job_id", _STAGES))


# ------------------------------------------------------------------ job columns (O-07)

_TIMES = {"started": "cast(created_at as timestamp)", "ended": "cast(created_at as timestamp) + interval {n} second"}
_OCR_CTE = f"""pg0 AS (SELECT o_orderkey, unnest(w) AS text, unnest(generate_series(1, len(w))) AS page_no
        FROM (SELECT o_orderkey, string_split(txt, chr(10)) AS w FROM invoices)),
pg1 AS (SELECT o_orderkey, page_no, {O.clean_text('text')} AS clean, CASE WHEN page_no % 2 = 0 THEN 0.75 ELSE 0.65 END AS c FROM pg0),
pg AS (SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, page_no, clean,
    CASE WHEN length(clean) > 50 AND c > 0.7 THEN 'paddle_ocr' ELSE 'tesseract_raw' END AS method,
    CASE WHEN length(clean) > 50 AND c > 0.7 THEN c::DOUBLE ELSE {O.raw_text_confidence('clean')} END AS confidence FROM pg1),
ocr AS (SELECT job_id, count(*) AS total_pages, sum(CASE WHEN clean <> '' THEN 1 ELSE 0 END) AS successful_pages,
    avg(confidence) AS mean, arg_min(method, page_no) AS first_method, arg_max(method, page_no) AS last_method,
    array_to_string(list_sort(list_distinct(list(method))), ',') AS methods, sum(length(clean))::BIGINT AS n_chars FROM pg GROUP BY job_id)
"""


def _job_pages(spark, sf_dir, invoices=None):
    """The chosen text of each page of a job's invoice (of ``invoices``, where
    they are at hand)."""
    from ..operators import ocr as OC
    from .catalog_ocr import _invoice_candidates
    p = OC.select_ocr_candidate(_invoice_candidates(spark, sf_dir, invoices))
    return p.select(F.concat(F.lit("job_"), F.col("doc_id").cast("string")).alias("job_id"), "page_no", "text", "method", "confidence")


@register("upsert_job_results", _RESULTS.rstrip() + ",\n" + _OCR_CTE + f"""
SELECT j.job_id, coalesce(r.status, j.status) AS status, r.total_line_items, r.escalation_count, r.error_message,
  CASE WHEN r.status = 'completed' THEN coalesce(o.total_pages, 0) END AS total_pages,
  CASE WHEN r.status = 'completed' THEN o.first_method END AS ocr_method,
  CASE WHEN r.status = 'completed' THEN round(coalesce(o.mean, 0.0), 9) END AS ocr_confidence,
  CASE WHEN r.status = 'completed' THEN (j.o_orderkey % 90 + 1)::DOUBLE END AS processing_time,
  CASE WHEN r.status = 'completed' THEN cast(cast(created_at AS timestamp) + to_seconds(j.o_orderkey % 90 + 1) AS varchar) END AS completed_at
FROM jobs j LEFT JOIN results r ON j.job_id = r.job_id AND j.status <> 'pending' LEFT JOIN ocr o ON o.job_id = j.job_id""")
def q_upsert_job_results(spark, sf_dir):
    """All columns that a finished job gets, for the jobs that were picked up."""
    jobs = _jobs(spark, sf_dir)
    inv = FX.render_invoices(spark, sf_dir).select("o_orderkey", "txt")
    docs = jobs.where("status <> 'pending'").join(inv, "o_orderkey", "left").select(
        "job_id", F.expr(_TEXT.format(key="o_orderkey", text="txt")).alias("text"), F.col("created_at").cast("timestamp").alias("started"),
        (F.col("created_at").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 90 + 1)).alias("ended"))
    results = J.job_result_rows(docs, line_items_table(spark, sf_dir), ocr=J.ocr_summary(_job_pages(spark, sf_dir), "job_id"),
                                started="started", completed="ended")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema.fields if f.name not in ("job_id", "status")]
    out = J.upsert_jobs(jobs.select("job_id", "status", *empty), results)
    return out.select("job_id", "status", F.col("total_line_items").cast("bigint"), F.col("escalation_count").cast("bigint"),
                      "error_message", "total_pages", "ocr_method", F.round("ocr_confidence", 9).alias("ocr_confidence"),
                      "processing_time", F.col("completed_at").cast("string").alias("completed_at"))


# ------------------------------------------------------------------ VARIANT (O-05, O-56, O-60)

#: Options with keys that nobody declared.
_WIDE_OPTIONS = ("replace(options, '}}', concat(', \"priority\": ', cast(o_orderkey % 9 as {s}), ', \"tags\": [\"a\", \"t', "
                 "cast(o_orderkey % 7 as {s}), '\"], \"nested\": {{\"depth\": ', cast(o_orderkey % 4 as {s}), '}}}}'))")


@register("variant_options", "WITH " + O.cte_jobs() + f""",
w AS (SELECT job_id, {FX.sql(_WIDE_OPTIONS, 'duckdb')} AS options FROM jobs)
SELECT job_id, {_OPTS.format(d='true')}, json_extract(options, '$.priority')::BIGINT AS priority,
  json_extract_string(options, '$.tags[1]') AS second_tag, json_extract(options, '$.nested.depth')::BIGINT AS depth FROM w""")
def q_variant_options(spark, sf_dir):
    """Options stored as VARIANT and read back: declared keys as before,
    undeclared ones still there."""
    jobs = _jobs(spark, sf_dir).withColumn("options", F.expr(FX.sql(_WIDE_OPTIONS)))
    kept = SK.materialize(VR.variant_options(jobs).drop("options"), "variant-options")
    v = F.col("options_variant")
    return kept.select("job_id", "enable_agentic_lookup", "option_supplier_name", "batch_id",
                       VR.path_value(v, "$.priority", "bigint").alias("priority"), VR.path_value(v, "$.tags[1]", "string").alias("second_tag"),
                       VR.path_value(v, "$.nested.depth", "bigint").alias("depth"))


@register("variant_answers", "WITH " + O.cte_answers() + """
SELECT job_id, line_no, json_extract_string(answer, '$.uom') AS uom, json_extract(answer, '$.pack_quantity')::BIGINT AS pack_quantity,
  json_extract(answer, '$.confidence')::DOUBLE AS confidence, json_extract_string(answer, '$.reasoning') AS reasoning FROM answers""")
def q_variant_answers(spark, sf_dir):
    kept = SK.materialize(VR.variant_answers(FX.render_answers(spark, sf_dir)), "variant-answers")
    return kept.select("job_id", "line_no", "uom", "pack_quantity", "confidence", "reasoning")


_DOC_ITEM = [c for c in ITEM_OUT if c not in ("pack_unit", "pack_quantity", "pack_confidence", "pack_source")]
_DOC_TYPES = {"line_no": "int", "detected_pack_quantity": "bigint", "escalation_flag": "boolean", **{c: "double" for c in (
    "price_per_base_unit", "confidence_score", "unit_price", "total_amount", "taxable_amount", "quantity")}}


@register("variant_json_documents", _JOB_ITEMS.rstrip() + ",\n" + _OCR_CTE + f""",
w AS (SELECT job_id, o_orderkey, file_name, status, {FX.sql(_WIDE_OPTIONS, 'duckdb')} AS options FROM jobs)
SELECT w.job_id, w.file_name, w.status, json_extract(w.options, '$.nested.depth')::BIGINT AS depth, o.total_pages,
  o.successful_pages::BIGINT AS successful_pages, round(o.mean, 9) AS avg_confidence, o.methods AS methods_used,
  o.last_method, o.n_chars, {', '.join('it.' + c for c in _DOC_ITEM)}, it.pack_unit, it.pack_quantity, it.pack_confidence
FROM w LEFT JOIN it USING (job_id) LEFT JOIN ocr o USING (job_id)""")
def q_variant_json_documents(spark, sf_dir):
    """Whole JSON documents (header, all options, OCR summary and page
    details, extraction summary, every field of every item), written, read
    back as VARIANT and taken apart by path."""
    jobs = _jobs(spark, sf_dir).withColumn("options", F.expr(FX.sql(_WIDE_OPTIONS)))
    inv = SK.materialize(FX.render_invoices(spark, sf_dir), "invoices")   # feeds items and pages
    items = SK.materialize(line_items_table(spark, sf_dir, inv), "json-items")
    pages = SK.materialize(_job_pages(spark, sf_dir, inv), "json-pages")
    docs = VR.job_documents(jobs.select("job_id", "file_name", "status", "options"), items, pages,
                            J.extraction_summary(items, jobs), J.ocr_summary(pages, "job_id"))
    path = shared_dir(spark, "jsondocs") + "/t"
    SK.sink_json_documents(docs, path)
    v = F.col("document")
    get = lambda p, kind: VR.path_value(v, p, kind)
    fields = ", ".join(f"{c}: {'array<string>' if c == 'escalation_reasons' else _DOC_TYPES.get(c, 'string')}" for c in _DOC_ITEM)
    kind = f"array<struct<{fields}, pack_info: struct<unit: string, quantity: bigint, confidence: double>>>"
    d = VR.read_documents(spark.read.text(path)).select(
        get("$.job_id", "string").alias("job_id"), get("$.file_name", "string").alias("file_name"), get("$.status", "string").alias("status"),
        get("$.options.nested.depth", "bigint").alias("depth"), get("$.ocr_summary.total_pages", "bigint").alias("total_pages"),
        get("$.ocr_summary.successful_pages", "bigint").alias("successful_pages"),
        F.round(get("$.ocr_summary.avg_confidence", "double"), 9).alias("avg_confidence"),
        F.array_join(get("$.ocr_summary.methods_used", "array<string>"), ",").alias("methods_used"),
        get("$.ocr_results", "array<struct<page_no: int, method: string, n_chars: bigint>>").alias("_pages"),
        get("$.line_items", kind).alias("_items"))
    # what a document's pages add up to is made once for it and not for each of its items
    d = d.select(*[c for c in d.columns if c not in ("_pages", "_items")],
                 F.element_at("_pages", -1)["method"].alias("last_method"),
                 F.aggregate(F.transform("_pages", lambda p: p["n_chars"]), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_chars"),
                 F.explode_outer("_items").alias("i"))
    return d.select(
        *[c for c in d.columns if c != "i"],
        *[(F.array_join(f"i.{c}", ",") if c == "escalation_reasons" else F.col(f"i.{c}")).alias(c) for c in _DOC_ITEM],
        F.col("i.pack_info.unit").alias("pack_unit"), F.col("i.pack_info.quantity").alias("pack_quantity"),
        F.col("i.pack_info.confidence").alias("pack_confidence"))
