"""Registered file and stream queries (O-01, O-19, O-33, O-59, O-61..O-64).

Stream queries write their input rows (rendered from the tables) as files
in a fresh folder under the shared checkpoint folder, run the stream with
``availableNow`` (several micro-batches), and return
what the sink holds, read back as a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from ..operators import jobs as J
from ..operators import partials as PT
from ..operators import resolve as R
from ..session import shared_dir
from ..sources.sinks import materialize, sink_text_files
from ..streaming import ingest as S
from ..streaming import state as ST
from . import fixtures as FX
from . import oracle as O
from .catalog import ITEM_OUT, _sql_items, register
from .catalog_jobs import _BATCHED, _JOB_ITEMS
from .catalog_resolve import _APPLIED_SQL, _sql_resolved, applied_columns

_JOB_COUNTS_SQL = _sql_resolved() + """
SELECT concat('job_', cast(o_orderkey AS varchar)) AS job_id, 'completed' AS status, coalesce(n, 0)::BIGINT AS total_line_items,
  coalesce(e, 0)::BIGINT AS escalation_count
FROM invoices LEFT JOIN (SELECT job_id, count(*) AS n, sum(CASE WHEN escalation_flag OR escalate THEN 1 ELSE 0 END) AS e
  FROM resolved GROUP BY job_id) r ON r.job_id = concat('job_', cast(o_orderkey AS varchar))"""

_OBS = "WITH " + O.cte_observations() + "\n"


def _obs(spark, sf_dir):
    return FX.render_observations(spark, sf_dir).withColumn("file_hash", F.md5(F.col("content")))


#: Rows of an arriving file, least files of a micro-batch, and the micro-batches into which more files are dealt.
ROWS_PER_FILE, FILES_PER_BATCH, BATCHES = 20_000, 16, 8


def _write_inputs(df, name, spark):
    """The rows as arriving files, written by the tasks that hold them; their
    number grows with the rows."""
    path = shared_dir(spark, name) + "/in"
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return path


def _files_per_batch(spark, path, least=FILES_PER_BATCH, files=None):
    """Files of a micro-batch.  A batch has costs of its own and asks what the
    earlier ones have left, so a back-fill takes about ``BATCHES`` of them,
    however many files there are (listed, unless their number is known)."""
    if files is None:
        files = len(spark.read.format("binaryFile").load(path).inputFiles())
    return max(least, -(-files // BATCHES))


@register("file_hash", _OBS + "SELECT event_id, path, md5(content) AS file_hash FROM observations")
def q_file_hash(spark, sf_dir):
    return S.file_hash(FX.render_observations(spark, sf_dir)).select("event_id", "path", "file_hash")


@register("unprocessed_files", "WITH " + O.cte_observations() + """,
obs AS (SELECT o.event_id, concat('/in/', cast(e.user_id AS varchar), '/', cast(o.event_id AS varchar), '.pdf') AS path,
          md5(o.content) AS file_hash, e.event_type, e.value FROM observations o JOIN events e USING (event_id)),
done AS (SELECT path, file_hash FROM obs WHERE event_type = 'error' AND value > 150)
SELECT event_id, path, file_hash FROM obs
WHERE path NOT IN (SELECT path FROM done) AND file_hash NOT IN (SELECT file_hash FROM done)""")
def q_unprocessed_files(spark, sf_dir):
    """Every event is a file version; files of high-value error events are
    the processed ones.  The rest minus anything processed by path or by
    content."""
    ev = FX.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    obs = _obs(spark, sf_dir).select("event_id", "file_hash").join(ev, "event_id").select(
        "event_id", F.format_string("/in/%d/%d.pdf", "user_id", "event_id").alias("file_path"), "file_hash",
        "event_type", "value")
    state = obs.where((F.col("event_type") == "error") & (F.col("value") > 150)).select(
        "file_path", "file_hash", F.lit(True).alias("processed"))
    out = S.unprocessed_files(obs.select("event_id", "file_path", "file_hash"), state)
    return out.select("event_id", F.col("file_path").alias("path"), "file_hash")


@register("stable_files", _OBS + """,
o AS (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY observed_at, event_id) AS prev,
        min(observed_at) OVER (PARTITION BY path) AS first_seen FROM observations),
q AS (SELECT path, first_seen, count(*) AS observations,
        arg_min(observed_at, (observed_at, event_id)) FILTER (WHERE size = prev AND size > 0 AND observed_at <= first_seen + INTERVAL 30 SECOND) AS ready_at,
        arg_min(size, (observed_at, event_id)) FILTER (WHERE size = prev AND size > 0 AND observed_at <= first_seen + INTERVAL 30 SECOND) AS ready_size
      FROM o GROUP BY path, first_seen)
SELECT path, cast(first_seen AS varchar) AS first_seen, cast(ready_at AS varchar) AS ready_at, ready_size,
  CASE WHEN ready_at IS NOT NULL THEN 'ready' ELSE 'timeout' END AS status, observations FROM q""".replace("\n,", ",", 1))
def q_stable_files(spark, sf_dir):
    s = S.stable_files(FX.render_observations(spark, sf_dir), timeout_s=30)
    return s.select("path", F.col("first_seen").cast("string").alias("first_seen"),
                    F.col("ready_at").cast("string").alias("ready_at"), "ready_size", "status", "observations")


_USER_FILES = _OBS.rstrip() + r""",
files AS (SELECT regexp_extract(path, '/in/(\d+)\.pdf', 1) AS "user",
  string_agg(content || chr(10), '' ORDER BY event_id) AS body FROM observations GROUP BY 1)
"""


def _write_user_files(spark, sf_dir, base, folders=True):
    """Observation contents as one text file per user, in event order; returns
    their number."""
    obs = FX.render_observations(spark, sf_dir).select(
        F.regexp_extract("path", r"/in/(\d+)\.pdf", 1).alias("user"), "event_id", F.coalesce("content", F.lit("")).alias("content"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "content"))), lambda x: x["content"])
    bodies = obs.groupBy("user").agg(F.array_join(lines, "\n").alias("text"))
    return sink_text_files(bodies, base + "/docs", "user", folders=folders)


def _write_flat_files(spark, sf_dir, base):
    """The same files side by side, for a stream, which lists them each time."""
    return _write_user_files(spark, sf_dir, base, folders=False)


@register("scan_files", _USER_FILES + 'SELECT "user", strlen(body) AS file_size, md5(body) AS file_hash FROM files')
def q_scan_files(spark, sf_dir):
    """Files of a folder tree, listed and hashed with the binary-file source
    (O-01 + O-59)."""
    base = shared_dir(spark, "files")
    _write_user_files(spark, sf_dir, base)
    files = S.scan_files(spark, base + "/docs", glob="*.txt", with_hash=True, suffix=".txt", recursive=True)
    return files.select(F.regexp_extract("file_path", r"user=(\d+)", 1).alias("user"), "file_size", "file_hash")


@register("stream_ingest", _OBS + "SELECT event_id, path, md5(content) AS file_hash FROM observations")
def q_stream_ingest(spark, sf_dir):
    """File-arrival records streamed in, some files per trigger (O-61)."""
    obs = _obs(spark, sf_dir)
    src = _write_inputs(obs, "ingest", spark)
    stream = S.read_table_stream(spark, src, obs.schema, max_files=_files_per_batch(spark, src))
    out = src.rsplit("/", 1)[0] + "/out"
    q = (stream.select("event_id", "path", "file_hash").writeStream.format("parquet")
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_dedupe", _OBS + "SELECT DISTINCT md5(content) AS file_hash FROM observations")
def q_stream_dedupe(spark, sf_dir):
    """Content-hash de-duplication over the stream (O-62): each hash once."""
    obs = _obs(spark, sf_dir)
    src = _write_inputs(obs, "dedupe", spark)
    stream = S.dedupe_stream(S.read_table_stream(spark, src, obs.schema, max_files=_files_per_batch(spark, src)))
    out = src.rsplit("/", 1)[0] + "/out"
    q = (stream.select("file_hash").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_dedupe_watermark", _OBS + "SELECT DISTINCT md5(content) AS file_hash FROM observations")
def q_stream_dedupe_watermark(spark, sf_dir):
    """Bounded-state variant: a hash is forgotten an hour after its ingestion;
    the replay takes less, so each hash reaches the sink once."""
    obs = _obs(spark, sf_dir)
    src = _write_inputs(obs, "dedupe_wm", spark)
    stream = S.dedupe_stream(S.read_table_stream(spark, src, obs.schema, max_files=_files_per_batch(spark, src)),
                             within="1 hour")
    out = src.rsplit("/", 1)[0] + "/out"
    q = (stream.select("file_hash").writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


@register("stream_dedupe_keyed", _OBS + "SELECT DISTINCT md5(content) AS file_hash FROM observations")
def q_stream_dedupe_keyed(spark, sf_dir):
    """Keyed state with expiry: each hash once within a day of its ingestion;
    a hash enters the state once a task, however often it arrives."""
    obs = _obs(spark, sf_dir)
    src = _write_inputs(obs, "dedupe_keyed", spark)
    stream = S.read_table_stream(spark, src, obs.schema, max_files=_files_per_batch(spark, src)).select("file_hash")
    out = src.rsplit("/", 1)[0] + "/out"
    q = (ST.dedupe_keyed(stream, ["file_hash"], 86_400).writeStream.format("parquet")
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out)


#: Parts of the whole time in which the polls arrive.
ARRIVALS = 8


def _write_in_order(df, name, spark, ts, heartbeat):
    """The rows as arriving files, one part of the time after the other, and
    last a row that only moves the clock; with the length of a part, by which
    rows may be out of order."""
    path = shared_dir(spark, name) + "/in"
    first, last = df.agg(F.unix_micros(F.min(ts)), F.unix_micros(F.max(ts))).first()
    step = (last - first) // ARRIVALS + 1
    for k in range(ARRIVALS):
        part = df.where((F.unix_micros(ts) >= first + k * step) & (F.unix_micros(ts) < first + (k + 1) * step))
        part.write.mode("append").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    df.limit(1).select(*heartbeat(F.timestamp_micros(F.lit(last + 10 * step)))).write.mode("append").parquet(path)
    return path, step // 1_000_000 + 1


@register("stream_stable_files", _OBS + """,
o AS (SELECT *, lag(size) OVER (PARTITION BY path ORDER BY observed_at, event_id) AS prev,
        min(observed_at) OVER (PARTITION BY path) AS first_seen FROM observations),
q AS (SELECT path, first_seen,
        arg_min(observed_at, (observed_at, event_id)) FILTER (WHERE size = prev AND size > 0 AND observed_at <= first_seen + INTERVAL 30 SECOND) AS ready_at,
        arg_min(size, (observed_at, event_id)) FILTER (WHERE size = prev AND size > 0 AND observed_at <= first_seen + INTERVAL 30 SECOND) AS ready_size
      FROM o GROUP BY path, first_seen)
SELECT path, cast(first_seen AS varchar) AS first_seen, cast(ready_at AS varchar) AS ready_at, ready_size,
  CASE WHEN ready_at IS NOT NULL THEN 'ready' ELSE 'timeout' END AS status FROM q""".replace("\n,", ",", 1))
def q_stream_stable_files(spark, sf_dir):
    """The polls of every path as a stream; event-time timers decide (O-33)."""
    obs = FX.render_observations(spark, sf_dir).select("path", F.col("observed_at").cast("timestamp").alias("observed_at"),
                                                       "size", "event_id")
    beat = lambda at: [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "observed_at"
                       else at.cast(f.dataType).alias(f.name) for f in obs.schema.fields]
    src, delay = _write_in_order(obs, "polls", spark, "observed_at", beat)
    stream = S.read_table_stream(spark, src, obs.schema, max_files=_files_per_batch(spark, src))
    out = src.rsplit("/", 1)[0] + "/out"
    q = (ST.stable_files_stream(stream, timeout_s=30, delay=f"{delay} seconds").writeStream.format("parquet")
         .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    return spark.read.parquet(out).select("path", F.col("first_seen").cast("string").alias("first_seen"),
                                          F.col("ready_at").cast("string").alias("ready_at"), "ready_size", "status")


def _run_extraction_stream(spark, sf_dir):
    inv = FX.render_invoices(spark, sf_dir).select(
        "o_orderkey", F.concat(F.lit("/in/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path"),
        "txt", F.md5("txt").alias("file_hash"), F.current_timestamp().alias("modificationTime"))
    src = _write_inputs(inv, "extract", spark)
    stream = S.read_table_stream(spark, src, inv.schema, max_files=_files_per_batch(spark, src))
    out = src.rsplit("/", 1)[0] + "/out"

    def per_batch(batch, batch_id):
        items = E.flatten_items(E.extract_line_items(batch, ["o_orderkey"], text="txt"))
        return {"items": items, "state": S.file_state_rows(batch, batch_id)}

    q = S.start_extraction(stream, out, out + "_ckpt", per_batch)
    q.awaitTermination()
    return out


@register("stream_extract", _sql_items(True) + "SELECT o_orderkey, " + ", ".join(ITEM_OUT) + " FROM items")
def q_stream_extract(spark, sf_dir):
    """Extraction per micro-batch equals the batch extraction (O-63)."""
    out = _run_extraction_stream(spark, sf_dir)
    return spark.read.parquet(out + "/items").select("o_orderkey", *ITEM_OUT)


@register("file_state", "WITH " + O.cte_invoices() + """
SELECT concat('/in/', cast(o_orderkey AS varchar), '.pdf') AS file_path, md5(txt) AS file_hash, true AS processed,
  concat('job_', md5(concat('/in/', cast(o_orderkey AS varchar), '.pdf', chr(10), md5(txt)))) AS job_id FROM invoices""")
def q_file_state(spark, sf_dir):
    """Per-file bookkeeping written by the extraction stream (O-64)."""
    out = _run_extraction_stream(spark, sf_dir)
    st = S.current_file_state(spark.read.parquet(out + "/state"))
    return st.select("file_path", "file_hash", "processed", "job_id")


#: How long the chain knows a (path, content) pair without asking the history.
REPEAT_TTL_S = 30 * 86_400


def run_chain(spark, src, schema, out, checkpoint, answers):
    """Arriving files -> new by path and content -> items -> units resolved ->
    items, audit, job results and state, batch by batch (O-61..O-64)."""
    def per_batch(batch, batch_id):
        todo = materialize(S.new_files(batch, S.earlier_state(spark, out + "/state", batch_id)), "new-files")
        # before the work starts: what it is interrupted at stays on record
        S.write_batch(S.file_state_rows(todo, batch_id, processed=False), out, "discovered", batch_id)
        resolved = R.resolve_uom(E.extract_line_items(todo, ["job_id"], text="txt"), answers=answers)
        # audit and results read the items as they stand, which are stored once
        resolved = S.write_batch(resolved, out, "items", batch_id)
        jobs = J.job_result_rows(todo.select("job_id", F.col("txt").alias("text")), resolved)
        return {"audit": R.lookup_audit(resolved), "jobs": jobs, "state": S.file_state_rows(todo, batch_id)}

    # a file that arrives again as it was never reaches a batch; its state is forgotten after a month
    stream = ST.dedupe_keyed(S.read_table_stream(spark, src, schema, max_files=_files_per_batch(spark, src)), ["file_path", "file_hash"],
                             REPEAT_TTL_S)
    S.start_extraction(stream, out, checkpoint, per_batch).awaitTermination()


def _chain(spark, sf_dir):
    """Every invoice as a file; every tenth arrives again under another path,
    every seventh again as it was; every thirteenth was also once under a path
    that others with the same hundreds have rewritten."""
    inv = materialize(FX.render_invoices(spark, sf_dir).select("o_orderkey", "txt"), "invoices")   # four parts of the input
    path = lambda folder: F.concat(F.lit(folder), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path")
    files = (inv.select("*", path("/in/")).union(inv.where("o_orderkey % 10 = 0").select("*", path("/in/copy-")))
             .union(inv.where("o_orderkey % 7 = 0").select("*", path("/in/")))
             .union(inv.where("o_orderkey % 13 = 0").select("*", F.concat(
                 F.lit("/in/0-"), F.floor(F.col("o_orderkey") / 100).cast("string"), F.lit(".pdf")))))
    files = files.select(F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("job_id"), "file_path", "txt",
                         F.md5("txt").alias("file_hash"), F.current_timestamp().alias("modificationTime"))
    src = _write_inputs(files, "chain", spark)
    out = src.rsplit("/", 1)[0] + "/out"
    # every batch asks for its answers
    run_chain(spark, src, files.schema, out, out + "_ckpt", materialize(FX.render_answers(spark, sf_dir), "answers"))
    return out


@register("stream_jobs_items", _APPLIED_SQL)
def q_stream_jobs_items(spark, sf_dir):
    """Items that the whole chain leaves: each content once, units resolved."""
    return applied_columns(spark.read.parquet(_chain(spark, sf_dir) + "/items"))


@register("stream_jobs_state", "WITH " + O.cte_invoices() + """
SELECT md5(txt) AS file_hash, 1::BIGINT AS files, true AS processed FROM invoices""")
def q_stream_jobs_state(spark, sf_dir):
    """Bookkeeping after the chain: one processed file per content."""
    state = S.current_file_state(spark.read.parquet(_chain(spark, sf_dir) + "/state"))
    return state.groupBy("file_hash").agg(F.count("*").alias("files"), F.every("processed").alias("processed"))


@register("stream_jobs_discovered", "WITH " + O.cte_invoices() + """
SELECT md5(txt) AS file_hash, true AS processed, 1::BIGINT AS discovered FROM invoices""")
def q_stream_jobs_discovered(spark, sf_dir):
    """Every discovered file once, and whether its work has ended (O-64)."""
    out = _chain(spark, sf_dir)
    discovered = spark.read.parquet(out + "/discovered")
    state = S.current_file_state(spark.read.parquet(out + "/state"), discovered)
    seen = discovered.groupBy("file_path").agg(F.count("*").alias("discovered"))
    return state.join(seen, "file_path", "left").select("file_hash", "processed", "discovered")


@register("stream_jobs_results", _JOB_COUNTS_SQL)
def q_stream_jobs_results(spark, sf_dir):
    """Job results after the chain."""
    out = spark.read.parquet(_chain(spark, sf_dir) + "/jobs")
    return out.select("job_id", "status", F.col("total_line_items").cast("bigint").alias("total_line_items"),
                      F.col("escalation_count").cast("bigint").alias("escalation_count"))


_SUMMARY_SQL = _JOB_ITEMS.rstrip() + """,
agg AS (SELECT job_id, count(*) AS n, sum(CASE WHEN coalesce(original_uom, '') <> '' THEN 1 ELSE 0 END) AS uom,
  sum(CASE WHEN coalesce(manufacturer_part_number, '') <> '' THEN 1 ELSE 0 END) AS mpn,
  sum(CASE WHEN escalation_flag THEN 1 ELSE 0 END) AS esc, avg(confidence_score) AS a FROM it GROUP BY job_id)
SELECT j.job_id, coalesce(n, 0) AS total_line_items, coalesce(uom, 0) AS items_with_uom, coalesce(mpn, 0) AS items_with_mpn,
  coalesce(esc, 0) AS items_requiring_escalation, round(coalesce(a, 0.0), 9) AS avg_confidence,
  coalesce(json_extract(options, '$.enable_agentic_lookup')::BOOLEAN, false) AS agentic_lookup_used
FROM jobs j LEFT JOIN agg USING (job_id)"""


def _dealt(rows, *keys):
    """``rows`` dealt over as many files as tasks write, eight at least, by
    ``keys`` or in turn."""
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys)


def _stream_parts(spark, rows, name, make):
    """States written batch by batch as ``rows`` arrive."""
    src = _write_inputs(rows, name, spark)
    out = src.rsplit("/", 1)[0] + "/out"
    stream = S.read_table_stream(spark, src, rows.schema, max_files=_files_per_batch(spark, src, least=2))
    S.start_extraction(stream, out, out + "_ckpt", lambda batch, batch_id: {"parts": make(batch)}).awaitTermination()
    return spark.read.parquet(out + "/parts")


@register("stream_extraction_summary", _SUMMARY_SQL)
def q_stream_extraction_summary(spark, sf_dir):
    """Per-job summaries merged from the states of each batch of items (the
    lines of an invoice arrive in several batches)."""
    from .catalog import line_items_table
    items = line_items_table(spark, sf_dir).select("job_id", "line_no", "original_uom", "manufacturer_part_number",
                                                   "escalation_flag", "confidence_score")
    parts = _stream_parts(spark, _dealt(items, "line_no", "job_id"), "summary", PT.summary_parts)
    parts = PT.compact(parts, ["job_id"], PT.SUMMARY_STATE, before=2)
    s = PT.merged_summary(parts, FX.render_jobs(spark, sf_dir))
    return s.withColumn("avg_confidence", F.round("avg_confidence", 9))


@register("stream_ocr_summary", "WITH " + O.cte_pages() + """
SELECT doc_id, count(*) AS total_pages, sum(CASE WHEN coalesce(text, '') <> '' THEN 1 ELSE 0 END) AS successful_pages,
  round(avg(confidence), 9) AS avg_confidence, array_to_string(list_sort(list_distinct(list(method))), ',') AS methods_used,
  arg_min(method, page_no) AS ocr_method
FROM pages_r GROUP BY doc_id""")
def q_stream_ocr_summary(spark, sf_dir):
    """Per-document OCR summaries from pages that arrive apart."""
    pages = FX.render_pages(spark, sf_dir).select("doc_id", "page_no", "text", "method", "confidence")
    parts = _stream_parts(spark, _dealt(pages, "page_no", "doc_id"), "ocr-summary", PT.ocr_parts)
    s = PT.merged_ocr_summary(parts)
    return s.select("doc_id", "total_pages", "successful_pages", F.round("avg_confidence", 9).alias("avg_confidence"),
                    F.array_join("methods_used", ",").alias("methods_used"), "ocr_method")


@register("stream_batch_summary", _BATCHED + """
SELECT batch_id, count(*) AS total_files, sum(CASE WHEN status = 'completed' THEN 1 ELSE 0 END)::BIGINT AS successful_files,
  sum(CASE WHEN status = 'completed' THEN 0 ELSE 1 END)::BIGINT AS failed_files,
  sum(CASE WHEN status = 'completed' THEN total_line_items ELSE 0 END)::BIGINT AS total_line_items
FROM batched GROUP BY batch_id""")
def q_stream_batch_summary(spark, sf_dir):
    """Batch totals from job results as they come in."""
    from .catalog_jobs import _batched
    results = _batched(spark, sf_dir).withColumnRenamed("batch_id", "upload")
    parts = _stream_parts(spark, _dealt(results), "batch-summary", lambda b: PT.batch_parts(b, ["upload"]))
    s = PT.merged_batch_summary(parts, ["upload"])
    return s.select(F.col("upload").alias("batch_id"), "total_files", "successful_files", "failed_files", "total_line_items")


@register("stream_files", _USER_FILES + "SELECT DISTINCT strlen(body) AS length, md5(body) AS file_hash FROM files")
def q_stream_files(spark, sf_dir):
    """Binary-file stream (O-61 + O-59 + O-62): files listed as they arrive,
    hashed and de-duplicated by content."""
    base = shared_dir(spark, "fstream")
    users = _write_flat_files(spark, sf_dir, base)
    st = S.read_file_stream(spark, base + "/docs", glob="*.txt", recursive=True,
                            max_files=_files_per_batch(spark, base + "/docs", least=50, files=users))
    hashed = S.dedupe_stream(S.file_hash(st).select(F.col("path").alias("file_path"), "length", "file_hash"))
    q = (hashed.writeStream.format("parquet").option("checkpointLocation", base + "/ck")
         .trigger(availableNow=True).start(base + "/out"))
    q.awaitTermination()
    return spark.read.parquet(base + "/out").select("length", "file_hash")
