"""Job and item tables: filters, reads, upserts, cascades, summaries
(O-07..O-10, O-14, O-15, O-20, O-22..O-24, O-35, O-60).

Tables have no keys or foreign keys in Spark: uniqueness of ``job_id`` is
kept by upsert (left join + coalesce + anti-join union), cascade delete by
paired anti-joins.  Summaries are grouped aggregations with map-side
partial aggregation, so a job with many items never lands whole in one
task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.items import strip
from .positions import positions

OPTIONS_SCHEMA = "enable_agentic_lookup boolean, supplier_name string, batch_id string"


def json_options(jobs: DataFrame, col: str = "options", lookup_default: bool = True) -> DataFrame:
    """Typed options (O-60).  ``lookup_default`` is True for the worker and
    False for the read summary, as each reads a missing flag differently."""
    o = F.from_json(F.col(col), OPTIONS_SCHEMA)
    return jobs.select("*", F.coalesce(o["enable_agentic_lookup"], F.lit(lookup_default)).alias("enable_agentic_lookup"),
                       o["supplier_name"].alias("option_supplier_name"), o["batch_id"].alias("batch_id"))


def filter_jobs_by_status(jobs: DataFrame, status: str | None = None) -> DataFrame:
    """Optional status equality (O-10)."""
    return jobs if status is None else jobs.where(F.col("status") == status)


def list_jobs(jobs: DataFrame, status: str | None = None, page: int = 1,
              page_size: int = X.PAGE_SIZE_DEFAULT) -> tuple[DataFrame, int]:
    """(page rows, total matching) — newest first, ``job_id`` breaking ties
    (O-35).  The page is a top-k (``offset`` + ``limit`` over a sort), the
    total a separate count action."""
    if page < 1 or not (1 <= page_size <= X.PAGE_SIZE_MAX):
        raise ValueError("page >= 1 and 1 <= page_size <= 100")
    sel = filter_jobs_by_status(jobs, status)
    total = sel.count()
    rows = sel.orderBy(F.col("created_at").desc(), F.col("job_id")).offset((page - 1) * page_size).limit(page_size)
    return rows, total


def page_after(jobs: DataFrame, after: tuple | None = None, status: str | None = None,
               page_size: int = X.PAGE_SIZE_DEFAULT) -> DataFrame:
    """The page that follows the job ``after`` = (created_at, job_id), in the
    order of ``list_jobs`` (O-35); the first page without it.  Every task
    keeps ``page_size`` rows, however far the page is from the first."""
    sel = filter_jobs_by_status(jobs, status)
    if after is not None:
        at, job = F.lit(after[0]), F.lit(after[1])
        sel = sel.where((F.col("created_at") <= at) & ((F.col("created_at") < at) | (F.col("job_id") > job)))
    return sel.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(page_size)


#: Ranges that one look at the counts distinguishes, and the rows that a jump may skip by reading them.
JUMP_RANGES, JUMP_ROWS = 256, 4096


def jump_to_page(jobs: DataFrame, page: int, status: str | None = None, page_size: int = X.PAGE_SIZE_DEFAULT,
                 skip_rows: int = JUMP_ROWS) -> DataFrame:
    """Page number ``page`` without reading the pages before it (O-35): counts
    by ranges of ``created_at``, newest first, tell in which range the page
    begins; that range is divided again until it holds ``skip_rows`` or one
    time alone, and a crowded time is divided by the beginnings of its job
    ids.  Only rows from there on are sorted, and no task keeps more than
    ``skip_rows`` and a page of them.  ``created_at`` is a date or timestamp;
    rows without it come last, as in ``list_jobs``."""
    if page < 1:
        raise ValueError("page >= 1")
    sel = filter_jobs_by_status(jobs, status)
    left = (page - 1) * page_size
    time = F.unix_micros(F.col("created_at").cast("timestamp"))
    low, high, n = sel.agg(F.min(time), F.max(time), F.count("created_at")).first()
    order = [F.col("created_at").desc(), F.col("job_id")]
    if left >= n:                                   # among the rows without a time
        rest, start, undated = sel.where(F.col("created_at").isNull()), "", True
        left -= n
        n = rest.count()
        if left >= n:
            return sel.limit(0)
    else:
        undated = False
        while n > skip_rows and low < high:
            step = (high - low) // JUMP_RANGES + 1
            bucket = F.floor((F.lit(high) - time) / F.lit(step))
            counts = sel.where((time >= low) & (time <= high)).groupBy(bucket.alias("b")).count().orderBy("b").collect()
            for r in counts:                        # JUMP_RANGES at most
                if left < r["count"]:
                    break
                left -= r["count"]
            n, high = r["count"], high - r["b"] * step
            low = max(low, high - step + 1)
        rest = sel.where(time <= high)
        start = ""
    if n > skip_rows:                               # one time
        same = rest if undated else rest.where(time == high)
        while n > skip_rows:
            begun = F.substring("job_id", 1, len(start) + 1)
            counts = same.where(F.col("job_id").startswith(start)).groupBy(begun.alias("b")).count().orderBy("b").collect()
            for r in counts:                        # one for each next character
                if left < r["count"]:
                    break
                left -= r["count"]
            if r["b"] == start:
                break
            n, start = r["count"], r["b"]
        if start:
            here = F.lit(True) if undated else time == high
            rest = rest.where(~here | (F.col("job_id") >= F.lit(start)))
    if not undated and sel is not rest:
        rest = rest.unionByName(sel.where(F.col("created_at").isNull()))
    return rest.orderBy(*order).offset(left).limit(page_size)


def filter_line_items(items: DataFrame, job_id: str | None = None, escalation_only: bool = False,
                      min_confidence: float = 0.0) -> DataFrame:
    """Items of a job (all jobs when ``job_id`` is None); optionally only
    escalated ones and only those scoring at least ``min_confidence`` — that
    test applies only when the minimum is above 0, so null scores survive a
    minimum of 0 (O-09).  Predicates reach the Parquet scan."""
    if not 0.0 <= min_confidence <= 1.0:
        raise ValueError("min_confidence must be in [0, 1]")
    df = items if job_id is None else items.where(F.col("job_id") == job_id)
    if escalation_only:
        df = df.where(F.col("escalation_flag"))
    if min_confidence > 0:
        df = df.where(F.col("confidence_score") >= min_confidence)
    return df


def delete_jobs(jobs: DataFrame, items: DataFrame, doomed: DataFrame,
                audit: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Remove the jobs in ``doomed(job_id)`` and everything hanging off them
    (O-14): one anti-join per table; write the results to new locations."""
    ids = doomed.select("job_id").distinct()
    out = [jobs.join(ids, "job_id", "left_anti"), items.join(ids, "job_id", "left_anti")]
    if audit is not None:
        out.append(audit.join(ids, "job_id", "left_anti"))
    return tuple(out)


def job_with_items(jobs: DataFrame, items: DataFrame, include_items: bool = True,
                   nested: bool = False) -> DataFrame:
    """Job rows with their items attached when asked for and the job is
    completed (O-15).  The status test sits in the join condition, so other
    jobs keep one row with null item columns.  ``nested=True`` gathers the
    items of a job into an array ordered by ``line_no`` (one job's items)."""
    if not include_items:
        return jobs
    it = items.withColumnRenamed("job_id", "_jid")
    joined = jobs.join(it, (jobs.job_id == it._jid) & (jobs.status == "completed"), "left").drop("_jid")
    if not nested:
        return joined
    item_cols = [c for c in items.columns if c != "job_id"]
    return (joined.groupBy(*jobs.columns)
            .agg(F.array_sort(F.filter(F.collect_list(F.struct(*item_cols)),
                                       lambda s: s["line_no"].isNotNull())).alias("line_items")))


def one_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key: the least by its other columns in their order (nulls
    first).  A partial aggregate, so copies of a key never meet in a task."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    return df.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_jobs(base: DataFrame, updates: DataFrame, key: str = "job_id") -> DataFrame:
    """Assign the columns present in ``updates`` for matching keys, nulls
    included, so a value can be cleared (O-07).  Of several updates of a key
    the least counts (``one_per_key``); keys only in ``updates`` are skipped,
    as an update of a missing job is.  New jobs are added with
    ``insert_jobs``.  Parquet has no MERGE: write the result to a new folder
    or partition."""
    upd_cols = [c for c in updates.columns if c != key]
    u = one_per_key(updates, [key]).select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_u_{c}") for c in upd_cols])
    j = base.join(u, key, "left")
    return j.select(*[F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in upd_cols else F.col(c)
                      for c in base.columns])


def insert_jobs(base: DataFrame, new: DataFrame, key: str = "job_id") -> DataFrame:
    """Append jobs whose key is not yet present; of several new ones with a
    key, the least (``job_id`` stays unique)."""
    return base.unionByName(one_per_key(new, [key]).join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def job_result_rows(docs: DataFrame, items: DataFrame, key: str = "job_id", text: str = "text",
                    ocr: DataFrame | None = None, started: str | None = None, completed: str | None = None) -> DataFrame:
    """One result per document, success or failure (O-08): blank text fails
    with the no-text message; counts come from a partial aggregate of the
    items, joined back on the key (left, so failed documents remain).

    With ``ocr`` (``ocr_summary`` by the same key) completed rows also have
    ``total_pages``, ``ocr_method`` (of the first page) and ``ocr_confidence``
    (mean); with ``started``, a timestamp column of ``docs``, also
    ``processing_time`` in seconds and ``completed_at`` (the column
    ``completed``, else now) — the columns that ``upsert_jobs`` assigns."""
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("total_line_items"),
                                    F.count_if("escalation_flag").alias("escalation_count"))
    blank = F.coalesce(strip(F.col(text)), F.lit("")) == ""
    times = [F.col(started).cast("timestamp").alias("_from"),
             (F.col(completed) if completed else F.current_timestamp()).cast("timestamp").alias("_to")] if started else []
    d = docs.select(key, blank.alias("_blank"), *times).join(counts, key, "left")
    done = lambda c: F.when(~F.col("_blank"), c)
    extra = []
    if ocr is not None:
        d = d.join(ocr.select(key, F.col("total_pages").alias("_pages"), F.col("ocr_method").alias("_method"),
                              F.col("avg_confidence").alias("_mean")), key, "left")
        extra += [done(F.coalesce("_pages", F.lit(0))).alias("total_pages"), done(F.col("_method")).alias("ocr_method"),
                  done(F.coalesce("_mean", F.lit(0.0))).alias("ocr_confidence")]
    if started:
        extra += [done((F.unix_micros("_to") - F.unix_micros("_from")) / 1e6).alias("processing_time"),
                  done(F.col("_to")).alias("completed_at")]
    return d.select(
        key,
        F.when(F.col("_blank"), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
        F.when(F.col("_blank"), F.lit(X.MSG_NO_TEXT)).alias("error_message"),
        F.when(F.col("_blank"), F.lit(0)).otherwise(F.coalesce("total_line_items", F.lit(0))).alias("total_line_items"),
        F.when(F.col("_blank"), F.lit(0)).otherwise(F.coalesce("escalation_count", F.lit(0))).alias("escalation_count"), *extra)


def ocr_summary(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: pages, pages with text, mean page confidence (empty
    pages count), sorted distinct methods, first page's method (O-22)."""
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_pages"),
        F.count_if(F.coalesce(F.col("text"), F.lit("")) != "").alias("successful_pages"),
        F.avg("confidence").alias("avg_confidence"),
        F.array_sort(F.collect_set("method")).alias("methods_used"),
        F.min_by("method", "page_no").alias("ocr_method"))


def extraction_summary(items: DataFrame, jobs: DataFrame, key: str = "job_id",
                       lookup_default: bool = False) -> DataFrame:
    """Per job: items, items with a unit (UNK counts), with a part number,
    escalated, mean score (0 when none), lookup flag from options (O-23).
    Items are aggregated first (partial + final), then joined to the jobs."""
    agg = items.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_line_items"),
        F.count_if(F.coalesce(F.col("original_uom"), F.lit("")) != "").alias("items_with_uom"),
        F.count_if(F.coalesce(F.col("manufacturer_part_number"), F.lit("")) != "").alias("items_with_mpn"),
        F.count_if("escalation_flag").alias("items_requiring_escalation"),
        F.avg("confidence_score").alias("_avg"))
    j = json_options(jobs.select(key, "options"), lookup_default=lookup_default)
    return j.join(agg, key, "left").select(
        key, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in
               ("total_line_items", "items_with_uom", "items_with_mpn", "items_requiring_escalation")],
        F.coalesce(F.col("_avg"), F.lit(0.0)).alias("avg_confidence"),
        F.col("enable_agentic_lookup").alias("agentic_lookup_used"))


def batch_summary(results: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Totals over job results (O-24): successful, failed = total -
    successful, items over successful jobs, success rate (0 without files),
    mean items per successful job (0 without successes)."""
    ok = F.col("status") == "completed"
    g = results.groupBy(*(group or []))
    agg = g.agg(F.count(F.lit(1)).alias("total_files"), F.count_if(ok).alias("successful_files"),
                F.coalesce(F.sum(F.when(ok, F.col("total_line_items"))), F.lit(0)).alias("total_line_items"))
    return agg.select(
        *(group or []), "total_files", "successful_files",
        (F.col("total_files") - F.col("successful_files")).alias("failed_files"), "total_line_items",
        F.coalesce(F.try_divide(F.col("successful_files"), F.col("total_files")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide(F.col("total_line_items"), F.col("successful_files")), F.lit(0.0))
        .alias("avg_items_per_file"))


def zip_jobs_paths(ids: DataFrame, paths: DataFrame, group: str, id_col: str = "job_id",
                   path_col: str = "file_path", id_order: str | None = None,
                   path_order: str | None = None) -> DataFrame:
    """Pair the i-th id with the i-th path within each group, truncating to
    the shorter list (O-20).  ``id_order`` and ``path_order`` name the places
    in the request; without them ids and paths are sorted.  Places are
    two-level ranks, so one request of any size is numbered by many tasks; the
    pairs are an equi-join on (group, place), of which no two rows share one."""
    def placed(df: DataFrame, value: str, order: str | None) -> DataFrame:
        rows = df.select(F.col(group), F.col(value), F.col(order or value).alias("_order"))
        return positions(rows, [group], [F.col("_order"), F.col(value)], "pos", name="request-places").select(
            group, value, (F.col("pos") + 1).cast("int").alias("pos"))

    return placed(ids, id_col, id_order).join(placed(paths, path_col, path_order), [group, "pos"], "inner")


def bulk_summary(pairs: DataFrame, paths: DataFrame, results: DataFrame, group: str, key: str = "job_id") -> DataFrame:
    """Totals of bulk requests: every path counts as a file, also one that
    got no id; what did not complete failed; rates as in ``batch_summary``."""
    files = paths.groupBy(group).agg(F.count(F.lit(1)).alias("total_files"))
    ok = F.col("status") == "completed"
    done = pairs.select(group, key).join(results.select(key, "status", "total_line_items"), key).groupBy(group).agg(
        F.count_if(ok).alias("_n"), F.sum(F.when(ok, F.col("total_line_items"))).alias("_items"))
    made = files.join(done, group, "left").select(group, "total_files", F.coalesce("_n", F.lit(0)).alias("successful_files"),
                                                  F.coalesce("_items", F.lit(0)).alias("total_line_items"))
    return made.select(
        group, "total_files", "successful_files", (F.col("total_files") - F.col("successful_files")).alias("failed_files"),
        "total_line_items", F.coalesce(F.try_divide("successful_files", "total_files"), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide("total_line_items", "successful_files"), F.lit(0.0)).alias("avg_items_per_file"))


def project_item(items: DataFrame) -> DataFrame:
    """Response projection with the defaults: reasons never null,
    canonical unit EA."""
    return items.select(*[F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c) if c == "escalation_reasons"
                          else (F.coalesce(F.col(c), F.lit("EA")).alias(c) if c == "canonical_base_uom" else F.col(c))
                          for c in items.columns])
