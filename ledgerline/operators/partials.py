"""Summaries that are kept up to date (O-22..O-24).

Every micro-batch writes *partial states*: one row per job, document or batch
of what its rows add to a summary.  States of a key merge in any order and
grouping (sums, counts, sets, the row of the least page), so a reader merges
the few rows of each key instead of reading all items again, and ``compact``
folds old states into fewer.  A replayed micro-batch overwrites its own
states (``streaming.ingest.write_batch``), so nothing counts twice.

Each summary is a pair: ``*_parts`` makes states from rows, ``merged_*`` turns
states into the result of the plain operator in ``jobs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jobs import json_options

#: How the columns of a state merge.
_SUM, _FIRST, _SET = "sum", "first", "set"
SUMMARY_STATE = {"items": _SUM, "with_uom": _SUM, "with_mpn": _SUM, "escalated": _SUM, "score_sum": _SUM, "scored": _SUM}
OCR_STATE = {"pages": _SUM, "texts": _SUM, "confidence_sum": _SUM, "confident": _SUM, "methods": _SET, "first": _FIRST}
BATCH_STATE = {"files": _SUM, "completed": _SUM, "completed_items": _SUM}


def _merge(name: str, how: str) -> Column:
    if how == _SUM:
        return F.sum(name).alias(name)
    if how == _FIRST:
        return F.min(name).alias(name)
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name)))).alias(name)


def merge_parts(parts: DataFrame, keys: list[str], state: dict[str, str]) -> DataFrame:
    """One state per key; merging merged states gives the same."""
    return parts.groupBy(*keys).agg(*[_merge(c, how) for c, how in state.items()])


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def summary_parts(items: DataFrame, key: str = "job_id") -> DataFrame:
    """States of ``extraction_summary`` from items."""
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(_filled("original_uom")).alias("with_uom"),
        F.count_if(_filled("manufacturer_part_number")).alias("with_mpn"), F.count_if("escalation_flag").alias("escalated"),
        F.coalesce(F.sum("confidence_score"), F.lit(0.0)).alias("score_sum"), F.count("confidence_score").alias("scored"))


def merged_summary(parts: DataFrame, jobs: DataFrame, key: str = "job_id", lookup_default: bool = False) -> DataFrame:
    """``jobs.extraction_summary`` from states (O-23)."""
    s = merge_parts(parts, [key], SUMMARY_STATE)
    j = json_options(jobs.select(key, "options"), lookup_default=lookup_default)
    number = lambda c, name: F.coalesce(F.col(c), F.lit(0)).alias(name)
    return j.join(s, key, "left").select(
        key, number("items", "total_line_items"), number("with_uom", "items_with_uom"), number("with_mpn", "items_with_mpn"),
        number("escalated", "items_requiring_escalation"),
        F.coalesce(F.try_divide("score_sum", "scored"), F.lit(0.0)).alias("avg_confidence"),
        F.col("enable_agentic_lookup").alias("agentic_lookup_used"))


def ocr_parts(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """States of ``ocr_summary`` from pages, which may arrive in any order."""
    return pages.groupBy(key).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(_filled("text")).alias("texts"),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence_sum"), F.count("confidence").alias("confident"),
        F.array_sort(F.collect_set("method")).alias("methods"),
        F.min(F.when(F.col("page_no").isNotNull(), F.struct("page_no", "method"))).alias("first"))


def merged_ocr_summary(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``jobs.ocr_summary`` from states (O-22)."""
    s = merge_parts(parts, [key], OCR_STATE)
    return s.select(key, F.col("pages").alias("total_pages"), F.col("texts").alias("successful_pages"),
                    F.try_divide("confidence_sum", "confident").alias("avg_confidence"),
                    F.col("methods").alias("methods_used"), F.col("first.method").alias("ocr_method"))


def batch_parts(results: DataFrame, group: list[str]) -> DataFrame:
    """States of ``batch_summary`` from job results."""
    ok = F.col("status") == "completed"
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"), F.count_if(ok).alias("completed"),
        F.coalesce(F.sum(F.when(ok, F.col("total_line_items")).cast("bigint")), F.lit(0)).alias("completed_items"))


def merged_batch_summary(parts: DataFrame, group: list[str]) -> DataFrame:
    """``jobs.batch_summary`` from states (O-24)."""
    s = merge_parts(parts, group, BATCH_STATE)
    return s.select(
        *group, F.col("files").alias("total_files"), F.col("completed").alias("successful_files"),
        (F.col("files") - F.col("completed")).alias("failed_files"), F.col("completed_items").alias("total_line_items"),
        F.coalesce(F.try_divide("completed", "files"), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.try_divide("completed_items", "completed"), F.lit(0.0)).alias("avg_items_per_file"))


def compact(parts: DataFrame, keys: list[str], state: dict[str, str], before: int) -> DataFrame:
    """The states of all batches below ``before`` merged into one per key
    (``batch_id`` -1), later ones as they are: what a housekeeping job writes
    as the new table, to keep the rows per key few."""
    old = merge_parts(parts.where(F.col("batch_id") < before), keys, state).withColumn("batch_id", F.lit(-1).cast("bigint"))
    columns = [*keys, *state, "batch_id"]
    return old.select(*columns).unionByName(parts.where(F.col("batch_id") >= before).select(
        *columns[:-1], F.col("batch_id").cast("bigint").alias("batch_id")))
