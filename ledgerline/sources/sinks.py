"""Sinks (O-04, O-05, O-06): Parquet item tables, one JSON document per job,
batch summaries."""

from __future__ import annotations

import os
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_line_items(items: DataFrame, path: str, partition_by: tuple[str, ...] = ("escalation_flag",),
                    mode: str = "append") -> None:
    """Append items as Parquet, partitioned so escalation reads prune
    folders; rows are ordered by job within each file (O-04).  Every task
    writes what it has: no shuffle, and no flag value meets in one task."""
    (items.sortWithinPartitions(*partition_by, "job_id", "line_no")
     .write.mode(mode).partitionBy(*partition_by).parquet(path))


def json_documents(jobs: DataFrame, items: DataFrame, ocr: DataFrame | None = None,
                   summary: DataFrame | None = None, key: str = "job_id") -> DataFrame:
    """One nested document per job (O-05): job header, ``ocr_summary``,
    ``extraction_summary`` and ``line_items`` (ordered by line), as a
    ``(job_id, document)`` JSON-string table.  Items are gathered per job —
    one invoice's items — after a shuffle by job."""
    item_cols = [c for c in items.columns if c != key]
    nested = items.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*item_cols))).alias("line_items"))
    doc = jobs.join(nested, key, "left")
    if ocr is not None:
        doc = doc.join(ocr.select(key, F.struct(*[c for c in ocr.columns if c != key]).alias("ocr_summary")),
                       key, "left")
    if summary is not None:
        doc = doc.join(summary.select(key, F.struct(*[c for c in summary.columns if c != key])
                                      .alias("extraction_summary")), key, "left")
    body = [c for c in doc.columns if c != key]
    return doc.select(key, F.to_json(F.struct(F.col(key), *[F.col(c) for c in body])).alias("document"))


def sink_json_documents(docs: DataFrame, path: str, mode: str = "overwrite", compression: str = "gzip") -> None:
    """One document a line (O-05).  Every item repeats the names of its
    fields, so the lines are compressed; readers of text open them as they
    are."""
    docs.select("document").write.mode(mode).option("compression", compression).text(path)


def sink_batch_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Batch summaries, one row per batch, as JSON lines (O-06); written by
    the tasks that hold them."""
    summary.write.mode(mode).json(path)


def sink_batch_details(results: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Per-file results and failures of the batches as JSON lines in two
    folders (O-06), one row per job.  The results are stored once, as each
    folder would make them again."""
    results = materialize(results, "batch-details")
    done = F.col("status") == "completed"
    results.where(done).drop("error_message").write.mode(mode).json(f"{path}/results")
    results.where(~done).write.mode(mode).json(f"{path}/failures")


#: Name of a file whose key is null or empty, as in partitioned writes.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def sink_text_files(texts: DataFrame, path: str, key: str, text: str = "text", folders: bool = True) -> int:
    """One text file for each row, ``<key>=<value>`` and ``.txt``, with a line
    end; returns their number.  The values of ``key`` are distinct.  On a
    mounted file system the tasks write them, each into a folder of its own or
    (``folders=False``) all side by side: through Spark's writer every file asks a child process for its permissions.
    A file gets its name when it is whole, so a repeated task writes the same.
    On other file systems Spark's writer makes a folder for each value."""
    rows = texts.select(F.col(key).cast("string").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    parts = urlsplit(path)
    if parts.scheme not in ("", "file"):
        rows = materialize(rows, "texts")
        rows.write.partitionBy(key).text(path)
        return rows.count()
    root = parts.path

    def write(batches):
        task = TaskContext.get()
        folder, n = os.path.join(root, f"{task.partitionId():05d}") if folders else root, 0
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = f"{key}={quote(name or NO_KEY, safe='')}.txt"
                made = os.path.join(folder, f".{task.taskAttemptId()}.{name}")
                with open(made, "wb") as f:
                    f.write(body.as_py().encode() + b"\n")
                os.replace(made, os.path.join(folder, name))
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the session's shared checkpoint folder
    and return the table read back: cuts the lineage when one result feeds
    several outputs (items and their audit rows), so it is computed once and
    a lost executor re-reads files instead of recomputing the chain."""
    from ..session import shared_dir
    path = shared_dir(df.sparkSession, name) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
