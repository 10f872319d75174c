"""Table scans (O-02, O-03) and the parallelism guard for CPU-bound work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` over the cluster when its scan yields fewer
    partitions than cores (a single-file or single-row-group input).

    Text extraction is CPU-bound, so a one-task scan would leave the cluster
    idle.  On real inputs (thousands of splits) this is a no-op and adds no
    shuffle.  Round-robin repartitioning sorts before distributing
    (``spark.sql.execution.sortBeforeRepartition``), so a retried task
    recomputes the same rows."""
    spark = df.sparkSession
    target = min_partitions or spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page-text rows ``(doc_id, page_no, text, method, confidence, ...)``
    from Parquet (O-02)."""
    return spark.read.parquet(path)


def scan_page_files(spark: SparkSession, path: str, glob: str = "*.txt", doc_pattern: str = r"([^/]+)/[^/]+$",
                    page_break: str = "\f") -> DataFrame:
    """One text file per document, pages separated by form feeds (O-02):
    ``(doc_id, page_no, text)``.  The document id is group 1 of
    ``doc_pattern`` on the file path (default: the folder); pages are numbered
    from 1 as they stand in the file, blank ones included; a line end at the
    file's end is not part of the last page."""
    from pyspark.sql import functions as F
    df = (spark.read.option("wholetext", "true").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").text(path)
          .select(F.regexp_extract(F.input_file_name(), doc_pattern, 1).alias("doc_id"),
                  F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), page_break, -1)).alias("pos", "text")))
    return df.select("doc_id", (F.col("pos") + 1).alias("page_no"), "text")


def scan_tokens(spark: SparkSession, path: str) -> DataFrame:
    """OCR word tokens ``(doc_id, page_no, token_idx, block_num, line_num,
    lft, conf, text)`` from Parquet (O-03)."""
    return spark.read.parquet(path)
