"""Dead letters (O-08, O-60): an input that cannot be read or parsed fails its
own row, not the batch.

Readers keep going and put what they could not use in a rescue column next to
the value; ``failures`` turns these columns into one table of (key, stage,
message, raw), ``intact`` gives the rows to work on, and ``with_failures``
puts a failed result in place of each key that has a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import materialize

MSG_NOT_OBJECT = "{0} are not a JSON object"
MSG_WRONG_TYPE = "{0} hold a value of a wrong type"
MSG_NOT_TEXT = "content is not UTF-8 text"
MSG_UNREADABLE = "file cannot be read"

_CORRUPT = "_corrupt"


def checked_json(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """``df`` plus ``out`` (the struct of ``schema``, null fields for what is
    missing) and ``<out>_error`` (null, or what is wrong with the text).  A
    null text is no error."""
    text = F.col(f"`{column}`")
    parsed = F.from_json(text, f"{schema}, {_CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    made = df.withColumn("_parsed", parsed)
    wrong = (F.when(text.isNull(), F.lit(None).cast("string"))
             .when(F.json_object_keys(text).isNull(), F.lit(MSG_NOT_OBJECT.format(column)))
             .when(F.col(f"_parsed.{_CORRUPT}").isNotNull(), F.lit(MSG_WRONG_TYPE.format(column))))
    made = made.withColumn(f"{out}_error", wrong)
    return made.withColumn(out, F.col("_parsed").dropFields(_CORRUPT)).drop("_parsed")


def decoded_text(content: Column) -> tuple[Column, Column]:
    """(text, error) of a file's bytes."""
    text = F.try_validate_utf8(content.cast("string"))
    return text, F.when(content.isNotNull() & text.isNull(), F.lit(MSG_NOT_TEXT))


def read_text_files(spark: SparkSession, path: str, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(file_path, text, error) of every file that is listed.  Files that
    vanish or break while they are read, and files that are not text, have an
    error and no text.  (Files without a byte are not listed: Spark's file
    sources pass them over.)"""
    r = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("ignoreMissingFiles", "true")
         .option("ignoreCorruptFiles", "true"))
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    files = r.load(path)
    listed = materialize(files.select(F.col("path").alias("file_path")), "listed-files")
    text, error = decoded_text(F.col("content"))
    read = materialize(files.select(F.col("path").alias("file_path"), text.alias("text"), error.alias("error")), "read-files")
    lost = listed.join(read.select("file_path"), "file_path", "left_anti")
    return read.unionByName(lost.select("file_path", F.lit(None).cast("string").alias("text"), F.lit(MSG_UNREADABLE).alias("error")))


def failures(df: DataFrame, key: str, stages: dict[str, tuple[str, str | None]]) -> DataFrame:
    """(key, stage, message, raw): one row for each error that a row has;
    ``stages`` maps a stage to its error column and the column of the raw
    value, which is kept as text."""
    found = [F.when(F.col(f"`{error}`").isNotNull(), F.struct(
        F.lit(stage).alias("stage"), F.col(f"`{error}`").alias("message"),
        (F.col(f"`{raw}`").cast("string") if raw else F.lit(None).cast("string")).alias("raw")))
        for stage, (error, raw) in stages.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")


def intact(df: DataFrame, stages: dict[str, tuple[str, str | None]]) -> DataFrame:
    """The rows without an error."""
    for error, _ in stages.values():
        df = df.where(F.col(f"`{error}`").isNull())
    return df


def with_failures(results: DataFrame, failed: DataFrame, key: str = "job_id") -> DataFrame:
    """``jobs.job_result_rows`` of the intact rows plus a failed row for each
    key of ``failed``, with its least message.  A key that has both failed."""
    least = failed.groupBy(key).agg(F.min("message").alias("error_message"))
    rows = least.select(key, F.lit("failed").alias("status"), "error_message", *[
        F.lit(0).cast(results.schema[c].dataType).alias(c) for c in ("total_line_items", "escalation_count")])
    return results.join(least.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)
