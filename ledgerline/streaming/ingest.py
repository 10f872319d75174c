"""File arrival as Structured Streaming (O-01, O-19, O-33, O-59, O-61..O-64).

* ``scan_files`` lists documents with the ``binaryFile`` source (content
  pruned unless a hash is needed).
* ``read_file_stream`` is the same listing as a stream; ``availableNow``
  back-fills what exists, ``processingTime`` follows new arrivals.
* ``dedupe_stream`` drops files whose content hash was already seen:
  unbounded state with ``dropDuplicates``, or state bounded by a watermark
  with ``dropDuplicatesWithinWatermark``.
* ``start_extraction`` runs extraction per micro-batch with
  ``foreachBatch``; every output is written to a folder named by the batch
  id with overwrite, so a replayed batch rewrites the same files (effectively
  exactly once).  Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import fixed as X
from ..operators.bloom import anti_join, plain_anti_join, possible_matches
from ..sources.sinks import materialize

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
#: A file is known by its path or by its content.
FILE_KEYS = [["file_path"], ["file_hash"]]
STATE_COLUMNS = ["file_path", "file_hash", "processed", "job_id", "discovered_at", "processed_at"]


def scan_files(spark: SparkSession, path: str, glob: str = "*.{pdf,PDF}", with_hash: bool = False,
               suffix: str = ".pdf", recursive: bool = False) -> DataFrame:
    """Listing of documents (O-01), non-recursive by default; the suffix
    test is case-insensitive.  Content is read only when a hash is asked
    for (otherwise the column is pruned and files are only listed)."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    df = r.load(path).where(F.lower("path").endswith(suffix.lower()))
    cols = [F.col("path").alias("file_path"), "modificationTime", F.col("length").alias("file_size")]
    if with_hash:
        cols.append(F.md5("content").alias("file_hash"))
    return df.select(*cols)


def file_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """MD5 hex of the content (O-59)."""
    return df.withColumn("file_hash", F.md5(F.col(content)))


def unprocessed_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files not yet processed by path nor by content hash (O-19): two
    anti-joins (an OR condition in one join would be a nested loop), behind a
    Bloom filter of the processed paths and hashes, so that only possible hits
    meet the history."""
    return anti_join(files, state.where(F.col("processed")), FILE_KEYS)


def stable_files(obs: DataFrame, timeout_s: int = X.FILE_READY_TIMEOUT_S, path: str = "path",
                 ts: str = "observed_at", size: str = "size", tiebreak: str = "event_id") -> DataFrame:
    """Per path: ready when two consecutive size observations agree and are
    non-zero within ``timeout_s`` of first sight, else timed out (O-33).

    Only observations inside the timeout can decide, and every earlier
    observation of the path is inside it too, so ``lag`` runs on that
    bounded window only: first sight and counts come from a partially
    aggregated group-by, the rest of a busy path never reaches the window."""
    first = obs.groupBy(path).agg(F.min(ts).alias("first_seen"), F.count(F.lit(1)).alias("observations"))
    limit = F.col("first_seen") + F.make_dt_interval(secs=F.lit(timeout_s))
    early = (obs.select(path, ts, size, tiebreak).join(first.select(path, "first_seen"), path)
             .where(F.col(ts) <= limit))
    w = Window.partitionBy(path).orderBy(ts, tiebreak)
    o = early.select(path, ts, size, tiebreak, F.lag(size).over(w).alias("_prev"))
    ok = (F.col(size) == F.col("_prev")) & (F.col(size) > 0)
    ready = o.groupBy(path).agg(F.min_by(F.struct(ts, size), F.when(ok, F.struct(ts, tiebreak))).alias("_r"))
    g = first.join(ready, path, "left")
    return g.select(path, "first_seen", F.col(f"_r.{ts}").alias("ready_at"), F.col(f"_r.{size}").alias("ready_size"),
                    F.when(F.col("_r").isNotNull(), F.lit("ready")).otherwise(F.lit("timeout")).alias("status"),
                    "observations")


def read_file_stream(spark: SparkSession, path: str, glob: str = "*.{pdf,PDF}",
                     max_files: int | None = None, since=None, recursive: bool = False) -> DataFrame:
    """Arriving documents as a stream (O-61).  The binary source needs its
    schema given; ``since`` (a timestamp) skips files that existed before,
    the "existing files off" option."""
    r = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    df = r.load(path)
    if since is not None:
        df = df.where(F.col("modificationTime") > F.lit(since))
    return df


def read_table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None,
                      fmt: str = "parquet") -> DataFrame:
    """Arriving rows (page texts, observations) as a stream (O-61)."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


def dedupe_stream(stream: DataFrame, key: str = "file_hash", within: str | None = None) -> DataFrame:
    """Skip content seen before (O-62).  Without ``within`` the set of seen
    keys is kept for ever; with it, a key is forgotten that long after it was
    last let through.  The clock is the time of ingestion, not a time in the
    data, so no row can be late and none is dropped unseen."""
    if within is None:
        return stream.dropDuplicates([key])
    marked = stream.withColumn("_arrived", F.current_timestamp())
    return marked.withWatermark("_arrived", within).dropDuplicatesWithinWatermark([key]).drop("_arrived")


def file_state_rows(batch: DataFrame, batch_id: int, processed: bool = True) -> DataFrame:
    """Bookkeeping rows for the files of a micro-batch (O-64): discovered
    ones (``processed=False``), written before the work, have no end yet."""
    return batch.select(
        F.col("file_path"), F.col("file_hash"), F.lit(processed).alias("processed"),
        F.concat(F.lit("job_"), F.md5(F.concat_ws("\n", "file_path", "file_hash"))).alias("job_id"),
        F.col("modificationTime").alias("discovered_at"),
        (F.current_timestamp() if processed else F.lit(None).cast("timestamp")).alias("processed_at"),
        F.lit(batch_id).cast("bigint").alias("batch_id"))


def new_files(batch: DataFrame, state: DataFrame | None) -> DataFrame:
    """Files of a micro-batch that are new by path and by content: of the
    rows that ``state`` doesn't have as processed, one hash per path (the
    least), then one path per hash (the least), and again among the paths and
    hashes still free, until no row is new by both.  A row without a hash has
    unknown content: it equals no other, and stands for its path only if no
    row of the path has a hash."""
    left = batch.select("file_path", "file_hash").where(F.col("file_path").isNotNull()).distinct()
    if state is not None:
        # of the history only what the batch can match is joined
        left = materialize(left, "batch-pairs")
        done = materialize(possible_matches(state.where(F.col("processed")).select("file_path", "file_hash"), left, FILE_KEYS), "matches")
        left = plain_anti_join(left, done, FILE_KEYS)
    left = materialize(left, "new-pairs")
    hashed, chosen = left.where(F.col("file_hash").isNotNull()), []
    while True:
        per_path = hashed.groupBy("file_path").agg(F.min("file_hash").alias("file_hash"), F.count(F.lit(1)).alias("n"))
        per_hash = per_path.groupBy("file_hash").agg(F.min("file_path").alias("file_path"), F.max("n").alias("n"))
        chosen.append(materialize(per_hash, "new-by-hash"))
        # only a path with several contents can leave one behind
        if chosen[-1].where("n > 1").isEmpty():
            break
        for key in ("file_path", "file_hash"):
            hashed = hashed.join(chosen[-1].select(key), key, "left_anti")
        hashed = materialize(hashed, "new-left")
    readable = left.where(F.col("file_hash").isNotNull()).select("file_path").distinct()
    unread = left.where(F.col("file_hash").isNull()).join(readable, "file_path", "left_anti")
    picked = reduce(DataFrame.unionByName, [c.select("file_path", "file_hash") for c in chosen], unread.select("file_path", "file_hash"))
    picked = picked.select(F.col("file_path").alias("_path"), F.col("file_hash").alias("_hash"))
    return batch.join(picked, (F.col("file_path") == F.col("_path")) & F.col("file_hash").eqNullSafe(F.col("_hash")),
                      "left_semi").dropDuplicates(["file_path", "file_hash"])


def earlier_state(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """Bookkeeping of batches before this one, or None if there is none; a
    replayed batch doesn't see its own rows."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.parquet(path).where(F.col("batch_id") < batch_id)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def current_file_state(state: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """Latest bookkeeping row per file across batches; with the ``discovered``
    rows also the files that were seen and whose batch has not ended, so a
    crash leaves a trace of what it interrupted."""
    if discovered is not None:
        state = discovered.unionByName(state)
    return (state.groupBy("file_path")
            .agg(F.max_by(F.struct(*STATE_COLUMNS), F.struct("batch_id", "processed")).alias("s")).select("s.*"))


def write_batch(df: DataFrame, out: str, name: str, batch_id: int) -> DataFrame:
    """One table of a micro-batch, and the rows as they were written; a replay
    writes the same files again."""
    rows, path = df.drop("batch_id"), f"{out}/{name}/batch_id={batch_id}"
    rows.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def start_extraction(stream: DataFrame, out: str, checkpoint: str,
                     transform: Callable[[DataFrame, int], dict[str, DataFrame]],
                     trigger: dict | None = None) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and write each returned table
    to ``out/<name>/batch_id=<id>`` with overwrite (O-63, O-64).  The batch
    is stored once, so that no table computes it (or a stateful parent of it)
    again; tables are written in the order returned, bookkeeping last."""
    def each(batch: DataFrame, batch_id: int) -> None:
        for name, df in transform(materialize(batch, "batch"), batch_id).items():
            write_batch(df, out, name, batch_id)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
