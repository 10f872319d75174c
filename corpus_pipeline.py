"""A training-corpus pipeline of five stages: toxic documents go, one document
of each near-duplicate group stays, documents with benchmark passages go,
personal data is masked, and texts are encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the
last return exactly the columns of their input, whatever their names.  A
stage learns from and decides on its own input.  ``run`` writes each stage's
result to the shared folder and reads it again.

Defined results: null and empty texts pass the filters (they are clean) and
are encoded as the end id alone; in the second stage a document is an id with
a text, so texts that share an id are judged each, and of rows that repeat both
one stays; rows without doc_id link with nothing; an empty input gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, ngram_join, personal_data, sentence_pieces, toxicity
from ledgerline.llm.common import stored, table
from ledgerline.operators.positions import positions

#: Near duplicates share 80 per cent of their five-word sequences; the op3 query has its own contract.
NEAR_WORDS, NEAR_SHARE = 5, 80


#: Arrow batches of the stages: rows and bytes.  Executors and workers hold several at a time, for all five stages.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of the stages' sizes, where the session leaves the default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with every column but doc_id and text under a neutral name,
    so that no operator's own columns clash with them."""
    return docs.select(*[F.col(f"`{c}`").alias(_name(docs, c)) for c in docs.columns])


def _name(docs: DataFrame, column: str) -> str:
    return column if column in ("doc_id", "text") else f"in_{docs.columns.index(column)}"


def _named(made: DataFrame, docs: DataFrame) -> list:
    return [made[_name(docs, c)].alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score_column(F.col("text"), model, spark) < toxicity.THRESHOLD)


def _nodes(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``node``, one number for each (doc_id, text): the doc_id
    itself unless several texts or rows share it; ``shared`` tells which."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    kinds = docs.where("doc_id IS NOT NULL").select("doc_id", digest.alias("digest")).groupBy("doc_id", "digest").count()
    several = kinds.groupBy("doc_id").agg(F.sum("count").alias("n")).where("n > 1").select("doc_id")
    kinds = stored(kinds.join(several, "doc_id", "left_semi").select("doc_id", "digest"), "pipeline-shared-ids")
    least = docs.agg(F.min("doc_id")).first()[0] or 0
    numbered = positions(kinds, [], [F.col("doc_id"), F.col("digest")], "at", name="pipeline-nodes").select(
        F.col("doc_id").alias("_id"), "digest", (F.lit(least - 1) - F.col("at")).alias("_own"))
    rows = docs.withColumn("_digest", digest)
    rows = rows.join(numbered, (F.col("doc_id") == F.col("_id")) & (F.col("_digest") == F.col("digest")), "left")
    return rows.select(*docs.columns, F.coalesce("_own", "doc_id").alias("node"), F.col("_own").isNotNull().alias("shared"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = stored(_nodes(_plain(docs)), "pipeline-rows")
    groups = ngram_join.component_table(rows.select(F.col("node").alias("doc_id"), "text"), words=NEAR_WORDS, share=NEAR_SHARE,
                                        links=False)   # who links is not asked, the groups are
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("node")).distinct()
    left = stored(rows.join(gone, "node", "left_anti"), "pipeline-left")
    # rows that repeat both id and text are one document
    once = left.where("shared").dropDuplicates(["node"])
    made = left.where("NOT shared").unionByName(once)
    return made.select(*_named(made, docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = decontaminate.find_windows(_plain(docs), table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0)
    return made.select(*_named(made, docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = personal_data.train(docs.select("text"))
    made = personal_data.redact(personal_data.find_spans(_plain(docs), model))
    sizes = [F.when(F.size("spans") > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(
        F.col(_name(docs, c))).alias(c) if c == "n_chars" else made[_name(docs, c)].alias(c) for c in docs.columns]
    return made.select(*sizes)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the workers have served four other stages
    return sentence_pieces.encode(docs, ("ids", "n_tokens", "decoded_sha256"), cache_size=60_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

#: Toxicity's fitted model and the encoding have no SQL; tests compare ``run`` with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
