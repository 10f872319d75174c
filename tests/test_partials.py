"""Summaries merged from partial states equal the plain ones, however the
rows are dealt over batches."""

import random

from pyspark.sql import functions as F

from ledgerline.operators import jobs as J
from ledgerline.operators import partials as PT
from ledgerline.session import shared_dir
from ledgerline.streaming import ingest as S


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return sorted(map(str, df.collect()))


def test_states_merge_in_any_grouping(spark):
    rnd = random.Random(3)
    items = spark.createDataFrame([(f"j{rnd.randrange(9)}", rnd.choice(["EA", "", None]), rnd.choice(["m", None]), rnd.random() < 0.3,
                                    rnd.choice([None, rnd.random()]), rnd.randrange(5)) for _ in range(300)],
                                  "job_id string, original_uom string, manufacturer_part_number string, escalation_flag boolean, "
                                  "confidence_score double, b int")
    jobs = spark.createDataFrame([(f"j{k}", '{"enable_agentic_lookup": true}' if k % 2 else None) for k in range(11)],
                                 "job_id string, options string")
    want = rounded(J.extraction_summary(items, jobs), "avg_confidence")
    parts = None
    for b in range(5):
        p = PT.summary_parts(items.where(f"b = {b}")).withColumn("batch_id", F.lit(b))
        parts = p if parts is None else parts.unionByName(p)
    assert rounded(PT.merged_summary(parts, jobs), "avg_confidence") == want
    folded = PT.compact(parts, ["job_id"], PT.SUMMARY_STATE, before=4)
    assert folded.count() < parts.count() and folded.select("batch_id").distinct().count() == 2
    assert rounded(PT.merged_summary(folded, jobs), "avg_confidence") == want

    pages = spark.createDataFrame([(d, p, rnd.choice(["t", "", None]), rnd.choice(["a", "b", "c"]), rnd.choice([None, rnd.random()]))
                                   for d in range(8) for p in range(rnd.randint(1, 6))],
                                  "doc_id int, page_no int, text string, method string, confidence double")
    parts = PT.ocr_parts(pages.where("page_no % 2 = 0")).unionByName(PT.ocr_parts(pages.where("page_no % 2 = 1")))
    assert rounded(PT.merged_ocr_summary(parts), "avg_confidence") == rounded(J.ocr_summary(pages), "avg_confidence")

    results = spark.createDataFrame([(f"g{k % 4}", "completed" if k % 5 and k % 4 else "failed", k) for k in range(40)],
                                    "g string, status string, total_line_items int")
    parts = PT.batch_parts(results.where("total_line_items < 17"), ["g"]).unionByName(
        PT.batch_parts(results.where("total_line_items >= 17"), ["g"]))
    assert rounded(PT.merged_batch_summary(parts, ["g"]), "success_rate", "avg_items_per_file") == rounded(
        J.batch_summary(results, ["g"]), "success_rate", "avg_items_per_file")


def test_a_replayed_batch_counts_once(spark):
    out = shared_dir(spark, "t-parts")
    results = spark.createDataFrame([("g", "completed", 3), ("g", "failed", 0)], "g string, status string, total_line_items int")
    for _ in range(2):
        S.write_batch(PT.batch_parts(results, ["g"]), out, "parts", 7)
    S.write_batch(PT.batch_parts(results, ["g"]), out, "parts", 8)
    r = PT.merged_batch_summary(spark.read.parquet(out + "/parts"), ["g"]).first()
    assert (r["total_files"], r["successful_files"], r["total_line_items"]) == (4, 2, 6)
