"""OCR tables, job tables and summaries."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import jobs as J
from ledgerline.operators import ocr as OC


def test_g4_token_stats(spark):
    confs = [95, 60, 59, -1, 80]
    rows = [(1, 1, i, 1, 1, i, c, f"w{i}") for i, c in enumerate(confs)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, token_idx int, block_num int, line_num int, "
                                     "lft int, conf int, text string")
    s = OC.token_confidence_stats(df).first()
    assert (s.total_words, s.mean_confidence, s.median_confidence) == (4, 73.5, 70.0)
    assert (s.min_confidence, s.max_confidence, s.low_confidence_words, s.high_confidence_words) == (59, 95, 1, 1)
    assert (s.very_low, s.low, s.medium, s.high) == (0, 1, 1, 2)


def test_line_key_string_order(spark):
    rows = [(1, 1, 0, 1, 10, 0, 90, "ten"), (1, 1, 1, 1, 2, 0, 90, "two"), (1, 1, 2, 2, 1, 0, 90, "next"),
            (1, 1, 3, 1, 2, 5, 90, "more"), (1, 1, 4, 1, 2, 1, 10, "low")]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, token_idx int, block_num int, line_num int, "
                                     "lft int, conf int, text string")
    r = OC.assemble_lines(df, clean=False).first()
    assert r.text == "ten\ntwo more\nnext" and r.confidence == pytest.approx(0.9)


def test_g4_candidate_choice(spark):
    rows = [(1, 1, "tesseract_layout", 0, "x" * 150, 0.6), (1, 1, "tesseract_multi_psm", 1, "y" * 101, 0.51),
            (1, 1, "tesseract_raw", 4, "z", 0.1), (2, 1, "tesseract_raw", 4, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, method string, priority int, text string, confidence double")
    got = {r.doc_id: (r.method, r.error) for r in OC.select_ocr_candidate(df).collect()}
    assert got == {1: ("tesseract_multi_psm", None), 2: ("tesseract_raw", "All advanced methods failed")}


def test_g5_min_confidence(spark):
    df = spark.createDataFrame([("j", 0, None, False), ("j", 1, 0.5, True)],
                               "job_id string, line_no int, confidence_score double, escalation_flag boolean")
    assert J.filter_line_items(df, "j", min_confidence=0.0).count() == 2
    assert J.filter_line_items(df, "j", min_confidence=0.01).count() == 1
    assert J.filter_line_items(df, "j", escalation_only=True).count() == 1


def test_g5_batch_summary(spark):
    df = spark.createDataFrame([("a", "completed", 4), ("b", "completed", 6), ("c", "failed", 0)],
                               "job_id string, status string, total_line_items int")
    s = J.batch_summary(df).first()
    assert (s.total_files, s.successful_files, s.failed_files, s.total_line_items) == (3, 2, 1, 10)
    assert s.success_rate == pytest.approx(2 / 3) and s.avg_items_per_file == 5.0
    e = J.batch_summary(df.limit(0)).first()
    assert (e.success_rate, e.avg_items_per_file) == (0.0, 0.0)


def test_upsert_delete_and_paging(spark):
    jobs = spark.createDataFrame([(f"job_{i}", "pending", i % 3) for i in range(25)],
                                 "job_id string, status string, created_at int")
    items = spark.createDataFrame([(f"job_{i}", 0) for i in range(25)], "job_id string, line_no int")
    upd = spark.createDataFrame([("job_1", "completed"), ("job_99", "completed")], "job_id string, status string")
    out = {r.job_id: r.status for r in J.upsert_jobs(jobs, upd).collect()}
    assert out["job_1"] == "completed" and "job_99" not in out and len(out) == 25
    j2, i2 = J.delete_jobs(jobs, items, jobs.where(F.col("created_at") == 0))
    assert i2.join(j2, "job_id", "left_anti").count() == 0       # no orphans
    pages = [J.list_jobs(jobs, page=p, page_size=10)[0].collect() for p in (1, 2, 3)]
    ids = [r.job_id for pg in pages for r in pg]
    assert len(ids) == 25 and len(set(ids)) == 25 and J.list_jobs(jobs)[1] == 25


def test_concat_pages(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, "")], "doc_id int, page_no int, text string")
    w = OC.concat_pages(df).first()
    c = OC.concat_pages(df, style="cli").first()
    assert w.text == "a\n\n--- PAGE BREAK ---\n\nb" and c.text == "a\n\nb\n\n" and w.total_pages == 3
