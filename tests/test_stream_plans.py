"""Streams (replay, batch equality) and plan shape."""

from pyspark.sql import functions as F

from ledgerline.operators import extract as E
from ledgerline.session import shared_dir
from ledgerline.streaming import ingest as S


def test_dedupe_replay_is_idempotent(spark):
    base = shared_dir(spark, "t-dedupe")
    rows = [(i, f"h{i % 3}") for i in range(9)]
    spark.createDataFrame(rows, "event_id int, file_hash string").repartition(3).write.parquet(base + "/in")
    schema = "event_id int, file_hash string"

    def run():
        st = S.dedupe_stream(S.read_table_stream(spark, base + "/in", schema, max_files=1))
        q = (st.writeStream.format("parquet").option("checkpointLocation", base + "/ck")
             .trigger(availableNow=True).start(base + "/out"))
        q.awaitTermination()
        return spark.read.parquet(base + "/out").count()

    assert run() == 3
    assert run() == 3          # replay from the checkpoint adds nothing


def test_stream_equals_batch(spark):
    base = shared_dir(spark, "t-stream")
    text = "Supplier: Northwind Traders\nDescription  Qty\nGreen gear  12/CS  INR 4  INR 10.00  INR 40.00\nTotal"
    docs = spark.createDataFrame([(i, text) for i in range(6)], "doc_id int, txt string")
    docs.repartition(3).write.parquet(base + "/in")
    st = S.read_table_stream(spark, base + "/in", docs.schema, max_files=1)
    q = S.start_extraction(st, base + "/out", base + "/ck",
                           lambda b, i: {"items": E.flatten_items(E.extract_line_items(b, ["doc_id"], text="txt"))})
    q.awaitTermination()
    streamed = spark.read.parquet(base + "/out/items").drop("batch_id")
    batch = E.flatten_items(E.extract_line_items(docs, ["doc_id"], text="txt"))
    assert sorted(map(tuple, streamed.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_extraction_plan_has_no_python_and_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    items = E.extract_line_items(docs, ["doc_id"])
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "Exchange" not in plan
    assert "PushedFilters" in docs.where(F.col("doc_id") > 3)._jdf.queryExecution().executedPlan().toString()


def test_entry_and_registry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs) and len(qs) >= 60


def test_a_back_fill_takes_few_batches(spark):
    """However many files have arrived, they come in a bounded number of
    micro-batches."""
    from ledgerline.plans import catalog_stream as CS
    src = shared_dir(spark, "t-files")
    spark.range(60).repartition(60).write.parquet(src)
    files = len(spark.read.parquet(src).inputFiles())
    assert files > 30 and CS._files_per_batch(spark, src, least=2) == -(-files // CS.BATCHES)
    assert CS._files_per_batch(spark, src) == CS.FILES_PER_BATCH
    assert CS._files_per_batch(spark, src, least=50, files=90_000) == 11_250
    parts = CS._stream_parts(spark, spark.range(60).repartition(60), "t-parts", lambda b: b.select("id"))
    assert parts.count() == 60 and parts.select("batch_id").distinct().count() <= CS.BATCHES


def test_flat_files_hold_what_the_users_files_hold(spark, tmp_path):
    """Files that are streamed lie side by side, one a user (F8); their
    contents are those of the files in a folder for each user."""
    import datetime as dt
    from pathlib import Path

    from ledgerline.plans import catalog_stream as CS
    ts = dt.datetime(2024, 1, 1)
    rows = [(k, ts, None if k % 11 == 0 else k % 5, None if k % 7 == 0 else f'{{"k": {k}}}') for k in range(60)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert CS._write_flat_files(spark, str(tmp_path), f"{tmp_path}/flat") == 6
    CS._write_user_files(spark, str(tmp_path), f"{tmp_path}/own")
    files = lambda name: sorted(p.read_text() for p in Path(f"{tmp_path}/{name}/docs").rglob("*.txt"))
    assert files("flat") == files("own") and len(files("flat")) == 6
    assert not [p for p in Path(f"{tmp_path}/flat/docs").iterdir() if p.is_dir()]


def test_text_files_are_written_by_the_tasks(spark, tmp_path):
    """A file for each document, without a folder for each (F3), and the same pages read back."""
    from pathlib import Path

    from ledgerline.plans import catalog_ocr as CO
    from ledgerline.plans import fixtures as FX
    from ledgerline.sources.sinks import sink_text_files
    texts = [(k, "a\n\nb" if k else None) for k in range(40)] + [(-7, "x"), (None, "é")]
    df = spark.createDataFrame(texts, "doc bigint, text string").repartition(3)
    assert sink_text_files(df, f"file:{tmp_path}/files", "doc") == 42
    found = {p.name: p.read_text() for p in Path(f"{tmp_path}/files").rglob("*") if p.is_file()}
    assert found == {f"doc={'__HIVE_DEFAULT_PARTITION__' if k is None else k}.txt": (t or "") + "\n" for k, t in texts}
    assert len([p for p in Path(f"{tmp_path}/files").iterdir()]) <= 3
    spark.createDataFrame([(1, "p\n\nq"), (2, ""), (-3, "r"), (4, None)], "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.page_no, r.text) for r in CO.q_scan_page_files(spark, str(tmp_path)).collect())
    want = sorted((str(r.doc_id), r.page_no, r.text) for r in FX.render_pages(spark, str(tmp_path)).collect())
    assert got == want and len(got) == 5
