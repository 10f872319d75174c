"""No loss, no cap, one row per key: the cases that once lost or doubled rows."""

import pytest
from pyspark.sql import functions as F

from ledgerline import session
from ledgerline.functions import fixed as X
from ledgerline.functions import items as I
from ledgerline.operators import jobs as J
from ledgerline.operators import ocr as OC
from ledgerline.operators import resolve as R
from ledgerline.session import shared_dir
from ledgerline.sources import sinks as SK
from ledgerline.sources import tables as TB
from ledgerline.streaming import ingest as S

ITEM = ("job_id string, line_no int, supplier_name string, item_description string, manufacturer_part_number string, "
        "hsn_code string, sac_code string, raw_line string, unit_price double, original_uom string, "
        "detected_pack_quantity bigint, price_per_base_unit double, escalation_flag boolean, "
        "escalation_reasons array<string>, pack_info struct<quantity:bigint,unit:string,confidence:double,source:string>")


def items_of(spark, descriptions):
    return spark.createDataFrame([("j", n, "s", d, "", "", "", d, 10.0, None, None, None, False, [], None)
                                  for n, d in enumerate(descriptions)], ITEM)


def rules_of(n):
    """n keywords; the first rules share a priority."""
    return [(k // 2, [f"word{k:05d}"], "CS", k, 0.7, "r", f"t{k}") for k in range(n)]


@pytest.mark.parametrize("n", [R.MAX_INLINE_KEYWORDS, R.MAX_INLINE_KEYWORDS + 1])
def test_catalogue_of_any_size(spark, n):
    items = items_of(spark, ["a word00000 word00001 b", "word01999", "x word01998y", "none", "", None, "word00007 word00006"])
    got = {r["line_no"]: (r["lookup_success"], r["pack_info"] and r["pack_info"]["quantity"], r["lookup_reasoning"])
           for r in R.resolve_uom(items, rules=rules_of(n)).collect()}
    assert len(got) == 7
    assert got[0][:2] == (True, 0) and got[1][:2] == (True, 1999) and got[2][:2] == (True, 1998) and got[6][:2] == (True, 6)
    assert got[3] == (False, None, X.MSG_ALL_FAILED_REASON)


def test_inlined_and_joined_catalogue_agree(spark):
    items = items_of(spark, ["box of gloves", "glove box", "pair gloves", "nothing", "BOX", None, "glove box"])
    rules = [(2, ["glove"], "PR", 2, 0.8, "g", "b"), (2, ["box"], "BX", 10, 0.7, "x", "a"), (1, ["pair"], "PR", 1, 0.9, "p", "c")]
    a = R.catalog_match(items, rules)
    b = R.catalog_match_join(items, spark.createDataFrame(rules, R.RULE_SCHEMA))
    cols = ["line_no", "catalog_result", "catalog_tag"]
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_repeated_answers_keep_one_item(spark):
    items = items_of(spark, ["plain thing here", "other thing here"])
    answers = spark.createDataFrame([("j", 0, '{"uom": "CS", "pack_quantity": 6, "confidence": 0.8}'),
                                     ("j", 0, '{"uom": "BX", "pack_quantity": 5, "confidence": 0.8}')],
                                    "job_id string, line_no int, answer string")
    got = R.resolve_uom(items, rules=[], answers=answers).orderBy("line_no").collect()
    assert [(r["line_no"], r["original_uom"]) for r in got] == [(0, "BX"), (1, None)]


def test_only_items_that_need_an_answer_are_joined(spark):
    items = items_of(spark, ["plain thing here"] * 50)
    answers = spark.createDataFrame([("j", 0, "{}")], "job_id string, line_no int, answer string")
    plan = R.resolve_uom(items, rules=[], answers=answers)._jdf.queryExecution().executedPlan().toString()
    union = plan[plan.index("Union"):]
    branches = union.split("Scan parquet")
    # the branch of untouched rows reads its file without an exchange
    assert "Exchange" not in branches[-1] and branches[-1] != union


def test_lookup_obeys_the_option(spark):
    items = items_of(spark, ["word"] * 4).withColumn("on", F.expr("CASE line_no WHEN 0 THEN true WHEN 1 THEN false END"))
    got = R.resolve_uom(items, rules=[(1, ["word"], "CS", 1, 0.7, "r", "t")], enabled=F.col("on")).collect()
    assert {r["line_no"]: r["lookup_success"] for r in got} == {0: True, 1: None, 2: None, 3: None}


def test_upsert_assigns_clears_and_keeps_one_row(spark):
    base = spark.createDataFrame([("a", "failed", "boom"), ("b", "pending", None), ("c", "done", "x")],
                                 "job_id string, status string, error_message string")
    updates = spark.createDataFrame([("a", "completed", None), ("b", "z", None), ("b", "failed", "late"), ("q", "new", None)],
                                    base.schema)
    got = sorted(tuple(r) for r in J.upsert_jobs(base, updates).collect())
    assert got == [("a", "completed", None), ("b", "failed", "late"), ("c", "done", "x")]
    new = spark.createDataFrame([("a", "n", None), ("d", "n", None), ("d", "m", None)], base.schema)
    assert sorted(r["job_id"] for r in J.insert_jobs(base, new).collect()) == ["a", "b", "c", "d"]


def test_white_space_alone_is_no_text(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["\n\n", " \t ", "", None, "x"])], "job_id int, text string")
    items = spark.createDataFrame([], "job_id int, escalation_flag boolean")
    got = {r["job_id"]: r["status"] for r in J.job_result_rows(docs, items).collect()}
    assert got == {0: "failed", 1: "failed", 2: "failed", 3: "failed", 4: "completed"}


def test_pack_match_beyond_a_megabyte(spark):
    # one million and some zeros before the slash and the unit
    line = F.concat(F.lit("0" * 20 + "12"), F.repeat(F.lit(" "), 1_100_000), F.lit("/CS"))
    matched = spark.range(1).select(I.pack_from_match(F.concat(F.lit("1"), line)).alias("p")).first()["p"]
    assert matched["unit"] == "CS"


def test_sinks_write_where_rows_are(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("cast(id as string) job_id", "cast(id as int) line_no",
                                                "id % 100 = 0 escalation_flag")
    path = shared_dir(spark, "sink-test")
    SK.sink_line_items(rows, path)
    back = spark.read.parquet(path)
    assert back.count() == 4000
    assert back.where("escalation_flag = 'false'").select(F.input_file_name()).distinct().count() > 1


def test_page_files_keep_numbers_and_blank_pages(spark, tmp_path):
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "a.txt").write_text("one\f\fthree\f\n")
    (tmp_path / "d2").mkdir()
    (tmp_path / "d2" / "a.txt").write_text("only")
    got = sorted(tuple(r) for r in TB.scan_page_files(spark, str(tmp_path)).collect())
    assert got == [("d1", 1, "one"), ("d1", 2, ""), ("d1", 3, "three"), ("d1", 4, ""), ("d2", 1, "only")]


def test_bounded_dedupe_drops_no_late_row(spark):
    """Old times in the data don't matter: the clock is that of arrival."""
    src = shared_dir(spark, "dedupe-test")
    for day in (9, 1, 5, 1):
        spark.range(20).selectExpr(f"concat('h', id + {day} * 10) file_hash", f"timestamp'2024-01-0{day}' observed_at") \
            .coalesce(1).write.mode("append").parquet(src + "/in")
    stream = S.dedupe_stream(S.read_table_stream(spark, src + "/in", "file_hash string, observed_at timestamp", max_files=1),
                             within="1 hour")
    q = (stream.writeStream.format("parquet").option("checkpointLocation", src + "/ck").trigger(availableNow=True)
         .start(src + "/out"))
    q.awaitTermination()
    got = [r["file_hash"] for r in spark.read.parquet(src + "/out").collect()]
    assert sorted(got) == sorted({f"h{k + d * 10}" for d in (9, 1, 5) for k in range(20)})


def test_job_ids_tell_paths_and_contents_apart(spark):
    rows = [("/a", "h1"), ("/b", "h1"), ("/a", "h2")]
    files = spark.createDataFrame(rows, "file_path string, file_hash string").withColumn("modificationTime", F.current_timestamp())
    ids = [r["job_id"] for r in S.file_state_rows(files, 1).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 36 for i in ids)


def test_candidate_order_comes_from_the_method(spark):
    rows = [(1, 1, "tesseract_raw", "r", 0.1), (1, 1, "paddle_ocr", "p" * 60, 0.8), (1, 1, "paddle_ocr", "q" * 60, 0.9)]
    df = spark.createDataFrame(rows, "doc_id int, page_no int, method string, text string, confidence double")
    r = OC.select_ocr_candidate(df).first()
    assert (r["method"], r["confidence"]) == ("paddle_ocr", 0.9)


def test_shared_folder_without_a_scheme(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "_shared_base", lambda s: str(tmp_path / "not-yet-there") + "/")
    path = shared_dir(spark, "x")
    assert path.startswith(str(tmp_path)) and not (tmp_path / "not-yet-there").exists()
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3


def test_chain_skips_what_was_processed(spark):
    """A second run over the same files, with a new checkpoint, adds nothing;
    a new path with a known content neither."""
    from ledgerline.plans import catalog_stream as CS
    src = shared_dir(spark, "chain-test")
    text = "Acme Ltd\nDescription Qty Rate Amount\n1 Steel bolt 40 EA AB-1234 10.00 400.00\nTotal 400.00\n"
    rows = [("job_1", "/a.pdf", text, "h1"), ("job_2", "/b.pdf", text + " ", "h2"), ("job_1", "/c.pdf", text, "h1")]
    df = spark.createDataFrame(rows, "job_id string, file_path string, txt string, file_hash string").withColumn(
        "modificationTime", F.current_timestamp())
    answers = spark.createDataFrame([], "job_id string, line_no int, answer string")
    df.coalesce(1).write.parquet(src + "/in")
    CS.run_chain(spark, src + "/in", df.schema, src + "/out", src + "/ck1", answers)
    count = lambda: [spark.read.parquet(f"{src}/out/{t}").count() for t in ("items", "jobs", "state")]
    first = count()
    assert first[1:] == [2, 2]
    df.where("file_path = '/c.pdf'").coalesce(1).write.mode("append").parquet(src + "/in")
    CS.run_chain(spark, src + "/in", df.schema, src + "/out", src + "/ck1", answers)
    assert count() == first


def test_new_files_keep_every_free_content(spark):
    """A rewritten path takes no content from its copies, and unread files stay."""
    def chosen(rows, state=None):
        batch = spark.createDataFrame(rows, "file_path string, file_hash string")
        done = None if state is None else spark.createDataFrame(state, "file_path string, file_hash string, processed boolean")
        return sorted((tuple(r) for r in S.new_files(batch, done).select("file_path", "file_hash").collect()), key=str)

    assert chosen([("p1", "h1"), ("p1", "h2"), ("p2", "h2")]) == [("p1", "h1"), ("p2", "h2")]
    # the least hash of p1 goes to p0: p1 is free for its other one
    assert chosen([("p0", "h1"), ("p1", "h1"), ("p1", "h2")]) == [("p0", "h1"), ("p1", "h2")]
    # what is processed doesn't stand in the way of what isn't
    assert chosen([("p1", "h1"), ("p1", "h2"), ("p2", "h2")], [("q", "h1", True), ("p3", "h9", False)]) == [("p1", "h2")]
    assert chosen([("p1", None), ("p2", None), ("p2", None), ("p3", None), ("p3", "h3")], [("p1", None, True)]) == [
        ("p2", None), ("p3", "h3")]


def test_inputs_reach_every_rule(spark):
    """The rendered invoices hold lines that are no candidates, describe
    nothing, have a pack of zero or little confidence, and no supplier."""
    from ledgerline.operators import extract as E
    from ledgerline.plans import catalog as C
    from ledgerline.plans import fixtures as FX
    sf = "/root/testdata/sf0.01"
    lines = FX.render_lines(spark, sf).count()
    candidates = E.explode_candidate_lines(FX.render_invoices(spark, sf), ["o_orderkey"], text="txt", clean=False).count()
    items = C.invoice_items(spark, sf)
    reason = lambda r: F.count_if(F.array_contains("escalation_reasons", r)).alias(r)
    got = items.agg(F.count("*").alias("n"), F.count_if(F.col("supplier_name").isNull()).alias("unnamed"),
                    F.count_if(F.col("pack_info.quantity") == 0).alias("zero"), reason(X.MISSING_UOM), reason(X.INVALID_PRICE),
                    reason(X.LOW_CONFIDENCE)).first()
    assert lines > candidates > got["n"] > 0 and min(got) > 0


def test_batch_summaries_are_read_back_whole(spark, monkeypatch):
    """The rates that are written are part of the result."""
    from ledgerline.plans import catalog_jobs
    rows = [("b1", "completed", 6), ("b1", "completed", 1), ("b1", "failed", 0), ("b2", "failed", 0), (None, "completed", 2)]
    made = spark.createDataFrame(rows, "batch_id string, status string, total_line_items int")
    monkeypatch.setattr(catalog_jobs, "_batched", lambda spark, sf_dir: made)
    got = {r["batch_id"]: tuple(r)[1:] for r in catalog_jobs.q_sink_batch_summary(spark, "").collect()}
    assert got == {"b1": (3, 2, 1, 7, 0.666666667, 3.5), "b2": (1, 0, 1, 0, 0.0, 0.0), None: (1, 1, 0, 2, 1.0, 2.0)}
