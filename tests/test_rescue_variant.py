"""Inputs that cannot be read or parsed, and values with undeclared keys."""

import os

from pyspark.sql import functions as F

from ledgerline.operators import extract as E
from ledgerline.operators import jobs as J
from ledgerline.operators import rescue as RS
from ledgerline.operators import variant as VR
from ledgerline.session import shared_dir
from ledgerline.sources import sinks as SK

TEXT = "NORTHERN SUPPLY LLC\nDescription  Qty\nGreen gear  12/CS  INR 4  INR 10.00  INR 40.00\nTotal"


def test_broken_files_fail_alone(spark, tmp_path, monkeypatch):
    for name, content in [("a", TEXT.encode()), ("b", b"\xff\xfe broken"), ("c", b" \n"), ("d", TEXT.encode())]:
        (tmp_path / f"{name}.txt").write_bytes(content)
    stored, calls = RS.materialize, []

    def vanish(df, name):
        calls.append(name)
        made = stored(df, name)
        if name == "listed-files":
            os.remove(tmp_path / "d.txt")       # between listing and reading
        return made

    monkeypatch.setattr(RS, "materialize", vanish)
    files = RS.read_text_files(spark, str(tmp_path)).withColumn("job_id", F.regexp_extract("file_path", r"(\w)\.txt$", 1))
    stages = {"content": ("error", None)}
    work = RS.intact(files, stages)
    results = RS.with_failures(J.job_result_rows(work, E.extract_line_items(work, ["job_id"])), RS.failures(files, "job_id", stages))
    got = {r["job_id"]: (r["status"], r["error_message"], r["total_line_items"]) for r in results.collect()}
    assert calls == ["listed-files", "read-files"]
    assert got["a"] == ("completed", None, 1) and got["c"][0] == "failed"
    assert got["b"] == ("failed", RS.MSG_NOT_TEXT, 0) and got["d"] == ("failed", RS.MSG_UNREADABLE, 0)


def test_options_are_checked(spark):
    rows = [("1", '{"enable_agentic_lookup": false, "x": 1}'), ("2", '{"enable_agentic'), ("3", "[1]"), ("4", "7"), ("5", None),
            ("6", '{"enable_agentic_lookup": "no"}'), ("7", "{}"), ("8", "")]
    df = RS.checked_json(spark.createDataFrame(rows, "job_id string, options string"), "options", J.OPTIONS_SCHEMA, "o")
    assert df.columns == ["job_id", "options", "o_error", "o"]
    errors = {r["job_id"]: r["o_error"] for r in df.collect()}
    assert [k for k, e in errors.items() if e is None] == ["1", "5", "7"]
    assert errors["6"] == RS.MSG_WRONG_TYPE.format("options") and errors["2"] == RS.MSG_NOT_OBJECT.format("options")
    assert df.where("job_id = '1'").first()["o"]["enable_agentic_lookup"] is False
    failed = RS.failures(df, "job_id", {"options": ("o_error", "options")})
    assert {(r["job_id"], r["stage"], r["raw"]) for r in failed.collect()} == {(k, "options", dict(rows)[k]) for k in "23468"}


def test_a_key_with_several_errors_fails_once(spark):
    rows = spark.createDataFrame([("1", "z", "a"), ("1", None, None), ("2", None, None)], "job_id string, e1 string, e2 string")
    failed = RS.failures(rows, "job_id", {"one": ("e1", None), "two": ("e2", None)})
    assert failed.count() == 2
    results = spark.createDataFrame([("1", "completed", None, 4, 1), ("2", "completed", None, 5, 0)],
                                    "job_id string, status string, error_message string, total_line_items int, escalation_count int")
    got = {r["job_id"]: r for r in RS.with_failures(results, failed).collect()}
    assert len(got) == 2 and got["1"]["error_message"] == "a" and got["1"]["total_line_items"] == 0 and got["2"]["total_line_items"] == 5


def test_undeclared_keys_survive(spark):
    rows = [("1", '{"enable_agentic_lookup": false, "deep": {"a": [1, {"b": "c"}]}, "big": 12345678901234}'), ("2", "{broken"), ("3", None)]
    jobs = spark.createDataFrame(rows, "job_id string, options string")
    kept = SK.materialize(VR.variant_options(jobs), "t-variant")
    got = {r["job_id"]: r for r in kept.select(
        "job_id", "enable_agentic_lookup", VR.path_value(F.col("options_variant"), "$.deep.a[1].b", "string").alias("b"),
        VR.path_value(F.col("options_variant"), "$.big", "bigint").alias("big")).collect()}
    assert got["1"]["enable_agentic_lookup"] is False and got["1"]["b"] == "c" and got["1"]["big"] == 12345678901234
    assert got["2"]["enable_agentic_lookup"] is True and got["2"]["b"] is None and got["3"]["b"] is None
    plain = {r["job_id"]: r["enable_agentic_lookup"] for r in J.json_options(jobs).collect()}
    assert plain == {k: r["enable_agentic_lookup"] for k, r in got.items()}


def test_whole_documents_come_back(spark):
    jobs = spark.createDataFrame([("1", "a.pdf", '{"enable_agentic_lookup": true, "extra": [1, 2]}'), ("2", "b.pdf", None)],
                                 "job_id string, file_name string, options string")
    items = E.extract_line_items(spark.createDataFrame([("1", TEXT)], "job_id string, text string"), ["job_id"])
    pages = spark.createDataFrame([("1", 1, "x", "m1", 0.5), ("1", 2, "", "m2", 0.0)],
                                  "job_id string, page_no int, text string, method string, confidence double")
    docs = VR.job_documents(jobs, items, pages, J.extraction_summary(items, jobs), J.ocr_summary(pages, "job_id"))
    path = shared_dir(spark, "t-docs") + "/t"
    SK.sink_json_documents(docs, path)
    v = F.col("document")
    back = VR.read_documents(spark.read.text(path)).select(
        VR.path_value(v, "$.job_id", "string").alias("j"), VR.path_value(v, "$.options.extra[1]", "int").alias("x"),
        VR.path_value(v, "$.ocr_results[1].has_text", "boolean").alias("t"), VR.path_value(v, "$.ocr_summary.ocr_method", "string").alias("m"),
        VR.path_value(v, "$.line_items[0].pack_info.quantity", "int").alias("q"))
    assert {tuple(r) for r in back.collect()} == {("1", 2, False, "m1", 12), ("2", None, None, None, None)}


def test_written_documents_are_compressed(spark):
    """Lines that repeat their field names take less room than their text."""
    path = shared_dir(spark, "t-small") + "/t"
    docs = spark.range(2000).selectExpr("concat('{\"job_id\": ', id, ', \"line_items\": [{\"item_description\": \"bolt\"}]}') as document")
    SK.sink_json_documents(docs, path)
    files = spark.read.format("binaryFile").load(path)
    assert files.agg(F.sum("length")).first()[0] < docs.agg(F.sum(F.length("document"))).first()[0] / 4
    assert spark.read.text(path).exceptAll(docs).isEmpty() and spark.read.text(path).count() == 2000
