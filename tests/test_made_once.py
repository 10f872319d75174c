"""What is costly is made once, stored narrow, and only for the rows that need it."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import resolve as R
from ledgerline.plans import catalog, catalog_jobs, catalog_resolve, catalog_stream
from ledgerline.sources import sinks as SK

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_supplier_is_looked_for_once(spark):
    """The text is cleaned once for both columns of the query."""
    assert optimized(catalog.q_extract_supplier(spark, SF)).count(r"\p{L}\p{N}\s") == 1


def test_staged_supplier_equals_the_column(spark):
    texts = ["Sold By: Acme Works\nx", "COMPANY: Bolt House\n", "some thing\nNorth Star Supply Co.\n", "Baker & sons l.t.d\nBAKER SONS LtD.",
             "Northern Tools Group\nrest", "Plain Workshop Name\n12", "no name here", "", None, "wincor\nalpha beta Inc", "A1\n\nVendor:\tKent  Ltd"]
    docs = spark.createDataFrame([*enumerate(texts)], "k int, x string").withColumn("y", T.clean_text("x"))
    for c in ("x", "y"):
        plain = {r.k: r.s for r in docs.select("k", T.extract_supplier(c).alias("s")).collect()}
        assert {r.k: r.supplier_name for r in T.with_supplier(docs, c).collect()} == plain
        assert len({*plain.values()}) > 7


def test_cleaning_squeezes_spaces_and_tabs(spark):
    texts = ["a b  c", "a\tb", "a \tb", "a\t \tb c", "one\t\ntwo  \n three", " \t ", "a   b", "x\x07 \x07y"]
    got = [r.t for r in spark.createDataFrame([*enumerate(texts)], "k int, x string").orderBy("k").select(T.clean_text("x").alias("t")).collect()]
    assert got == ["\n".join(p for p in (q.strip(" \t\x0b\x0c\r") for q in re.sub("[ \t]+", " ", t.replace("\x07", "")).split("\n")) if p)
                   for t in texts]


def test_batch_details_make_their_results_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(status):
        made.add(1)
        return status

    rows = [("b1", "j1", "completed", None), ("b1", "j2", "failed", "no text"), (None, "j3", "completed", None), ("b2", "j4", None, None)]
    results = spark.createDataFrame(rows, "batch_id string, job_id string, status string, error_message string").repartition(2)
    SK.sink_batch_details(results.withColumn("status", seen("status")), str(tmp_path / "t"))
    assert made.value == 4
    back = [sorted(r.job_id for r in spark.read.schema("job_id string").json(str(tmp_path / "t" / part)).collect()) for part in ("results", "failures")]
    assert back == [["j1", "j3"], ["j2"]]


@pytest.fixture
def stored(monkeypatch):
    """Columns of the tables that resolution and the catalogue store, by name."""
    out, plain = {}, R.materialize

    def kept(df, name):
        out[name] = df.columns
        return plain(df, name)

    monkeypatch.setattr(R, "materialize", kept)
    return out


@pytest.mark.parametrize("query", ["q_resolve_uom", "q_resolve_uom_enabled"])
def test_resolution_stores_what_it_reads(spark, stored, query):
    assert getattr(catalog_resolve, query)(spark, SF).count() > 0
    assert not {"raw_line", "supplier_name", "confidence_score"} & {*stored["resolve"]}


def test_catalogue_stores_what_it_matches(spark, stored):
    catalog_resolve.q_catalog_part_join(spark, SF)
    assert stored["catalog-items"] == ["o_orderkey", "line_no", "item_description"]


def test_search_terms_are_made_for_looked_up_items(spark):
    items = spark.createDataFrame([("j", 0, "box of gloves", "", "", "", 1.0, None, None, None, False, [], None)], (
        "job_id string, line_no int, item_description string, manufacturer_part_number string, hsn_code string, sac_code string, "
        "unit_price double, original_uom string, detected_pack_quantity bigint, price_per_base_unit double, escalation_flag boolean, "
        "escalation_reasons array<string>, pack_info struct<quantity:bigint,unit:string,confidence:double,source:string>"))
    resolved = R.resolve_uom(items)
    assert re.search(r"CASE WHEN _try#\d+ THEN concat\(", resolved._jdf.queryExecution().analyzed().toString())
    assert resolved.select("lookup_attempts").first()[0][0]["lookup_query"] == "box gloves"


def test_audit_rows_meet_the_items_they_can_match(spark):
    audit = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 1, "n"), ("q", 9, "none")], "job_id string, line_no int, s string")
    items = spark.createDataFrame([("a", 1, "i"), ("a", 1, "twice"), ("a", 2, "other"), ("b", 2, "j"), (None, 1, "k"), ("c", None, "l")],
                                  "job_id string, line_no int, d string")
    got = R.audit_join_items(audit, items)
    assert got.columns == ["job_id", "line_no", "s", "d"] and "may_contain" in optimized(got)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, audit.join(items, ["job_id", "line_no"]).collect()))
    wider = items.withColumn("line_no", F.col("line_no").cast("bigint"))
    assert R.audit_join_items(audit, wider).count() == got.count() == 5


def test_documents_render_their_invoices_once(spark, monkeypatch):
    calls, plain = [], catalog_jobs.FX.render_invoices
    monkeypatch.setattr(catalog_jobs.FX, "render_invoices", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    assert catalog_jobs.q_variant_json_documents(spark, SF).count() > 0
    assert len(calls) == 1


def test_the_chain_stores_its_items_once(spark, tmp_path, monkeypatch):
    names, plain = [], catalog_stream.materialize
    monkeypatch.setattr(catalog_stream, "materialize", lambda df, name: (names.append(name), plain(df, name))[1])
    text = "Sold By: Acme\nDescription Qty Amount\nsteel bolt long  5 INR 10.00\nwidget red 12/CS INR 9.00\nSubtotal 4"
    files = spark.createDataFrame([("j1", "/in/1", text, "h1"), ("j2", "/in/2", " ", "h2"), ("j3", "/in/3", text, "h1")],
                                  "job_id string, file_path string, txt string, file_hash string").withColumn("modificationTime", F.current_timestamp())
    answers = spark.createDataFrame([("j1", 2, '{"uom": "BX", "pack_quantity": 5, "confidence": 0.8}')], "job_id string, line_no int, answer string")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files.write.parquet(src)
    catalog_stream.run_chain(spark, src, files.schema, out, out + "_ckpt", answers)
    items, jobs = spark.read.parquet(out + "/items"), spark.read.parquet(out + "/jobs")
    assert {*names} == {"new-files"}
    assert items.groupBy("job_id").count().collect() == [("j1", 2)]
    assert sorted((r.job_id, r.status, r.total_line_items) for r in jobs.collect()) == [("j1", "completed", 2), ("j2", "failed", 0)]
