"""Line items page by page, and the running sums below it."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import extract as E
from ledgerline.operators import ocr as OC
from ledgerline.operators import pages as P
from ledgerline.operators.positions import RANGE, attach, positions, running

LINES = ["Green gear  12/CS  INR 4  INR 10.00", "Blue pump  PK6  USD40.50", "Description  Qty", "Item 7", "SUBTOTAL 3",
         "Grand Total 9", "Sold By: Acme Trading 5", "NORTHERN SUPPLY LLC", "plain words", "--", "", "  ", "12", "Widget 3 EA",
         "x\x07y 55 parts", "Particulars and subtotal 4"]


def random_pages(seed, docs=60):
    rnd = random.Random(seed)
    rows = []
    for d in range(docs):
        for p in range(rnd.choice([0, 1, 2, 5, 45])):
            n = rnd.choice([0, 1, 3, 12])
            few = [x for x in LINES if not re.search("total|item|descr|partic", x.lower())] if rnd.random() < 0.85 else LINES
            rows.append((None if d == 3 else d, 2 * p + 1, None if rnd.random() < 0.1 else "\n".join(rnd.choice(few) for _ in range(n))))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("style, clean", [("worker", True), ("worker", False), ("cli", True), ("cli", False)])
def test_page_items_equal_document_items(spark, style, clean):
    pages = spark.createDataFrame(random_pages(5), "doc_id bigint, page_no int, text string").repartition(3)
    docs = OC.concat_pages(pages, style=style)
    want = E.flatten_items(E.extract_line_items(docs, ["doc_id"], clean=clean))
    got = E.flatten_items(P.extract_page_items(pages, style=style, clean=clean, partitions=5))
    assert want.count() > 100
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # the page that an item stands on holds its line
    texts = {(r["doc_id"], r["page_no"]): (r["text"] or "").replace("\x07", "") for r in pages.collect()}
    assert all(r["raw_line"].replace("\x07", "").split()[0] in texts[r["doc_id"], r["page_no"]] for r in got.collect())


def test_given_suppliers(spark):
    pages = spark.createDataFrame([(k, 1, "NORTHERN SUPPLY LLC\nDescription\nGreen gear  12/CS  INR 4") for k in range(3)],
                                  "doc_id int, page_no int, text string")
    given = spark.createDataFrame([(1, "Mine"), (2, ""), (9, "Other")], "doc_id int, supplier_name string")
    got = {r["doc_id"]: r["supplier_name"] for r in P.extract_page_items(pages, given=given).collect()}
    assert got[1] == "Mine" and got[0] == got[2] == "NORTHERN SUPPLY LLC"


def test_no_pages(spark):
    pages = spark.createDataFrame([], "doc_id int, page_no int, text string")
    assert P.extract_page_items(pages).count() == 0
    assert P.extract_page_items(spark.createDataFrame([(1, 1, None)], pages.schema)).count() == 0


def test_one_document_is_spread_over_tasks(spark):
    """A document with nearly all pages: its places, bounds and items are
    made by many tasks, and no operator gathers its pages."""
    n = 20_000
    pages = spark.range(n, numPartitions=4).select(
        F.when(F.col("id") % 100 == 99, F.col("id")).otherwise(F.lit(0)).alias("doc_id"), F.col("id").cast("int").alias("page_no"),
        F.when(F.col("id") == n - 1000, F.lit("Grand total 4")).otherwise(F.format_string(
            "Part name %d  12/CS  INR 4.00", F.col("id"))).alias("text"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        states = P.page_states(pages)
        bounds = P.page_bounds(states, between=1, partitions=8)
        hot = bounds.where("doc_id = 0")
        assert hot.select(RANGE).distinct().count() >= 7
        assert hot.agg(F.max("first_line"), F.countDistinct("first_line")).first()[1] == hot.count()
        plan = bounds._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        items = P.extract_page_items(pages, partitions=8)
        rows = items.where("doc_id = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        total = sum(r["count"] for r in rows)
        assert total == pages.where(f"doc_id = 0 AND page_no < {n - 1000}").count()
        assert len(rows) >= 4 and max(r["count"] for r in rows) < 0.5 * total
        assert "Window" not in items._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_running_numbers_and_sums(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), k, rnd.choice([None, 0, 3, 7])) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k int, v int").repartition(3)
    made = running(df, ["g"], [F.col("k").desc()], number="at", sums={"before": "v"}, keep_range=True, partitions=6)
    got = {(r["g"], r["k"]): (r["at"], r["before"]) for r in made.collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
        assert [got[g, k] for _, k, _ in own] == [(i, sum(v or 0 for _, _, v in own[:i])) for i in range(len(own))]
    assert made.where("g = 'a'").select(RANGE).distinct().count() > 2
    values = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "g string, w int")
    assert {(r["g"], r["w"]) for r in attach(made, ["g"], values).collect()} == {("a", 1), ("b", None), (None, 2)}
    assert sorted(r["at"] for r in positions(df, [], ["k"], "at", partitions=4).collect()) == list(range(500))
