"""Pages by key and by jump, places in bulk requests."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import extract as E
from ledgerline.operators import jobs as J


@pytest.fixture(scope="module")
def jobs(spark):
    """Crowded days, ties across page borders, jobs without a date."""
    rnd = random.Random(4)
    day = lambda: rnd.choice([dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 2, 3, 4, 5, rnd.randrange(9)),
                              dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rnd.randrange(10 ** 7)), None])
    rows = [(f"job_{k}", day(), "done" if k % 3 else "open") for k in range(600)]
    return spark.createDataFrame(rows, "job_id string, created_at timestamp, status string").repartition(4).cache()


def in_order(jobs, status=None):
    rows = [r for r in jobs.collect() if status in (None, r["status"])]
    return [r["job_id"] for r in sorted(rows, key=lambda r: (r["created_at"] is None,
                                                             -r["created_at"].timestamp() if r["created_at"] else 0, r["job_id"]))]


@pytest.mark.parametrize("skip", [3, 40, 4096])
def test_jumps_give_the_pages_of_the_whole_order(spark, jobs, skip):
    want = in_order(jobs)
    for page in (1, 2, 7, 14, 16, 20, 24, 25, 26, 40):
        got = [r["job_id"] for r in J.jump_to_page(jobs, page, page_size=25, skip_rows=skip).collect()]
        assert got == want[25 * (page - 1):25 * page], page
    assert [r["job_id"] for r in J.jump_to_page(jobs, 5, "open", 11, skip).collect()] == in_order(jobs, "open")[44:55]
    assert J.jump_to_page(jobs.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        J.jump_to_page(jobs, 0)


def test_pages_one_after_the_other(spark, jobs):
    dated = jobs.where("created_at IS NOT NULL")
    got, after = [], None
    while rows := J.page_after(dated, after, page_size=37).collect():
        got += [r["job_id"] for r in rows]
        after = rows[-1]["created_at"], rows[-1]["job_id"]
    assert got == in_order(dated)
    plan = J.page_after(dated, after, page_size=37)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=37" in plan


def test_requests_are_paired_in_their_order(spark):
    """One request holds nearly all rows; ids are fewer than paths."""
    n = 3000
    rows = spark.range(n).select(F.when(F.col("id") % 50 == 0, F.lit("small")).otherwise(F.lit("big")).alias("g"),
                                 (F.lit(n) - F.col("id")).alias("at"), F.concat(F.lit("j"), F.col("id")).alias("job_id"),
                                 F.concat(F.lit("/p"), F.col("id")).alias("file_path"))
    ids = rows.where("id % 7 <> 0") if "id" in rows.columns else rows.where("at % 7 <> 0")
    pairs = J.zip_jobs_paths(ids, rows, "g", id_order="at", path_order="at")
    got = sorted((r["g"], r["pos"], r["job_id"], r["file_path"]) for r in pairs.collect())
    want = []
    for g in ("big", "small"):
        paths = [r["file_path"] for r in sorted(rows.where(f"g = '{g}'").collect(), key=lambda r: r["at"])]
        jobs_ = [r["job_id"] for r in sorted(ids.where(f"g = '{g}'").collect(), key=lambda r: r["at"])]
        want += [(g, k, j, p) for k, (j, p) in enumerate(zip(jobs_, paths), 1)]
    assert got == sorted(want)
    results = pairs.select("job_id", F.lit("completed").alias("status"), F.lit(2).alias("total_line_items")).where("job_id <> 'j5'")
    total = {r["g"]: r for r in J.bulk_summary(pairs, rows, results, "g").collect()}
    assert total["big"]["total_files"] == 2940 and total["big"]["successful_files"] == sum(w[0] == "big" for w in want) - 1
    assert total["big"]["failed_files"] == 2940 - total["big"]["successful_files"]
    assert total["small"]["total_line_items"] == 2 * sum(w[0] == "small" for w in want)


def test_items_of_a_huge_document_are_numbered(spark):
    items = spark.range(5000).select(F.lit("d").alias("doc"), (F.col("id") * 3).cast("int").alias("line_no"), F.lit("x").alias("v"))
    made = E.number_items(items.repartition(3), ["doc"])
    assert made.columns == ["doc", "line_no", "v", "item_no"] and dict(made.dtypes)["item_no"] == "int"
    assert made.where("item_no <> line_no / 3 + 1").count() == 0 and made.count() == 5000
