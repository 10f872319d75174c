"""File readiness, processed-state anti-joins, positional pairing, unit dictionaries."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import jobs as J
from ledgerline.operators import units as U
from ledgerline.streaming import ingest as S


def test_stable_files(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("/a.pdf", t0, 0, 1), ("/a.pdf", t0 + dt.timedelta(seconds=1), 5, 2),
            ("/a.pdf", t0 + dt.timedelta(seconds=2), 5, 3),                     # ready at +2 s
            ("/b.pdf", t0, 7, 4), ("/b.pdf", t0 + dt.timedelta(seconds=40), 7, 5),  # too late
            ("/c.pdf", t0, 0, 6), ("/c.pdf", t0 + dt.timedelta(seconds=1), 0, 7)]   # empty file
    df = spark.createDataFrame(rows, "path string, observed_at timestamp_ntz, size bigint, event_id int")
    got = {r.path: (r.status, r.ready_size) for r in S.stable_files(df, timeout_s=30).collect()}
    assert got == {"/a.pdf": ("ready", 5), "/b.pdf": ("timeout", None), "/c.pdf": ("timeout", None)}


def test_unprocessed_by_path_or_hash(spark):
    files = spark.createDataFrame([("/1.pdf", "h1"), ("/2.pdf", "h2"), ("/3.pdf", "h3"), ("/4.pdf", "h1")],
                                  "file_path string, file_hash string")
    state = spark.createDataFrame([("/2.pdf", "hx", True), ("/9.pdf", "h1", True), ("/3.pdf", "h3", False)],
                                  "file_path string, file_hash string, processed boolean")
    assert sorted(r.file_path for r in S.unprocessed_files(files, state).collect()) == ["/3.pdf"]


def test_zip_truncates(spark):
    ids = spark.createDataFrame([("g", "job_2"), ("g", "job_1")], "grp string, job_id string")
    paths = spark.createDataFrame([("g", "/c"), ("g", "/a"), ("g", "/b")], "grp string, file_path string")
    got = [(r.job_id, r.file_path) for r in J.zip_jobs_paths(ids, paths, "grp").orderBy("pos").collect()]
    assert got == [("job_1", "/a"), ("job_2", "/b")]


def test_unit_dictionaries_broadcast(spark):
    df = spark.createDataFrame([(" litre ",), ("doz",), ("",), ("foo",), ("pr",)], "t string")
    out = U.join_uom_multiplier(U.join_uom_alias(df, "t"), "uom_code")
    assert [(r.uom_code, r.multiplier) for r in out.orderBy(F.col("t")).collect()] == \
        [("UNK", 1), ("L", 1), ("DZ", 12), ("UNK", 1), ("PR", 2)]   # "", " litre ", doz, foo, pr
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan
