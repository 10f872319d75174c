"""Anti-join behind a Bloom filter."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import bloom as B
from ledgerline.streaming import ingest as S


@pytest.mark.parametrize("max_bits", [B.MAX_BITS, 1 << 8])
def test_same_rows_as_two_anti_joins(spark, max_bits):
    rnd = random.Random(1)
    path, digest = lambda: rnd.choice([None, f"/p{rnd.randrange(400)}"]), lambda: rnd.choice([None, *(f"h{rnd.randrange(300)}" for _ in range(3))])
    files = [(k, path(), digest()) for k in range(900)]
    done = [(path(), digest(), rnd.random() < 0.8) for _ in range(150)]
    f = spark.createDataFrame(files, "id int, file_path string, file_hash string")
    s = spark.createDataFrame(done, "file_path string, file_hash string, processed boolean")
    paths, hashes = {d[0] for d in done if d[2]} - {None}, {d[1] for d in done if d[2]} - {None}
    want = sorted(x[0] for x in files if x[1] not in paths and x[2] not in hashes)
    got = B.anti_join(f, s.where("processed"), S.FILE_KEYS, max_bits)
    matches = B.possible_matches(s.where("processed"), f, S.FILE_KEYS, max_bits)
    assert sorted(r["id"] for r in B.plain_anti_join(f, matches, S.FILE_KEYS).collect()) == want
    assert got.columns == f.columns and sorted(r["id"] for r in got.collect()) == want
    assert sorted(r["id"] for r in S.unprocessed_files(f, s).collect()) == want
    assert sorted(r["id"] for r in S.unprocessed_files(f, s.where("false")).collect()) == [x[0] for x in files]


def test_filter_grows_and_denies_no_member(spark):
    few = B.key_filter([(spark.range(10).select(F.col("id").cast("string").alias("k")), ["k"])])
    table = spark.range(60_000).select(F.col("id").cast("string").alias("k"))
    many = B.key_filter([(table, ["k"])])
    assert few.bits == B.MIN_BITS and many.bits >= 60_000 * B.BITS_PER_KEY and many.keys == 60_000
    marked = B.mark(spark.range(120_000).select(F.col("id").cast("string").alias("k"), "id"), [["k"]], many, "m")
    assert marked.where("id < 60000 AND NOT m").count() == 0
    assert marked.where("id >= 60000 AND m").count() < 600


def test_misses_pass_no_exchange(spark):
    """In the plan the rows that cannot be hits are a scan and a filter."""
    f = spark.range(1000).select(F.concat(F.lit("/"), F.col("id")).alias("file_path"), F.col("id").cast("string").alias("file_hash"))
    s = f.limit(20).withColumn("processed", F.lit(True))
    out = S.unprocessed_files(f, s)
    assert out.count() == 980
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    start = next(x.index(":- ") for x in lines if x.lstrip().startswith(":- "))
    free = [x for x in lines if x[start:start + 1] == ":"]
    assert any("FileScan" in x for x in free) and not any("Exchange" in x or "Join" in x for x in free)


def test_a_long_history_is_not_shuffled(spark):
    history = spark.range(20_000).select(F.concat(F.lit("/"), F.col("id")).alias("file_path"), F.col("id").cast("string").alias("file_hash"))
    batch = spark.createDataFrame([("/7", "x"), ("/a", "9"), ("/b", "y")], "file_path string, file_hash string")
    found = B.possible_matches(history, batch, S.FILE_KEYS)
    assert 2 <= found.count() < 20 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
