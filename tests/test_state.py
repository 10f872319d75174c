"""Keyed stream state: expiry and timers under a clock that the test sets."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.session import shared_dir
from ledgerline.streaming import ingest as S
from ledgerline.streaming import state as ST

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)


class Replay:
    """Batches of rows as files that arrive one after the other."""

    def __init__(self, spark, schema):
        self.spark, self.schema, self.base, self.files = spark, schema, shared_dir(spark, "t-state"), 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.base}/in/f{self.files:03d}")
        self.files += 1

    def run(self, make):
        """Everything so far, one file a batch; then the rows of the sink."""
        stream = (self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
                  .parquet(self.base + "/in"))
        q = (make(stream).writeStream.format("parquet").option("checkpointLocation", self.base + "/ck")
             .trigger(availableNow=True).start(self.base + "/out"))
        q.awaitTermination()
        return self.spark.read.parquet(self.base + "/out").collect()


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_keys_expire_by_the_clock(spark):
    r = Replay(spark, "k string, v int, at timestamp")
    make = lambda s: ST.dedupe_keyed(s, ["k"], 60, clock=F.col("at"))
    r.add([("a", 1, at(0)), ("a", 2, at(0)), ("b", 3, at(1)), (None, 4, at(1))])
    r.add([("a", 5, at(59)), ("c", 6, at(59)), (None, 7, at(59))])
    got = r.run(make)
    assert sorted((x["k"] or "", x["v"]) for x in got) == [("", 4), ("a", 1), ("b", 3), ("c", 6)]
    r.add([("a", 8, at(60)), ("b", 9, at(60))])          # a's minute is over, b's not
    r.add([("x", 10, at(300))])                          # the clock moves on: timers remove a, b, c
    r.add([("a", 11, at(301)), ("b", 12, at(301)), ("x", 13, at(301))])
    got = r.run(make)                                    # from the checkpoint
    assert sorted(x["v"] for x in got) == [1, 3, 4, 6, 8, 10, 11, 12]
    assert sorted(x["v"] for x in r.run(make)) == [1, 3, 4, 6, 8, 10, 11, 12]   # nothing new: nothing doubled


def test_one_row_per_key_and_task_enters_the_state(spark):
    hot = spark.range(30_000, numPartitions=3).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    assert ST.first_per_task(hot, ["k"]).where("k = 'hot'").count() == 3
    made = ST.first_per_task(hot.withColumn("j", F.lit(None).cast("int")), ["k", "j"])
    assert made.count() <= 3 * 51 and made.select("k").distinct().count() == 51


def test_the_state_is_asked_by_bucket_and_not_by_key(spark, monkeypatch):
    """Keys that share a bucket are told apart, batch by batch, and their segments become one."""
    monkeypatch.setattr(ST, "BUCKETS", 3), monkeypatch.setattr(ST, "SEGMENTS", 2)
    r = Replay(spark, "k double, j string, v int, at timestamp")
    make = lambda s: ST.dedupe_keyed(s, ["k", "j"], 1000, clock=F.col("at"))
    nan, n = float("nan"), 0
    for b in range(5):
        rows = [(float(k), None if k % 2 else "x", n + k, at(b)) for k in range(b * 5, b * 5 + 10)]   # half of them known
        r.add(rows + [(nan, "x", -1 - b, at(b)), (None, None, -101 - b, at(b))])
        n += 100
    got = [x["v"] for x in r.run(make)]
    new = [b * 100 + k for b in range(5) for k in range(b * 5 + (5 if b else 0), b * 5 + 10)]
    assert sorted(got) == sorted([*new, -1, -101])
    keys = spark.read.format("statestore").option("stateVarName", "seen").load(r.base + "/ck")
    assert keys.select("key").distinct().count() <= 3


def plain_stable(obs, timeout=30):
    out = {}
    for p in {o[0] for o in obs}:
        own = sorted(((o[1], o[3], o[2]) for o in obs if o[0] == p))
        first, ready = own[0][0], None
        for (_, _, s), (t, _, n) in zip(own, own[1:]):
            if s == n and n and t <= first + dt.timedelta(seconds=timeout):
                ready = (t, n)
                break
        out[p] = (first, *(ready or (None, None)), "ready" if ready else "timeout")
    return out


def as_found(rows):
    zone = lambda t: t and t.astimezone(dt.timezone.utc)
    got = {r["path"]: (zone(r["first_seen"]), zone(r["ready_at"]), r["ready_size"], r["status"]) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_stable_files_equal_the_batch_form(spark, seed):
    """Out of order by up to 40 s, polls repeated, several files a second."""
    rnd = random.Random(seed)
    obs = []
    for p in range(25):
        t = rnd.uniform(0, 300)
        for _ in range(rnd.randint(1, 9)):
            obs.append((f"p{p}", at(round(t, rnd.choice([0, 3, 6]))), rnd.choice([0, 5, 5, 7, None]), len(obs)))
            t += rnd.choice([0, 0.5, 5, 12, 40])
    by_arrival = sorted(obs, key=lambda o: o[1] + dt.timedelta(seconds=rnd.uniform(0, 40)))
    r = Replay(spark, "path string, observed_at timestamp, size bigint, event_id bigint")
    for k in range(0, len(by_arrival), 20):
        r.add(by_arrival[k:k + 20])
    r.add([(None, at(10_000), 0, -1)])
    got = as_found(r.run(lambda s: ST.stable_files_stream(s, delay="40 seconds")))
    assert got == plain_stable(obs)
    batch = S.stable_files(spark.createDataFrame(obs, r.schema))
    assert got == as_found(batch.select("path", "first_seen", "ready_at", "ready_size", "status").collect())


def test_timeout_comes_without_a_further_event_of_the_path(spark):
    make = lambda s: ST.stable_files_stream(s, forget_s=100)
    r = Replay(spark, "path string, observed_at timestamp, size bigint, event_id bigint")
    r.add([("a", at(0), 3, 1), ("b", at(0), 3, 2)])
    r.add([("b", at(5), 3, 3)])
    r.add([(None, at(29), None, 4)])
    assert {p: x[3] for p, x in as_found(r.run(make)).items()} == {"b": "ready"}
    r.add([(None, at(31), None, 5)])
    r.add([("a", at(32), 3, 6), ("b", at(32), 3, 7)])     # both are closed: ignored
    assert {p: x[3] for p, x in as_found(r.run(make)).items()} == {"b": "ready", "a": "timeout"}
    r.add([(None, at(500), None, 8)])                     # forgotten
    r.add([("a", at(501), 4, 9), ("a", at(502), 4, 10), ("b", at(400), 9, 11)])   # b's poll is late: dropped
    r.add([(None, at(900), None, 12)])
    rows = r.run(make)
    assert sorted((x["path"], x["status"], x["ready_size"]) for x in rows) == [
        ("a", "ready", 4), ("a", "timeout", None), ("b", "ready", 3)]


def test_interrupted_work_stays_on_record(spark):
    """The batch function fails once after the files were discovered."""
    r = Replay(spark, "file_path string, file_hash string, modificationTime timestamp")
    r.add([("/a", "h1", at(0)), ("/b", "h2", at(1))])
    out, fail = r.base + "/tables", [True]

    def per_batch(batch, batch_id):
        S.write_batch(S.file_state_rows(batch, batch_id, processed=False), out, "discovered", batch_id)
        if fail.pop() if fail else False:
            raise RuntimeError("interrupted")
        return {"state": S.file_state_rows(batch, batch_id)}

    def run():
        stream = spark.readStream.schema(r.schema).option("recursiveFileLookup", "true").parquet(r.base + "/in")
        S.start_extraction(stream, out, r.base + "/ck2", per_batch).awaitTermination()

    with pytest.raises(Exception, match="interrupted"):
        run()
    discovered = spark.read.parquet(out + "/discovered")
    nothing = discovered.where("false")
    got = S.current_file_state(nothing, discovered).collect()
    assert {(x["file_path"], x["processed"], x["processed_at"]) for x in got} == {("/a", False, None), ("/b", False, None)}
    run()
    got = S.current_file_state(spark.read.parquet(out + "/state"), spark.read.parquet(out + "/discovered")).collect()
    assert {(x["file_path"], x["processed"], x["processed_at"] is None) for x in got} == {("/a", True, False), ("/b", True, False)}
