"""Keyed stream state with event-time timers (O-33, O-62).

``dedupe_keyed`` keeps one small value per key, in buckets, and forgets it by a timer;
``stable_files_stream`` decides for each path when its file is complete.  Both
read no table of earlier batches: what a key needs to know is in the state
store, next to the task that handles the key.

State lives in the RocksDB state store (``use_keyed_state`` names it for the
session), so it is bounded by disk, checkpointed with the query and restored
when an executor is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from ..functions import fixed as X

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Keys that a task remembers while it thins out a batch; later ones pass unthinned.
PARTIAL_KEYS = 500_000


def use_keyed_state(spark: SparkSession) -> None:
    """Timers and list state need the RocksDB store."""
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)


def _ms(stamp) -> int:
    """Epoch milliseconds of a timestamp value, rounded down."""
    return _us(stamp) // 1000


def _us(stamp) -> int:
    whole = int(stamp.replace(microsecond=0).timestamp())
    return whole * 1_000_000 + stamp.microsecond


# ---------------------------------------------------------------- seen keys (O-62)

def first_per_task(df: DataFrame, keys: list[str]) -> DataFrame:
    """Thins a stream out before its shuffle: of the rows of a key, each task
    passes the first one on.  A key that half of all rows share reaches the
    state as one row a task.  No state is kept beyond the task."""
    schema, limit = df.schema, PARTIAL_KEYS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            at = pa.table([*(batch.column(k) for k in keys), pa.array(range(batch.num_rows), pa.int64())], names=[*keys, "_row"])
            firsts = at.group_by(keys, use_threads=False).aggregate([("_row", "min")])
            rows = []
            for key, row in zip(zip(*(firsts.column(k).to_pylist() for k in keys)), firsts.column("_row_min").to_pylist()):
                if key not in seen:
                    rows.append(row)
                    if len(seen) < limit:
                        seen.add(key)
            yield batch.take(pa.array(sorted(rows), pa.int64()))

    return df.mapInArrow(run, schema)


#: Groups that keys are dealt to by their hash, and segments of a group's list beyond which they become one.
BUCKETS, SEGMENTS = 4096, 16
_NAN = float("nan")


def _plain(value):
    """A key's value as it is compared and stored: not-a-number is one object."""
    if isinstance(value, float):
        return value if value == value else _NAN
    if isinstance(value, (list, tuple, dict)):
        return repr(value)
    return bytes(value) if isinstance(value, bytearray) else value


def _segment(seen: dict[tuple, int]) -> tuple[int, bytes]:
    """(the last time, keys and their times as an Arrow file) of some keys."""
    made = pa.table([*(pa.array(list(v)) for v in zip(*seen)), pa.array(seen.values(), pa.int64())],
                    names=[str(k) for k in range(len(next(iter(seen))) + 1)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, made.schema) as out:
        out.write_table(made)
    return max(seen.values()), sink.getvalue().to_pybytes()


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key through, and the next one once ``ttl_ms``
    have passed on the clock since then.  It is called for a bucket of keys,
    whose times are a list of segments: what a batch adds is one segment, so
    the store is asked a few times a bucket and not for every key."""

    def __init__(self, keys: list[str], clock: str, ttl_ms: int, segments: int):
        self.keys, self.clock, self.ttl_ms, self.segments = keys, clock, ttl_ms, segments

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "until_ms bigint, keys binary")

    def handleInputRows(self, key, rows, timerValues):
        segments = list(self.seen.get())
        known: dict[tuple, int] = {}
        for _, data in segments:
            *values, until = (c.to_pylist() for c in pa.ipc.open_stream(bytes(data)).read_all().columns)
            for k, ms in zip(zip(*(map(_plain, v) for v in values)), until):
                known[k] = max(ms, known.get(k, ms))
        new: dict[tuple, int] = {}
        for row in sorted(rows, key=lambda r: r[self.clock]):
            k, at = tuple(_plain(row[c]) for c in self.keys), _ms(row[self.clock])
            until = new.get(k, known.get(k))
            if until is None or at >= until:
                new[k] = at + self.ttl_ms
                yield row
        if not new:
            return
        if len(segments) < self.segments:
            self.seen.appendList([_segment(new)])
        else:
            now = timerValues.getCurrentWatermarkInMs()
            self.seen.put([_segment({k: ms for k, ms in (known | new).items() if ms > now or k in new})])
        self.handle.registerTimer(max(new.values()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        segments = [tuple(s) for s in self.seen.get()]
        left = [s for s in segments if s[0] > expiredTimerInfo.getExpiryTimeInMs()]
        if not left:
            self.seen.clear()
        elif len(left) < len(segments):
            self.seen.put(left)
        return iter([])

    def close(self) -> None:
        pass


def dedupe_keyed(stream: DataFrame, keys: list[str], ttl_seconds: int, clock: Column | None = None) -> DataFrame:
    """Rows of ``stream`` whose ``keys`` were not let through within the last
    ``ttl_seconds`` (O-62).  One row per key and task of a batch enters the
    state; a key's state is one number, stored with those of its bucket
    (``BUCKETS`` of them, by the keys' hash) and removed by a timer.

    The clock is the time of ingestion, so no row can be late.  Another
    ``clock`` (a timestamp that never falls behind from batch to batch) gives
    a replay with the times of its rows; rows without a time are taken as of
    now, rows behind the clock of an earlier batch are late and dropped."""
    use_keyed_state(stream.sparkSession)
    for c in ("_clock", "_bucket"):
        if c in stream.columns:
            raise ValueError(f"input has the column {c}")
    now = F.current_timestamp()
    marked = stream.withColumn("_clock", now if clock is None else F.coalesce(clock, now))
    thin = first_per_task(marked, keys).withWatermark("_clock", "0 seconds")
    dealt = thin.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithState(
        statefulProcessor=FirstOfKey(keys, "_clock", ttl_seconds * 1000, SEGMENTS), outputStructType=StructType(dealt.schema.fields),
        outputMode="append", timeMode="EventTime").drop("_clock", "_bucket")


# ---------------------------------------------------------------- complete files (O-33)

class StableFile(StatefulProcessor):
    """Looks at the size observations of a path in the order of their times,
    each once the watermark has passed it.  Two equal sizes above 0 in a row,
    within the timeout from first sight: ready.  Timeout without that: timed
    out.  Afterwards the path is closed until its state is forgotten."""

    def __init__(self, timeout_ms: int, forget_ms: int | None):
        self.timeout_us, self.forget_ms = timeout_ms * 1000, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", "first_us bigint, size bigint, timer_ms bigint, closed boolean")
        self.open = handle.getListState("open", "us bigint, tie bigint, size bigint")

    def handleInputRows(self, key, rows, timerValues):
        if key[0] is None:
            return
        first, size, timer, closed = self.file.get() if self.file.exists() else (None, None, None, False)
        watermark_ms = timerValues.getCurrentWatermarkInMs()
        # what Spark calls late is a batch behind; here what stands before the watermark was decided without
        rows = [(_us(r["observed_at"]), r["tiebreak"], r["size"]) for r in rows]
        rows = [r for r in rows if r[0] >= watermark_ms * 1000]
        if not rows:
            return
        if closed:
            # rows come before the timers of their batch
            if timer is None or watermark_ms < timer:
                return
            self.handle.deleteTimer(timer)
            first, size, timer = None, None, None
        self.open.appendList(rows)
        yield from self._decide(key, first, size, timer, watermark_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if not self.file.exists():
            return
        first, size, timer, closed = self.file.get()
        if closed:
            self.file.clear()
            return
        yield from self._decide(key, first, size, None, timerValues.getCurrentWatermarkInMs())

    def _decide(self, key, first, size, timer, watermark_ms):
        """Takes the observations that nothing can precede any more."""
        waiting = sorted(self.open.get(), key=lambda o: (o[0], o[1]))
        done = None
        while waiting and waiting[0][0] < watermark_ms * 1000 and done is None:
            at, _, now = waiting.pop(0)
            if first is None:
                first = at
            elif at <= first + self.timeout_us and now == size and now:
                done = Row(path=key[0], first_us=first, ready_us=at, ready_size=now, status="ready")
            size = now
        if done is None and first is not None and watermark_ms * 1000 > first + self.timeout_us:
            done = Row(path=key[0], first_us=first, ready_us=None, ready_size=None, status="timeout")
        if done is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.open.clear()
            forget = None
            if self.forget_ms is not None:
                forget = max(watermark_ms, (first + self.timeout_us) // 1000) + self.forget_ms
                self.handle.registerTimer(forget)
            self.file.update((first, size, forget, True))
            yield done
            return
        if waiting:
            self.open.put([tuple(o) for o in waiting])
        else:
            self.open.clear()
        # the next observation's turn, or the end of the time
        ends = ([waiting[0][0]] if waiting else []) + ([first + self.timeout_us] if first is not None else [])
        turn = min(ends) // 1000 + 1
        if turn != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(turn)
        self.file.update((first, size, turn, False))

    def close(self) -> None:
        pass


def stable_files_stream(obs: DataFrame, timeout_s: int = X.FILE_READY_TIMEOUT_S, delay: str = "0 seconds",
                        forget_s: int | None = None, path: str = "path", ts: str = "observed_at", size: str = "size",
                        tiebreak: str = "event_id") -> DataFrame:
    """Streamed form of ``ingest.stable_files`` (O-33): one row per path,
    ``ready`` as soon as the watermark has passed the second of two equal
    sizes, ``timeout`` when it has passed the end of the time.

    ``delay`` is how far observations may be out of order; later ones are
    dropped.  Observations without a path advance the clock only, so a poller
    can send them as heartbeats.  A closed path keeps one small row of state,
    for ever or for ``forget_s`` after its time; then it may appear anew."""
    use_keyed_state(obs.sparkSession)
    rows = obs.select(F.col(path).alias("path"), F.col(ts).cast("timestamp").alias("observed_at"), F.col(size).cast("bigint").alias("size"),
                      F.col(tiebreak).cast("bigint").alias("tiebreak"))
    # no filter on the path here: it would be moved below the watermark, and heartbeats would not move the clock
    marked = rows.withWatermark("observed_at", delay)
    made = marked.groupBy("path").transformWithState(
        statefulProcessor=StableFile(timeout_s * 1000, None if forget_s is None else forget_s * 1000),
        outputStructType="path string, first_us bigint, ready_us bigint, ready_size bigint, status string",
        outputMode="append", timeMode="EventTime")
    return made.select("path", F.timestamp_micros("first_us").alias("first_seen"), F.timestamp_micros("ready_us").alias("ready_at"),
                       "ready_size", "status")
