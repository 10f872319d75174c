"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z only; other letters stay."""
    return F.translate(col, UPPER, LOWER)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's ``spark.checkpoint.dir``.  On a local
    master without the setting (tests) a temporary folder is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        from ..session import shared_dir
        return shared_dir(spark, name)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps start
    from files that every executor can read, and a lost executor never
    recomputes what stands before."""
    spark = df.sparkSession
    path = shared_path(spark, name) + "/t"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``LEDGERLINE_TOKENIZERS`` names
    another folder."""
    folder = os.environ.get("LEDGERLINE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def set_aside(df: DataFrame, helpers) -> tuple[DataFrame, dict[str, str], dict[str, str]]:
    """``df`` with its columns that are called like one of an operator's
    ``helpers`` under neutral names, and the names there and back
    (``withColumnsRenamed(back)`` restores them).  Names are compared as Spark
    does, without case."""
    helpers, taken = {h.lower() for h in helpers}, {c.lower() for c in df.columns}
    there: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in helpers:
            k = len(there)
            while f"aside_{k}" in taken:
                k += 1
            taken.add(f"aside_{k}")
            there[c] = f"aside_{k}"
    return df.withColumnsRenamed(there) if there else df, there, {new: old for old, new in there.items()}


def give_back() -> None:
    """Hand the memory that this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def rows_of(batches):
    """Rows of Arrow batches as dicts, one at a time, for rows that are large;
    what each has left is given back before the next."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]
            give_back()


class WordCache(dict):
    """word -> ``compute(word)``, with a bound on what it holds: a full cache
    becomes the old generation, from which words that come again move over.
    Words longer than ``longest`` are never kept."""

    #: All caches of this worker.
    alive: weakref.WeakSet = weakref.WeakSet()

    def __init__(self, compute, size: int = 200_000, longest: int = 64):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}
        self.alive.add(self)

    __hash__ = object.__hash__

    @classmethod
    def empty_others(cls, module: str) -> None:
        """Empty what other modules' operators have left in this worker, and
        hand the memory back to the system."""
        others = [c for c in cls.alive if c.compute.__module__ != module and (c or c.old)]
        for cache in others:
            cache.old = {}
            cache.clear()
        if others:
            gc.collect()
            give_back()

    def __missing__(self, word):
        if len(word) > self.longest:
            return self.compute(word)
        value = self.old.get(word)
        if value is None:
            value = self.compute(word)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[word] = value
        return value


def bound_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Arrow batches bounded in rows and bytes, where the session leaves the
    default."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded in rows and bytes, so that long
    texts don't pile up in one batch; a worker that served another operator
    gives back its caches first."""
    bound_batches(df.sparkSession)

    def run(batches):
        WordCache.empty_others(function.__module__)
        yield from function(batches)

    return df.mapInArrow(run, schema)


#: Numbers, or bytes, that ``pack`` and ``unpack`` take at once: their helper arrays are several times as large.
AT_ONCE = 1 << 18


def pack(numbers: np.ndarray) -> bytes:
    """Small numbers in fewer bytes: 7 bits a byte, low part first."""
    return b"".join(_pack(numbers[at:at + AT_ONCE]) for at in range(0, len(numbers), AT_ONCE))


def _pack(numbers: np.ndarray) -> bytes:
    x = numbers.astype(np.uint64)
    longest = max(1, -(-int(x.max()).bit_length() // 7))
    size = np.ones(len(x), np.int64)
    for k in range(1, longest):
        size += x >= np.uint64(1 << 7 * k)
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(longest):
        more = size > k
        out[at[more] + k] = ((x[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | ((size[more] > k + 1) << 7).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(int(np.count_nonzero(raw < 128)), np.int64)
    at = made = 0
    while at < len(raw):
        part = raw[at:at + AT_ONCE]
        part = part[:int(np.flatnonzero(part < 128)[-1]) + 1]   # whole numbers
        first = np.flatnonzero(np.concatenate([[True], part[:-1] < 128]))
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
        out[made:made + len(first)] = np.add.reduceat((part & 127).astype(np.int64) << (7 * place), first)
        at, made = at + len(part), made + len(first)
    return out
