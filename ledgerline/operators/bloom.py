"""Anti-joins behind a Bloom filter (O-19): rows whose keys cannot match pass
without meeting the other side.

``key_filter`` builds a Bloom filter by an aggregation over its words; its
size grows with the keys (``BITS_PER_KEY``) up to ``MAX_BITS``.  The driver and
each worker hold the bits once, 32 MB at most.  Beyond that size more rows are
possible matches and take the join, with the same result.

``anti_join`` builds it of the history: rows are marked and written once, and
those that cannot be hits are passed on without an exchange.
``possible_matches`` builds it of a few new rows and picks what they can match
out of a long history, which is scanned and never shuffled.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize

BITS_PER_KEY, PROBES = 16, 6
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28


def _hashes(kind: int, keys: list[str]) -> list[Column]:
    """Two hashes of a key of the kind; the filter's bits derive from them."""
    return [F.xxhash64(F.lit(kind), *[F.col(k) for k in keys], F.lit(j)).alias(f"_h{j}") for j in (1, 2)]


def _places(h1: pa.Array, h2: pa.Array, bits: int) -> np.ndarray:
    """The bits of each key, one row of ``PROBES`` each."""
    a, b = (np.asarray(h.to_numpy(zero_copy_only=False), np.int64).view(np.uint64) for h in (h1, h2))
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * (b | np.uint64(1))[:, None]) & np.uint64(bits - 1)).astype(np.int64)


class KeyFilter:
    """Bits of the keys; ``may_contain`` is exact for what it denies."""

    def __init__(self, bits: int, data: np.ndarray, keys: int):
        self.bits, self.data, self.keys = bits, data, keys

    def test(self, h1: pa.Array, h2: pa.Array) -> np.ndarray:
        at = _places(h1, h2, self.bits)
        return ((self.data[at >> 6] >> (at & 63)) & 1).all(axis=1)


def key_filter(sides: list[tuple[DataFrame, list[str]]], max_bits: int = MAX_BITS) -> KeyFilter:
    """One filter of the distinct keys of several tables; the i-th table's
    key columns are keys of kind i.  Rows with a null key are left out, as
    they equal nothing."""
    known = None
    for kind, (table, keys) in enumerate(sides):
        own = table.select(*keys).dropna().select(*_hashes(kind, keys))
        known = own if known is None else known.unionByName(own)
    known = materialize(known.distinct(), "filter-keys")
    n = known.count()
    bits = min(max(MIN_BITS, 1 << max(0, (n * BITS_PER_KEY - 1).bit_length())), max_bits)

    mask = F.lit(bits - 1).cast("bigint")
    at = F.explode(F.array(*[(F.col("_h1").bitwiseAND(mask) + F.lit(j) * F.col("_h2").bitwiseOR(F.lit(1).cast("bigint")).bitwiseAND(mask))
                             .bitwiseAND(mask) for j in range(PROBES)])).alias("at")
    words = known.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("flags")).toArrow()
    data = np.zeros(bits // 64, np.int64)
    data[words.column("word").to_numpy()] = words.column("flags").to_numpy()
    return KeyFilter(bits, data, n)


def mark(df: DataFrame, keys: list[list[str]], known: KeyFilter, out: str) -> DataFrame:
    """``df`` plus ``out``: whether one of the row's keys (the i-th being of
    kind i) may be among the known."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def may_contain(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.test(pa.array(h1), pa.array(h2)))

    any_ = F.lit(False)
    for kind, columns in enumerate(keys):
        complete = F.lit(True)
        for c in columns:
            complete = complete & F.col(c).isNotNull()
        any_ = any_ | (complete & may_contain(*_hashes(kind, columns)))
    return df.withColumn(out, any_)


def plain_anti_join(df: DataFrame, history: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of ``df`` that ``history`` holds by none of ``keys``."""
    out = df
    for k in keys:
        out = out.join(history.select(*k).dropna().distinct(), k, "left_anti")
    return out.select(*df.columns)


def anti_join(df: DataFrame, history: DataFrame, keys: list[list[str]], max_bits: int = MAX_BITS) -> DataFrame:
    """``plain_anti_join`` behind a filter of the history's keys, for as many
    rows as the history has or more: only possible hits are joined."""
    marked = materialize(mark(df, keys, key_filter([(history, k) for k in keys], max_bits), "_may"), "filtered")
    free = marked.where("NOT _may").select(*df.columns)
    return free.unionByName(plain_anti_join(marked.where("_may").select(*df.columns), history, keys))


def possible_matches(history: DataFrame, df: DataFrame, keys: list[list[str]], max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``history`` that may match a row of ``df`` by one of ``keys``,
    through a filter of the keys of ``df``, for a long history and few rows:
    the history is scanned and not shuffled."""
    return mark(history, keys, key_filter([(df, k) for k in keys], max_bits), "_may").where("_may").drop("_may")
