"""Row numbers and running sums by two-level ranks: no task holds a group.

``Window.partitionBy(group)`` numbers a group inside one task, and a window
without a group numbers the whole table in one.  Here rows are dealt by ranges
of (group, order), so a large group is spread over as many tasks as it fills;
each range numbers what it holds, and the totals of the ranges before it are
added.  Only these totals, one row per group and range, are summed up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize

#: Name of the range column that ``running`` can keep; an input must not have it.
RANGE = "_range"


def _match(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    out = None
    for x, y in pairs:
        same = a[x].eqNullSafe(b[y])
        out = same if out is None else out & same
    return out


def running(df: DataFrame, groups: list[str], order: list[Column], number: str | None = None,
            sums: dict[str, str] | None = None, keep_range: bool = False, partitions: int | None = None,
            name: str = "running") -> DataFrame:
    """``df`` plus ``number``, the row's number (bigint, from 0) by ``order``
    within its ``groups`` (of the whole table, if none are named), and for
    each ``{out: column}`` of ``sums`` the sum of that column over the rows
    before it (0 for the first; nulls count as 0).

    ``order`` must decide between any two rows of a group whose place matters;
    rows equal in it are numbered in any order, but each number is given once.
    A null group is a group.  ``df`` should be narrow: it is dealt by ranges
    and written once, so that the numbers don't depend on which task is
    retried."""
    sums = sums or {}
    if RANGE in (c.lower() for c in df.columns):
        raise ValueError(f"input has the column {RANGE}")
    keys = [F.col(f"`{g}`") for g in groups]
    by = [*keys, *order]
    dealt = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    dealt = materialize(dealt.withColumn(RANGE, F.spark_partition_id()), name)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order)
    sofar = inside.rowsBetween(Window.unboundedPreceding, -1)
    value = lambda c: F.coalesce(F.col(f"`{c}`").cast("bigint"), F.lit(0))
    own = [(F.row_number().over(inside).cast("bigint") - 1).alias("_own_0"),
           *[F.coalesce(F.sum(value(c)).over(sofar), F.lit(0)).alias(f"_own_{k}") for k, c in enumerate(sums.values(), 1)]]
    placed = dealt.select("*", *own)
    outs = ([number] if number else []) + list(sums)
    totals = dealt.groupBy(*keys, RANGE).agg(F.count("*").alias("_t_0"),
                                             *[F.sum(value(c)).alias(f"_t_{k}") for k, c in enumerate(sums.values(), 1)])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[k.alias(f"_g_{i}") for i, k in enumerate(keys)], F.col(RANGE).alias("_r"), *[
        F.sum(f"_t_{k}").over(earlier).alias(f"_before_{k}") for k in range(len(sums) + 1)]).where("_before_0 > 0")
    made = placed.join(before, _match(placed, before, [(RANGE, "_r"), *[(g, f"_g_{i}") for i, g in enumerate(groups)]]), "left")
    first = 0 if number else 1
    return made.select(*[placed[c] for c in df.columns], *([placed[RANGE]] if keep_range else []), *[
        (F.col(f"_own_{k}") + F.coalesce(F.col(f"_before_{k}"), F.lit(0))).alias(out) for k, out in enumerate(outs, first)])


def positions(df: DataFrame, groups: list[str], order: list[Column], out: str, partitions: int | None = None,
              name: str = "positions") -> DataFrame:
    """``df`` plus the row's number ``out``; see ``running``."""
    return running(df, groups, order, number=out, partitions=partitions, name=name)


def attach(placed: DataFrame, groups: list[str], values: DataFrame) -> DataFrame:
    """``placed`` (made with ``keep_range``) plus the columns of ``values``,
    which has one row per group at most; no match: nulls.  Joined on (group,
    range), of which a large group has many, so none of its rows meet in one
    task."""
    extra = [c for c in values.columns if c not in groups]
    ranges = placed.select(*groups, RANGE).distinct()
    known = ranges.join(values, _match(ranges, values, [(g, g) for g in groups]), "left").select(
        *[ranges[g].alias(f"_g_{i}") for i, g in enumerate(groups)], ranges[RANGE].alias("_r"), *[values[c] for c in extra])
    made = placed.join(known, _match(placed, known, [(RANGE, "_r"), *[(g, f"_g_{i}") for i, g in enumerate(groups)]]), "left")
    return made.select(*[placed[c] for c in placed.columns], *[known[c] for c in extra])
