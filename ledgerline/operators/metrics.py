"""Operator output metrics.

``observed`` attaches ``Dataset.observe`` metrics (row counts and the
like, readable from a query listener or an ``Observation``) to an
operator's output.  The ``CollectMetrics`` node also fixes the operator's
output as a plan boundary: a later filter on a computed column (say
``escalation_flag``) is evaluated on the computed value instead of being
pushed below the projections, where Catalyst would re-expand the whole
expression tree into the filter."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEQ = itertools.count()


def observed(df: DataFrame, name: str, *metrics: Column) -> DataFrame:
    exprs = metrics or (F.count(F.lit(1)).alias("rows"),)
    return df.observe(f"{name}_{next(_SEQ)}", *exprs)
