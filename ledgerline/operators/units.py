"""Unit dictionaries as tables (O-16, O-17).

The alias (27 rows) and multiplier (12 rows) dimensions are fixed-size,
so broadcasting them is safe at any data size; a token join is then a
map-side hash join with no shuffle of the token table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions.items import strip


def uom_alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(X.UOM_ALIASES.items()), "alias string, code string")


def uom_multiplier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(X.UOM_MULTIPLIERS.items()), "code string, multiplier int")


def join_uom_alias(df: DataFrame, token: str, out: str = "uom_code") -> DataFrame:
    """Token (trimmed, upper-cased) -> unit code; blank or unknown -> UNK."""
    dim = F.broadcast(uom_alias_table(df.sparkSession))
    keyed = df.withColumn("_alias", F.upper(strip(F.col(token))))
    j = keyed.join(dim.withColumnRenamed("alias", "_alias").withColumnRenamed("code", "_code"), "_alias", "left")
    return j.withColumn(out, F.coalesce("_code", F.lit("UNK"))).drop("_alias", "_code")


def join_uom_multiplier(df: DataFrame, code: str, out: str = "multiplier") -> DataFrame:
    """Unit code -> units per pack; anything else (UNK included) 1."""
    dim = F.broadcast(uom_multiplier_table(df.sparkSession)).withColumnRenamed("code", "_c") \
        .withColumnRenamed("multiplier", "_m")
    j = df.join(dim, df[code] == dim["_c"], "left")
    return j.withColumn(out, F.coalesce("_m", F.lit(1))).drop("_c", "_m")
