"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_PARTS of the rows; so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 64
#: Tables below this many rows per part aren't worth a spread.
LEAST_ROWS = 20_000


def hot_keys(rows: DataFrame, key: str, parts: int = HOT_PARTS, least: int = LEAST_ROWS) -> list:
    """The keys that hold more than ``1/parts`` of ``rows``: fewer than ``parts`` values, whatever the table's size.

    Counted with map-side combination; null keys are left out, as they join nothing.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    return [r[0] for r in counts.where(F.col("n") > max(total // parts, least)).select(key).collect()]


def spread_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", parts: int = HOT_PARTS, least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` joined with ``lookup`` (at most a few rows per ``key``), hot keys spread over ``parts`` tasks.

    Rows of a hot key get a salt from the hash of all their columns; only the lookup rows of hot keys are
    repeated once per salt. Without hot keys it is the plain join. ``how`` may be ``inner`` or ``left``.
    """
    hot = hot_keys(rows, key, parts, least)
    if not hot:
        return rows.join(lookup, key, how)
    is_hot = F.col(key).isin(hot)
    salted = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(parts)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(lookup.withColumn("_salt", F.explode(copies)), [key, "_salt"], how).drop("_salt")
