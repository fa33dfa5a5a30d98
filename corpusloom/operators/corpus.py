"""Corpus engineering: splits by hash, leakage audits, capped and round-robin selection, idempotent upserts, evidence mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_bucket(key: Column, buckets: int) -> Column:
    """A stable bucket of a string: the first 16 hexadecimal digits of the SHA-256 of its JSON form, modulo ``buckets``.

    The JSON form is the string in quotes, with escapes. A null has none and no bucket.
    """
    quoted = F.regexp_extract(F.to_json(F.array(key)), r"(?s)^\[(.*)\]$", 1)
    number = F.conv(F.substring(F.sha2(quoted, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(key.isNotNull(), (number % F.lit(buckets)).cast("int"))


def shared_across_splits(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """``key, splits``: values of ``key`` that stand in more than one split; null keys and splits count nowhere."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(split).isNotNull()).select(key, split).distinct()
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


def capped(rows: DataFrame, group: str, order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each ``group``; a window with a rank filter, which Spark limits before the shuffle."""
    place = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap)


def round_robin(rows: DataFrame, bucket: str, order: list[Column], size: int) -> DataFrame:
    """``size`` rows taken in turn from the buckets: first all buckets' first rows, then all second ones.

    Only rows that can be among them are ranked: no bucket gives more than ``size``.
    """
    turns = capped(rows, bucket, order, size).withColumnRenamed("place", "turn")
    return turns.orderBy("turn", bucket).limit(size)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new`` put in place: per ``key`` the row with the largest ``order``, new before old if equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    others = [c for c in old.columns if c not in (key, order)]
    best = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, "_new", *others)).alias("r"))
    return best.select(*[F.col(key) if c == key else F.col("r")[c].alias(c) for c in old.columns])


def interval_overlaps(a: DataFrame, b: DataFrame, key: str, width: int, keep_key: bool = False) -> DataFrame:
    """Pairs ``a_id, b_id``, with ``key`` if it is kept, whose integer intervals (``start``, ``end``, inclusive) under one ``key`` overlap.

    Each interval enters the bins of ``width`` that it touches, so the join is an equi-join on key and bin; a pair
    is kept in the bin where its overlap starts only. Intervals with a null end or a start after it match nothing.
    """

    def binned(df: DataFrame, name: str) -> DataFrame:
        sound = df.where("start is not null and `end` is not null and start <= `end`")
        bins = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width)))
        return sound.select(F.col("id").alias(f"{name}_id"), key, F.col("start").alias(f"{name}_start"), F.col("end").alias(f"{name}_end"), bins.alias("bin"))

    joined = binned(a, "a").join(binned(b, "b"), [key, "bin"])
    first = F.floor(F.greatest("a_start", "b_start") / width)
    return joined.where((F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end")) & (F.col("bin") == first)).select(*[key] * keep_key, "a_id", "b_id")


def asof_backward(rows: DataFrame, marks: DataFrame, key: str, at: str, value: str, default: str) -> DataFrame:
    """``rows`` with ``value`` of the last mark at or before ``at`` under the same ``key``, or ``default``.

    Marks and rows are sorted together once; the last mark is carried forward.
    """
    columns = rows.columns
    both = rows.withColumn(value, F.lit(None).cast("string")).withColumn("_row", F.lit(1)).unionByName(
        marks.select(key, at, value).withColumn("_row", F.lit(0)), allowMissingColumns=True
    )
    order = Window.partitionBy(key).orderBy(at, "_row").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_mark", F.last(value, ignorenulls=True).over(order)).where("_row = 1")
    return carried.select(*columns, F.coalesce("_mark", F.lit(default)).alias(value))
