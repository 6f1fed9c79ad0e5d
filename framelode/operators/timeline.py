"""Timelines of tracks: running sums, run lengths, as-of matches, probes, seeks. All are DataFrame plans partitioned by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exclusive_sum(value: Column, keys: list[str], order: list) -> Column:
    """The sum of all earlier rows of a track; 0 at its first. Overflow of longs raises."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def expand_runs(df: DataFrame, count: str, keep: list[str]) -> DataFrame:
    """Run-length decoding: each row `count` times, with its place `pos` in the run. Runs of 0 or fewer give nothing."""
    return df.filter(F.col(count) > 0).select(*keep, F.explode(F.sequence(F.lit(0), F.col(count).cast("int") - 1)).alias("pos"))


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, value: str, forward: bool = False) -> DataFrame:
    """left with the value of the last right row at or before left_on (the first at or after it if forward), null without one.

    Both sides go through one sort per key: of equal times the right row counts. Of right rows at one time the largest value does.
    """
    a = left.select("*", F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    names = [c for c in left.columns if c not in keys]
    nulls = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names]
    b = right.select(*keys, *nulls, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    time = F.desc("_at") if forward else F.asc("_at")
    order = W.partitionBy(*keys).orderBy(time, "_side", "_value").rowsBetween(W.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(order)).filter("_side = 1").select(*left.columns, F.col("_value").alias(value))


def reach(dim: DataFrame, keys: list[str], on: str) -> DataFrame:
    """Each row of an ordered dimension with the start of the next one, as [on, next_on)."""
    return dim.withColumn(f"next_{on}", F.lead(on).over(W.partitionBy(*keys).orderBy(on)))


def repeats(value: str, keys: list[str], order: list) -> tuple[Column, Column]:
    """Whether a row equals the one before; whether it equals the one before that but not the one between."""
    w = W.partitionBy(*keys).orderBy(*order)
    one, two = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    return F.coalesce(F.col(value) == one, F.lit(False)), F.coalesce((F.col(value) == two) & (F.col(value) != one), F.lit(False))


def summary(df: DataFrame, keys: list[str], order: list, pts: str) -> DataFrame:
    """Samples, repeated and backwards timestamps, least and largest."""
    back = F.col(pts) < F.lag(pts).over(W.partitionBy(*keys).orderBy(*order))
    return (
        df.select(*keys, pts, F.coalesce(back, F.lit(False)).alias("back"))
        .groupBy(*keys)
        .agg(F.count("*").alias("samples"), (F.count(pts) - F.count_distinct(pts)).alias("duplicate_pts"), F.count_if("back").alias("backwards_pts"), F.min(pts).alias("min_pts"), F.max(pts).alias("max_pts"))
    )


def gaps(df: DataFrame, keys: list[str], order: list, pts: str, end: str) -> DataFrame:
    """df with gap: pts less the end of the row before; null at a track's first row. Negative gaps are overlaps."""
    return df.withColumn("gap", F.col(pts) - F.lag(end).over(W.partitionBy(*keys).orderBy(*order)))


def top(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def from_first(df: DataFrame, keys: list[str], time: str, starts: Column) -> DataFrame:
    """Rows from the first start of their key on; keys without a start go."""
    first = F.min(F.when(starts, F.col(time))).over(W.partitionBy(*keys))
    return df.withColumn("_first", first).filter(F.col(time) >= F.col("_first")).drop("_first")


def islands(start: Column, keys: list[str], order: list) -> Column:
    """Numbers groups that each begin where start is true; 0 before the first."""
    return F.sum(start.cast("int")).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))


def unwrap(ticks: Column, origin: Column, bits: int = 33) -> Column:
    """Ticks of a counter of so many bits, counted from an origin, over one wrap at most."""
    return F.pmod(ticks - origin, F.lit(1 << bits))


def fill_missing(df: DataFrame, keys: list[str], order: list, pts: str, duration: str) -> DataFrame:
    """Missing timestamps: the last known one and the durations since; 0 and the durations since before the first."""
    known = F.col(pts).isNotNull()
    own = df.withColumn("_g", islands(known, keys, order))
    start = F.coalesce(F.max(pts).over(W.partitionBy(*keys, "_g")), F.lit(0))
    return own.withColumn(pts, start + exclusive_sum(F.col(duration), [*keys, "_g"], order)).drop("_g")


def midpoints(pts: str, duration: str, keys: list[str], order: list) -> Column:
    """Times half way from the row before; half a duration early at the first."""
    return F.coalesce((F.lag(pts).over(W.partitionBy(*keys).orderBy(*order)) + F.col(pts)) / 2, F.col(pts) - F.col(duration) / 2)
