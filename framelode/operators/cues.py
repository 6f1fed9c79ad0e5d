"""Cues as intervals: which are active at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BACK_SCAN = 8


def valid(cues: DataFrame) -> DataFrame:
    """Cues with text and a finite, positive span."""
    finite = lambda c: ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return cues.filter((F.length("text") > 0) & finite("start") & finite("end") & (F.col("end") > F.col("start")))


def active(points: DataFrame, cues: DataFrame, width: float) -> DataFrame:
    """All pairs of a point `at` and a cue with start <= at < end.

    Time falls into buckets of `width` seconds; a cue is put into each bucket that it touches, so the join is an equality of buckets.
    """
    own = cues.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    return points.withColumn("bucket", F.floor(F.col("at") / width)).join(own, "bucket").filter("start <= at and at < end").drop("bucket")


def back_scan(points: DataFrame, cues: DataFrame, limit: int = BACK_SCAN) -> DataFrame:
    """(at, seq) of the cues shown at each point by the bounded scan: of the `limit` cues that started last, from the latest back,
    expired ones are passed until one is active, then all up to the next expired one are taken.

    Each cue is given the numbers of the `limit` starts that end with its own; a point meets those of its last start alone.
    """
    rank = W.orderBy("start", "end", "seq")
    # positions over all cues of a file: one sorted file's cues fit a task
    own = cues.withColumn("n", F.row_number().over(rank))
    last = points.join(own.groupBy("start").agg(F.max("n").alias("n")).withColumn("next", F.lead("start").over(W.orderBy("start"))), (F.col("at") >= F.col("start")) & (F.col("next").isNull() | (F.col("at") < F.col("next")))).select("at", F.explode(F.sequence(F.greatest(F.col("n") - limit + 1, F.lit(1)), F.col("n"))).alias("n"))
    seen = last.join(own.select("n", "seq", "end"), "n").withColumn("on", F.col("end") > F.col("at"))
    back = W.partitionBy("at").orderBy(F.desc("n"))
    hit = seen.withColumn("hits", F.sum(F.col("on").cast("int")).over(back)).withColumn("stops", F.sum(((~F.col("on")) & (F.col("hits") > 0)).cast("int")).over(back))
    return hit.filter("on and stops = 0").select("at", "seq")
