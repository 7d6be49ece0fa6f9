"""Interval merge, removal of rows in intervals, window selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Intervals are cut at multiples of this to become equi-join keys.
CELL_MS = 60_000


def merge_intervals(df: DataFrame) -> DataFrame:
    """session_id, start_ms, end_ms: overlapping or touching intervals as one."""
    before = Window.partitionBy("session_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("session_id").orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = F.coalesce((F.col("start_ms") > F.max("end_ms").over(before)).cast("int"), F.lit(1))
    return df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order)).groupBy("session_id", "__island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("__island")


def drop_intervals(rows: DataFrame, intervals: DataFrame, cell_ms: int = CELL_MS) -> DataFrame:
    """Rows whose t_ms is in no interval (ends included). Intervals are cut into cells, so the join is on keys."""
    cells = intervals.select("session_id", F.col("start_ms").alias("__a"), F.col("end_ms").alias("__b"), F.explode(F.sequence(F.floor(F.col("start_ms") / cell_ms), F.floor(F.col("end_ms") / cell_ms))).alias("__cell"))
    keyed = rows.withColumn("__cell", F.floor(F.col("t_ms") / cell_ms))
    inside = (keyed["session_id"] == cells["session_id"]) & (keyed["__cell"] == cells["__cell"]) & (F.col("t_ms") >= F.col("__a")) & (F.col("t_ms") <= F.col("__b"))
    return keyed.join(cells, inside, "left_anti").drop("__cell")


def select_windows(windows: DataFrame, threshold: float = 0.8, codes: tuple[str, ...] = ()) -> DataFrame:
    """Windows to drop: below the threshold, or with one of the codes."""
    hit = F.col("trust_score") < threshold
    if codes:
        hit = hit | F.arrays_overlap("reason_codes", F.array(*map(F.lit, codes)))
    return windows.where(hit)


def reason_counts(windows: DataFrame) -> DataFrame:
    """code, n: how often each code occurs."""
    return windows.select(F.explode("reason_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
