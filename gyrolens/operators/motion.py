"""Steps, dead reckoning and headings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.config import ReplayConfig
from gyrolens.functions.expressions import norm, wrap_angle
from gyrolens.operators.sampling import in_blocks, own_rows, running_sums, with_previous


def _centred(column: Column, rows: int, along) -> Column:
    return F.avg(column).over(along.rowsBetween(-(rows // 2), (rows - 1) // 2))


def rolling_means(df: DataFrame, means: dict[str, tuple[Column, int]]) -> DataFrame:
    """df with centred means of a column over some rows of its session; an even width leans back by one row."""
    widest = max(rows for _, rows in means.values())
    dealt, along = in_blocks(df, widest // 2, (widest - 1) // 2)
    return own_rows(dealt.withColumns({name: _centred(c, rows, along) for name, (c, rows) in means.items()}))


def step_candidates(imu: DataFrame, width: int, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """Strict local maxima of the acceleration over its rolling mean: session_id, row_idx, t_ms, dynamic."""
    acc = norm(F.col("ax"), F.col("ay"), F.col("az"))
    dealt, along = in_blocks(imu.select("session_id", "row_idx", "t_ms", acc.alias("__acc")), width // 2 + 1, (width - 1) // 2 + 1)
    rows = dealt.withColumn("dynamic", F.col("__acc") - _centred(F.col("__acc"), width, along))
    rows = rows.withColumns({"__b": F.lag("dynamic").over(along), "__a": F.lead("dynamic").over(along)})
    return own_rows(rows).where((F.col("dynamic") > cfg.step_prominence) & (F.col("dynamic") > F.col("__b")) & (F.col("dynamic") > F.col("__a"))).drop("__acc", "__a", "__b")


def accept_steps(candidates: DataFrame, min_interval_ms: int = 280) -> DataFrame:
    """Greedy in time: a peak counts if it is min_interval_ms or more after the last one that did.

    A recurrence over a session's candidates, which are few beside its rows: they are streamed in order, and only the last accepted time is held."""
    placed = candidates.select("session_id", "row_idx", "t_ms", "dynamic").repartition("session_id").sortWithinPartitions("session_id", "t_ms", "row_idx")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = None, 0
        for batch in batches:
            taken = np.zeros(batch.num_rows, bool)
            for i, (s, t) in enumerate(zip(batch.column("session_id").to_pylist(), batch.column("t_ms").to_pylist())):
                if s != session or t - last >= min_interval_ms:
                    taken[i], session, last = True, s, t
            yield batch.filter(pa.array(taken))

    return placed.mapInArrow(accept, "session_id string, row_idx long, t_ms long, dynamic double")


def dead_reckoning(track: DataFrame, steps: DataFrame, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """track (session_id, row_idx, t_ms, yaw) with x, y: steps summed along the heading, from the origin."""
    boost = F.greatest(F.lit(0.8), F.least(F.lit(1.3), F.col("dynamic") / 6.0))
    rows = track.join(steps.select("session_id", "row_idx", "dynamic"), ["session_id", "row_idx"], "left")
    length = F.when(F.col("dynamic").isNotNull(), cfg.step_length_m * boost)
    return running_sums(rows.drop("x", "y"), {"x": length * F.cos("yaw"), "y": length * F.sin("yaw")}).drop("dynamic")


def step_warnings(steps: Column) -> Column:
    return F.when(F.coalesce(steps, F.lit(0)) == 0, F.array(F.lit("No steps were detected; trajectory remained at the origin."))).otherwise(F.array().cast("array<string>"))


def heading_from_positions(truth: DataFrame) -> DataFrame:
    """Missing headings from movement; the first row takes the second's."""
    rows = with_previous(truth, ["x", "y"])
    dx, dy = F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")
    rows = rows.withColumn("__h", F.when((dx != 0) | (dy != 0), F.atan2(dy, dx)))
    second = rows.where(F.col("prev").isNotNull()).groupBy("session_id").agg(F.min_by("__h", F.struct("t_ms", "row_idx")).alias("__second"))
    filled = F.coalesce("heading", F.when(F.col("prev").isNull(), F.col("__second")).otherwise(F.col("__h")))
    return rows.join(second, "session_id", "left").withColumn("heading", filled).drop("__h", "__second", "prev")


def path_smoothness(track: DataFrame) -> DataFrame:
    """Mean absolute second difference of the unwrapped yaw; 0 for fewer than three rows."""
    rows = with_previous(track.where(F.col("yaw").isNotNull()).select("session_id", "row_idx", "t_ms", "yaw"), ["yaw"])
    d = F.col("yaw") - F.col("prev.yaw")
    wrapped = wrap_angle(d)
    step = F.when((wrapped == -F.pi()) & (d > 0), F.pi()).otherwise(wrapped)
    rows = with_previous(rows.withColumn("__d", step).drop("prev"), ["__d"])
    return rows.groupBy("session_id").agg(F.coalesce(F.avg(F.abs(F.col("__d") - F.col("prev.__d"))), F.lit(0.0)).alias("path_smoothness"))
