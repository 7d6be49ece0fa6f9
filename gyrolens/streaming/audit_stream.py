"""The windowed audit over a stream of sensor rows (A20): event time, watermark, append or update mode.

Windows, metrics, penalties, scores and reason codes are those of the audit's default mode, by the same expressions. A stream has no window
functions, so a window's rows are kept in the state until it closes (they are few: the window's length times the rate), and its steps
are read from them in order. The session's start comes with the rows, since a stream can't look it up; facts of sessions
and their GPS shares are tables. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.config import AuditConfig
from gyrolens.operators import audit, sampling
from gyrolens.schema import AXES


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x.cast("double")) / F.size(values)


def _median(values: Column) -> Column:
    ordered = F.sort_array(values)
    low, high = (F.get(ordered, f((F.size(values) - 1) / 2).cast("int")) for f in (F.floor, F.ceil))
    return (low + high) / 2


def stream_metrics(rows: DataFrame, sessions: DataFrame, cfg: AuditConfig = AuditConfig(), delay: str = "10 seconds") -> DataFrame:
    """rows: session_id, row_idx, t0 (the session's start), t_ms and channels. The metrics of each session's windows, with win_end."""
    if not (cfg.own_median_gap and cfg.sensor_gates):
        raise ValueError("A stream knows its windows only, not whole sessions: use the default mode of the audit")
    d = (F.col("t_ms") - F.col("t0")).cast("double")
    first = F.greatest(F.lit(0), F.ceil((d - cfg.window_ms) / cfg.step_ms)).cast("long")
    dealt = rows.withColumn("win_idx", F.explode(F.sequence(first, F.floor(d / cfg.step_ms).cast("long"))))
    ends = F.timestamp_millis(F.col("t0") + F.col("win_idx") * cfg.step_ms + cfg.window_ms)
    limits = sessions.select("session_id", "acc_limit", "gyro_limit", "mag_limit")
    kept = dealt.join(limits, "session_id").withColumn("win_end", ends).withWatermark("win_end", delay)
    got = kept.groupBy("win_end", "session_id", "win_idx").agg(*audit.levels(), F.sort_array(F.collect_list(F.struct("t_ms", "row_idx", *AXES))).alias("rows"))
    n = F.size("rows") - 1

    def step(before: Column, row: Column) -> Column:
        same = sampling.repeats([row[a] for a in AXES], [before[a] for a in AXES])
        return F.struct((row["t_ms"] - before["t_ms"]).alias("dt"), same.cast("int").alias("same"))

    got = got.withColumn("steps", F.zip_with(F.slice("rows", 1, n), F.slice("rows", 2, n), step)).withColumn("dts", F.col("steps.dt")).withColumn("mean_dt", _mean(F.col("dts")))
    spread = F.sqrt(_mean(F.transform("dts", lambda x: (x - F.col("mean_dt")) * (x - F.col("mean_dt")))))
    return audit.finished(got.withColumns({"jitter_ms": spread, "median_dt": _median(F.col("dts")), "repeat_share": _mean(F.col("steps.same"))}), cfg, "win_end")


def stream_windows(rows: DataFrame, sessions: DataFrame, checks: DataFrame, cfg: AuditConfig = AuditConfig(), delay: str = "10 seconds") -> DataFrame:
    """A row for each window: metrics, penalties, trust_score and reason_codes. sessions and checks (see audit.gps_checks) are tables."""
    return audit.window_penalties(stream_metrics(rows, sessions, cfg, delay), sessions, checks, cfg)
