"""Replay metrics in long format, dead-reckoning replay, the primary metric and row limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolens.config import HarConfig, LimitConfig, ReplayConfig
from gyrolens.operators import asof, har, motion, replay
from gyrolens.operators.tables import kept

BASELINES = ("madgwick", "mahony", "pdr")
#: The metric that stands for a task, and the one taken where it is missing (fixed values).
PRIMARY = {"orientation": ("heading_drift_rad", "path_smoothness"), "pdr": ("trajectory_rmse_m", "step_count"), "har": ("macro_f1", "accuracy")}


def enforce_row_limit(imu: DataFrame, limit: int, kind: str) -> None:
    """Raises if a session has more rows than the limit; 0 is none. The largest session alone reaches the driver."""
    if limit > 0 and (worst := imu.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").first()) and worst["count"] > limit:
        raise ValueError(f"{kind} takes sessions of up to {limit} rows; {worst['session_id']} has {worst['count']}")


def _widths(imu: DataFrame) -> DataFrame:
    """Rows of the step detector's rolling mean, by the session's rate."""
    return imu.withColumn("__width", F.greatest(F.floor(F.coalesce(F.nullif(F.col("hz"), F.lit(0.0)), F.lit(100.0)) * 0.8).cast("int"), F.lit(3)))


def find_steps(imu: DataFrame, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """Accepted steps of sessions of any rate (imu with hz). Widths differ by rate, of which there are few."""
    rows = _widths(imu)
    widths = [r[0] for r in rows.select("__width").distinct().collect()]
    found = [motion.step_candidates(rows.where(F.col("__width") == w).drop("__width"), w, cfg) for w in sorted(widths)]
    return motion.accept_steps(reduce(DataFrame.unionByName, found), cfg.step_min_interval_ms) if found else motion.accept_steps(motion.step_candidates(imu, 3, cfg), cfg.step_min_interval_ms)


def replay_track(imu: DataFrame, baseline: str, cfg: ReplayConfig = ReplayConfig(), limits: LimitConfig = LimitConfig(), steps: DataFrame | None = None) -> DataFrame:
    """Orientation of each row; for pdr also x and y, summed along Madgwick's headings. imu brings hz (see replay.with_rate); steps: those of find_steps, if they are at hand."""
    if baseline not in BASELINES:
        raise ValueError(f"Unsupported baseline: {baseline}")
    enforce_row_limit(imu, limits.replay_max_rows, "replay")
    track = replay.replay(imu, "madgwick" if baseline == "pdr" else baseline, cfg)
    if baseline != "pdr":
        return track
    return motion.dead_reckoning(track, find_steps(imu, cfg) if steps is None else steps, cfg)


def _long(df: DataFrame, baseline: str, *names: str) -> DataFrame:
    return df.select("session_id", F.lit(baseline).alias("baseline"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]))).where(F.col("value").isNotNull())


def replay_metrics(track: DataFrame, truth: DataFrame | None, baseline: str, steps: DataFrame | None = None) -> DataFrame:
    """session_id, baseline, metric, value: path smoothness; with a truth heading drift, and for pdr the trajectory's error; for pdr the number of steps."""
    parts = [_long(motion.path_smoothness(track), baseline, "path_smoothness")]
    if truth is not None:
        parts.append(_long(asof.heading_error(track, truth.where(F.col("heading").isNotNull())), baseline, "heading_drift_rad"))
        if "x" in track.columns:
            parts.append(_long(asof.trajectory_rmse(track, truth.where(F.col("x").isNotNull() & F.col("y").isNotNull())), baseline, "trajectory_rmse_m"))
    if steps is not None:
        n = steps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
        parts.append(_long(track.select("session_id").distinct().join(n, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).alias("step_count")), baseline, "step_count"))
    return reduce(DataFrame.unionByName, parts)


def validation_metrics(imu: DataFrame, sessions: DataFrame, truth: DataFrame | None = None, cfg: ReplayConfig = ReplayConfig(), limits: LimitConfig = LimitConfig()) -> DataFrame:
    """session_id, baseline, metric, value of each session's own task (V6): what its replay and its benchmark measure. imu brings hz.

    Sessions without a task count as orientation. Those of other tasks, and those with more rows than the limits, have no metrics."""
    top = min([n for n in (limits.replay_max_rows, limits.benchmark_max_rows) if n > 0], default=0)
    sizes = imu.groupBy("session_id").count()
    task = F.coalesce(F.col("task"), F.lit("orientation")) if "task" in sessions.columns else F.lit("orientation")
    fit = sessions.select("session_id", task.alias("__task")).join(sizes.where(F.col("count") <= top) if top else sizes, "session_id").drop("count")
    found = []
    for kind, replayed in (("orientation", "madgwick"), ("pdr", "pdr")):
        rows = imu.join(fit.where(F.col("__task") == kind).drop("__task"), "session_id", "left_semi")
        if rows.isEmpty():
            continue
        measured = benchmark(rows, truth, kind, cfg, limits=LimitConfig(0, 0))
        sources = F.when(F.col("baseline") == replayed, F.array(F.lit("replay_"), F.lit("benchmark_"))).otherwise(F.array(F.lit("benchmark_")))
        found.append(measured.select("session_id", F.explode(F.transform(sources, lambda p: F.concat(p, "baseline"))).alias("baseline"), "metric", "value"))
    return reduce(DataFrame.unionByName, found) if found else imu.sparkSession.createDataFrame([], "session_id string, baseline string, metric string, value double")


def primary_metric(metrics: DataFrame, preferred: str, fallback: str) -> DataFrame:
    """session_id, primary_metric_name, primary_metric_value: the mean over baselines of the preferred metric, or else of the fallback; null without either."""
    mean = lambda name: F.avg(F.when(F.col("metric") == name, F.col("value")))
    rows = metrics.groupBy("session_id").agg(mean(preferred).alias("p"), mean(fallback).alias("f"))
    return rows.select("session_id", F.when(F.col("p").isNotNull(), preferred).when(F.col("f").isNotNull(), fallback).alias("primary_metric_name"), F.coalesce("p", "f").alias("primary_metric_value"))


def benchmark(imu: DataFrame, truth: DataFrame | None, task: str, cfg: ReplayConfig = ReplayConfig(), har_cfg: HarConfig = HarConfig(), limits: LimitConfig = LimitConfig()) -> DataFrame:
    """Metrics of a task in long format. imu brings hz. The forest is trained on the windows of all sessions given, each rate with its own window size."""
    if task not in PRIMARY:
        raise ValueError(f"Unsupported task: {task}")
    enforce_row_limit(imu, limits.benchmark_max_rows, "benchmark")
    if task == "har":
        labelled = imu.where(F.col("activity_label").isNotNull())
        if labelled.isEmpty():
            raise ValueError("The activity benchmark needs rows with an activity_label.")
        sized = imu.withColumn("__hz", F.round(F.coalesce(F.nullif(F.col("hz"), F.lit(0.0)), F.lit(50.0)), 6))
        rates = sorted(r[0] for r in sized.select("__hz").distinct().collect())  # a row for each rate
        windows = reduce(DataFrame.unionByName, [har.har_features(sized.where(F.col("__hz") == hz), *har.window_size(hz, har_cfg)) for hz in rates])
        scores = har.classification_metrics(har.forest_benchmark(windows, har_cfg))
        return _long(scores.withColumn("session_id", F.lit("all")), "rf_features", "accuracy", "macro_f1")
    found = []
    for baseline in ("madgwick", "mahony") if task == "orientation" else ("pdr",):
        # Filters and steps run in Python and each metric reads the track, so both are written once.
        steps = kept(find_steps(imu, cfg), "steps") if baseline == "pdr" else None
        track = kept(replay_track(imu, baseline, cfg, limits, steps), "track")
        found.append(replay_metrics(track, truth, baseline, steps))
    return reduce(DataFrame.unionByName, found)

