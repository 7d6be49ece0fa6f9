"""The windowed audit (A1-A19): sliding windows, metrics, penalties, scores, issues and summary, for all sessions in one job.

Rows are dealt by session and window, so a long session spreads over tasks; everything after the metrics works on windows or sessions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.config import CODES, GRAVITY, AuditConfig
from gyrolens.functions.expressions import norm, safe_norm, status
from gyrolens.operators import sampling
from gyrolens.schema import AXES, MAG

#: Codes that windows can have.
WINDOW_CODES = ("timing_bad", "dropout", "clipping", "mag_disturbed", "gps_unreliable", "orientation_inconsistent", "pressure_unstable")
METRICS = ("jitter_ms", "missing_ratio", "freeze_ratio", "clipping_ratio", "acc_std", "gyro_std", "gravity_residual", "mag_cv", "pressure_delta", "pressure_std")


def sliding_windows(imu: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """A row for each row and window it is in: win_idx added. Windows are closed at both ends and start with the session."""
    starts = imu.groupBy("session_id").agg(F.min("t_ms").alias("t0"))
    d = (F.col("t_ms") - F.col("t0")).cast("double")
    first = F.greatest(F.lit(0), F.ceil((d - cfg.window_ms) / cfg.step_ms)).cast("long")
    return imu.join(starts, "session_id").withColumn("win_idx", F.explode(F.sequence(first, F.floor(d / cfg.step_ms).cast("long")))).drop("t0")


def _any_mag() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in MAG])


def levels(no_mag: Column | None = None) -> list[Column]:
    """Aggregates of a window's rows (with acc_limit, gyro_limit, mag_limit) that need no order. no_mag: whether the whole session has no field."""
    axes = [F.col(a) for a in AXES]
    acc, gyro = norm(*axes[:3]), norm(*axes[3:])
    mag = safe_norm(F.lit(False) if no_mag is None else no_mag, *[F.col(c) for c in MAG])
    whole_std = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.stddev_pop(c))
    return [
        F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg(sampling.zeros(axes).cast("int")).alias("zero_share"),
        F.coalesce(F.greatest(sampling.clipped_share(AXES[:3], F.col("acc_limit")), sampling.clipped_share(AXES[3:], F.col("gyro_limit")), sampling.clipped_share(MAG, F.col("mag_limit"))), F.lit(0.0)).alias("clipping_ratio"),
        whole_std(acc).alias("acc_std"), whole_std(gyro).alias("gyro_std"), F.percentile(F.abs(acc - GRAVITY), 0.5).alias("gravity_residual"),
        F.count(F.when(_any_mag(), 1)).alias("mag_rows"), F.count(mag).alias("mag_n"), F.avg(mag).alias("mag_mean"), F.stddev_pop(mag).alias("mag_std"),
        F.coalesce(F.max("pressure_pa") - F.min("pressure_pa"), F.lit(0.0)).alias("pressure_delta"), F.coalesce(F.stddev_pop("pressure_pa"), F.lit(0.0)).alias("pressure_std"),
        F.avg("gx").alias("mean_gx"), F.avg("gy").alias("mean_gy"), F.avg("gz").alias("mean_gz"),
    ]


def finished(got: DataFrame, cfg: AuditConfig, *keys: str) -> DataFrame:
    """The ten metrics from levels() and what the steps gave: dts, median_dt or base_dt, jitter_ms, repeat_share."""
    limit = cfg.gap_factor * F.greatest(F.col("median_dt" if cfg.own_median_gap else "base_dt"), F.lit(1.0))
    has_mag = (F.col("mag_n") > 3) & (F.col("mag_mean") > 0) & ((F.col("mag_rows") > 0) if cfg.sensor_gates else F.lit(True))
    return (
        got.where(F.col("n") >= 2)
        .withColumn("__limit", limit)
        .withColumn("missing_ratio", F.size(F.filter("dts", lambda x: x > F.col("__limit"))) / F.size("dts"))
        .withColumn("freeze_ratio", F.greatest("repeat_share", "zero_share"))
        .withColumn("mag_cv", F.when(has_mag, F.col("mag_std") / F.col("mag_mean")).otherwise(0.0))
        .select(*keys, "session_id", "win_idx", "n", "start_ms", "end_ms", *METRICS, "mean_gx", "mean_gy", "mean_gz")
    )


def window_metrics(imu: DataFrame, sessions: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """The ten metrics of each window of two rows or more, its first and last time and the mean rates."""
    order = Window.partitionBy("session_id", "win_idx").orderBy("t_ms", "row_idx")
    rows = sliding_windows(imu, cfg).withColumn("prev", F.lag(F.struct("t_ms", *AXES)).over(order))
    extra = sessions.select("session_id", "acc_limit", "gyro_limit", "mag_limit")
    if not cfg.own_median_gap:
        extra = extra.join(sampling.sampling_stats(imu).select("session_id", F.col("median_dt_ms").alias("base_dt")), "session_id")
    if not cfg.sensor_gates:  # the norm is null only where the whole session has no magnetometer
        extra = extra.join(imu.groupBy("session_id").agg((F.count(F.when(_any_mag(), 1)) == 0).alias("no_mag")), "session_id")
    dt = F.col("t_ms") - F.col("prev.t_ms")
    repeat = F.when(F.col("prev").isNotNull(), sampling.repeats([F.col(a) for a in AXES], [F.col(f"prev.{a}") for a in AXES]).cast("int"))
    got = rows.join(extra, "session_id").groupBy("session_id", "win_idx").agg(
        *levels(None if cfg.sensor_gates else F.col("no_mag")), F.coalesce(F.stddev_pop(dt), F.lit(0.0)).alias("jitter_ms"), F.percentile(dt, 0.5).alias("median_dt"), F.collect_list(dt).alias("dts"),
        F.avg(repeat).alias("repeat_share"), *([] if cfg.own_median_gap else [F.max("base_dt").alias("base_dt")]),
    )
    return finished(got, cfg)


def gps_checks(imu: DataFrame, gps: DataFrame) -> DataFrame:
    """gps_rows, gps_valid_ratio (0 without rows) and gps_alignment_ratio (null with under two rows) of each session."""
    spans = imu.groupBy("session_id").agg((F.max("t_ms") - F.min("t_ms")).cast("double").alias("span"))
    fixes = gps.groupBy("session_id").agg(F.count(F.lit(1)).alias("gps_rows"), F.avg(F.coalesce("valid", F.lit(False)).cast("int")).alias("r"), (F.max("t_ms") - F.min("t_ms")).cast("double").alias("g"))
    return spans.join(fixes, "session_id", "left").select(
        "session_id",
        F.coalesce("gps_rows", F.lit(0)).alias("gps_rows"),
        F.coalesce("r", F.lit(0.0)).alias("gps_valid_ratio"),
        F.when((F.col("gps_rows") >= 2) & (F.col("span") > 0), F.col("g") / F.col("span")).alias("gps_alignment_ratio"),
    )


def window_penalties(metrics: DataFrame, sessions: DataFrame, gps: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """metrics with p_<code> for each window code, is_static, trust_score and reason_codes."""
    w = cfg.weights
    rows = metrics.join(sessions.select("session_id", "has_mag", "has_gps", "has_pressure"), "session_id").join(gps.select("session_id", "gps_valid_ratio"), "session_id")
    c = F.col
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    scaled = lambda code, value, top: w[code] * F.least(F.lit(1.0), value / max(top, 1e-6))
    worst = F.greatest("missing_ratio", "freeze_ratio")
    static = yes((c("acc_std") <= cfg.static_acc_std) & (c("gyro_std") <= cfg.static_gyro_std))
    mag, press = (c("has_mag"), c("has_pressure")) if cfg.sensor_gates else (F.lit(True), F.lit(True))
    short = cfg.gps_valid_warn - c("gps_valid_ratio")
    penalties = {
        "timing_bad": F.when(c("jitter_ms") >= cfg.jitter_warn_ms, scaled("timing_bad", c("jitter_ms"), cfg.jitter_fail_ms)),
        "dropout": F.when((c("missing_ratio") >= cfg.dropout_warn) | (c("freeze_ratio") >= cfg.freeze_warn), scaled("dropout", worst, cfg.dropout_warn)),
        "clipping": F.when(c("clipping_ratio") >= cfg.clipping_warn, scaled("clipping", c("clipping_ratio"), cfg.clipping_warn)),
        "mag_disturbed": F.when(yes(mag) & (c("mag_cv") >= cfg.mag_cv_warn), scaled("mag_disturbed", c("mag_cv"), cfg.mag_cv_warn)),
        "gps_unreliable": F.when(yes(c("has_gps")) & (c("gps_valid_ratio") < cfg.gps_valid_warn), scaled("gps_unreliable", short, cfg.gps_valid_warn)),
        "orientation_inconsistent": F.when(c("is_static") & (c("gravity_residual") >= cfg.gravity_residual_warn), scaled("orientation_inconsistent", c("gravity_residual"), cfg.gravity_residual_warn)),
        "pressure_unstable": F.when(c("is_static"), F.when(yes(press) & (c("pressure_std") >= cfg.pressure_unstable), scaled("pressure_unstable", c("pressure_std"), cfg.pressure_unstable))).when(
            yes(press) & (c("pressure_delta") >= cfg.pressure_floor_change), F.lit(w["pressure_unstable"] * 0.5)
        ),
    }
    scored = rows.withColumn("is_static", static).withColumns({f"p_{k}": F.coalesce(v, F.lit(0.0)) for k, v in penalties.items()})
    total = reduce(lambda a, b: a + b, [c(f"p_{k}") for k in WINDOW_CODES])
    codes = F.array_sort(F.array_compact(F.array(*[F.when(c(f"p_{k}") > 0, k) for k in WINDOW_CODES])))
    return scored.withColumn("trust_score", F.greatest(F.lit(0.0), 1.0 - total)).withColumn("reason_codes", codes).drop("has_mag", "has_gps", "has_pressure", "gps_valid_ratio")


def window_issues(windows: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """A row for each window and code."""
    return windows.select(
        "session_id", "win_idx", F.explode("reason_codes").alias("code"), F.when(F.col("trust_score") < cfg.fail, "fail").otherwise("warning").alias("severity"), "start_ms", "end_ms"
    ).withColumn("message", F.concat(F.regexp_replace("code", "_", " "), F.lit(" detected")))


def load_issues(spark, path: str) -> DataFrame:
    """Issues that were written as JSON."""
    return spark.read.schema("session_id string, win_idx long, code string, severity string, start_ms long, end_ms long, message string").json(path)


def gyro_bias_drift(windows: DataFrame) -> DataFrame:
    """Largest distance of a static window's mean rate from the first one's; 0 with fewer than two."""
    at = F.when(F.col("is_static"), F.col("win_idx"))
    base = windows.groupBy("session_id").agg(F.min_by(F.struct("mean_gx", "mean_gy", "mean_gz"), at).alias("b"), F.min(at).alias("first"))
    away = norm(*[F.col(f"mean_{g}") - F.col(f"b.mean_{g}") for g in ("gx", "gy", "gz")])
    later = F.col("is_static") & (F.col("win_idx") != F.col("first"))
    return windows.join(base, "session_id").groupBy("session_id").agg(F.coalesce(F.max(F.when(later, away)), F.lit(0.0)).alias("gyro_bias_drift_rads"))


def session_scores(windows: DataFrame, sessions: DataFrame, gps: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Scores, totals of penalties (t_<code>), reason codes and status of each session that gps_checks found rows of; sessions without windows score 0.92."""
    sums = windows.groupBy("session_id").agg(F.count(F.lit(1)).alias("window_count"), F.avg("trust_score").alias("window_mean"), F.avg(F.col("is_static").cast("int")).alias("static_window_ratio"), *[F.sum(f"p_{k}").alias(f"t_{k}") for k in WINDOW_CODES])
    zero = F.lit(0.0)
    rows = gps.join(sums, "session_id", "left").join(gyro_bias_drift(windows), "session_id", "left").join(sessions.select("session_id", "has_mag", "has_gps", "has_pressure"), "session_id")
    rows = rows.fillna(0.0, ["static_window_ratio", "gyro_bias_drift_rads", *[f"t_{k}" for k in WINDOW_CODES]]).fillna(0, ["window_count"]).fillna(1.0, ["window_mean"])
    short = cfg.static_ratio_warn - F.col("static_window_ratio")
    off = F.coalesce(F.col("has_gps") & ((F.col("gps_alignment_ratio") < cfg.gps_align_low) | (F.col("gps_alignment_ratio") > cfg.gps_align_high)), F.lit(False))
    bias = F.col("gyro_bias_drift_rads")
    rows = rows.withColumns(
        {
            "t_gyro_bias_drift": F.when(bias >= cfg.bias_drift_warn, cfg.weights["gyro_bias_drift"] * F.least(F.lit(1.0), bias / cfg.bias_drift_warn)).otherwise(zero),
            "t_insufficient_static_segment": F.when(short > 0, cfg.weights["insufficient_static_segment"] * F.least(F.lit(1.0), short / cfg.static_ratio_warn)).otherwise(zero),
            "t_gps_unreliable": F.col("t_gps_unreliable") + F.when(off, cfg.weights["gps_unreliable"] * 0.5).otherwise(zero),
        }
    )
    total = reduce(lambda a, b: a + b, [F.col(f"t_{k}") for k in CODES])
    score = F.greatest(zero, F.least(F.lit(1.0), F.col("window_mean") - total / F.greatest(F.col("window_count"), F.lit(1))))
    codes = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"t_{k}") > 0, k) for k in CODES])))
    return rows.withColumn("trust_score", score).withColumn("status", status(score, cfg.warning, cfg.fail)).withColumn("reason_codes", codes)


def skipped_checks() -> Column:
    return F.array_compact(
        F.array(F.when(~F.coalesce("has_mag", F.lit(False)), "mag_disturbed"), F.when(~F.coalesce("has_gps", F.lit(False)), "gps_unreliable"), F.when(~F.coalesce("has_pressure", F.lit(False)), "pressure_unstable"))
    )


def audit_windows(imu: DataFrame, sessions: DataFrame, gps: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    return window_penalties(window_metrics(imu, sessions, cfg), sessions, gps_checks(imu, gps), cfg)


def audit_summary(imu: DataFrame, sessions: DataFrame, gps: DataFrame, cfg: AuditConfig = AuditConfig(), windows: DataFrame | None = None) -> DataFrame:
    """One row for each session with all results of the audit (A18). windows: those of audit_windows, if they are at hand."""
    windows = audit_windows(imu, sessions, gps, cfg) if windows is None else windows
    scores = session_scores(windows, sessions, gps_checks(imu, gps), cfg)
    rows = scores.join(sampling.session_facts(imu, cfg.positive_deltas, cfg.gap_factor), "session_id", "left").join(sampling.session_levels(imu, sessions), "session_id", "left")
    rows = rows.withColumn("duration_s", F.col("span_ms") / 1000.0)
    return rows.select(
        "session_id", "duration_s", "nominal_hz", "jitter_ms", "trust_score", "status", "window_count", "static_window_ratio", "gyro_bias_drift_rads", "clipping_ratio", "pressure_stability_pa",
        F.coalesce("gap_count", F.lit(0)).alias("missing_gap_count"), F.greatest(F.coalesce("dropout_ratio", F.lit(0.0)), "freeze_ratio").alias("dropout_ratio"),
        F.when(F.col("gps_rows") > 0, F.col("gps_valid_ratio")).alias("gps_valid_ratio"), "gps_alignment_ratio", "reason_codes", skipped_checks().alias("skipped_checks"),
        *[F.round(f"t_{k}", 6).alias(f"t_{k}") for k in CODES],
    )
