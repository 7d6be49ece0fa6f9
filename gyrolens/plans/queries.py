"""One query for each operator, over the sensor frames of the driver's tables. Numbers are rounded and arrays joined, so results can be compared as values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolens.config import CODES, AuditConfig
from gyrolens.functions import expressions as X
from gyrolens.operators import asof, audit, benchmark, compare, corruption, har, intervals, motion, replay, sampling
from gyrolens.operators.tables import kept
from gyrolens.plans import artifacts
from gyrolens.plans import views as V
from gyrolens.sources import readers

STREAM, MEMORY = AuditConfig(), AuditConfig.in_memory()


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def joined(name: str) -> Column:
    return F.array_join(name, ",").alias(name)


def _windows(s: SparkSession, d: str, cfg: AuditConfig = STREAM) -> DataFrame:
    return audit.audit_windows(V.imu(s, d), V.sessions(s, d), V.gps(s, d), cfg)


def _scores(s: SparkSession, d: str, cfg: AuditConfig = STREAM) -> DataFrame:
    imu, sessions, gps = kept(V.imu(s, d), "imu"), V.sessions(s, d), V.gps(s, d)
    checks = audit.gps_checks(imu, gps)
    windows = kept(audit.window_penalties(audit.window_metrics(imu, sessions, cfg), sessions, checks, cfg), "windows")
    return audit.session_scores(windows, sessions, checks, cfg)


def unit_conversions(s, d):
    t, v = F.col("event_id") * 0.5, F.col("value")
    return s.read.parquet(f"{d}/events.parquet").select(
        "event_id", X.time_ms(t, "ms").alias("half_ms"), X.time_ms(F.col("event_id") * 1500, "us").alias("us_ms"), X.time_ms(F.col("event_id"), "s").alias("s_ms"),
        *[F.round(c, 8).alias(n) for n, c in {
            "acc": X.acceleration(v, "g"), "gyro": X.angle(v, "deg/s"), "mag": X.magnetic(v, "uT"), "kelvin": X.temperature(v, "K"), "fahrenheit": X.temperature(v, "F"), "kpa": X.pressure(v, "kPa"), "hpa": X.pressure(v, "hPa"), "cm": X.position(v, "cm"), "mm": X.position(v, "mm"), "wrapped": X.wrap_angle(v),
        }.items()],
    )


def slug_and_redact(s, d):
    c = F.concat(F.lit(" /data/"), "event_type", F.lit("--"), F.col("user_id").cast("string"), F.lit("! "))
    return s.read.parquet(f"{d}/events.parquet").select("event_id", X.slugify(c).alias("slug"), X.redact_path(c).alias("name"), X.redact_subject(F.when(F.col("event_id") % 2 == 0, "p")).alias("subject"))


def epoch_unit_heuristic(s, d):
    scale = F.when(F.col("activity_label") == "click", 1e6).when(F.col("activity_label") == "view", 1e3).otherwise(1.0)
    rows = V.imu(s, d).select("session_id", "row_idx", (F.lit(5e11) + 20 * F.col("row_idx") * scale).alias("stamp"))
    return X.epoch_to_ms(rows, "stamp").select("session_id", "row_idx", "t_ms")


def sampling_stats(s, d):
    return sampling.sampling_stats(V.imu(s, d)).select("session_id", "n_rows", *r6("median_dt_ms", "mean_dt_ms", "jitter_ms", "duration_s", "nominal_hz"))


def positive_dt_stats(s, d):
    return sampling.sampling_stats(corruption.corrupt(V.imu(s, d), "timestamp_jitter_3ms"), positive=True).select("session_id", "n_rows", *r6("median_dt_ms", "jitter_ms", "nominal_hz"))


def gap_ratio(s, d):
    return sampling.gap_ratio(V.imu(s, d)).select("session_id", "gap_count", *r6("dropout_ratio"))


def freeze_zero_ratio(s, d):
    return sampling.freeze_ratio(V.imu(s, d)).select("session_id", *r6("repeat_ratio", "zero_ratio", "freeze_ratio"))


def clipping_ratio(s, d):
    return sampling.clipping_ratio(V.imu(s, d), V.sessions(s, d)).select("session_id", *r6("clipping_ratio"))


def sliding_windows(s, d):
    return audit.sliding_windows(V.imu(s, d)).groupBy("session_id", "win_idx").agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"))


def _metrics(s, d, cfg):
    return audit.window_metrics(V.imu(s, d), V.sessions(s, d), cfg).select("session_id", "win_idx", "n", "start_ms", "end_ms", *r6(*audit.METRICS))


def window_metrics(s, d):
    return _metrics(s, d, STREAM)


def window_metrics_memory(s, d):
    return _metrics(s, d, MEMORY)


def mag_norm_cv(s, d):
    return audit.window_metrics(V.imu(s, d), V.sessions(s, d)).select("session_id", "win_idx", *r6("mag_cv"))


def _penalties(s, d, cfg):
    return _windows(s, d, cfg).select("session_id", "win_idx", "is_static", *r6(*[f"p_{k}" for k in audit.WINDOW_CODES]))


def window_penalties_stream(s, d):
    return _penalties(s, d, STREAM)


def window_penalties_memory(s, d):
    return _penalties(s, d, MEMORY)


def window_trust_score(s, d):
    return _windows(s, d).select("session_id", "win_idx", *r6("trust_score"), joined("reason_codes"))


def window_issues(s, d):
    return audit.window_issues(_windows(s, d))


def gyro_bias_drift(s, d):
    return audit.gyro_bias_drift(_windows(s, d)).select("session_id", *r6("gyro_bias_drift_rads"))


def static_ratio(s, d):
    return _scores(s, d).select("session_id", "window_count", *r6("static_window_ratio", "t_insufficient_static_segment"))


def gps_checks(s, d):
    return audit.gps_checks(V.imu(s, d), V.gps(s, d)).select("session_id", "gps_rows", *r6("gps_valid_ratio", "gps_alignment_ratio"))


def session_trust_score(s, d):
    return _scores(s, d).select("session_id", *r6("window_mean", "trust_score"), "status")


def session_trust_score_memory(s, d):
    return _scores(s, d, MEMORY).select("session_id", *r6("window_mean", "trust_score"), "status")


def audit_summary(s, d):
    imu, sessions, gps = kept(V.imu(s, d), "imu"), V.sessions(s, d), V.gps(s, d)
    rows = audit.audit_summary(imu, sessions, gps, windows=kept(audit.audit_windows(imu, sessions, gps), "windows"))
    numbers = ("duration_s", "nominal_hz", "jitter_ms", "trust_score", "static_window_ratio", "gyro_bias_drift_rads", "clipping_ratio", "pressure_stability_pa", "dropout_ratio", "gps_valid_ratio", "gps_alignment_ratio", *[f"t_{k}" for k in CODES])
    return rows.select("session_id", "status", "window_count", "missing_gap_count", *r6(*numbers), joined("reason_codes"), joined("skipped_checks"))


def batch_ranking(s, d):
    return compare.rank_sessions(_scores(s, d)).select("session_id", "rank", "status", *r6("trust_score"))


def status_counts(s, d):
    return compare.status_counts(_scores(s, d))


def reason_frequency(s, d):
    return compare.reason_frequency(_scores(s, d))


def _dropped(s, d):
    return intervals.select_windows(_windows(s, d), 0.55)  # about half of the view's rows are in such windows


def interval_merge(s, d):
    return intervals.merge_intervals(_dropped(s, d).select("session_id", "start_ms", "end_ms"))


def qa_filtered_export(s, d):
    merged = intervals.merge_intervals(_dropped(s, d).select("session_id", "start_ms", "end_ms"))
    return intervals.drop_intervals(V.imu(s, d), merged).select("session_id", "row_idx", "t_ms")


def dropped_reason_counts(s, d):
    return intervals.reason_counts(_dropped(s, d))


def _numbered(rows: DataFrame) -> DataFrame:
    """kind (event type and which pair) and number within the pair: session 0 with 1, 2 with 3."""
    number = F.substring_index("session_id", "_", -1).cast("int")
    return rows.withColumns({"kind": F.concat_ws("_", F.substring_index("session_id", "_", 1), F.floor(number / 2).cast("string")), "number": number % 2})


def compare_sessions(s, d):
    rows = _numbered(kept(_scores(s, d), "scores"))
    names = ("jitter_error", "static_ratio", "bias_drift")
    long = rows.select("kind", "number", F.inline(F.array(*[F.struct(F.lit("replay").alias("category"), F.lit("audit").alias("baseline"), F.lit(n).alias("metric"), F.col(c).alias("value")) for n, c in zip(names, ("t_timing_bad", "static_window_ratio", "gyro_bias_drift_rads"))])))
    keys = ("kind", "category", "baseline", "metric")
    deltas = compare.metric_deltas(long.where("number = 0"), long.where("number = 1"), keys)
    pairs = compare.compare_sessions(rows.where("number = 0"), rows.where("number = 1"), ["kind"], deltas)
    return pairs.select("kind", *r6("trust_delta"), joined("added"), joined("removed"), F.array_join("regression_reasons", ";").alias("regression_reasons"), F.array_join("improvement_reasons", ";").alias("improvement_reasons"), "recommendation")


def metadata_diff(s, d):
    rows = _numbered(V.sessions(s, d))
    long = rows.select("number", F.col("kind"), F.inline(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("value")) for c in ("has_mag", "has_gps", "has_pressure", "acc_limit")])))
    keyed = long.select("number", F.concat_ws(".", "kind", "k").alias("key"), "value")
    return compare.metadata_diff(keyed.where("number = 0"), keyed.where("number = 1"))


def _corrupt(preset: str, *columns: str):
    def query(s, d):
        return corruption.corrupt(V.imu(s, d), preset).select("session_id", "row_idx", *columns)

    query.__name__ = f"corrupt_{preset}"
    return query


def _audited_presets(s, d):
    # The audit reads the copies and their windows several times.
    imu, every, fixes = kept(corruption.all_presets(V.imu(s, d)).drop("preset"), "copies"), corruption.copies_of(V.sessions(s, d)), corruption.copies_of(V.gps(s, d))
    checks = audit.gps_checks(imu, fixes)
    windows = kept(audit.window_penalties(audit.window_metrics(imu, every, STREAM), every, checks, STREAM), "windows")
    return kept(corruption.base_and_preset(audit.session_scores(windows, every, checks, STREAM)), "scores")


def trust_validation(s, d):
    return compare.validate(_audited_presets(s, d)).select("base_id", "preset", "non_improving", *r6("clean_score", "trust_score", "trust_score_delta"))


def validation_summary(s, d):
    rows = compare.validation_summary(compare.validate(_audited_presets(s, d)))
    return rows.select("base_id", "all_non_improving", F.size("known_limitations").alias("n_limitations"), F.array_join("known_limitations", ";").alias("known_limitations"))


def validation_delta_stats(s, d):
    rows = compare.validate(_audited_presets(s, d)).select(F.col("base_id").alias("metric"), F.col("trust_score_delta").alias("delta"))
    return compare.delta_stats(rows).select("metric", "preset_count", *r6("average_delta", "max_delta", "min_delta"))


def rolling_mean_centered(s, d):
    rows = motion.rolling_means(V.imu(s, d).select("session_id", "row_idx", "t_ms", "ax"), {"even": (F.col("ax"), 4), "odd": (F.col("ax"), 5)})
    return rows.select("session_id", "row_idx", F.round("even", 9).alias("even"), F.round("odd", 9).alias("odd"))


def _steps(s, d):
    return motion.accept_steps(motion.step_candidates(V.imu(s, d), 40))


def pdr_peaks(s, d):
    return _steps(s, d).select("session_id", "row_idx", "t_ms", *r6("dynamic"))


def _reckoned(s, d):
    return motion.dead_reckoning(V.track(s, d), _steps(s, d))


def dead_reckoning(s, d):
    return _reckoned(s, d).select("session_id", "row_idx", *[F.round(c, 5).alias(c) for c in ("x", "y")])


def heading_from_positions(s, d):
    return motion.heading_from_positions(V.truth(s, d)).select("session_id", "row_idx", *r6("heading"))


def asof_nearest(s, d):
    truth = V.truth(s, d).where(F.col("row_idx") % 30 != 0)
    pairs = asof.nearest(V.track(s, d), truth, 60, ["heading"])
    return pairs.select("session_id", "row_idx", F.col("matched.t_ms").alias("matched_t_ms"), F.round("matched.heading", 6).alias("heading"))


def asof_heading_error(s, d):
    return asof.heading_error(V.track(s, d), V.truth(s, d)).select("session_id", *r6("heading_drift_rad"))


def trajectory_rmse(s, d):
    return asof.trajectory_rmse(_reckoned(s, d), V.truth(s, d)).select("session_id", F.round("trajectory_rmse_m", 5).alias("trajectory_rmse_m"))


def path_smoothness(s, d):
    return motion.path_smoothness(V.track(s, d)).select("session_id", *r6("path_smoothness"))


def quat_to_euler(s, d):
    q = [F.cos(F.col("yaw") / 2) * 0.8, F.sin(F.col("yaw") / 2) * 0.8, F.cos(F.col("yaw")) * 0.6, F.sin(F.col("yaw")) * 0.6]
    return V.track(s, d).select("session_id", "row_idx", *[F.round(c, 6).alias(n) for c, n in zip(X.euler(*q), ("roll", "pitch", "yaw"))])


def har_features(s, d):
    return har.har_features(V.imu(s, d), 100, 50).select("session_id", "win_idx", "label", *r6(*har.FEATURES))


def nmea_parse(s, d):
    return readers.parse_nmea(V.nmea_lines(s, d)).select("row_idx", "valid", *r6("lat", "lon"))


def labelled_lines_parse(s, d):
    return readers.parse_labelled_lines(V.lines(s, d)).select("session_id", "row_idx", "activity_label", *r6("stamp", "ax", "ay", "az"))


def gps_sidecar_times(s, d):
    return readers.spread_sidecar(V.gps(s, d).drop("t_ms"), V.imu(s, d)).select("session_id", "row_idx", "t_ms")


def accel_units(s, d):
    third = F.substring_index("session_id", "_", -1)
    g = F.when(third == "0", 1.0).when(third == "1", 30.0).otherwise(9.0)
    u = F.when(third == "2", F.lit(9.0)).otherwise(F.lit(1.0))
    rows = V.imu(s, d).select("session_id", "row_idx", (F.col("ax") / 64).alias("ux"), F.lit(0.0).alias("uy"), u.alias("uz"), F.lit(0.0).alias("wx"), F.lit(0.0).alias("wy"), g.alias("wz"))
    return readers.accel_to_mps2(rows).select("session_id", "row_idx", *r6("ax", "ay", "az"))


def describe_sessions(s, d):
    return readers.describe_sessions(V.imu(s, d), V.gps(s, d)).select("session_id", "n_rows", "has_imu", "has_mag", "has_pressure", "has_temperature", "labels_available", "has_gps")


def _rated(s, d):
    imu = kept(V.imu(s, d), "imu")
    return kept(replay.with_rate(imu, sampling.sampling_stats(imu, positive=True)), "rated")


def replay_madgwick(s, d):
    return benchmark.replay_track(_rated(s, d), "madgwick")


def replay_mahony(s, d):
    return benchmark.replay_track(_rated(s, d), "mahony")


def replay_pdr(s, d):
    return benchmark.replay_track(_rated(s, d), "pdr")


def benchmark_pdr(s, d):
    return benchmark.benchmark(_rated(s, d), V.truth(s, d), "pdr")


def pdr_peaks_by_rate(s, d):
    return benchmark.find_steps(_rated(s, d)).select("session_id", "row_idx", "t_ms", *r6("dynamic"))


def _track_metrics(s, d):
    """Two baselines: the track, and for some sessions the track without a truth."""
    track, truth = V.track(s, d), V.truth(s, d).where(~F.col("session_id").like("%2"))
    return benchmark.replay_metrics(track, truth, "first").unionByName(benchmark.replay_metrics(track.withColumn("yaw", F.col("yaw") / 2), truth, "second"))


def replay_metrics(s, d):
    return _track_metrics(s, d).select("session_id", "baseline", "metric", *r6("value"))


def primary_metric(s, d):
    return benchmark.primary_metric(_track_metrics(s, d), *benchmark.PRIMARY["orientation"]).select("session_id", "primary_metric_name", *r6("primary_metric_value"))


def preset_metric_deltas(s, d):
    """What each preset does to the mean sampling step, the mean rate and field: metrics that SQL has too, through the same join as replay metrics."""
    imu = corruption.base_and_preset(corruption.all_presets(V.imu(s, d)).drop("preset"))
    sums = imu.groupBy("base_id", "preset").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg("gx").alias("mean_gx"), F.avg("mx").alias("mean_mx"))
    names = ("rows", "mean_gx", "mean_mx")
    long = sums.select("base_id", "preset", F.lit("means").alias("baseline"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    return compare.preset_deltas(long).select("base_id", "preset", "metric", *r6("delta"))


def downsampled(s, d):
    return artifacts.downsample(V.imu(s, d), 37).select("session_id", "row_idx", "t_ms")


def gate_statuses(s, d):
    rows = _scores(s, d)
    return rows.select("session_id", X.status(F.col("trust_score"), 0.7, 0.5).alias("status"), (F.col("trust_score") < 0.5).alias("fails"))


def first_reasons(s, d):
    issues = audit.window_issues(_windows(s, d))
    first = issues.groupBy("session_id", "code").agg(F.min("win_idx").alias("win_idx"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("win_idx", "code"))
    return first.withColumn("place", place).where("place <= 4").select("session_id", "place", "code", "win_idx")


def export_counts(s, d):
    merged = intervals.merge_intervals(_dropped(s, d).select("session_id", "start_ms", "end_ms"))
    rows = V.imu(s, d)
    kept = intervals.drop_intervals(rows, merged).groupBy("session_id").agg(F.count(F.lit(1)).alias("k"))
    n = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows_in"))
    return n.join(kept, "session_id", "left").select("session_id", "rows_in", F.coalesce("k", F.lit(0)).alias("rows_kept"))


def har_random_forest(s, d):
    return har.forest_benchmark(har.har_features(V.imu(s, d), 100, 50))


def har_metrics(s, d):
    label, n = F.col("activity_label"), F.count(F.lit(1)).alias("n")
    said = F.when(F.col("row_idx") % 5 == 0, "view").otherwise(label)
    return har.classification_metrics(V.imu(s, d).groupBy(label.alias("label"), said.alias("prediction")).agg(n)).select(*r6("accuracy", "macro_f1"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        unit_conversions, slug_and_redact, epoch_unit_heuristic, sampling_stats, positive_dt_stats, gap_ratio, freeze_zero_ratio, clipping_ratio, mag_norm_cv, sliding_windows, window_metrics, window_metrics_memory,
        window_penalties_stream, window_penalties_memory, window_trust_score, window_issues, gyro_bias_drift, static_ratio, gps_checks, session_trust_score, session_trust_score_memory, audit_summary,
        batch_ranking, status_counts, reason_frequency, interval_merge, qa_filtered_export, dropped_reason_counts, compare_sessions, metadata_diff,
        _corrupt("packet_loss_5", "t_ms"), _corrupt("timestamp_jitter_3ms", "t_ms"), _corrupt("axis_flip_x", "ax", "gx", "mx"), _corrupt("gyro_bias_small", "gx", "gy", "gz"), _corrupt("mag_bias_30ut", "mx", "my", "mz"),
        trust_validation, validation_summary, validation_delta_stats, rolling_mean_centered, pdr_peaks, dead_reckoning, heading_from_positions, asof_nearest, asof_heading_error, trajectory_rmse, path_smoothness, quat_to_euler,
        har_features, har_metrics, nmea_parse, labelled_lines_parse, gps_sidecar_times, accel_units, describe_sessions, replay_madgwick, replay_mahony, har_random_forest,
        replay_pdr, benchmark_pdr, pdr_peaks_by_rate, replay_metrics, primary_metric, preset_metric_deltas, downsampled, gate_statuses, first_reasons, export_counts,
    ]
    return {f.__name__: f for f in found}
