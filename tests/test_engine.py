"""Hand-computed and edge cases of the engine."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gyrolens.config import AuditConfig
from gyrolens.functions import expressions as X
from gyrolens.operators import asof, audit, benchmark, compare, corruption, har, intervals, motion, replay, sampling
from gyrolens.schema import GPS, IMU, normalise
from gyrolens.sources import readers


def recording(spark, n=1000, session="s", step=10, **channels):
    """Rows at rest: gravity on z, a field and a pressure that stay; channels override a column with a list."""
    base = {"ax": 0.0, "ay": 0.0, "az": 9.80665, "gx": 0.0, "gy": 0.0, "gz": 0.01, "mx": 42.0, "my": 0.0, "mz": 5.0, "pressure_pa": 101325.0}
    rows = []
    for i in range(n):
        r = {"session_id": session, "row_idx": i, "t_ms": step * i} | {c: v + 1e-3 * ((i * 7 + j) % 5) if c[0] in "ag" else v for j, (c, v) in enumerate(base.items())}
        rows.append(r | {c: v[i] for c, v in channels.items()})
    return normalise(spark.createDataFrame(rows, "session_id string, row_idx long, t_ms long, " + ", ".join(f"{c} double" for c in base)), IMU)


def described(imu, gps=None, scale=(None, None, None)):
    return readers.describe_sessions(imu, gps, scale)


def no_gps(spark):
    return spark.createDataFrame([], "session_id string, row_idx long, t_ms long, valid boolean")


def summary(spark, imu, cfg=AuditConfig(), scale=(None, None, None)):
    return {r.session_id: r for r in audit.audit_summary(imu, described(imu, scale=scale), no_gps(spark), cfg).collect()}


def test_clean_session_passes(spark):
    row = summary(spark, recording(spark))["s"]
    assert (row.trust_score, row.status, row.window_count, row.reason_codes) == (1.0, "pass", 4, [])
    assert row.skipped_checks == ["gps_unreliable"]


def test_sessions_without_windows(spark):
    row = summary(spark, recording(spark, 1))["s"]
    assert round(row.trust_score, 6) == 0.92 and row.status == "pass" and row.reason_codes == ["insufficient_static_segment"]


def test_faults_are_found(spark):
    n = 1000
    t = [10 * i + (300 if i >= 100 else 0) for i in range(n)]
    gx = [4.3 if 300 <= i <= 340 else 0.001 * (i % 3) for i in range(n)]
    mx = [42.0 * (8 if 500 <= i <= 560 else 1) for i in range(n)]
    dead = {c: [0.0 if 700 <= i <= 760 else v + 1e-3 * (i % 5) for i in range(n)] for c, v in (("ax", 0.0), ("ay", 0.0), ("az", 9.8), ("gy", 0.0), ("gz", 0.01))}
    gx = [0.0 if 700 <= i <= 760 else x for i, x in enumerate(gx)]
    row = summary(spark, recording(spark, n, t_ms=t, gx=gx, mx=mx, **dead), scale=(19.6, 4.36, 491.0))["s"]
    assert {"timing_bad", "clipping", "dropout", "mag_disturbed"} <= set(row.reason_codes) and row.trust_score < 0.8


def test_missing_rates_are_never_static(spark):
    row = summary(spark, recording(spark, gx=[None] * 1000, gy=[None] * 1000, gz=[None] * 1000))["s"]
    assert row.static_window_ratio == 0 and round(row.trust_score, 6) == round(1 - 0.08 / row.window_count, 6)


def test_packet_loss_lowers_the_score(spark):
    imu = recording(spark)
    lost = corruption.corrupt(imu, "packet_loss_5")
    assert lost.count() == 950
    assert summary(spark, lost)["s"].trust_score < summary(spark, imu)["s"].trust_score
    with pytest.raises(ValueError):
        corruption.corrupt(imu, "other")


def test_window_membership_is_closed(spark):
    imu = recording(spark, 3, step=2500).where("row_idx <= 2")
    wins = audit.sliding_windows(imu).where("t_ms = 5000").select("win_idx").collect()
    assert sorted(r.win_idx for r in wins) == [0, 1, 2]


def test_empty_tables(spark):
    imu = recording(spark, 2).where("false")
    assert audit.audit_summary(imu, described(imu), no_gps(spark)).count() == 0
    assert motion.accept_steps(motion.step_candidates(imu, 3)).count() == 0
    assert intervals.merge_intervals(imu.select("session_id", F.col("t_ms").alias("start_ms"), F.col("t_ms").alias("end_ms"))).count() == 0


def test_previous_row_crosses_buckets(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate((0, 5, 3_600_000, 9_000_000))], "session_id string, row_idx long, t_ms long")
    got = {r.t_ms: r.prev and r.prev.t_ms for r in sampling.with_previous(rows, ["t_ms"]).collect()}
    assert got == {0: None, 5: 0, 3_600_000: 5, 9_000_000: 3_600_000}


def test_sessions_cut_into_cells(spark):
    """Numbers, sums and maxima over cells of any width are those of one window over the session."""
    r = np.random.default_rng(8)
    rows = [(s, i, int(t), float(v) if v > -1 else None) for s in "ab" for i, (t, v) in enumerate(zip(np.sort(r.integers(0, 500, 300)), r.normal(size=300)))]
    df = spark.createDataFrame(rows, "session_id string, row_idx long, t_ms long, v double")
    along = Window.partitionBy("session_id").orderBy("t_ms", "row_idx")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cell = F.floor(F.col("t_ms") / 37)
    got = sampling.numbered(df, "n", cell=cell, total="size")
    got = sampling.running_sums(got, {"s": F.col("v")}, cell=cell)
    got = sampling.running_max(got, F.col("v"), "top", cell=cell)
    want = df.withColumns({"n": F.row_number().over(along) - 1, "size": F.lit(300), "s": F.coalesce(F.sum("v").over(so_far), F.lit(0.0)), "top": F.max("v").over(so_far)})
    pick = lambda d: sorted((x.session_id, x.row_idx, x.n, x.size, round(x.s, 9), x.top) for x in d.collect())
    assert pick(got) == pick(want)
    dealt, block = sampling.in_blocks(df, 3, 2, block=10)
    means = sampling.own_rows(dealt.withColumn("m", F.avg("v").over(block.rowsBetween(-3, 2))))
    plain = df.withColumn("m", F.avg("v").over(along.rowsBetween(-3, 2)))
    pick = lambda d: sorted((x.session_id, x.row_idx, x.m) for x in d.collect())
    assert pick(means) == pick(plain) and means.columns == [*df.columns, "m"]


def test_copies_are_those_of_each_preset(spark):
    imu = recording(spark, 300).unionByName(recording(spark, 100, "other"))
    every = corruption.all_presets(imu)
    for preset in corruption.PRESETS:
        got = every.where(F.col("preset") == preset).drop("preset")
        want = corruption.corrupt(imu, preset).withColumn("session_id", corruption.corrupted_id(F.col("session_id"), preset)).select(*got.columns)
        assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()
    assert every.where("preset = 'clean'").drop("preset").exceptAll(imu).isEmpty()


def test_facts_of_one_pass(spark):
    imu = recording(spark, 400, t_ms=[10 * i + (500 if i > 200 else 0) for i in range(400)]).unionByName(recording(spark, 1, "single"))
    got = {r.session_id: r for r in sampling.session_facts(imu).collect()}
    for part in (sampling.sampling_stats(imu), sampling.gap_ratio(imu), sampling.freeze_ratio(imu)):
        for row in part.collect():
            assert all(row[c] == got[row.session_id][c] for c in part.columns if c in got[row.session_id] and c != "session_id")
    assert got["s"].gap_count == 1 and got["single"].dropout_ratio is None and got["single"].freeze_ratio == 0
    dt = [10.0] * 398 + [510.0]
    assert math.isclose(got["s"].jitter_ms, np.std(dt)) and got["s"].median_dt_ms == 10


def test_intervals(spark):
    i = spark.createDataFrame([("s", 0, 10), ("s", 10, 20), ("s", 21, 30), ("s", 22, 25)], "session_id string, start_ms long, end_ms long")
    merged = intervals.merge_intervals(i)
    assert sorted((r.start_ms, r.end_ms) for r in merged.collect()) == [(0, 20), (21, 30)]
    rows = spark.range(0, 40).select(F.lit("s").alias("session_id"), F.col("id").alias("t_ms"))
    assert sorted(r.t_ms for r in intervals.drop_intervals(rows, merged, cell_ms=7).collect()) == list(range(31, 40))


def test_asof_against_brute_force(spark):
    rng = np.random.default_rng(5)
    left = sorted(rng.integers(0, 900, 60).tolist())
    right = sorted(rng.integers(0, 900, 40).tolist())
    a = spark.createDataFrame([("s", i, t) for i, t in enumerate(left)], "session_id string, row_idx long, t_ms long")
    b = spark.createDataFrame([("s", i, t, float(i)) for i, t in enumerate(right)], "session_id string, row_idx long, t_ms long, v double")
    got = {r.row_idx: (r.matched.t_ms, r.matched.v) for r in asof.nearest(a, b, 20, ["v"], cell_ms=100).collect()}
    want = {}
    for i, t in enumerate(left):
        gap, _, at, j = min((abs(t - u), u > t, u, -j) for j, u in enumerate(right))
        if gap <= 20:
            want[i] = (at, float(-j))
    assert got == want


def test_units_and_text(spark):
    row = spark.range(1).select(
        X.time_ms(F.lit(2.5), "ms").alias("t"), X.pressure(F.lit(101.325), "kPa").alias("p"), X.temperature(F.lit(32.0), "F").alias("f"), X.angle(F.lit(180.0), "dps").alias("a"), X.slugify(F.lit("--A b!")).alias("s"), X.slugify(F.lit("!")).alias("e"), X.wrap_angle(F.lit(4.0)).alias("w"),
        X.nmea_degrees(F.lit("2948.20448"), F.lit("S")).alias("n"), X.nmea_degrees(F.lit(""), F.lit("N")).alias("x"),
    ).first()
    assert (row.t, row.p, row.f, row.s, row.e, row.x) == (2, 101325.0, 0.0, "a_b", "session", None)
    assert math.isclose(row.a, math.pi) and math.isclose(row.w, 4 - 2 * math.pi) and math.isclose(row.n, -(29 + 48.20448 / 60))
    with pytest.raises(ValueError):
        X.acceleration(F.lit(1.0), "furlong")


def test_tabular_round_trip(spark, tmp_path):
    path = str(tmp_path / "walk.csv")
    spark.createDataFrame([(20 * i, 0.0, 0.0, 1.0, 101.325, "walk", 0.1 * i, 0.0, 90.0) for i in range(200)], "time_ms long, ax_g double, ay_g double, az_g double, p double, activity string, x_m double, y_m double, h double").coalesce(1).write.option("header", True).csv(path)
    mapping = {
        "format": "csv",
        "imu": {"time_col": "time_ms", "time_unit": "ms", "acc_cols": ["ax_g", "ay_g", "az_g"], "acc_unit": "g", "pressure_col": "p", "pressure_unit": "kPa", "label_col": "activity"},
        "ground_truth": {"position_cols": ["x_m", "y_m"], "heading_col": "h", "heading_unit": "deg"},
    }
    frames = readers.ingest_tabular(spark, path, mapping, "walk")
    row = frames["imu"].where("t_ms = 0").first()
    assert math.isclose(row.az, 9.80665) and row.pressure_pa == 101325.0 and row.gx is None and frames["imu"].count() == 200
    readers.save_sessions(frames, str(tmp_path / "out"))
    assert readers.load_sessions(spark, str(tmp_path / "out"))["ground_truth"].where("session_id = 'walk'").count() == 200
    mapping["imu"]["acc_cols"][0] = "missing_ax"
    with pytest.raises(ValueError, match="Missing required columns"):
        readers.ingest_tabular(spark, path, mapping)


def test_mixed_log(spark):
    lines = ["calibration header", "\t".join(map(str, [100] + [1] * 9)), "GPS Data: $GPRMC,081836,A,2948.20448,N,12133.39414,E,000.0", "$GPVTG,x", "\t".join(map(str, [110] + [1] * 11))]
    frames = readers.parse_mixed_log(spark.createDataFrame(list(enumerate(lines)), "row_idx long, value string"))
    fix = frames["gps"].collect()
    assert frames["imu"].count() == 2 and len(fix) == 1 and fix[0].valid and fix[0].t_ms == 100


def test_filters_hold_still_and_turn(spark):
    n, hz = 400, 100.0
    acc = np.tile([0, 0, 9.80665], (n, 1))
    turn = np.tile([0, 0, 0.5], (n, 1))
    for method in ("madgwick", "mahony"):
        still = replay.orient(np.zeros((n, 3)), acc, None, hz, method)
        assert np.allclose(still, [1, 0, 0, 0], atol=1e-9)
        q = replay.orient(turn, acc, None, hz, method)
        assert np.allclose(np.linalg.norm(q, axis=1), 1) and abs(2 * np.arctan2(q[-1, 3], q[-1, 0]) - 0.5 * (n - 1) / hz) < 1e-3
        tilted = replay.orient(np.zeros((n, 3)), np.tile([0, 6.93, 6.93], (n, 1)), np.tile([30.0, 5, 20], (n, 1)), hz, method)
        assert np.allclose(tilted[0], tilted[-1], atol=1e-3)
        state = replay.Filter(hz, method)  # pieces of any size give what the whole gives
        pieces = [replay.orient(turn[i : i + 7], acc[i : i + 7], None, hz, method, state=state) for i in range(0, n, 7)]
        assert (np.concatenate(pieces) == q).all()
    assert replay.replay(recording(spark, 50), "mahony").count() == 50
    with pytest.raises(ValueError):
        replay.replay(recording(spark, 5), "kalman")


def test_steps_wait(spark):
    c = spark.createDataFrame([("s", t, t, 2.0) for t in (0, 100, 300, 350, 600)], "session_id string, row_idx long, t_ms long, dynamic double")
    assert sorted(r.t_ms for r in motion.accept_steps(c).collect()) == [0, 300, 600]


def test_steps_against_the_greedy_rule(spark):
    r = np.random.default_rng(3)
    times = np.unique(r.integers(0, 60_000, 900))
    rows = [(s, int(t), int(t), 2.0) for s in "ab" for t in times[:: 1 + (s == "b")]]
    got = {(x.session_id, x.t_ms) for x in motion.accept_steps(spark.createDataFrame(rows, "session_id string, row_idx long, t_ms long, dynamic double")).collect()}
    want, last = set(), {}
    for s, t, *_ in rows:
        if t - last.get(s, -(10**9)) >= 280:
            want.add((s, t))
            last[s] = t
    assert got == want


def test_rates_limits_and_metadata(spark, tmp_path):
    path = str(tmp_path / "turn.csv")
    spark.createDataFrame([(20 * i, 0.0, 0.0, 9.80665, 0.0, 0.0, 0.5, 0.01 * i) for i in range(300)], "t long, a double, b double, c double, d double, e double, f double, h double").coalesce(1).write.option("header", True).csv(path)
    mapping = {
        "format": "csv", "imu": {"time_col": "t", "acc_cols": ["a", "b", "c"], "acc_unit": "mps2", "gyro_cols": ["d", "e", "f"], "gyro_unit": "radps"}, "ground_truth": {"position_cols": ["a", "b"], "heading_col": "h"},
        "metadata": {"session_id": "turn", "task": "orientation", "subject_id": "p1", "extra": {"full_scale": {"acc_mps2": 9.9, "gyro_rads": 4.0}}},
    }
    frames = readers.ingest_tabular(spark, path, mapping)
    row = frames["sessions"].first()
    assert (row.session_id, row.nominal_hz, row.acc_limit, row.gyro_limit, row.mag_limit, row.subject_id, row.reference_type) == ("turn", 50.0, 9.9, 4.0, None, "p1", "trajectory")
    imu = replay.with_rate(frames["imu"], frames["sessions"])
    last = benchmark.replay_track(imu, "mahony").orderBy("t_ms").collect()[-1]
    assert abs(last.yaw - 0.5 * 299 / 50) < 0.02  # half of that at 100 Hz
    assert audit.audit_summary(frames["imu"], frames["sessions"], no_gps(spark)).first().clipping_ratio > 0.3
    metrics = {(r.baseline, r.metric): r.value for r in benchmark.benchmark(imu, frames["ground_truth"], "orientation").collect()}
    assert metrics.keys() == {(b, m) for b in ("madgwick", "mahony") for m in ("path_smoothness", "heading_drift_rad")} and max(v for (_, m), v in metrics.items() if m == "heading_drift_rad") < 0.05
    walked = {r.metric: r.value for r in benchmark.benchmark(imu, frames["ground_truth"], "pdr").collect()}
    assert walked["step_count"] == 0 and walked["trajectory_rmse_m"] == 0
    with pytest.raises(ValueError, match="turn has 300"):
        benchmark.enforce_row_limit(imu, 299, "replay")
    with pytest.raises(ValueError, match="activity_label"):
        benchmark.benchmark(imu, None, "har")


def test_positional_files_and_detection(spark, tmp_path):
    (tmp_path / "imu1.csv").write_text("\n".join(f"{i / 50},0,0,0,0,0,0,0,0,1,0.1,0,0,30,0,5" for i in range(60)))
    (tmp_path / "vi1.csv").write_text("\n".join(f"{i / 50},0,{i},{0.3 * i},0,0,0,0,0" for i in range(60)))
    frames = readers.ingest_positional(spark, str(tmp_path))
    assert frames["imu"].count() == frames["ground_truth"].count() == 60 and abs(frames["imu"].first().az - 9.80665) < 1e-9
    assert readers.detect(str(tmp_path)) == "positional" and readers.detect("x.parquet") == "tabular" and readers.detect("a.h5") == "hdf5"
    assert readers.resolve_log(str(tmp_path)).endswith("imu1.csv")


def test_presets_without_metrics_are_a_limitation(spark):
    rows = spark.createDataFrame([("s__a", "clean", 0.9), ("s__a", "axis_flip_x", 0.8), ("s__a", "mag_bias_30ut", 0.9)], "base_id string, preset string, trust_score double")
    deltas = compare.preset_deltas(spark.createDataFrame([("s__a", "clean", "pdr", "step_count", 3.0), ("s__a", "axis_flip_x", "pdr", "step_count", 5.0)], "base_id string, preset string, baseline string, metric string, value double"))
    assert [r.delta for r in deltas.collect()] == [2.0]
    row = compare.validation_summary(compare.validate(rows), deltas).first()
    assert row.all_non_improving and [t.split()[0] for t in row.known_limitations] == ["mag_bias_30ut"] * 2
    ids = spark.createDataFrame([("a__b",), ("a__b__axis_flip_x",)], "session_id string")
    assert sorted(tuple(r)[1:] for r in corruption.base_and_preset(ids).collect()) == [("a__b", "axis_flip_x"), ("a__b", "clean")]


def test_directions_and_gate(spark):
    names = ["trajectory_rmse", "macro_f1", "loss_ratio", "step_count"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "m string").select(compare.metric_direction(F.col("m"))).collect()]
    assert got == ["lower_is_better", "higher_is_better", "lower_is_better", "unknown"]
    row = spark.range(1).select(*[compare.gate_fails(F.lit(r), F.lit(d), m).alias(f"c{i}") for i, (r, d, m) in enumerate([("regressed", -0.1, "never"), ("regressed", 0.0, "regression"), ("mixed", 0.0, "regression"), ("mixed", 0.0, "mixed")])]).first()
    assert list(row) == [False, True, False, True]


def test_features_and_forest(spark):
    imu = recording(spark, 600)
    imu = imu.withColumn("activity_label", F.when(F.col("row_idx") < 300, "sit").otherwise("walk")).withColumn("ax", F.when(F.col("row_idx") < 300, F.col("ax")).otherwise(5.0 + F.col("ax")))
    features = har.har_features(imu, *har.window_size(25.0))
    assert features.count() == 23 and len(har.FEATURES) == 34
    assert har.classification_metrics(har.forest_benchmark(features)).first().accuracy > 0.7
    with pytest.raises(ValueError, match="Not enough"):
        har.forest_benchmark(features.limit(3))


def test_normalise(spark):
    row = normalise(spark.createDataFrame([("s", 1, float("nan"))], "session_id string, t_ms long, lat double"), GPS).first()
    assert (row.session_id, row.lat, row.valid, row.raw_sentence) == ("s", None, False, "")
