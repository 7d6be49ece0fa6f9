"""Command line, artifacts and the streaming twin."""

import json

import pytest
from pyspark.sql import functions as F

from gyrolens import cli
from gyrolens.operators import audit
from gyrolens.plans import artifacts
from gyrolens.sources import readers
from gyrolens.streaming.audit_stream import stream_windows
from tests.test_engine import recording


def test_commands(spark, tmp_path):
    root, out = str(tmp_path / "sessions"), str(tmp_path / "out")
    good, bad = recording(spark, 800, "good"), recording(spark, 800, "bad", t_ms=[10 * i + 9 * (i % 2) for i in range(800)])
    readers.save_sessions({"imu": good.unionByName(bad)}, root)
    assert cli.main(["audit", root, "--out", out], spark) == 0
    batch = json.loads((tmp_path / "out" / "batch_summary.json").read_text())
    assert batch["worst"] == "bad" and batch["session_count"] == 2 and (tmp_path / "out" / "batch_rankings.csv").exists()
    assert cli.main(["audit", root, "--out", out, "--fail-below", "0.9"], spark) == 1
    assert cli.main(["export", root, "--out", str(tmp_path / "x"), "--profile", "other"], spark) == 2
    assert cli.main(["export", root, "--out", str(tmp_path / "x"), "--profile", "qa_filtered", "--format", "csv", "--threshold", "0.95"], spark) == 0
    kept = json.loads((tmp_path / "x.summary.json").read_text())
    assert kept["rows_in"] == 1600 and kept["rows_kept"] == 800 and kept["reason_counts"]["timing_bad"] > 0
    assert cli.main(["compare", root, "good", "bad", "--fail-on", "regression", "--out", str(tmp_path / "c.html")], spark) == 1
    assert cli.main(["report", root, "--session", "bad", "--out", str(tmp_path / "r.html")], spark) == 0
    assert "Irregular timing" in (tmp_path / "r.html").read_text()
    assert cli.main(["compare", root, "good", "bad", "--fail-on", "regression", "--trust-drop-threshold", "0.9", "--json-out", str(tmp_path / "c.json"), "--out", str(tmp_path / "c.html")], spark) in (0, 1)
    assert json.loads((tmp_path / "c.json").read_text())["recommendation"]
    assert cli.main(["replay", root, "--baseline", "pdr", "--out", str(tmp_path / "pdr")], spark) == 0 and spark.read.parquet(str(tmp_path / "pdr")).count() == 1600
    assert cli.main(["benchmark", root, "--task", "pdr", "--out", str(tmp_path / "bench")], spark) == 0
    assert {r.primary_metric_name for r in spark.read.json(str(tmp_path / "bench" / "primary")).collect()} == {"step_count"}
    assert cli.main(["validate-trustscore", root, "--out", str(tmp_path / "v")], spark) == 0
    assert json.loads((tmp_path / "v" / "validation.json").read_text())["session_count"] == 2
    stats = {r.metric: r.preset_count for r in spark.read.json(str(tmp_path / "v" / "metric_stats")).where("base_id = 'good'").collect()}
    assert stats == {f"{b}_path_smoothness": 5 for b in ("replay_madgwick", "benchmark_madgwick", "benchmark_mahony")}
    assert not any("metric" in t for r in spark.read.json(str(tmp_path / "v" / "sessions")).collect() for t in r.known_limitations)
    assert audit.load_issues(spark, f"{out}/issues").where("code = 'timing_bad'").count() > 0


def test_report_shows_what_there_is(spark, tmp_path):
    root, twin = str(tmp_path / "sessions"), str(tmp_path / "twin")
    imu = recording(spark, 800, "good")
    gps = spark.range(0, 8).select(F.lit("good").alias("session_id"), F.col("id").alias("row_idx"), (F.col("id") * 1000).alias("t_ms"), (F.col("id") / 9).alias("lat"), (F.col("id") / 7).alias("lon"), (F.col("id") != 3).alias("valid"))
    truth = spark.range(0, 80).select(F.lit("good").alias("session_id"), F.col("id").alias("row_idx"), (F.col("id") * 100).alias("t_ms"), (F.col("id") / 9).alias("x"), (F.col("id") / 7).alias("y"), F.lit(0.1).alias("heading"))
    readers.save_sessions({"imu": imu, "gps": gps, "ground_truth": truth, "sessions": readers.describe_sessions(imu, gps)}, root)
    assert cli.main(["corrupt", root, "--preset", "packet_loss_5", "--out", twin], spark) == 0
    done = artifacts.load_corruption(spark, twin)
    assert done["preset"] == "packet_loss_5" and done["source"] == root and artifacts.load_corruption(spark, root) is None
    frames = readers.load_sessions(spark, twin)
    assert frames.keys() == {"imu", "gps", "ground_truth", "sessions"} and {r.session_id for f in frames.values() for r in f.select("session_id").distinct().collect()} == {"good__packet_loss_5"}
    assert frames["imu"].count() == 760 and frames["sessions"].first().corruption == "packet_loss_5"
    assert cli.main(["audit", root, "--out", str(tmp_path / "a")], spark) == 0
    assert cli.main(["replay", twin, "--baseline", "pdr", "--out", str(tmp_path / "walk")], spark) == 0
    assert cli.main(["benchmark", twin, "--task", "orientation", "--out", str(tmp_path / "bench")], spark) == 0
    wanted = ["--replay", str(tmp_path / "walk"), "--benchmark", str(tmp_path / "bench"), "--source-audit", str(tmp_path / "a")]
    assert cli.main(["report", twin, "--session", "good__packet_loss_5", *wanted, "--out", str(tmp_path / "r.html")], spark) == 0
    text = (tmp_path / "r.html").read_text()
    for part in ("GPS track", "Replay walk: heading", "path, with the truth", "heading_drift_rad", "<rect", "score before", "A twentieth of the rows is lost."):
        assert part in text, part
    assert cli.main(["report", root, "--session", "good", "--out", str(tmp_path / "p.html")], spark) == 0 and "Corruption" not in (tmp_path / "p.html").read_text()
    assert cli.main(["report", root, "--session", "nobody", "--out", str(tmp_path / "n.html")], spark) == 2


def test_downsample_is_even(spark):
    rows = spark.range(0, 1000).select(F.lit("s").alias("session_id"), F.col("id").alias("t_ms"), F.col("id").alias("row_idx"))
    got = sorted(r.t_ms for r in artifacts.downsample(rows, 7).collect())
    assert got == [int(j * 999 / 6) for j in range(7)] and artifacts.downsample(rows, 2000).count() == 1000


def test_stream_equals_batch(spark, tmp_path):
    n = 2500
    late = [10 * i + 4 * (i % 3 == 1) + 300 * (i > 1200) for i in range(n)]
    frozen = [0.2 if 300 < i < 500 else 0.1 * (i % 7) for i in range(n)]
    imu = recording(spark, n, t_ms=late, ax=frozen, gz=[0.01 if 300 < i < 500 else 0.02 * (i % 3) for i in range(n)], mx=[42.0 + 30 * (i % 2) * (i > 1500) for i in range(n)])
    sessions, checks = readers.describe_sessions(imu, None, (1.0, 4.0, 90.0)), audit.gps_checks(imu, spark.createDataFrame([], "session_id string, row_idx long, t_ms long, valid boolean"))
    want = {r.win_idx: r.asDict() for r in audit.window_penalties(audit.window_metrics(imu, sessions), sessions, checks).collect()}
    assert any(r["reason_codes"] for r in want.values()) and len({r["trust_score"] for r in want.values()}) >= 3
    imu.withColumn("t0", F.lit(0).cast("long")).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    for mode, name in (("update", "streamed"), ("append", "closed")):
        query = stream_windows(stream, sessions, checks).writeStream.outputMode(mode).format("memory").queryName(name).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        got = {r.win_idx: r.asDict() for r in spark.table(name).collect()}
        # In append mode windows come when the watermark, ten seconds behind the last window's end, has passed them.
        closed = max(want) * 2500 + 5000 - 10000
        assert got.keys() == ({w for w in want if w * 2500 + 5000 <= closed} if mode == "append" else want.keys()) and got
        for w, row in got.items():
            for key, value in want[w].items():
                assert row[key] == pytest.approx(value, abs=1e-9) if isinstance(value, float) else row[key] == value, (w, key)
