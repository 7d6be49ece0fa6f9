"""Command line over folders of sessions: python -m gyrolens.cli COMMAND. Exit codes: 0 fine, 1 a gate failed, 2 an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolens.config import AuditConfig
from gyrolens.functions.expressions import status
from gyrolens.operators import audit, benchmark, compare, corruption, replay
from gyrolens.plans import artifacts
from gyrolens.sources import readers

HINTS = (("Missing required columns", "Check the column names of the mapping."), ("PATH_NOT_FOUND", "Check the path."), ("Unsupported", "See --help for what is supported."))


def _frames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = readers.load_sessions(spark, root)
    imu = found["imu"]
    gps = found.get("gps", spark.createDataFrame([], "session_id string, row_idx long, t_ms long, valid boolean"))
    return imu, found.get("sessions", readers.describe_sessions(imu, gps)), gps


def _rated(spark: SparkSession, root: str) -> DataFrame:
    """Rows with their session's nominal rate."""
    imu, sessions, _ = _frames(spark, root)
    return replay.with_rate(imu, sessions if "nominal_hz" in sessions.columns else readers.describe_sessions(imu))


def _audit(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, windows and summary. Windows and sessions feed several artifacts, so they are kept (and spill to disk)."""
    imu, sessions, gps = _frames(spark, root)
    sessions = sessions.persist()
    windows = audit.audit_windows(imu, sessions, gps).persist()
    return imu, windows, audit.audit_summary(imu, sessions, gps, windows=windows).persist()


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "ingest":
        with open(args.mapping) as f:
            text = f.read()
        mapping = json.loads(text) if args.mapping.endswith(".json") else __import__("yaml").safe_load(text)
        readers.save_sessions(readers.ingest_tabular(spark, args.source, mapping), args.out)
        artifacts.dump_json(spark, f"{args.out}/ingest_summary.json", readers.preflight(spark, args.source, mapping))
        return 0
    imu, windows, summary = _audit(spark, args.root)  # lazy: commands that don't read it never run it
    if args.command == "audit":
        batch = artifacts.save_batch(spark, summary, args.out)
        audit.window_issues(windows).write.mode("overwrite").json(f"{args.out}/issues")
        summary.write.mode("overwrite").json(f"{args.out}/audit_summary")
        if args.warning_below is not None or args.fail_below is not None:  # statuses of the gate, beside those of the audit
            gate = status(F.col("trust_score"), args.warning_below if args.warning_below is not None else AuditConfig().warning, args.fail_below if args.fail_below is not None else AuditConfig().fail)
            summary.select("session_id", "trust_score", gate.alias("status")).write.mode("overwrite").json(f"{args.out}/gate")
        print(artifacts.format_summary({k: batch[k] for k in ("session_count", "counts", "worst", "best")}, args.format))
        return int(args.fail_below is not None and any(r["trust_score"] < args.fail_below for r in batch["rows"]))
    if args.command == "export":
        artifacts.dump_json(spark, f"{args.out}.summary.json", artifacts.export_sessions(imu, windows, args.out, args.profile, args.format, args.threshold, tuple(args.code)))
    elif args.command == "report":
        found, done = readers.load_sessions(spark, args.root), artifacts.load_corruption(spark, args.root)
        extras = artifacts.Extras(found.get("gps"), found.get("ground_truth"), {p: artifacts.load_replay(spark, p) for p in args.replay}, [artifacts.load_benchmark(spark, p) for p in args.benchmark], done, artifacts.load_source_audit(spark, args.source_audit) if args.source_audit else None)
        artifacts.write_text(spark, args.out, artifacts.session_report(args.session, summary, windows, audit.window_issues(windows), imu, args.redact, extras=extras))
    elif args.command == "compare":
        one = lambda s: summary.where(F.col("session_id") == s)
        pair = compare.compare_sessions(one(args.a).withColumn("pair", F.lit(1)), one(args.b).withColumn("pair", F.lit(1)), ["pair"])
        row = pair.withColumn("fails", compare.gate_fails(F.col("recommendation"), F.col("trust_delta"), args.fail_on, args.trust_drop_threshold)).first().asDict()
        if args.redact:
            row = {k: "-" if k in ("session_a", "session_b", "subject_id", "source_path") else v for k, v in row.items()}
        artifacts.write_text(spark, args.out, artifacts.compare_report(row))
        if args.json_out:
            artifacts.dump_json(spark, args.json_out, {"artifact_type": "compare_report"} | row)
        print(artifacts.format_summary(row, args.format))
        return int(row["fails"])
    elif args.command == "corrupt":
        readers.save_sessions(corruption.corrupt_frames(readers.load_sessions(spark, args.root), args.preset), args.out)
        artifacts.dump_json(spark, f"{args.out}/{artifacts.CORRUPTION}", corruption.corruption_summary(args.preset, args.root, args.out))
    elif args.command == "replay":
        benchmark.replay_track(_rated(spark, args.root), args.baseline).write.mode("overwrite").partitionBy("session_id").parquet(args.out)
    elif args.command == "benchmark":
        metrics = benchmark.benchmark(_rated(spark, args.root), readers.load_sessions(spark, args.root).get("ground_truth"), args.task).persist()
        metrics.write.mode("overwrite").json(f"{args.out}/metrics")
        benchmark.primary_metric(metrics, *benchmark.PRIMARY[args.task]).write.mode("overwrite").json(f"{args.out}/primary")
    elif args.command == "validate-trustscore":
        _, sessions, gps = _frames(spark, args.root)
        # Corrupted copies keep their session's sensors, limits and GPS; only the rows change. They are written once, for the audit reads them often.
        copies = {"imu": corruption.all_presets(imu).drop("preset"), "sessions": corruption.copies_of(sessions), "gps": corruption.copies_of(gps)}
        if truth := readers.load_sessions(spark, args.root).get("ground_truth"):
            copies["ground_truth"] = corruption.copies_of(truth)
        for name, df in copies.items():
            df.write.mode("overwrite").parquet(f"{args.out}/copies/{name}")
            copies[name] = spark.read.schema(df.schema).parquet(f"{args.out}/copies/{name}")
        scored = corruption.base_and_preset(audit.audit_summary(copies["imu"], copies["sessions"], copies["gps"], AuditConfig.in_memory()))
        rows = compare.validate(scored).persist()
        rows.write.mode("overwrite").json(f"{args.out}/presets")
        rated = replay.with_rate(copies["imu"], copies["sessions"] if "nominal_hz" in copies["sessions"].columns else readers.describe_sessions(copies["imu"]))
        benchmark.validation_metrics(rated, copies["sessions"], copies.get("ground_truth")).write.mode("overwrite").parquet(f"{args.out}/metrics")
        deltas = compare.preset_deltas(corruption.base_and_preset(spark.read.parquet(f"{args.out}/metrics"))).withColumn("metric", F.concat_ws("_", "baseline", "metric"))
        deltas.write.mode("overwrite").json(f"{args.out}/metric_deltas")
        compare.delta_stats(deltas, "base_id").write.mode("overwrite").json(f"{args.out}/metric_stats")
        sessions_found = compare.validation_summary(rows, deltas).persist()
        sessions_found.write.mode("overwrite").json(f"{args.out}/sessions")
        counts = sessions_found.agg(F.count(F.lit(1)).alias("session_count"), F.count_if("all_non_improving").alias("non_improving_count")).first()
        artifacts.dump_json(spark, f"{args.out}/validation.json", {"artifact_type": "batch_trustscore_validation"} | counts.asDict())
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gyrolens", description="Quality assurance of sensor sessions.")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *options, root=True):
        c = sub.add_parser(name)
        if root:
            c.add_argument("root")
        for flags, more in options:
            c.add_argument(*flags, **more)
        c.add_argument("--out", required=True)

    form = (["--format"], {"default": "text", "choices": ("text", "markdown", "json")})
    command("ingest", (["source"], {}), (["--mapping"], {"required": True}), root=False)
    command("audit", (["--fail-below"], {"type": float}), (["--warning-below"], {"type": float}), form)
    command("export", (["--profile"], {"default": "canonical"}), (["--format"], {"default": "parquet"}), (["--threshold"], {"type": float, "default": AuditConfig().warning}), (["--code", "--reason-code"], {"action": "append", "default": [], "dest": "code"}))
    several = {"action": "append", "default": []}
    command("report", (["--session"], {"required": True}), (["--redact"], {"action": "store_true"}), (["--replay"], several), (["--benchmark"], several), (["--source-audit"], {}))
    command("compare", (["a"], {}), (["b"], {}), (["--fail-on"], {"default": "never", "choices": ("never", "regression", "mixed")}), (["--trust-drop-threshold"], {"type": float, "default": compare.THRESHOLD}), (["--json-out"], {}), (["--redact"], {"action": "store_true"}), form)
    command("corrupt", (["--preset"], {"required": True, "choices": corruption.PRESETS}))
    command("replay", (["--baseline"], {"default": "madgwick", "choices": benchmark.BASELINES}))
    command("benchmark", (["--task"], {"required": True, "choices": tuple(benchmark.PRIMARY)}))
    command("validate-trustscore")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(spark or SparkSession.builder.appName("gyrolens").getOrCreate(), args)
    except Exception as e:  # the command line reports, it doesn't trace
        print(f"error: {str(e).splitlines()[0]}", *[hint for sign, hint in HINTS if sign in str(e)], file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
