"""Sinks and reports: exports, batch and compare artifacts, HTML pages with inline SVG.

Data goes out through Spark's writers. Only summaries (a row for each session) and at most ``max_points`` points a plot come to the driver.
"""

from __future__ import annotations

import csv
import html
import io
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolens.config import ARTIFACT_SCHEMA_VERSION, AuditConfig
from gyrolens.functions.expressions import norm
from gyrolens.operators import benchmark, compare, intervals, sampling

#: Labels and advice for each reason code.
REASONS = {
    "timing_bad": ("Irregular timing", "Check the clock and the logging load."),
    "dropout": ("Lost or frozen samples", "Check the transport and the sensor driver."),
    "clipping": ("Signal at full scale", "Raise the range or lower the excitation."),
    "gyro_bias_drift": ("Drifting gyro bias", "Calibrate again and let the device warm up."),
    "mag_disturbed": ("Disturbed magnetic field", "Keep away from metal and currents."),
    "gps_unreliable": ("Unreliable GPS", "Record under open sky, for the whole session."),
    "insufficient_static_segment": ("Too little rest", "Begin and end sessions at rest."),
    "pressure_unstable": ("Unstable pressure", "Shield the barometer from wind and doors."),
    "orientation_inconsistent": ("Gravity does not fit", "Check scale and mounting."),
}


def write_text(df_spark, path: str, text: str) -> None:
    """Writes one small file to any file system Spark knows."""
    jvm = df_spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(df_spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def dump_json(spark, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=2, default=str) + "\n")


def export_sessions(imu: DataFrame, windows: DataFrame, path: str, profile: str = "canonical", kind: str = "parquet", threshold: float = 0.8, codes: tuple[str, ...] = ()) -> dict:
    """Writes sessions whole, or without the windows that fail (qa_filtered), and returns the export summary."""
    if profile not in ("canonical", "qa_filtered"):
        raise ValueError(f"Unsupported export profile: {profile}")
    if kind not in ("csv", "parquet"):
        raise ValueError(f"Unsupported export format: {kind}")
    dropped = intervals.select_windows(windows, threshold, codes)
    out = imu if profile == "canonical" else intervals.drop_intervals(imu, intervals.merge_intervals(dropped.select("session_id", "start_ms", "end_ms")))
    writer = out.write.mode("overwrite").partitionBy("session_id")
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(path)
    n, kept = imu.count(), (imu if profile == "canonical" else out).count()
    reasons = {} if profile == "canonical" else {r["code"]: r["n"] for r in intervals.reason_counts(dropped).orderBy("code").collect()}
    return {
        "artifact_type": "export_summary", "artifact_schema_version": ARTIFACT_SCHEMA_VERSION, "profile": profile, "format": kind, "rows_in": n, "rows_kept": kept, "rows_removed": n - kept,
        "kept_ratio": kept / n if n else 0.0, "dropped_windows": 0 if profile == "canonical" else dropped.count(), "reason_counts": reasons, "written_files": out.sparkSession.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).count(),
        "coverage_by_reason": {code: k / max(1, sum(reasons.values())) for code, k in reasons.items()},
    }


def batch_summary(summary: DataFrame) -> dict:
    rows = [r.asDict() for r in compare.rank_sessions(summary).select("rank", "session_id", "trust_score", "status", "reason_codes").orderBy("rank").collect()]
    counts = {s: sum(r["status"] == s for r in rows) for s in ("pass", "warning", "fail")}
    top = {r["code"]: r["n"] for r in compare.reason_frequency(summary).collect()}
    return {"artifact_type": "batch_summary", "artifact_schema_version": ARTIFACT_SCHEMA_VERSION, "session_count": len(rows), "counts": counts, "rows": rows, "top_reason_codes": top, "worst": rows[0]["session_id"] if rows else None, "best": rows[-1]["session_id"] if rows else None}


def save_batch(spark, summary: DataFrame, path: str) -> dict:
    """batch_summary.json (also under its older name), batch_rankings.csv and batch_report.html."""
    batch = batch_summary(summary)
    for name in ("batch_summary.json", "batch_audit_summary.json"):
        dump_json(spark, f"{path}/{name}", batch)
    lines = io.StringIO()
    sheet = csv.writer(lines, lineterminator="\n")
    sheet.writerows([("rank", "session_id", "trust_score", "status", "reason_codes"), *((r["rank"], r["session_id"], r["trust_score"], r["status"], "|".join(r["reason_codes"])) for r in batch["rows"])])
    write_text(spark, f"{path}/batch_rankings.csv", lines.getvalue())
    write_text(spark, f"{path}/batch_report.html", page("Batch audit", [("Status", table(["status", "sessions"], batch["counts"].items())), ("Ranking, worst first", table(["rank", "session", "score", "status", "reasons"], [(r["rank"], r["session_id"], f"{r['trust_score']:.3f}", r["status"], ", ".join(r["reason_codes"])) for r in batch["rows"]]))]))
    return batch


def downsample(df: DataFrame, max_points: int = 1200) -> DataFrame:
    """Evenly spread rows of each session, in time order: all of them if there are no more than max_points."""
    rows = sampling.numbered(df, "__i", total="__n")
    # Row i is taken if some j has floor(j * (n - 1) / (max - 1)) = i.
    j = F.ceil(F.col("__i") * (max_points - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    taken = (F.col("__n") <= max_points) | (F.floor(j * (F.col("__n") - 1) / (max_points - 1)) == F.col("__i"))
    return rows.where(taken).drop("__n", "__i")


def table(head, rows) -> str:
    cell = lambda tag, v: f"<{tag}>{html.escape(str(v))}</{tag}>"
    return "<table><tr>" + "".join(cell("th", h) for h in head) + "</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r) + "</tr>" for r in rows) + "</table>"


def svg_lines(*lines: list[tuple[float, float]], width: int = 800, height: int = 160) -> str:
    """Polylines in one box, scaled to all of their points; those of fewer than two points are left out."""
    lines = tuple(points for points in lines if len(points) > 1)
    if not lines:
        return "<svg/>"
    (x0, x1), (y0, y1) = ((min(p[i] for points in lines for p in points), max(p[i] for points in lines for p in points)) for i in (0, 1))
    at = lambda points: " ".join(f"{(x - x0) / ((x1 - x0) or 1) * width:.1f},{height - (y - y0) / ((y1 - y0) or 1) * height:.1f}" for x, y in points)
    drawn = "".join(f'<polyline class="line{n}" points="{at(points)}"/>' for n, points in enumerate(lines))
    return f'<svg viewBox="0 0 {width} {height}">{drawn}</svg>'


def svg_line(points: list[tuple[float, float]], width: int = 800, height: int = 160) -> str:
    """A polyline scaled to its box; empty for fewer than two points."""
    return svg_lines(points, width=width, height=height)


def svg_bars(values: list[tuple[str, float]], width: int = 800, bar: int = 22) -> str:
    """A bar for each named value, from 0."""
    top = max((abs(v) for _, v in values), default=0) or 1
    rows = "".join(f'<rect x="0" y="{i * bar}" width="{abs(v) / top * width * 0.7:.1f}" height="{bar - 6}"/><text x="{abs(v) / top * width * 0.7 + 6:.1f}" y="{i * bar + bar - 10}">{html.escape(n)} {v:.4g}</text>' for i, (n, v) in enumerate(values))
    return f'<svg viewBox="0 0 {width} {max(1, len(values)) * bar}">{rows}</svg>'


#: Look of all pages: lines and statuses by colour.
STYLE = (
    ":root{--ink:#1d2733;--line:#24567f;--second:#b5651d;--soft:#eef2f6}body{font:15px sans-serif;color:var(--ink);max-width:60em;margin:2em auto}h2{border-bottom:1px solid #ccd}"
    "table{border-collapse:collapse}td,th{border:1px solid #ccd;padding:.2em .6em;text-align:left}th{background:var(--soft)}svg{width:100%}polyline{fill:none;stroke:var(--line)}polyline.line1{stroke:var(--second)}"
    "rect{fill:var(--line)}text{font-size:12px}.badge{padding:.1em .6em;border-radius:.6em;color:#fff}.pass{background:#2d7d46}.warning{background:#a87112}.fail{background:#a33}"
)


def badge(status: str) -> str:
    return f'<span class="badge {html.escape(status)}">{html.escape(status)}</span>'


def page(title: str, sections: list[tuple[str, str]]) -> str:
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><style>{STYLE}</style><h1>{html.escape(title)}</h1>" + "".join(f"<h2>{html.escape(h)}</h2>{body}" for h, body in sections)


#: The file beside corrupted sessions that says what was done to them.
CORRUPTION = "corruption.json"


def load_corruption(spark, root: str) -> dict | None:
    """What corruption_summary said of these sessions; None where nothing was done to them."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{CORRUPTION}")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return json.loads(spark.read.text(f"{root}/{CORRUPTION}", wholetext=True).first()[0])


def load_replay(spark, path: str) -> DataFrame:
    """A track that ``replay`` wrote."""
    return spark.read.parquet(path)


def load_benchmark(spark, path: str) -> DataFrame:
    """Metrics that ``benchmark`` wrote."""
    return spark.read.schema("session_id string, baseline string, metric string, value double").json(f"{path}/metrics")


def load_source_audit(spark, path: str) -> DataFrame:
    """Scores that ``audit`` wrote of the sessions that were corrupted."""
    return spark.read.schema("session_id string, trust_score double, status string, reason_codes array<string>").json(f"{path}/audit_summary")


@dataclass(frozen=True)
class Extras:
    """What a report shows if it is there: fixes, truth, tracks by name, benchmark metrics, what was done to the sessions and the audit before that."""

    gps: DataFrame | None = None
    truth: DataFrame | None = None
    replays: dict[str, DataFrame] = field(default_factory=dict)
    metrics: list[DataFrame] = field(default_factory=list)
    corruption: dict | None = None
    source_audit: DataFrame | None = None


def _points(df: DataFrame, x: str, y: str, max_points: int) -> list[tuple[float, float]]:
    """At most max_points of df's rows with both values, in time order."""
    rows = downsample(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), max_points)
    return [(r.x, r.y) for r in rows.orderBy("t_ms", "row_idx").select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).collect()]


def _next_step(row: dict) -> str:
    codes = [c for c in row["reason_codes"] if c in REASONS]
    if codes:
        return REASONS[codes[0]][1]
    return {"pass": "Ready for comparison, ranking and export.", "fail": "Keep out of baselines; record again and audit anew."}.get(row["status"], "Look at the issues before using this session as a reference.")


def _extra_sections(session_id: str, row: dict, extras: Extras, redact: bool, max_points: int) -> list[tuple[str, str]]:
    of = lambda df: df.where(F.col("session_id") == session_id)
    sections = []
    if extras.gps is not None and {"lat", "lon"} <= set(extras.gps.columns) and (fixes := _points(of(extras.gps).where("valid"), "lon", "lat", max_points)):
        sections.append(("GPS track", svg_line(fixes, height=320)))
    for name, track in extras.replays.items():
        mine, label = of(track), "track" if redact else name.rstrip("/").rsplit("/", 1)[-1]
        sections.append((f"Replay {label}: heading", svg_line(_points(mine, "t_ms", "yaw", max_points))))
        if {"x", "y"} <= set(track.columns) and (path := _points(mine, "x", "y", max_points)):
            true = _points(of(extras.truth), "x", "y", max_points) if extras.truth is not None and {"x", "y"} <= set(extras.truth.columns) else []
            sections.append((f"Replay {label}: path, with the truth", svg_lines(path, [(x - true[0][0], y - true[0][1]) for x, y in true], height=320)))
    for metrics in extras.metrics:
        found = metrics.where(F.col("session_id").isin(session_id, "all")).orderBy("baseline", "metric").collect()  # a few for each session
        body = table(["baseline", "metric", "value"], [(r.baseline, r.metric, f"{r.value:.6g}") for r in found])
        for first, second in benchmark.PRIMARY.values():
            if shown := [(r.baseline, r.value) for r in found if r.metric == first] or [(r.baseline, r.value) for r in found if r.metric == second]:
                body += svg_bars(shown)
                break
        sections.append(("Benchmark", body))
    if extras.corruption:
        said = [(k, v) for k, v in extras.corruption.items() if k in ("preset", "description", "seed", "modifications")]
        if extras.source_audit is not None and (source := extras.source_audit.where(F.col("session_id") == session_id.removesuffix(f"__{extras.corruption['preset']}")).first()):
            said += [("score before", source.trust_score), ("score now", row["trust_score"]), ("reasons before", ", ".join(source.reason_codes or []))]
        sections.append(("Corruption", table(["fact", "value"], said)))
    return sections


def session_report(session_id: str, summary: DataFrame, windows: DataFrame, issues: DataFrame, imu: DataFrame, redact: bool = False, max_points: int = 1200, extras: Extras = Extras()) -> str:
    """HTML of one session: cards, timeline, signals, the first 30 issues, up to four main reasons, and what extras there are."""
    of = lambda df: df.where(F.col("session_id") == session_id)
    row = of(summary).first()
    if row is None:
        raise ValueError(f"Unknown session: {session_id}")
    row = row.asDict()
    timeline = _points(of(windows).withColumns({"t_ms": ((F.col("start_ms") + F.col("end_ms")) / 2).cast("long"), "row_idx": F.col("win_idx")}), "t_ms", "trust_score", max_points)
    signal = _points(of(imu).withColumn("__norm", norm(F.col("ax"), F.col("ay"), F.col("az"))), "t_ms", "__norm", max_points)
    found = of(issues).orderBy("win_idx", "code").limit(30).collect()
    first = of(issues).groupBy("code").agg(F.min(F.struct("win_idx", "code")).alias("at")).orderBy("at").limit(4).collect()  # codes in the order of their first issue
    codes = [r["code"] for r in first] or row["reason_codes"]
    reasons = [(REASONS[c][0], REASONS[c][1]) for c in [*codes, *(c for c in row["reason_codes"] if c not in codes)][:4]]
    return page(
        f"Session {'-' if redact else session_id}",
        [
            ("Decision", f"<p>{badge(row['status'])} {100 * row['trust_score']:.1f} %. {html.escape(_next_step(row))}</p>"),
            ("Summary", table(["measure", "value"], [(k, v) for k, v in row.items() if k != "session_id"])),
            ("Main reasons", table(["reason", "advice"], reasons)),
            ("Trust score by window", svg_line(timeline)),
            ("Acceleration", svg_line(signal)),
            *_extra_sections(session_id, row, extras, redact, max_points),
            ("Issues", table(["code", "severity", "from ms", "to ms"], [(r.code, r.severity, r.start_ms, r.end_ms) for r in found])),
        ],
    )


def compare_report(row: dict) -> str:
    return page(f"{row['session_id_a']} and {row['session_id_b']}", [("Recommendation", html.escape(row["recommendation"])), ("Scores", table(["a", "b", "change"], [(row["trust_score_a"], row["trust_score_b"], row["trust_delta"])])), ("Regressions", table(["reason"], [[r] for r in row["regression_reasons"]])), ("Improvements", table(["reason"], [[r] for r in row["improvement_reasons"]]))])


def format_summary(row: dict, kind: str = "text") -> str:
    if kind == "json":
        return json.dumps(row, sort_keys=True, default=str)
    if kind == "markdown":
        return "\n".join(["| measure | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in row.items())])
    if kind != "text":
        raise ValueError(f"Unsupported format: {kind}")
    return "\n".join(f"{k}: {v}" for k, v in row.items())


def deep_merge(base: dict, over: dict) -> dict:
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def default_thresholds(cfg: AuditConfig = AuditConfig()) -> dict:
    return {"warning_threshold": cfg.warning, "fail_threshold": cfg.fail, "jitter_warn_ms": cfg.jitter_warn_ms, "dropout_ratio_warn": cfg.dropout_warn, "clipping_warn_ratio": cfg.clipping_warn, "gravity_residual_warn_mps2": cfg.gravity_residual_warn}
