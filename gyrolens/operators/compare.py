"""Ranking, comparison and validation of audited sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.03
LOWER = "rmse|drift|error|loss"
HIGHER = "accuracy|f1|score|ratio"


def rank_sessions(summary: DataFrame) -> DataFrame:
    """Worst first, from 1. The window runs over one slim row for each session."""
    return summary.withColumn("rank", F.row_number().over(Window.orderBy("trust_score", "session_id")))


def status_counts(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warning", "fail")])


def reason_frequency(summary: DataFrame, top: int = 10) -> DataFrame:
    return summary.select(F.explode("reason_codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(top)


def metric_deltas(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("baseline", "metric")) -> DataFrame:
    """b - a of metrics in long format (keys, value) that both have."""
    return a.select(*keys, F.col("value").alias("__a")).join(b.select(*keys, F.col("value").alias("__b")), list(keys)).select(*keys, (F.col("__b") - F.col("__a")).alias("delta"))


def metadata_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (key, value) whose values differ or that one side lacks."""
    both = a.select("key", F.col("value").alias("value_a")).join(b.select("key", F.col("value").alias("value_b")), "key", "full")
    return both.where(~F.col("value_a").eqNullSafe(F.col("value_b")))


def metric_direction(metric: Column) -> Column:
    m = F.lower(metric)
    return F.when(m.rlike(LOWER), "lower_is_better").when(m.rlike(HIGHER), "higher_is_better").otherwise("unknown")


def metric_reason(category: Column, baseline: Column, metric: Column, delta: Column) -> Column:
    """Sentence on a metric that moved; null for unknown directions and no change."""
    way = metric_direction(metric)
    worse = ((way == "lower_is_better") & (delta > 0)) | ((way == "higher_is_better") & (delta < 0))
    better = ((way == "lower_is_better") & (delta < 0)) | ((way == "higher_is_better") & (delta > 0))
    word = F.when(worse, "worsened").when(better, "improved")
    return F.concat(category, F.lit(" "), baseline, F.lit(" "), metric, F.lit(" "), word, F.lit(" by "), F.format_string("%.3f", F.abs(delta)))


def compare_sessions(a: DataFrame, b: DataFrame, on: list[str] | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Pairs of summaries (b minus a). ``on``: columns that pair them; metrics: columns of ``on``, category, baseline, metric, delta."""
    pick = lambda df, s: df.select(*(on or []), *[F.col(c).alias(f"{c}_{s}") for c in ("session_id", "trust_score", "reason_codes")])
    pairs = pick(a, "a").join(pick(b, "b"), on)
    delta = F.col("trust_score_b") - F.col("trust_score_a")
    added, removed = F.array_sort(F.array_except("reason_codes_b", "reason_codes_a")), F.array_sort(F.array_except("reason_codes_a", "reason_codes_b"))
    pairs = pairs.withColumns({"trust_delta": delta, "added": added, "removed": removed})
    none = F.array().cast("array<string>")
    if metrics is None:
        pairs = pairs.withColumns({"__worse": none, "__better": none})
    else:
        said = metrics.withColumn("__s", metric_reason(F.col("category"), F.col("baseline"), F.col("metric"), F.col("delta"))).where(F.col("__s").isNotNull())
        row = F.struct("category", "baseline", "metric", "__s")
        grouped = said.groupBy(*(on or [])).agg(F.collect_list(F.when(F.col("__s").contains("worsened"), row)).alias("w"), F.collect_list(F.when(F.col("__s").contains("improved"), row)).alias("i"))
        texts = lambda c: F.coalesce(F.transform(F.array_sort(c), lambda x: x["__s"]), none)
        pairs = pairs.join(grouped, on, "left").withColumns({"__worse": texts("w"), "__better": texts("i")}).drop("w", "i")
    d = F.col("trust_delta")
    regression = F.array_compact(F.array(F.when(d <= -THRESHOLD, F.concat(F.lit("trust_score dropped by "), F.format_string("%.3f", F.abs(d)))), F.when(F.size("added") > 0, F.concat(F.lit("new reason codes: "), F.array_join("added", ", ")))))
    improvement = F.array_compact(F.array(F.when(d >= THRESHOLD, F.concat(F.lit("trust_score improved by "), F.format_string("%.3f", d))), F.when(F.size("removed") > 0, F.concat(F.lit("removed reason codes: "), F.array_join("removed", ", ")))))
    pairs = pairs.withColumns({"regression_reasons": F.concat(regression, "__worse"), "improvement_reasons": F.concat(improvement, "__better")}).drop("__worse", "__better")
    return pairs.withColumn("recommendation", recommendation(F.size("regression_reasons"), F.size("improvement_reasons"), d))


def recommendation(regressions: Column, improvements: Column, delta: Column) -> Column:
    return (
        F.when((regressions > 0) & (improvements == 0), "regressed").when((improvements > 0) & (regressions == 0), "improved").when((regressions > 0) & (improvements > 0), "mixed")
        .when(delta > 0, "improved").when(delta < 0, "regressed").otherwise("mixed")
    )


def gate_fails(recommended: Column, delta: Column, mode: str, threshold: float = THRESHOLD) -> Column:
    """Whether the regression gate fails: never, on regression, or also on mixed results."""
    if mode == "never":
        return F.lit(False)
    fails = (recommended == "regressed") | (delta <= -threshold)
    return fails | (recommended == "mixed") if mode == "mixed" else fails


def validate(summary: DataFrame) -> DataFrame:
    """summary (preset, base_id, trust_score, ...) of clean and corrupted sessions: base_id, preset, delta, non_improving."""
    clean = summary.where("preset = 'clean'").select("base_id", F.col("trust_score").alias("clean_score"))
    rows = summary.where("preset <> 'clean'").join(clean, "base_id")
    delta = F.col("trust_score") - F.col("clean_score")
    non_improving = F.col("trust_score") <= F.col("clean_score") + 1e-9
    zero = F.when(non_improving & (F.abs(delta) < 1e-6), F.concat("preset", F.lit(" did not improve trust_score, but the delta was effectively zero.")))
    return rows.select("base_id", "preset", "clean_score", "trust_score", delta.alias("trust_score_delta"), non_improving.alias("non_improving"), zero.alias("limitation"))


def validation_summary(validated: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """base_id, all_non_improving, known_limitations. deltas (base_id, preset, metric, delta): presets without any are a limitation too."""
    if deltas is not None:
        some = deltas.select("base_id", "preset").distinct().withColumn("__some", F.lit(True))
        without = F.when(F.col("__some").isNull(), F.concat("preset", F.lit(" had no replay or benchmark metric in common with the clean session.")))
        validated = validated.join(some, ["base_id", "preset"], "left").withColumn("limitation", F.array_compact(F.array("limitation", without))).drop("__some")
        texts = F.flatten(F.collect_list("limitation"))
    else:
        texts = F.array_compact(F.collect_list("limitation"))
    return validated.groupBy("base_id").agg(F.bool_and("non_improving").alias("all_non_improving"), F.array_sort(texts).alias("known_limitations"))


def preset_deltas(metrics: DataFrame) -> DataFrame:
    """base_id, preset, baseline, metric, delta: metrics (base_id, preset, baseline, metric, value) of corrupted sessions less those of the clean one, where both have them (V6)."""
    keys = ["base_id", "baseline", "metric"]
    clean = metrics.where("preset = 'clean'").select(*keys, F.col("value").alias("__c"))
    return metrics.where("preset <> 'clean'").join(clean, keys).select("base_id", "preset", "baseline", "metric", (F.col("value") - F.col("__c")).alias("delta"))


def delta_stats(deltas: DataFrame, *by: str) -> DataFrame:
    """metric, preset_count, average_delta, max_delta, min_delta; with ``by``, of each of its groups."""
    return deltas.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("preset_count"), F.avg("delta").alias("average_delta"), F.max("delta").alias("max_delta"), F.min("delta").alias("min_delta"))
