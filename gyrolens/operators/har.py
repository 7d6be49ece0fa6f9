"""Activity-recognition features and the forest benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.config import HarConfig
from gyrolens.functions.expressions import norm
from gyrolens.schema import AXES

NAMES = {"ax": "acc_x", "ay": "acc_y", "az": "acc_z", "gx": "gyro_x", "gy": "gyro_y", "gz": "gyro_z"}
FEATURES = tuple(f"{NAMES[a]}_{s}" for a in AXES for s in ("mean", "std", "min", "max", "energy")) + ("acc_norm_mean", "acc_norm_std", "gyro_norm_mean", "gyro_norm_std")


def window_size(hz: float, cfg: HarConfig = HarConfig()) -> tuple[int, int]:
    """Rows of a window and of a step."""
    return max(int(round(hz * cfg.window_ms / 1000)), 4), max(int(round(hz * cfg.step_ms / 1000)), 2)


def har_features(imu: DataFrame, size: int, step: int) -> DataFrame:
    """34 features of each full window of labelled rows, with its most frequent label (the first in order among equals)."""
    order = Window.partitionBy("session_id").orderBy("t_ms", "row_idx")
    rows = imu.withColumn("__n", F.row_number().over(order) - 1)
    first = F.greatest(F.lit(0), F.ceil((F.col("__n") - size + 1) / F.lit(step))).cast("long")
    # Below the first row of a step's window there is no window: when step exceeds size some rows are in none.
    last = F.floor(F.col("__n") / step).cast("long")
    dealt = rows.where(first <= last).withColumn("win_idx", F.explode(F.sequence(first, last)))
    stats = []
    for axis, name in NAMES.items():
        c = F.col(axis)
        stats += [F.avg(c).alias(f"{name}_mean"), F.stddev_pop(c).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.avg(c * c).alias(f"{name}_energy")]
    for name, part in (("acc", AXES[:3]), ("gyro", AXES[3:])):
        n = norm(*map(F.col, part))
        stats += [F.avg(n).alias(f"{name}_norm_mean"), F.stddev_pop(n).alias(f"{name}_norm_std")]
    label = F.expr("mode() WITHIN GROUP (ORDER BY activity_label)").alias("label")
    return dealt.groupBy("session_id", "win_idx").agg(F.count(F.lit(1)).alias("__rows"), label, *stats).where((F.col("__rows") == size) & F.col("label").isNotNull()).drop("__rows")


def split(features: DataFrame, cfg: HarConfig = HarConfig()) -> DataFrame:
    """features with ``is_test``: of each label the test share by a hash's rank."""
    place = F.percent_rank().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(cfg.seed), "session_id", "win_idx")))
    return features.withColumn("is_test", place < cfg.test_share)


def forest_benchmark(features: DataFrame, cfg: HarConfig = HarConfig()) -> DataFrame:
    """label, prediction, n: the confusion table of a random forest on the test windows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler

    if features.count() < cfg.min_windows:
        raise ValueError("Not enough labeled windows for HAR benchmark.")
    rows = split(features.fillna(0.0, list(FEATURES)), cfg)
    names = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(labelCol="y", featuresCol="x", numTrees=cfg.trees, seed=cfg.seed, maxDepth=10)
    model = Pipeline(stages=[names, VectorAssembler(inputCols=list(FEATURES), outputCol="x"), forest, IndexToString(inputCol="prediction", outputCol="predicted", labels=names.labels)]).fit(rows.where(~F.col("is_test")))
    return model.transform(rows.where("is_test")).groupBy("label", F.col("predicted").alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """accuracy and macro_f1 of a confusion table (label, prediction, n)."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    true = confusion.groupBy(F.col("label").alias("c")).agg(F.sum("n").alias("t"), F.sum(hit).alias("h"))
    said = confusion.groupBy(F.col("prediction").alias("c")).agg(F.sum("n").alias("p"))
    per = true.join(said, "c", "full").fillna(0, ["t", "h", "p"])
    return per.agg((F.sum("h") / F.sum("t")).alias("accuracy"), F.avg(2 * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))
