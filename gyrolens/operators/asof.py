"""Nearest as-of join with a tolerance (J1), and the errors measured with it.

Both sides are dealt by session and time cell; right rows also go to the cells their tolerance reaches into, so a long
session spreads over tasks. In a cell one window looks back and one ahead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.functions.expressions import wrap_angle

CELL_MS = 600_000


def nearest(left: DataFrame, right: DataFrame, tolerance_ms: int, columns: list[str], cell_ms: int = CELL_MS) -> DataFrame:
    """Rows of left (session_id, t_ms, row_idx, ...) with ``matched``: t_ms and columns of the right row nearest in time.

    Of equally near rows the earlier wins, of rows at one time the last. Rows without a match in the tolerance are left out.
    """
    names = [c for c in left.columns if c != "session_id"]
    cell = F.floor(F.col("t_ms") / cell_ms)
    value = F.struct("t_ms", *columns)
    kinds = dict(left.dtypes)
    a = left.select("session_id", cell.alias("cell"), "t_ms", F.lit(1).alias("is_left"), F.col("row_idx").alias("ord"), F.struct(*names).alias("l"), F.lit(None).cast(right.select(value.alias("v")).dtypes[0][1]).alias("v"))
    cells = F.sequence(F.floor((F.col("t_ms") - tolerance_ms) / cell_ms), F.floor((F.col("t_ms") + tolerance_ms) / cell_ms))
    b = right.select("session_id", F.explode(cells).alias("cell"), "t_ms", F.lit(0).alias("is_left"), F.col("row_idx").alias("ord"), F.lit(None).cast(f"struct<{','.join(f'{n}:{kinds[n]}' for n in names)}>").alias("l"), value.alias("v"))
    both = a.unionByName(b)
    # Each window runs one way with a frame that only grows. In both, the last right row met is the nearest on that side and, at one time, the last.
    back = Window.partitionBy("session_id", "cell").orderBy("t_ms", "is_left", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy("session_id", "cell").orderBy(F.desc("t_ms"), "is_left", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumns({"b": F.last("v", ignorenulls=True).over(back), "f": F.last("v", ignorenulls=True).over(ahead)}).where("is_left = 1")
    nearer = F.col("f").isNull() | (F.col("b").isNotNull() & (F.col("t_ms") - F.col("b.t_ms") <= F.col("f.t_ms") - F.col("t_ms")))
    return found.withColumn("matched", F.when(nearer, F.col("b")).otherwise(F.col("f"))).where(F.abs(F.col("matched.t_ms") - F.col("t_ms")) <= tolerance_ms).select("session_id", "l.*", "matched")


def heading_error(replay: DataFrame, truth: DataFrame, tolerance_ms: int = 250) -> DataFrame:
    """Mean absolute heading difference of each session."""
    pairs = nearest(replay.select("session_id", "row_idx", "t_ms", "yaw"), truth, tolerance_ms, ["heading"])
    return pairs.groupBy("session_id").agg(F.avg(F.abs(wrap_angle(F.col("yaw") - F.col("matched.heading")))).alias("heading_drift_rad"))


def _from_origin(df: DataFrame) -> DataFrame:
    first = df.groupBy("session_id").agg(F.min_by(F.struct("x", "y"), F.struct("t_ms", "row_idx")).alias("__o"))
    return df.join(first, "session_id").withColumns({"x": F.col("x") - F.col("__o.x"), "y": F.col("y") - F.col("__o.y")}).drop("__o")


def trajectory_rmse(replay: DataFrame, truth: DataFrame, tolerance_ms: int = 300) -> DataFrame:
    """Root mean squared distance, both tracks from their origins."""
    left = _from_origin(replay.select("session_id", "row_idx", "t_ms", "x", "y"))
    pairs = nearest(left, _from_origin(truth.select("session_id", "row_idx", "t_ms", "x", "y")), tolerance_ms, ["x", "y"])
    dx, dy = F.col("x") - F.col("matched.x"), F.col("y") - F.col("matched.y")
    return pairs.groupBy("session_id").agg(F.sqrt(F.avg(dx * dx + dy * dy)).alias("trajectory_rmse_m"))
