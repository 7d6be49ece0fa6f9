"""Ordered analytics over recordings: previous rows, time steps, gaps, freezes, clipping.

A session may hold most of the rows, so whatever runs along it is found in cells of time (or of another order): within a cell by a window,
across cells from one row for each, joined back. So go the previous row, row numbers, running sums and maxima; windows of
some rows either side run in blocks of numbered rows, with a margin of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyrolens.schema import AXES

BUCKET = 3_600_000
BLOCK = 200_000
RTOL, ATOL = 1e-5, 1e-12


def with_previous(df: DataFrame, columns: list[str], order: str = "t_ms", bucket: int = BUCKET) -> DataFrame:
    """df with a struct ``prev`` of the columns in the session's previous row by (order, row_idx); null in its first."""
    place = [order, "row_idx"] if order != "row_idx" else ["row_idx"]
    carried = F.struct(*columns)
    keyed = df.withColumn("__bucket", F.floor(F.col(order) / bucket))
    last = keyed.groupBy("session_id", "__bucket").agg(F.max_by(carried, F.struct(*place)).alias("__last"))
    before = last.select("session_id", "__bucket", F.lag("__last").over(Window.partitionBy("session_id").orderBy("__bucket")).alias("__before"))
    inside = Window.partitionBy("session_id", "__bucket").orderBy(*place)
    return keyed.withColumn("__in", F.lag(carried).over(inside)).join(before, ["session_id", "__bucket"]).withColumn("prev", F.coalesce("__in", "__before")).drop("__in", "__before", "__bucket")


TIME = ("t_ms", "row_idx")


def _cells(df: DataFrame, cell: Column | None) -> DataFrame:
    return df.withColumn("__cell", F.floor(F.col("t_ms") / BUCKET) if cell is None else cell)


def _earlier(partials: DataFrame, whole: dict[str, Column]) -> DataFrame:
    """One row for each session and cell: what the cells before it come to."""
    before = Window.partitionBy("session_id").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    return partials.select("session_id", "__cell", *[c.over(before).alias(n) for n, c in whole.items()])


def numbered(df: DataFrame, name: str, order: tuple[str, ...] = TIME, cell: Column | None = None, total: str | None = None) -> DataFrame:
    """df with each row's number in its session, from 0, and the session's rows in ``total`` if that is named. cell must not fall along order.

    The join is a left one, so that the rows are never the side that is broadcast, and stay in order. Rows without a cell (no time) get no number."""
    rows = _cells(df, cell)
    sizes = rows.groupBy("session_id", "__cell").agg(F.count(F.lit(1)).alias("__size"))
    if total:
        sizes = sizes.withColumn(total, F.sum("__size").over(Window.partitionBy("session_id")))
    before = F.sum("__size").over(Window.partitionBy("session_id").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    earlier = sizes.withColumn("__earlier", F.coalesce(before, F.lit(0))).drop("__size")
    inside = F.row_number().over(Window.partitionBy("session_id", "__cell").orderBy(*order)) - 1
    return rows.withColumn(name, inside).join(earlier, ["session_id", "__cell"], "left").withColumn(name, F.col("__earlier") + F.col(name)).drop("__earlier", "__cell")


def running_sums(df: DataFrame, sums: dict[str, Column], order: tuple[str, ...] = TIME, cell: Column | None = None) -> DataFrame:
    """df with sums up to and with each row of its session; nulls count as 0."""
    rows = _cells(df, cell).withColumns({f"__{n}": F.coalesce(c, F.lit(0.0)) for n, c in sums.items()})
    totals = rows.groupBy("session_id", "__cell").agg(*[F.sum(f"__{n}").alias(n) for n in sums])
    earlier = _earlier(totals, {f"__{n}_before": F.sum(n) for n in sums})
    inside = Window.partitionBy("session_id", "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"__{n}": F.sum(f"__{n}").over(inside) for n in sums}).join(earlier, ["session_id", "__cell"], "left")
    return rows.withColumns({n: F.coalesce(f"__{n}_before", F.lit(0.0)) + F.col(f"__{n}") for n in sums}).drop("__cell", *[f"__{n}" for n in sums], *[f"__{n}_before" for n in sums])


def running_max(df: DataFrame, value: Column, name: str, order: tuple[str, ...] = TIME, cell: Column | None = None) -> DataFrame:
    """df with the largest value up to and with each row of its session, nulls aside."""
    rows = _cells(df, cell).withColumn("__value", value)
    earlier = _earlier(rows.groupBy("session_id", "__cell").agg(F.max("__value").alias("__top")), {"__before": F.max("__top")})
    inside = Window.partitionBy("session_id", "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__value", F.max("__value").over(inside)).join(earlier, ["session_id", "__cell"], "left")
    larger = F.when(F.col("__before").isNull() | (F.col("__value") >= F.col("__before")), F.col("__value")).otherwise(F.col("__before"))
    return rows.withColumn(name, larger).drop("__cell", "__value", "__before")


def in_blocks(df: DataFrame, before: int, after: int, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """df dealt to blocks of rows with copies of the ``before`` and ``after`` rows around them, and the window along a block. Rows with __own are the block's own; keep those alone at the end."""
    rows = numbered(df, "__n")
    # Block b needs the rows from b * block - before to (b + 1) * block - 1 + after.
    first, last = F.greatest(F.lit(0), F.floor((F.col("__n") - after) / block)), F.floor((F.col("__n") + before) / block)
    dealt = rows.withColumn("__block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return dealt.withColumn("__own", F.col("__block") == F.floor(F.col("__n") / block)), Window.partitionBy("session_id", "__block").orderBy("__n")


def own_rows(dealt: DataFrame) -> DataFrame:
    return dealt.where("__own").drop("__own", "__block", "__n")


def step_counts(imu: DataFrame, *carried: str, **sums: Column) -> DataFrame:
    """session_id, dt, n: how often consecutive rows are dt apart (null for a first row), with sums over those rows. Times are whole milliseconds, so a session has few distinct steps."""
    rows = with_previous(imu.select("session_id", "row_idx", "t_ms", *carried), ["t_ms", *carried])
    return rows.groupBy("session_id", (F.col("t_ms") - F.col("prev.t_ms")).alias("dt")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])


def _weighted(counts: DataFrame, positive: bool, factor: float) -> DataFrame:
    """step_counts with __w, the weight of a step in statistics, their mean, and __gap, whether it is a gap."""
    session = Window.partitionBy("session_id")
    weight = F.when(F.col("dt") > 0 if positive else F.col("dt").isNotNull(), F.col("n")).otherwise(0)
    every = F.when(F.col("dt").isNotNull(), F.col("n")).otherwise(0)
    rows = counts.withColumns({"__w": weight, "__all": every})
    mean = F.sum(F.col("dt") * F.col("__w")).over(session) / F.nullif(F.sum("__w").over(session), F.lit(0))
    limit = factor * F.greatest(F.percentile("dt", 0.5, F.col("__all")).over(session), F.lit(1.0))
    return rows.withColumns({"__mean": mean, "__gap": F.col("dt") > limit})


def _step_stats() -> list[Column]:
    far = F.col("dt") - F.col("__mean")
    return [F.percentile("dt", 0.5, F.col("__w")).alias("m"), F.max("__mean").alias("a"), F.sqrt(F.sum(F.col("__w") * far * far) / F.nullif(F.sum("__w"), F.lit(0))).alias("j")]


def _gap_stats() -> list[Column]:
    gaps = F.sum(F.when(F.col("__gap"), F.col("n")).otherwise(0))
    return [gaps.alias("gap_count"), (gaps / F.nullif(F.sum("__all"), F.lit(0))).alias("dropout_ratio")]


def _freeze_sums() -> dict[str, Column]:
    cols = [F.col(a) for a in AXES]
    return {"repeated": F.when(F.col("prev").isNotNull(), repeats(cols, [F.col(f"prev.{a}") for a in AXES]).cast("int")), "zeroed": zeros(cols).cast("int")}


def _freeze_stats() -> list[Column]:
    n = F.sum("n")
    repeat, zero = F.sum("repeated") / F.nullif(n - 1, F.lit(0)), F.sum("zeroed") / n
    return [repeat.alias("repeat_ratio"), zero.alias("zero_ratio"), F.when(n < 2, 0.0).otherwise(F.greatest(repeat, zero)).alias("freeze_ratio")]


def _rates() -> list[Column]:
    zero = F.lit(0.0)
    return [F.coalesce("m", zero).alias("median_dt_ms"), F.coalesce("a", zero).alias("mean_dt_ms"), F.coalesce("j", zero).alias("jitter_ms"), F.when(F.col("m") > 0, 1000.0 / F.col("m")).otherwise(zero).alias("nominal_hz")]


def sampling_stats(imu: DataFrame, positive: bool = False) -> DataFrame:
    """n_rows, median_dt_ms, mean_dt_ms, jitter_ms, duration_s, nominal_hz; zeros for sessions of one row."""
    steps = _weighted(step_counts(imu), positive, 1.0).groupBy("session_id").agg(*_step_stats())
    spans = imu.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_rows"), (F.max("t_ms") - F.min("t_ms")).alias("span"))
    return spans.join(steps, "session_id", "left").select("session_id", "n_rows", *_rates(), (F.col("span") / 1000.0).alias("duration_s"))


def gap_ratio(imu: DataFrame, factor: float = 1.8) -> DataFrame:
    """gap_count and dropout_ratio against the session's median step; sessions of one row have none."""
    return _weighted(step_counts(imu), False, factor).groupBy("session_id").agg(*_gap_stats()).where(F.col("dropout_ratio").isNotNull())


def session_facts(imu: DataFrame, positive: bool = False, factor: float = 1.8) -> DataFrame:
    """What sampling_stats, gap_ratio and freeze_ratio say of steps, gaps and freezes, from one pass over the rows."""
    counts = step_counts(imu, *AXES, **_freeze_sums())
    found = _weighted(counts, positive, factor).groupBy("session_id").agg(*_step_stats(), *_gap_stats(), *_freeze_stats())
    return found.select("session_id", *_rates(), "gap_count", "dropout_ratio", "freeze_ratio")


def repeats(now: list[Column], before: list[Column]) -> Column:
    """All channels close to the previous row's; false where any is null."""
    close = [F.abs(a - b) <= ATOL + RTOL * F.abs(b) for a, b in zip(now, before)]
    return F.coalesce(_all(close), F.lit(False))


def zeros(now: list[Column]) -> Column:
    return F.coalesce(_all([F.abs(a) <= ATOL for a in now]), F.lit(False))


def _all(parts: list[Column]) -> Column:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole & p
    return whole


def freeze_ratio(imu: DataFrame) -> DataFrame:
    """The larger of the shares of repeated and of all-zero rows."""
    return step_counts(imu, *AXES, **_freeze_sums()).groupBy("session_id").agg(*_freeze_stats())


def clipped_share(columns: tuple[str, ...], limit: Column) -> Column:
    """Aggregate: share of a sensor's cells at 98 % of full scale or more; null without a limit."""
    hit = sum((F.coalesce((F.abs(F.col(c)) >= 0.98 * limit).cast("int"), F.lit(0)) for c in columns[1:]), F.coalesce((F.abs(F.col(columns[0])) >= 0.98 * limit).cast("int"), F.lit(0)))
    return F.when(F.max(limit) > 0, F.sum(hit) / (len(columns) * F.count(F.lit(1))))


def session_levels(imu: DataFrame, sessions: DataFrame, mag: tuple[str, ...] = ("mx", "my", "mz")) -> DataFrame:
    """span_ms, pressure_stability_pa and clipping_ratio, the largest share over sensors with a full scale (acc_limit, gyro_limit, mag_limit of sessions)."""
    rows = imu.join(sessions.select("session_id", "acc_limit", "gyro_limit", "mag_limit"), "session_id")
    parts = rows.groupBy("session_id").agg(
        clipped_share(AXES[:3], F.col("acc_limit")).alias("a"), clipped_share(AXES[3:], F.col("gyro_limit")).alias("g"), clipped_share(mag, F.col("mag_limit")).alias("m"),
        F.stddev_pop("pressure_pa").alias("pressure_stability_pa"), (F.max("t_ms") - F.min("t_ms")).alias("span_ms"),
    )
    return parts.select("session_id", "span_ms", "pressure_stability_pa", F.coalesce(F.greatest("a", "g", "m"), F.lit(0.0)).alias("clipping_ratio"))


def clipping_ratio(imu: DataFrame, sessions: DataFrame) -> DataFrame:
    return session_levels(imu, sessions).select("session_id", "clipping_ratio")
