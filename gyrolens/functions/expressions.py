"""Column expressions: units, angles, norms, text keys (P1-P21, S13). All run inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.config import GRAVITY

#: Factors to the canonical unit (fixed values).
TIME = {"s": 1000.0, "ms": 1.0, "us": 1e-3, "ns": 1e-6}
ACCELERATION = {"g": GRAVITY, "m/s^2": 1.0, "mps2": 1.0}
PRESSURE = {"Pa": 1.0, "kPa": 1000.0, "hPa": 100.0}
POSITION = {"m": 1.0, "cm": 0.01, "mm": 0.001}
RADIANS, DEGREES = ("rad/s", "rads", "radps", "rad"), ("deg/s", "dps", "degps", "deg")


def _factor(table: dict[str, float], unit: str, what: str) -> float:
    if unit not in table:
        raise ValueError(f"Unsupported {what} unit: {unit}")
    return table[unit]


def time_ms(c: Column, unit: str) -> Column:
    """Whole milliseconds, half to even."""
    return F.rint(c.cast("double") * _factor(TIME, unit, "time")).cast("long")


def acceleration(c: Column, unit: str) -> Column:
    return c.cast("double") * _factor(ACCELERATION, unit, "acceleration")


def angle(c: Column, unit: str) -> Column:
    """Angles and angular rates in radians."""
    if unit in DEGREES:
        return F.radians(c.cast("double"))
    if unit not in RADIANS:
        raise ValueError(f"Unsupported angle unit: {unit}")
    return c.cast("double")


def magnetic(c: Column, unit: str) -> Column:
    return c.cast("double") * _factor({"uT": 1.0}, unit, "magnetic field")


def temperature(c: Column, unit: str) -> Column:
    c = c.cast("double")
    forms = {"C": c, "K": c - 273.15, "F": (c - 32.0) * 5.0 / 9.0}
    if unit not in forms:
        raise ValueError(f"Unsupported temperature unit: {unit}")
    return forms[unit]


def pressure(c: Column, unit: str) -> Column:
    return c.cast("double") * _factor(PRESSURE, unit, "pressure")


def position(c: Column, unit: str) -> Column:
    return c.cast("double") * _factor(POSITION, unit, "position")


def norm(*parts: Column) -> Column:
    """Null if any component is."""
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def safe_norm(all_null: Column, *parts: Column) -> Column:
    """Null where all_null holds (for a whole group of rows); else null components count as 0."""
    filled = [F.coalesce(p, F.lit(0.0)) for p in parts]
    return F.when(~all_null, norm(*filled))


def wrap_angle(c: Column) -> Column:
    return F.pmod(c + F.pi(), F.lit(2 * math.pi)) - F.pi()


def euler(qw: Column, qx: Column, qy: Column, qz: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch and yaw of a unit quaternion."""
    roll = F.atan2(2 * (qw * qx + qy * qz), 1 - 2 * (qx * qx + qy * qy))
    pitch = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (qw * qy - qz * qx))))
    yaw = F.atan2(2 * (qw * qz + qx * qy), 1 - 2 * (qy * qy + qz * qz))
    return roll, pitch, yaw


def slugify(c: Column) -> Column:
    slug = F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(slug == "", "session").otherwise(slug)


def redact_path(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def redact_subject(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("-"))


def status(score: Column, warning: float, fail: float) -> Column:
    return F.when(score < fail, "fail").when(score < warning, "warning").otherwise("pass")


def nmea_degrees(raw: Column, hemisphere: Column) -> Column:
    """DDMM.mm or DDDMM.mm as signed degrees; null without a dot."""
    dot = F.instr(raw, ".")
    degrees = raw.substr(F.lit(1), dot - 3).try_cast("double")
    minutes = raw.substr(dot - 2, F.length(raw)).try_cast("double")
    value = degrees + minutes / 60
    return F.when(dot > 3, F.when(hemisphere.isin("S", "W"), -value).otherwise(value))


def epoch_to_ms(df: DataFrame, time_col: str, session: str = "session_id", order: str = "row_idx") -> DataFrame:
    """t_ms from a clock of unknown unit (P12): relative to the first value, the scale guessed by the median step."""
    from gyrolens.operators.sampling import with_previous

    first = df.groupBy(session).agg(F.min_by(time_col, order).alias("__first"))
    stepped = with_previous(df.withColumn("t_ms", F.col(order)), [time_col], order=order)
    step = stepped.groupBy(session).agg(F.percentile(F.col(time_col) - F.col(f"prev.{time_col}"), 0.5).alias("__step"))
    relative = F.col(time_col) - F.col("__first")
    scaled = F.when(F.col("__step") > 1e5, relative / 1e6).when(F.col("__step") > 1e2, relative / 1e3).when(F.col("__step") < 1e-2, relative * 1000).otherwise(relative)
    return df.join(first, session).join(step, session, "left").withColumn("t_ms", scaled.cast("long")).drop("__first", "__step")
