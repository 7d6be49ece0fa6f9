"""Orientation filters (R1, R2), written from the published papers: recurrences over a session, whose rows are streamed in order through one task.
Only the filter's state is held between batches, so a session of any length fits.

Madgwick's gradient descent (2010) and Mahony's complementary filter (2008), with or without magnetometer. A row that is incomplete, or has no direction, only integrates
the rates it has (missing rates count as 0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyrolens.config import ReplayConfig
from gyrolens.functions.expressions import euler

SCHEMA = "session_id string, row_idx long, t_ms long, qw double, qx double, qy double, qz double"


def _unit(v):
    n = math.sqrt(sum(c * c for c in v))
    return [c / n for c in v] if n > 0 and math.isfinite(n) else None


def _start(acc, mag):
    """Orientation that puts gravity up, and the field, if any, to the north."""
    up = _unit(acc) if acc is not None else None
    if up is None:
        return [1.0, 0.0, 0.0, 0.0]
    roll, pitch, yaw = math.atan2(up[1], up[2]), math.atan2(-up[0], math.hypot(up[1], up[2])), 0.0
    if mag is not None and _unit(mag) is not None:
        mx = mag[0] * math.cos(pitch) + mag[1] * math.sin(roll) * math.sin(pitch) + mag[2] * math.cos(roll) * math.sin(pitch)
        yaw = math.atan2(-(mag[1] * math.cos(roll) - mag[2] * math.sin(roll)), mx)
    cr, sr, cp, sp, cy, sy = (f(a / 2) for a in (roll, pitch, yaw) for f in (math.cos, math.sin))
    return [cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy]


def _pairs(q, acc, mag):
    """Triples of (direction expected in the body frame, direction measured, the x and z of the direction in the earth's)."""
    if acc is None or (a := _unit(acc)) is None:
        return []
    w, x, y, z = q
    rows = ((1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)), (2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)), (2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)))
    found = [(rows[2], a, (0.0, 1.0))]
    if mag is not None and (m := _unit(mag)) is not None:
        h = [r[0] * m[0] + r[1] * m[1] + r[2] * m[2] for r in rows]
        bx, bz = math.hypot(h[0], h[1]), h[2]
        found.append(([bx * e + bz * u for e, u in zip(rows[0], rows[2])], m, (bx, bz)))
    return found


def _gradient(q, pairs):
    """Of half the squared distances between the directions expected and measured, by q."""
    w, x, y, z = q
    g = [0.0, 0.0, 0.0, 0.0]
    for seen, measured, (dx, dz) in pairs:
        e, f, h = (s - m for s, m in zip(seen, measured))
        g[0] += 2 * (-dz * y * e + (dz * x - dx * z) * f + dx * y * h)
        g[1] += 2 * (dz * z * e + (dx * y + dz * w) * f + (dx * z - 2 * dz * x) * h)
        g[2] += 2 * ((-2 * dx * y - dz * w) * e + (dx * x + dz * z) * f + (dx * w - 2 * dz * y) * h)
        g[3] += 2 * ((dz * x - 2 * dx * z) * e + (dz * y - dx * w) * f + dx * x * h)
    return g


class Filter:
    """One session's filter. It holds a quaternion and an integral, so rows can come in pieces of any size."""

    def __init__(self, hz: float, method: str, cfg: ReplayConfig = ReplayConfig()):
        self.dt, self.mahony, self.cfg = 1.0 / hz, method == "mahony", cfg
        self.q, self.integral = None, [0.0, 0.0, 0.0]

    def step(self, gyro, acc, mag):
        """The unit quaternion after a row. acc and mag are None unless complete; the first row only sets the start."""
        if self.q is None:
            self.q = _start(acc, mag)
            return self.q
        q, rate, dt = self.q, gyro, self.dt
        pairs = _pairs(q, acc, mag)
        if self.mahony and pairs:
            off = [0.0, 0.0, 0.0]
            for (a, b, c), (d, e, f), _ in pairs:  # measured x expected
                off = [off[0] + e * c - f * b, off[1] + f * a - d * c, off[2] + d * b - e * a]
            self.integral = [i + self.cfg.mahony_ki * e * dt for i, e in zip(self.integral, off)]
            rate = [r + self.cfg.mahony_kp * e + i for r, e, i in zip(rate, off, self.integral)]
        (w, x, y, z), (a, b, c) = q, rate
        change = [0.5 * (-x * a - y * b - z * c), 0.5 * (w * a + y * c - z * b), 0.5 * (w * b - x * c + z * a), 0.5 * (w * c + x * b - y * a)]
        if not self.mahony and pairs and (g := _unit(_gradient(q, pairs))) is not None:
            change = [s - self.cfg.madgwick_gain * d for s, d in zip(change, g)]
        q = [v + s * dt for v, s in zip(q, change)]
        n = math.sqrt(sum(v * v for v in q))
        self.q = [v / n for v in q]
        return self.q


def orient(gyro: np.ndarray, acc: np.ndarray, mag: np.ndarray | None, hz: float, method: str, cfg: ReplayConfig = ReplayConfig(), state: Filter | None = None) -> np.ndarray:
    """Unit quaternions (w, x, y, z) of n rows; state: a filter that has seen the rows before."""
    state = state or Filter(hz, method, cfg)
    whole = lambda m: np.isfinite(m).all(axis=1).tolist()
    n = len(gyro)
    fields, some = (mag.tolist(), whole(mag)) if mag is not None else ([None] * n, [False] * n)
    rows = zip(np.nan_to_num(gyro).tolist(), acc.tolist(), whole(acc), fields, some)
    return np.array([state.step(g, a if has_a else None, m if has_m else None) for g, a, has_a, m, has_m in rows]).reshape(n, 4)


def with_rate(imu: DataFrame, sessions: DataFrame) -> DataFrame:
    """imu with hz, the nominal rate of its session (sessions.nominal_hz; null where unknown)."""
    return imu.drop("hz").join(sessions.select("session_id", F.col("nominal_hz").cast("double").alias("hz")), "session_id", "left")


def replay(imu: DataFrame, method: str, cfg: ReplayConfig = ReplayConfig()) -> DataFrame:
    """session_id, row_idx, t_ms, quaternion and angles for each row. imu may bring hz; it is 100 where missing."""
    if method not in ("madgwick", "mahony"):
        raise ValueError(f"Unsupported baseline: {method}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, None
        for batch in batches:
            parts = []
            for name, pdf in batch.groupby("session_id", sort=False, dropna=False):
                if name != session:
                    hz = pdf["hz"].iloc[0]
                    session, state = name, Filter(hz if hz and hz > 0 else 100.0, method, cfg)
                q = orient(pdf[["gx", "gy", "gz"]].to_numpy(float), pdf[["ax", "ay", "az"]].to_numpy(float), pdf[["mx", "my", "mz"]].to_numpy(float), 1 / state.dt, method, cfg, state)
                parts.append(pdf[["session_id", "row_idx", "t_ms"]].assign(qw=q[:, 0], qx=q[:, 1], qy=q[:, 2], qz=q[:, 3]))
            if parts:
                yield pd.concat(parts)

    rows = imu if "hz" in imu.columns else imu.withColumn("hz", F.lit(100.0))
    rows = rows.select("session_id", "row_idx", "t_ms", "ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz", F.col("hz").cast("double"))
    found = rows.repartition("session_id").sortWithinPartitions("session_id", "t_ms", "row_idx").mapInPandas(run, SCHEMA)
    roll, pitch, yaw = euler(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    return found.withColumns({"roll": roll, "pitch": pitch, "yaw": yaw})
