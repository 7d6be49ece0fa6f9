"""Corruption presets (C1-C6). Random choices come from integer arithmetic on row numbers, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gyrolens.operators.sampling import numbered, running_max

PRESETS = ("packet_loss_5", "timestamp_jitter_3ms", "axis_flip_x", "gyro_bias_small", "mag_bias_30ut")
SEED = 42


def scatter(row: Column, seed: int = SEED) -> Column:
    """A pseudo-random integer below 1000003 for each row number."""
    return F.pmod((F.pmod(row, F.lit(1000003)) + seed) * 7919 + F.pmod(row * row, F.lit(1000003)) * 104729, F.lit(1000003))


#: What the presets of the channels add to them, and which they turn round (fixed values).
BIAS = {"gyro_bias_small": {"gx": 0.03, "gy": -0.02, "gz": 0.015}, "mag_bias_30ut": {"mx": 30.0, "my": -15.0, "mz": 10.0}}
FLIPPED = ("ax", "gx", "mx")
SCATTER_CELL, ROW_CELL = 1000, 200_000


def _with_loss(imu: DataFrame, seed: int) -> DataFrame:
    """imu with __lost: a twentieth of the session's rows, and at least one."""
    rows = imu.withColumn("__s", scatter(F.col("row_idx"), seed))
    rows = numbered(rows, "__r", ("__s", "row_idx"), F.floor(F.col("__s") / SCATTER_CELL), total="__k")
    lost = F.greatest(F.lit(1), F.rint(0.05 * F.col("__k"))).cast("long")
    return rows.withColumn("__lost", F.col("__r") < lost).drop("__s", "__r", "__k")


def _with_jitter(imu: DataFrame, seed: int) -> DataFrame:
    """imu with __jittered: times moved by up to 3 ms, never back."""
    moved = F.col("t_ms") + F.pmod(scatter(F.col("row_idx"), seed), F.lit(7)) - 3
    return running_max(imu, moved, "__jittered", ("row_idx",), F.floor(F.col("row_idx") / ROW_CELL))


def corrupt(imu: DataFrame, preset: str, seed: int = SEED) -> DataFrame:
    if preset == "packet_loss_5":
        return _with_loss(imu, seed).where(~F.col("__lost")).drop("__lost")
    if preset == "timestamp_jitter_3ms":
        return _with_jitter(imu, seed).withColumn("t_ms", F.col("__jittered")).drop("__jittered")
    if preset == "axis_flip_x":
        return imu.withColumns({c: -F.col(c) for c in FLIPPED})
    if preset in BIAS:
        return imu.withColumns({c: F.col(c) + v for c, v in BIAS[preset].items()})
    raise ValueError(f"Unsupported corruption preset: {preset}")


#: What is said of each preset.
DESCRIPTIONS = {
    "packet_loss_5": "A twentieth of the rows is lost.", "timestamp_jitter_3ms": "Times move by up to 3 ms, never back.", "axis_flip_x": "The x axis of all sensors is turned round.",
    "gyro_bias_small": "Rates have a constant bias.", "mag_bias_30ut": "The field has a constant bias.",
}


def corruption_summary(preset: str, source: str, out: str, seed: int = SEED) -> dict:
    """What was done to a set of sessions."""
    return {"artifact_type": "corruption_summary", "preset": preset, "description": DESCRIPTIONS[preset], "source": source, "out": out, "seed": seed, "modifications": BIAS.get(preset, {})}


def corrupt_frames(frames: dict[str, DataFrame], preset: str, seed: int = SEED) -> dict[str, DataFrame]:
    """All frames of sessions under their new ids: the rows corrupted, GPS, truth and facts as they were, with the preset noted in the facts."""
    out = {name: corrupt(df, preset, seed) if name == "imu" else df for name, df in frames.items()}
    if "sessions" in out:
        out["sessions"] = out["sessions"].withColumn("corruption", F.lit(preset))
    return {name: df.withColumn("session_id", corrupted_id(F.col("session_id"), preset)) for name, df in out.items()}


def corrupted_id(session_id: Column, preset: str) -> Column:
    return F.concat(session_id, F.lit(f"__{preset}"))


def _dealt(df: DataFrame) -> DataFrame:
    """A row for each row and preset, the clean one first."""
    return df.withColumn("preset", F.explode(F.array(*map(F.lit, ("clean", *PRESETS)))))


def _copy_id() -> Column:
    return F.when(F.col("preset") == "clean", F.col("session_id")).otherwise(F.concat("session_id", F.lit("__"), "preset"))


def copies_of(df: DataFrame) -> DataFrame:
    """What belongs to sessions (their facts, their GPS), for the clean ones and each corrupted copy."""
    return _dealt(df).withColumn("session_id", _copy_id()).drop("preset")


def base_and_preset(df: DataFrame) -> DataFrame:
    """df with base_id and preset (clean, or the corruption's), from the session ids."""
    parts = F.split("session_id", "__")
    known = F.element_at(parts, -1).isin(*PRESETS) & (F.size(parts) > 1)
    base = F.when(known, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "__")).otherwise(F.col("session_id"))
    return df.withColumns({"base_id": base, "preset": F.when(known, F.element_at(parts, -1)).otherwise("clean")})


def all_presets(imu: DataFrame, seed: int = SEED) -> DataFrame:
    """Clean sessions and their five corrupted copies, told apart by preset and session id. The rows are read and ordered once, and dealt to the copies."""
    rows = _dealt(_with_jitter(_with_loss(imu, seed), seed))
    rows = rows.where(~((F.col("preset") == "packet_loss_5") & F.col("__lost")))
    preset = F.col("preset")
    changed = {"t_ms": F.when(preset == "timestamp_jitter_3ms", F.col("__jittered")).otherwise(F.col("t_ms"))}
    for c in dict.fromkeys((*FLIPPED, *(c for add in BIAS.values() for c in add))):
        value = F.when((preset == "axis_flip_x") & F.lit(c in FLIPPED), -F.col(c))
        for name, add in BIAS.items():
            value = value.when(preset == name, F.col(c) + add.get(c, 0.0))
        changed[c] = value.otherwise(F.col(c))
    return rows.withColumns(changed | {"session_id": _copy_id()}).drop("__lost", "__jittered").select(*imu.columns, "preset")
