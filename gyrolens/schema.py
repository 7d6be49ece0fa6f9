"""Canonical frames, and readers that tolerate missing and surplus columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("ax", "ay", "az", "gx", "gy", "gz")
MAG = ("mx", "my", "mz")
IMU = {"t_ms": "long"} | {c: "double" for c in (*AXES, *MAG, "pressure_pa", "temp_c")} | {"activity_label": "string"}
GPS = {"t_ms": "long", "lat": "double", "lon": "double", "valid": "boolean", "raw_sentence": "string"}
TRUTH = {"t_ms": "long", "x": "double", "y": "double", "z": "double", "heading": "double"}
REPLAY = {"t_ms": "long"} | {c: "double" for c in ("qw", "qx", "qy", "qz", "roll", "pitch", "yaw", "x", "y")}


def normalise(df: DataFrame, schema: dict[str, str], keys: tuple[str, ...] = ("session_id", "row_idx")) -> DataFrame:
    """Keys that df has, then the schema's columns: missing ones null, NaN as null, surplus ones gone."""
    out = [F.col(k) for k in keys if k in df.columns]
    for name, kind in schema.items():
        c = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        if kind == "double":
            c = F.when(~F.isnan(c), c)
        if name == "valid":
            c = F.coalesce(c, F.lit(False))
        if name == "raw_sentence":
            c = F.coalesce(c, F.lit(""))
        out.append(c.alias(name))
    return df.select(*out)
