"""Readers of recordings: delimited tables with a mapping, headerless and text logs, NMEA lines, session folders."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyrolens.config import GRAVITY
from gyrolens.functions import expressions as X
from gyrolens.operators import sampling
from gyrolens.schema import GPS, IMU, TRUTH, normalise

FORMATS = {".csv": "csv", ".tsv": "tsv", ".parquet": "parquet"}
#: Entries of a mapping's metadata that are kept with the session, and names of full scales (fixed values).
FACTS = ("dataset", "task", "reference_type", "subject_id", "body_location", "device_pose", "label_namespace")
FULL_SCALE = ("acc_mps2", "gyro_rads", "mag_uT")
SIGNALS = {"acc": (("ax", "ay", "az"), X.acceleration), "gyro": (("gx", "gy", "gz"), X.angle), "mag": (("mx", "my", "mz"), X.magnetic)}


def resolve_format(path: str, declared: str | None = None) -> str:
    """The declared format, or else that of the suffix."""
    found = declared or FORMATS.get(os.path.splitext(path)[1].lower())
    if found not in ("csv", "tsv", "parquet"):
        raise ValueError(f"Unsupported tabular format: {path}")
    return found


def read_table(spark: SparkSession, path: str, declared: str | None = None, delimiter: str | None = None) -> DataFrame:
    kind = resolve_format(path, declared)
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.option("header", True).option("sep", delimiter or ("\t" if kind == "tsv" else ",")).csv(path)


def _mapped(mapping: dict) -> list[str]:
    """Source columns that a mapping names."""
    found = []
    for section in ("imu", "gps", "ground_truth"):
        for key, value in (mapping.get(section) or {}).items():
            if key.endswith("_cols"):
                found += list(value)
            elif key.endswith("_col"):
                found.append(value)
    return found


def check_mapping(df: DataFrame, mapping: dict) -> None:
    """Raises on missing columns, a mapping without signals, or positions that aren't in two or three dimensions."""
    missing = sorted(set(_mapped(mapping)) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    imu = mapping["imu"]
    if not any(f"{s}_cols" in imu for s in SIGNALS) and not {"temp_col", "pressure_col"} & imu.keys():
        raise ValueError("At least one signal must be mapped.")
    if len((mapping.get("ground_truth") or {}).get("position_cols", [0, 0])) not in (2, 3):
        raise ValueError("position_cols must name two or three columns.")


def from_table(df: DataFrame, mapping: dict, session_id: str, order: Column | None = None) -> dict[str, DataFrame]:
    """Canonical frames imu, gps (if mapped) and ground_truth (if mapped) of one table.

    mapping: sections imu, gps, ground_truth with <name>_col, <name>_cols and <name>_unit entries.
    """
    check_mapping(df, mapping)
    imu = mapping["imu"]
    time = X.time_ms(F.col(imu["time_col"]), imu.get("time_unit", "ms"))
    base = df.withColumns({"session_id": F.lit(session_id), "row_idx": order if order is not None else F.monotonically_increasing_id(), "__t": time})
    columns = {"t_ms": F.col("__t")}
    for name, (targets, convert) in SIGNALS.items():
        for target, source in zip(targets, imu.get(f"{name}_cols", ())):
            columns[target] = convert(F.col(source), imu[f"{name}_unit"])
    if "temp_col" in imu:
        columns["temp_c"] = X.temperature(F.col(imu["temp_col"]), imu.get("temp_unit", "C"))
    if "pressure_col" in imu:
        columns["pressure_pa"] = X.pressure(F.col(imu["pressure_col"]), imu.get("pressure_unit", "Pa"))
    if "label_col" in imu:
        columns["activity_label"] = F.col(imu["label_col"])
    meta = mapping.get("metadata") or {}
    pick = lambda cols: base.select("session_id", "row_idx", *[c.alias(n) for n, c in cols.items()])
    frames = {"imu": normalise(pick(columns), IMU)}
    if gps := mapping.get("gps"):
        cols = {"t_ms": F.col("__t"), "lat": F.col(gps["lat_col"]), "lon": F.col(gps["lon_col"])}
        cols["valid"] = F.col(gps["valid_col"]).cast("boolean") if "valid_col" in gps else F.lit(True)
        frames["gps"] = normalise(pick(cols).where(F.col("lat").isNotNull() & F.col("lon").isNotNull()), GPS)
    if truth := mapping.get("ground_truth"):
        cols = {"t_ms": F.col("__t")}
        for target, source in zip(("x", "y", "z"), truth.get("position_cols", ())):
            cols[target] = X.position(F.col(source), truth.get("position_unit", "m"))
        if "heading_col" in truth:
            cols["heading"] = X.angle(F.col(truth["heading_col"]), truth.get("heading_unit", "rad"))
        frames["ground_truth"] = normalise(pick(cols), TRUTH)
    scale = (meta.get("extra") or {}).get("full_scale") or meta.get("full_scale") or {}
    rows = describe_sessions(frames["imu"], frames.get("gps"), tuple(scale.get(k) for k in FULL_SCALE))
    facts = {k: F.lit(meta.get(k)).cast("string") for k in FACTS}
    facts["task"] = F.lit(meta.get("task") or "orientation")
    facts["dataset"] = F.lit(meta.get("dataset") or "tabular")
    if "ground_truth" in frames and not meta.get("reference_type"):
        facts["reference_type"] = F.lit("trajectory")
    notes = F.array(*map(F.lit, meta.get("notes") or ())).cast("array<string>")
    rate = F.lit(meta["nominal_hz"]).cast("double") if meta.get("nominal_hz") else F.col("nominal_hz")
    frames["sessions"] = rows.withColumns(facts | {"notes": notes, "nominal_hz": rate, "ground_truth_available": F.lit("ground_truth" in frames)})
    return frames


def ingest_tabular(spark: SparkSession, path: str, mapping: dict, session_id: str | None = None) -> dict[str, DataFrame]:
    df = read_table(spark, path, mapping.get("format"), mapping.get("delimiter"))
    named = session_id or (mapping.get("metadata") or {}).get("session_id") or os.path.splitext(os.path.basename(path))[0]
    return from_table(df, mapping, named)


def preflight(spark: SparkSession, path: str, mapping: dict) -> dict:
    """Format, bytes on disk, rows, an estimate of memory and the columns that would be read."""
    df = read_table(spark, path, mapping.get("format"), mapping.get("delimiter"))
    rows = df.count()
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles() if os.path.exists(f.removeprefix("file://")))
    return {"source_bytes": size, "sample": [r.asDict() for r in df.limit(5).collect()], "source_format": resolve_format(path, mapping.get("format")), "estimated_rows": rows, "estimated_imu_memory_bytes": rows * 8 * len(IMU), "files": len(df.inputFiles()), "columns": sorted(_mapped(mapping))}


# Text logs.


def parse_labelled_lines(lines: DataFrame, order: str = "row_idx") -> DataFrame:
    """Lines (value) of user,activity,timestamp,x,y,z; as session user_<n>, activity_label, stamp, ax, ay, az in m/s^2. Headers and damaged lines go."""
    parts = F.split(F.regexp_replace(F.trim("value"), ";+$", ""), ",")
    get = lambda i: F.trim(F.get(parts, F.lit(i)))
    rows = lines.select(order, F.size(parts).alias("n"), get(0).alias("user"), get(1).alias("activity_label"), get(2).try_cast("double").alias("stamp"), *[(get(i).try_cast("double") * GRAVITY).alias(a) for i, a in ((3, "ax"), (4, "ay"), (5, "az"))])
    whole = (F.col("n") >= 6) & (F.lower("user") != "user") & F.col("stamp").isNotNull() & F.col("ax").isNotNull() & F.col("ay").isNotNull() & F.col("az").isNotNull()
    return rows.where(whole).select(F.concat(F.lit("user_"), F.col("user")).alias("session_id"), order, "activity_label", "stamp", "ax", "ay", "az")


def parse_nmea(lines: DataFrame, order: str = "row_idx") -> DataFrame:
    """RMC sentences in lines (value): row, valid, lat, lon (null unless valid), raw_sentence."""
    sentence = lines.select(order, F.explode(F.split("value", "[$]")).alias("s"))
    f = F.split("s", ",")
    got = sentence.where(F.col("s").rlike("^G[PN]RMC,") & (F.size(f) >= 7)).withColumn("f", f)
    get = lambda i: F.get("f", F.lit(i))
    valid = get(2) == "A"
    return got.select(order, valid.alias("valid"), F.when(valid, X.nmea_degrees(get(3), get(4))).alias("lat"), F.when(valid, X.nmea_degrees(get(5), get(6))).alias("lon"), F.concat(F.lit("$"), F.trim("s")).alias("raw_sentence"))


#: Scales of the mixed log's raw counts (fixed values): full scale by 32768.
ACC_SCALE, GYRO_SCALE, MAG_SCALE = GRAVITY * 2 / 32768, 0.0174532925 * 250 / 32768, 0.6


def parse_mixed_log(lines: DataFrame, scaled: bool = False, order: str = "row_idx") -> dict[str, DataFrame]:
    """A log of numeric rows (ten or twelve fields: time, acceleration, rates, field[, temperature, pressure]) with NMEA sentences between them."""
    f = F.split(F.trim("value"), "[\\s,]+")
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    rows = lines.withColumn("f", f)
    numeric = (F.size("f") >= 10) & F.forall(F.slice("f", 1, 10), lambda x: x.try_cast("double").isNotNull())
    scale = lambda s: 1.0 if scaled else s
    cols = [number(i + 1) * scale(s) for i, s in enumerate([ACC_SCALE] * 3 + [GYRO_SCALE] * 3 + [MAG_SCALE] * 3)]
    names = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")
    imu = rows.where(numeric).select(order, number(0).cast("long").alias("t_ms"), *[c.alias(n) for c, n in zip(cols, names)], number(10).alias("temp_c"), number(11).alias("pressure_pa"))
    # A sentence has the time of the last numeric row before it.
    clock = lines.select(order, F.lit(None).cast("long").alias("t_ms")).join(imu.select(F.col(order).alias("__o"), F.col("t_ms").alias("__t")), F.col(order) == F.col("__o"), "left")
    carried = clock.select(order, F.last("__t", ignorenulls=True).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("t_ms"))
    gps = parse_nmea(lines, order).join(carried, order)
    return {"imu": imu, "gps": gps.withColumn("t_ms", F.coalesce("t_ms", (F.row_number().over(Window.orderBy(order)) - 1) * 1000))}


def spread_sidecar(gps: DataFrame, imu: DataFrame) -> DataFrame:
    """Times of GPS rows without a clock (session_id, row_idx): spread evenly over the recording, truncated to milliseconds."""
    span = imu.groupBy("session_id").agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))
    n = gps.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("session_id").orderBy("row_idx")) - 1
    return gps.withColumn("at", at).join(span, "session_id").join(n, "session_id").withColumn("t_ms", F.when(F.col("n") > 1, (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("at") / (F.col("n") - 1))).otherwise(F.col("lo")).cast("long")).drop("lo", "hi", "n", "at")


def choose_gps(inline: DataFrame, sidecar: DataFrame) -> DataFrame:
    """The longer source for each session; inline among equals."""
    a, b = (df.groupBy("session_id").agg(F.count(F.lit(1)).alias(n)) for df, n in ((inline, "i"), (sidecar, "s")))
    pick = a.join(b, "session_id", "full").select("session_id", (F.coalesce("s", F.lit(0)) > F.coalesce("i", F.lit(0))).alias("side"))
    return inline.join(pick.where(~F.col("side")), "session_id", "left_semi").unionByName(sidecar.join(pick.where("side"), "session_id", "left_semi"))


def join_notes(sessions: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes (stem, note) by the log's name, whatever its case."""
    return sessions.join(notes.select(F.lower("stem").alias("__stem"), "note"), F.lower("session_id") == F.col("__stem"), "left").drop("__stem")


# Headerless and HDF5 recordings.


def resolve_log(path: str) -> str:
    """A log file, or the first .txt or .csv of a folder in order of names."""
    if not os.path.isdir(path):
        return path
    names = sorted(n for n in os.listdir(path) if n.lower().endswith((".txt", ".csv")))
    if not names:
        raise ValueError(f"No .txt or .csv file in {path}")
    return os.path.join(path, names[0])


def detect(path: str) -> str | None:
    """The reader that a file or folder looks made for, by names alone."""
    names = sorted(os.listdir(path)) if os.path.isdir(path) else [os.path.basename(path)]
    low = [n.lower() for n in names]
    if any(n.endswith((".h5", ".hdf5")) for n in low):
        return "hdf5"
    if any(n.startswith("imu") and n.endswith(".csv") for n in low):
        return "positional"
    if any(os.path.splitext(n)[1] in FORMATS for n in low) and not os.path.isdir(path):
        return "tabular"
    return "labelled_lines" if any(n.endswith((".txt", ".csv")) for n in low) else None


def ingest_positional(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All imu*.csv of a folder as sessions, with the truth of the vi*.csv of the same number beside them."""

    def rows(prefix: str) -> DataFrame | None:
        files = sorted(n for n in os.listdir(folder) if n.lower().startswith(prefix) and n.lower().endswith(".csv"))
        if not files:
            return None
        read = spark.read.csv([os.path.join(folder, n) for n in files])
        number = F.regexp_extract(F.input_file_name(), rf"(?i)/{prefix}([^/]*)\.csv$", 1)
        return read.withColumns({"session_id": F.concat(F.lit("imu"), number), "row_idx": F.monotonically_increasing_id()})

    imu = rows("imu")
    if imu is None:
        raise ValueError(f"No imu*.csv in {folder}")
    return from_positional(imu, rows("vi"))


def from_positional(imu: DataFrame, truth: DataFrame | None = None) -> dict[str, DataFrame]:
    """Headerless rows _c0.. (with session_id, row_idx): time, attitude x3, rates x3, gravity x3, user acceleration x3, field x3. Accelerations in g are told by their median norm."""
    d = lambda i: F.col(f"_c{i}").cast("double")
    wide = "_c12" in imu.columns
    rows = imu.select("session_id", "row_idx", d(0).alias("stamp"), *[d(i).alias(n) for i, n in zip((4, 5, 6), ("gx", "gy", "gz"))], *[d(i).alias(f"u{n}") for i, n in zip((10, 11, 12) if wide else (1, 2, 3), "xyz")], *[d(i).alias(f"w{n}") for i, n in zip((7, 8, 9), "xyz")], *[(d(i) if f"_c{i}" in imu.columns else F.lit(None).cast("double")).alias(n) for i, n in zip((13, 14, 15), ("mx", "my", "mz"))])
    out = {"imu": accel_to_mps2(rows)}
    if truth is not None:
        out["ground_truth"] = truth.select("session_id", "row_idx", d(0).alias("stamp"), d(2).alias("x"), d(3).alias("y"), d(4).alias("z"))
    return out


def accel_to_mps2(rows: DataFrame) -> DataFrame:
    """ax, ay, az from user acceleration (ux..) and gravity (wx..): a median norm of gravity in (0.5, 1.5) means g for both; of acceleration alone, g; else as it is."""
    inside = lambda c: (F.col(c) > 0.5) & (F.col(c) < 1.5)
    med = lambda p: F.percentile(X.norm(*[F.col(f"{p}{a}") for a in "xyz"]), 0.5)
    medians = rows.groupBy("session_id").agg(med("w").alias("__w"), med("u").alias("__u"))
    joined = rows.join(medians, "session_id")
    cols = {f"a{a}": F.when(inside("__w"), (F.col(f"u{a}") + F.col(f"w{a}")) * GRAVITY).when(inside("__u"), F.col(f"u{a}") * GRAVITY).otherwise(F.col(f"u{a}")) for a in "xyz"}
    return joined.withColumns(cols).drop("__w", "__u", *[f"{p}{a}" for p in "uw" for a in "xyz"])


def ingest_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """Rows of HDF5 recordings (groups synced and pose): one Python task a file. Needs h5py."""
    import importlib.util

    if importlib.util.find_spec("h5py") is None:
        raise ImportError("h5py is needed to read HDF5 recordings")

    def parse(batches):
        import io

        import h5py
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with h5py.File(io.BytesIO(content), "r") as f:
                    synced = f["synced"]
                    pick = lambda *names: next((synced[n][:] for n in names if n in synced), None)  # noqa: B023, E731
                    frame = pd.DataFrame({"stamp": synced["time"][:]})
                    for p, data in (("a", pick("acce")), ("g", pick("gyro", "gyro_uncalib")), ("m", pick("magnet", "magnet_uncalib", "mag"))):
                        for i, a in enumerate("xyz"):
                            frame[p + a] = data[:, i] if data is not None else None
                    yield frame.assign(session_id=name.rsplit("/", 2)[-2], row_idx=range(len(frame)))

    kinds = ", ".join(f"{p}{a} double" for p in "agm" for a in "xyz")
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, f"stamp double, {kinds}, session_id string, row_idx long")


# Session folders.


def save_sessions(frames: dict[str, DataFrame], root: str) -> None:
    """A folder for each frame, partitioned by session."""
    for name, df in frames.items():
        df.write.mode("overwrite").partitionBy("session_id").parquet(f"{root}/{name}")


def load_sessions(spark: SparkSession, root: str, frames: tuple[str, ...] = ("imu", "gps", "ground_truth", "sessions")) -> dict[str, DataFrame]:
    """Lazy frames of all sessions under a root; those that aren't there are left out."""
    jvm = spark.sparkContext._jvm
    out = {}
    for name in frames:
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            out[name] = spark.read.parquet(f"{root}/{name}")
    return out


def describe_sessions(imu: DataFrame, gps: DataFrame | None = None, full_scale: tuple[float | None, float | None, float | None] = (None, None, None)) -> DataFrame:
    """sessions frame: which sensors have values, limits of full scale, nominal rate (median of positive steps; null if none), label and row facts."""
    some = lambda *cols: F.count(F.coalesce(*cols)) > 0
    rows = imu.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_rows"), some("ax", "gx").alias("has_imu"), some("mx", "my", "mz").alias("has_mag"), some("pressure_pa").alias("has_pressure"), some("temp_c").alias("has_temperature"), some("activity_label").alias("labels_available")
    )
    rates = sampling.sampling_stats(imu, positive=True).select("session_id", F.nullif(F.col("nominal_hz"), F.lit(0.0)).alias("nominal_hz"))
    rows = rows.join(rates, "session_id")
    limits = {n: F.lit(v).cast("double") for n, v in zip(("acc_limit", "gyro_limit", "mag_limit"), full_scale)}
    if gps is None:
        return rows.withColumns({"has_gps": F.lit(False)} | limits)
    return rows.join(gps.select("session_id").distinct().withColumn("__g", F.lit(True)), "session_id", "left").withColumns({"has_gps": F.coalesce("__g", F.lit(False))} | limits).drop("__g")


#: Registry of readers, by name in any case.
ADAPTERS = {"tabular": ingest_tabular, "positional": from_positional, "labelled_lines": parse_labelled_lines, "mixed_log": parse_mixed_log, "hdf5": ingest_hdf5}


def adapter(name: str):
    if name.lower() not in ADAPTERS:
        raise ValueError(f"Unknown adapter: {name}. Known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name.lower()]


def union_frames(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    names = dict.fromkeys(n for p in parts for n in p)
    return {n: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p[n] for p in parts if n in p]) for n in names}
