"""Sensor frames derived from the driver's events table. The SQL runs as it is in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gyrolens.schema import IMU, normalise

ROWS = """
  SELECT concat(event_type, '_', CAST(user_id % 4 AS STRING)) AS session_id, event_id, value,
    CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS row_idx
  FROM {events}"""

IMU_SQL = f"""
WITH r AS ({ROWS}),
c AS (SELECT r.*, CASE WHEN row_idx % 500 < 280 THEN 'S' WHEN row_idx % 500 < 300 THEN 'Z' ELSE 'D' END AS ph FROM r)
SELECT session_id, row_idx, 20 * row_idx + event_id % 5 AS t_ms,
  CASE ph WHEN 'S' THEN CAST(0.25 AS DOUBLE) WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE value / 8 END AS ax,
  CASE ph WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 7 AS DOUBLE) / 8 END AS ay,
  CASE ph WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE CAST(9.75 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) / 16 END AS az,
  CASE ph WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE CAST(event_id % 4 AS DOUBLE) / 64 END AS gx,
  CASE ph WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE CAST(row_idx % 8 AS DOUBLE) / 256 + CASE WHEN row_idx > 700 AND row_idx < 1200 THEN CAST(0.25 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END AS gy,
  CASE ph WHEN 'Z' THEN CAST(0 AS DOUBLE) ELSE CAST(0.125 AS DOUBLE) END AS gz,
  CASE WHEN row_idx % 10 = 9 THEN NULL ELSE CAST(32 + event_id % 16 AS DOUBLE) END AS mx,
  CASE WHEN row_idx % 10 = 9 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS my,
  CASE WHEN row_idx % 10 = 9 THEN NULL ELSE CAST(8 AS DOUBLE) END AS mz,
  CAST(101325 + event_id % 32 AS DOUBLE) AS pressure_pa,
  substring(session_id, 1, length(session_id) - 2) AS activity_label
FROM c WHERE event_id % 40 <> 0"""

SESSIONS_SQL = f"""
SELECT session_id, CAST(9.5 AS DOUBLE) AS acc_limit, CAST(0.5 AS DOUBLE) AS gyro_limit, CAST(47 AS DOUBLE) AS mag_limit,
  session_id NOT LIKE '%3' AS has_mag, session_id NOT LIKE '%2' AS has_gps, session_id NOT LIKE '%1' AS has_pressure
FROM (SELECT DISTINCT session_id FROM ({ROWS}) x) y"""

GPS_SQL = f"""
SELECT session_id, row_idx, 20 * row_idx + 7 AS t_ms, CAST(event_id % 90 AS DOUBLE) AS lat, CAST(event_id % 180 AS DOUBLE) AS lon,
  CASE WHEN session_id LIKE '%0' THEN event_id % 3 = 0 ELSE event_id % 3 <> 0 END AS valid
FROM ({ROWS}) x WHERE row_idx % 10 = 0 AND (session_id NOT LIKE '%1' OR row_idx < 60)"""

TRUTH_SQL = f"""
SELECT session_id, row_idx, 20 * row_idx + event_id % 5 AS t_ms, CAST(row_idx AS DOUBLE) / 64 AS x, CAST(row_idx % 16 AS DOUBLE) / 4 AS y, CAST(0 AS DOUBLE) AS z,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 25 - 12 AS DOUBLE) / 4 END AS heading
FROM ({ROWS}) x WHERE row_idx % 10 = 0"""

#: A track with made-up headings: what replay would give.
TRACK_SQL = f"SELECT session_id, row_idx, 20 * row_idx + event_id % 5 AS t_ms, CAST(event_id % 23 - 11 AS DOUBLE) / 4 AS yaw FROM ({ROWS}) x WHERE event_id % 40 <> 0"

LINES_SQL = """
SELECT event_id AS row_idx, concat(CASE WHEN event_id % 50 = 0 THEN 'user' ELSE CAST(user_id % 7 AS STRING) END, ',', event_type, ',', CAST(event_id * 50 AS STRING), ',', CAST(event_id % 9 AS STRING), '.5,',
  CASE WHEN event_id % 31 = 0 THEN 'bad' ELSE '0.25' END, ',1.0;') AS value FROM {events}"""

NMEA_SQL = """
SELECT event_id AS row_idx, concat('GPS Data: $', CASE WHEN event_id % 3 = 0 THEN 'GPVTG' WHEN event_id % 3 = 1 THEN 'GPRMC' ELSE 'GNRMC' END, ',081836,', CASE WHEN event_id % 5 = 0 THEN 'V' ELSE 'A' END, ',',
  CAST(2900 + event_id % 60 AS STRING), '.5,', CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END, ',', CAST(12100 + event_id % 60 AS STRING), '.25,E,000.0') AS value FROM {events}"""


def _events(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(_events(spark, sf_dir, IMU_SQL), IMU)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, SESSIONS_SQL)


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, GPS_SQL)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, TRUTH_SQL)


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, TRACK_SQL)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, LINES_SQL)


def nmea_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir, NMEA_SQL)
