"""DuckDB SQL of the queries."""

from __future__ import annotations

from gyrolens.config import CODES, AuditConfig
from gyrolens.operators.audit import METRICS, WINDOW_CODES
from gyrolens.operators.corruption import PRESETS
from gyrolens.plans import views as V

CFG = AuditConfig()
W = CFG.weights
view = lambda sql: sql.replace("{events}", "events")
AXES = ("ax", "ay", "az", "gx", "gy", "gz")

BASE = f"imu AS ({view(V.IMU_SQL)}), ses AS ({view(V.SESSIONS_SQL)}), gps AS ({view(V.GPS_SQL)}), truth AS ({view(V.TRUTH_SQL)}), track AS ({view(V.TRACK_SQL)})"
CLOSE = " AND ".join(f"coalesce(abs({a} - p{a}) <= 1e-12 + 1e-5 * abs(p{a}), false)" for a in AXES)
ZERO = " AND ".join(f"coalesce(abs({a}) <= 1e-12, false)" for a in AXES)
LAGS = ", ".join(f"lag({a}) OVER o AS p{a}" for a in ("t_ms", *AXES))


def clip(cols: tuple[str, ...], limit: str) -> str:
    hits = " + ".join(f"CASE WHEN abs({c}) >= 0.98 * {limit} THEN 1 ELSE 0 END" for c in cols)
    return f"sum({hits}) / CAST({len(cols)} * count(*) AS DOUBLE)"


CLIPS = f"coalesce(greatest({clip(AXES[:3], 'acc_limit')}, {clip(AXES[3:], 'gyro_limit')}, {clip(('mx', 'my', 'mz'), 'mag_limit')}), 0)"


def rows(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


DT = "dt AS (SELECT session_id, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms, row_idx) AS dt FROM imu)"


def stats(source: str = "imu", positive: bool = False) -> str:
    keep = "dt > 0" if positive else "dt IS NOT NULL"
    return f"""sdt AS (SELECT session_id, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms, row_idx) AS dt FROM {source}),
sst AS (SELECT session_id, quantile_cont(dt, 0.5) AS m, avg(dt) AS a, stddev_pop(dt) AS j FROM sdt WHERE {keep} GROUP BY session_id),
stats AS (SELECT session_id, n_rows, coalesce(m, 0) AS median_dt_ms, coalesce(a, 0) AS mean_dt_ms, coalesce(j, 0) AS jitter_ms, span / 1000.0 AS duration_s, CASE WHEN m > 0 THEN 1000.0 / m ELSE 0 END AS nominal_hz
  FROM (SELECT session_id, count(*) AS n_rows, CAST(max(t_ms) - min(t_ms) AS DOUBLE) AS span FROM imu GROUP BY session_id) LEFT JOIN sst USING (session_id))"""


def windows(memory: bool = False, imu: str = "imu", ses: str = "ses", gps: str = "gps") -> str:
    """CTEs up to win: metrics, penalties, score and codes of each window."""
    gate = (lambda c: "true") if memory else (lambda c: c)
    base = "base_dt" if memory else "greatest(median_dt, 1)"
    medians = f"bd AS (SELECT session_id, greatest(coalesce(quantile_cont(d, 0.5), 0), 1) AS base_dt FROM (SELECT session_id, t_ms - lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms, row_idx) AS d FROM {imu}) GROUP BY session_id),"
    scaled = lambda code, value, top: f"{W[code]} * least(1.0, {value} / {top}::DOUBLE)"
    p = {
        "timing_bad": f"CASE WHEN jitter_ms >= 4 THEN {scaled('timing_bad', 'jitter_ms', 8.0)} ELSE 0 END",
        "dropout": f"CASE WHEN missing_ratio >= 0.01 OR freeze_ratio >= 0.04 THEN {scaled('dropout', 'greatest(missing_ratio, freeze_ratio)', 0.01)} ELSE 0 END",
        "clipping": f"CASE WHEN clipping_ratio >= 0.005 THEN {scaled('clipping', 'clipping_ratio', 0.005)} ELSE 0 END",
        "mag_disturbed": f"CASE WHEN {gate('has_mag')} AND mag_cv >= 0.25 THEN {scaled('mag_disturbed', 'mag_cv', 0.25)} ELSE 0 END",
        "gps_unreliable": f"CASE WHEN has_gps AND gps_valid_ratio < 0.5 THEN {scaled('gps_unreliable', '(0.5 - gps_valid_ratio)', 0.5)} ELSE 0 END",
        "orientation_inconsistent": f"CASE WHEN is_static AND gravity_residual >= 1.5 THEN {scaled('orientation_inconsistent', 'gravity_residual', 1.5)} ELSE 0 END",
        "pressure_unstable": f"CASE WHEN is_static THEN CASE WHEN {gate('has_pressure')} AND pressure_std >= 12 THEN {scaled('pressure_unstable', 'pressure_std', 12.0)} ELSE 0 END WHEN {gate('has_pressure')} AND pressure_delta >= 18 THEN {W['pressure_unstable'] * 0.5} ELSE 0 END",
    }
    codes = ", ".join(f"CASE WHEN p_{k} > 0 THEN '{k}' END" for k in WINDOW_CODES)
    whole = lambda n: f"CASE WHEN count({n}) = count(*) THEN stddev_pop({n}) END"
    return f"""{medians}
t0 AS (SELECT session_id, min(t_ms) AS t0 FROM {imu} GROUP BY session_id),
x AS (SELECT i.*, unnest(generate_series(CAST(greatest(0, ceil((t_ms - t0 - 5000) / CAST(2500 AS DOUBLE))) AS BIGINT), CAST(floor((t_ms - t0) / CAST(2500 AS DOUBLE)) AS BIGINT))) AS win_idx FROM {imu} i JOIN t0 USING (session_id)),
y AS (SELECT x.*, {LAGS}, sqrt(ax * ax + ay * ay + az * az) AS accn, sqrt(gx * gx + gy * gy + gz * gz) AS gyrn, sqrt(coalesce(mx, 0) ** 2 + coalesce(my, 0) ** 2 + coalesce(mz, 0) ** 2) AS magn,
  acc_limit, gyro_limit, mag_limit FROM x JOIN {ses} USING (session_id) WINDOW o AS (PARTITION BY session_id, win_idx ORDER BY t_ms, row_idx)),
m AS (SELECT session_id, win_idx, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) AS end_ms, coalesce(stddev_pop(t_ms - pt_ms), 0) AS jitter_ms, quantile_cont(t_ms - pt_ms, 0.5) AS median_dt, list(t_ms - pt_ms) FILTER (WHERE pt_ms IS NOT NULL) AS dts,
  greatest(avg(CASE WHEN pt_ms IS NOT NULL THEN CASE WHEN {CLOSE} THEN 1.0 ELSE 0.0 END END), avg(CASE WHEN {ZERO} THEN 1.0 ELSE 0.0 END)) AS freeze_ratio, {CLIPS} AS clipping_ratio,
  {whole("accn")} AS acc_std, {whole("gyrn")} AS gyro_std, quantile_cont(abs(accn - 9.80665::DOUBLE), 0.5) AS gravity_residual,
  CASE WHEN count(*) > 3 AND avg(magn) > 0 {"" if memory else "AND count(coalesce(mx, my, mz)) > 0"} THEN stddev_pop(magn) / avg(magn) ELSE 0 END AS mag_cv,
  coalesce(max(pressure_pa) - min(pressure_pa), 0) AS pressure_delta, coalesce(stddev_pop(pressure_pa), 0) AS pressure_std, avg(gx) AS mgx, avg(gy) AS mgy, avg(gz) AS mgz FROM y GROUP BY session_id, win_idx HAVING count(*) >= 2),
met AS (SELECT m.*, len(list_filter(dts, lambda v: v > {CFG.gap_factor}::DOUBLE * {base})) / CAST(len(dts) AS DOUBLE) AS missing_ratio FROM m JOIN bd USING (session_id)),
gchk AS (SELECT session_id, coalesce(gps_rows, 0) AS gps_rows, coalesce(r, 0) AS gps_valid_ratio, CASE WHEN gps_rows >= 2 AND span > 0 THEN g / span END AS gps_alignment_ratio
  FROM (SELECT session_id, CAST(max(t_ms) - min(t_ms) AS DOUBLE) AS span FROM {imu} GROUP BY session_id) LEFT JOIN (SELECT session_id, count(*) AS gps_rows, avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) AS r, CAST(max(t_ms) - min(t_ms) AS DOUBLE) AS g FROM {gps} GROUP BY session_id) USING (session_id)),
st AS (SELECT met.*, has_mag, has_gps, has_pressure, gps_valid_ratio, coalesce(acc_std <= 0.35 AND gyro_std <= 0.08, false) AS is_static FROM met JOIN {ses} USING (session_id) JOIN gchk USING (session_id)),
pen AS (SELECT *, {", ".join(f"CAST({v} AS DOUBLE) AS p_{k}" for k, v in p.items())} FROM st),
win AS (SELECT *, greatest(0, 1.0 - ({" + ".join(f"p_{k}" for k in WINDOW_CODES)})) AS trust_score, list_sort(list_filter([{codes}], lambda c: c IS NOT NULL)) AS reason_codes FROM pen)"""


def scores(memory: bool = False, **names) -> str:
    imu, ses = names.get("imu", "imu"), names.get("ses", "ses")
    codes = ", ".join(f"CASE WHEN t_{k} > 0 THEN '{k}' END" for k in CODES)
    total = " + ".join(f"t_{k}" for k in CODES)
    plain = [k for k in WINDOW_CODES if k != "gps_unreliable"]
    return f"""{windows(memory, **names)},
fs AS (SELECT session_id, min(win_idx) AS w0, arg_min([mgx, mgy, mgz], win_idx) AS b FROM win WHERE is_static GROUP BY session_id),
drift AS (SELECT session_id, max(sqrt((mgx - b[1]) ** 2 + (mgy - b[2]) ** 2 + (mgz - b[3]) ** 2)) AS dr FROM win JOIN fs USING (session_id) WHERE is_static AND win_idx <> w0 GROUP BY session_id),
agg AS (SELECT session_id, count(*) AS window_count, avg(trust_score) AS window_mean, avg(CASE WHEN is_static THEN 1.0 ELSE 0.0 END) AS sr, {", ".join(f"sum(p_{k}) AS s_{k}" for k in WINDOW_CODES)} FROM win GROUP BY session_id),
ss AS (SELECT i.session_id, coalesce(window_count, 0) AS window_count, coalesce(window_mean, 1.0) AS window_mean, coalesce(sr, 0) AS static_window_ratio, coalesce(dr, 0) AS gyro_bias_drift_rads, gps_rows, gps_valid_ratio, gps_alignment_ratio, has_mag, has_gps, has_pressure,
  {", ".join(f"coalesce(s_{k}, 0) AS t_{k}" for k in plain)},
  CASE WHEN coalesce(dr, 0) >= 0.15 THEN 0.12 * least(1.0, dr / 0.15::DOUBLE) ELSE 0 END AS t_gyro_bias_drift,
  CASE WHEN coalesce(sr, 0) < 0.08 THEN 0.08 * least(1.0, (0.08::DOUBLE - coalesce(sr, 0)) / 0.08::DOUBLE) ELSE 0 END AS t_insufficient_static_segment,
  coalesce(s_gps_unreliable, 0) + CASE WHEN has_gps AND (gps_alignment_ratio < 0.2 OR gps_alignment_ratio > 1.6) THEN 0.04 ELSE 0 END AS t_gps_unreliable
  FROM (SELECT DISTINCT session_id FROM {imu}) i LEFT JOIN agg USING (session_id) LEFT JOIN drift USING (session_id) JOIN gchk USING (session_id) JOIN {ses} USING (session_id)),
sc0 AS (SELECT *, greatest(0, least(1, window_mean - ({total}) / greatest(window_count, 1))) AS trust_score, list_sort(list_filter([{codes}], lambda c: c IS NOT NULL)) AS reason_codes FROM ss),
sc AS (SELECT *, CASE WHEN trust_score < 0.6 THEN 'fail' WHEN trust_score < 0.8 THEN 'warning' ELSE 'pass' END AS status FROM sc0)"""


SCATTER = "((row_idx % 1000003 + 42) * 7919 + ((row_idx * row_idx) % 1000003) * 104729) % 1000003"
LOSS = f"SELECT * EXCLUDE (r, k) FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {SCATTER}, row_idx) AS r, greatest(1, round_even(0.05::DOUBLE * count(*) OVER (PARTITION BY session_id), 0)) AS k FROM imu) WHERE r > k"
JITTER = f"SELECT * REPLACE (max(t_ms + ({SCATTER}) % 7 - 3) OVER (PARTITION BY session_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS t_ms) FROM imu"
FLIP = "SELECT * REPLACE (-ax AS ax, -gx AS gx, -mx AS mx) FROM imu"
GYRO = "SELECT * REPLACE (gx + 0.03::DOUBLE AS gx, gy - 0.02::DOUBLE AS gy, gz + 0.015::DOUBLE AS gz) FROM imu"
MAG = "SELECT * REPLACE (mx + 30 AS mx, my - 15 AS my, mz + 10 AS mz) FROM imu"
CORRUPT = dict(zip(PRESETS, (LOSS, JITTER, FLIP, GYRO, MAG)))


def _with_presets(table: str) -> str:
    return " UNION ALL ".join([f"SELECT * FROM {table}", *[f"SELECT * REPLACE (session_id || '__{p}' AS session_id) FROM {table}" for p in PRESETS]])


PRESET_IMU = " UNION ALL ".join(["SELECT * FROM imu", *[f"SELECT * REPLACE (session_id || '__{p}' AS session_id) FROM ({sql})" for p, sql in CORRUPT.items()]])
VALID = f"""{BASE}, imu6 AS ({PRESET_IMU}), ses6 AS ({_with_presets("ses")}), gps6 AS ({_with_presets("gps")}), {scores(imu="imu6", ses="ses6", gps="gps6")},
vv AS (SELECT split_part(session_id, '__', 1) AS base_id, split_part(session_id, '__', 2) AS preset, trust_score FROM sc),
val AS (SELECT v.base_id, v.preset, c.trust_score AS clean_score, v.trust_score, v.trust_score - c.trust_score AS trust_score_delta, v.trust_score <= c.trust_score + 1e-9 AS non_improving FROM vv v JOIN vv c ON c.base_id = v.base_id AND c.preset = '' WHERE v.preset <> '')"""

DROPPED = f"{BASE}, {windows()}, dw AS (SELECT * FROM win WHERE trust_score < 0.55)"
MERGED = f"""{DROPPED},
mk AS (SELECT session_id, start_ms, end_ms, coalesce(start_ms > max(end_ms) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new FROM dw WINDOW o AS (PARTITION BY session_id ORDER BY start_ms, end_ms)),
isl AS (SELECT *, sum(CASE WHEN is_new THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS g FROM mk),
mi AS (SELECT session_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM isl GROUP BY session_id, g)"""

ORD = "PARTITION BY session_id ORDER BY t_ms, row_idx"
CAND = f"""dyn AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) - avg(sqrt(ax * ax + ay * ay + az * az)) OVER ({ORD} ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS dynamic FROM imu),
nb AS (SELECT *, lag(dynamic) OVER ({ORD}) AS b, lead(dynamic) OVER ({ORD}) AS a FROM dyn),
cand AS (SELECT session_id, row_idx, t_ms, dynamic, row_number() OVER ({ORD}) AS rn FROM nb WHERE dynamic > 1.1 AND dynamic > b AND dynamic > a),
walk AS (SELECT session_id, row_idx, t_ms, dynamic, rn, t_ms AS last, true AS keep FROM cand WHERE rn = 1
  UNION ALL SELECT c.session_id, c.row_idx, c.t_ms, c.dynamic, c.rn, CASE WHEN c.t_ms - w.last < 280 THEN w.last ELSE c.t_ms END, c.t_ms - w.last >= 280 FROM walk w JOIN cand c ON c.session_id = w.session_id AND c.rn = w.rn + 1),
steps AS (SELECT * FROM walk WHERE keep)"""
RECKON = f"""{CAND}, sl AS (SELECT t.*, CASE WHEN dynamic IS NOT NULL THEN 0.72::DOUBLE * greatest(0.8::DOUBLE, least(1.3::DOUBLE, dynamic / 6.0::DOUBLE)) END AS len FROM track t LEFT JOIN steps USING (session_id, row_idx)),
dr AS (SELECT session_id, row_idx, sl.t_ms, coalesce(sum(len * cos(yaw)) OVER o, 0) AS x, coalesce(sum(len * sin(yaw)) OVER o, 0) AS y FROM sl WINDOW o AS (PARTITION BY session_id ORDER BY t_ms, row_idx ROWS UNBOUNDED PRECEDING))"""
WRAP = lambda e: f"(({e}) + pi()) - 2 * pi() * floor((({e}) + pi()) / (2 * pi())) - pi()"


def near(left: str, right: str, tol: int, lcols: str, rcols: str) -> str:
    """CTE nr: left rows with the nearest right row in m."""
    fields = ", ".join(f"'{c}': {c}" for c in rcols.split())
    return f"""rl AS (SELECT session_id, t_ms, arg_max({{'rt': t_ms, {fields}}}, row_idx) AS v FROM {right} GROUP BY session_id, t_ms),
b AS (SELECT l.session_id, l.row_idx, l.t_ms, {lcols}, rl.v AS b FROM {left} l ASOF LEFT JOIN rl ON l.session_id = rl.session_id AND l.t_ms >= rl.t_ms),
bf AS (SELECT b.*, rl.v AS f FROM b ASOF LEFT JOIN rl ON b.session_id = rl.session_id AND b.t_ms <= rl.t_ms),
nr AS (SELECT * FROM (SELECT *, CASE WHEN f IS NULL OR (b IS NOT NULL AND t_ms - b.rt <= f.rt - t_ms) THEN b ELSE f END AS m FROM bf) WHERE abs(m.rt - t_ms) <= {tol})"""


ORIGIN = lambda t: f"SELECT session_id, row_idx, t_ms, x - first_value(x) OVER o AS x, y - first_value(y) OVER o AS y FROM {t} WINDOW o AS ({ORD})"
SUMMARY_NUMBERS = ("trust_score", "static_window_ratio", "gyro_bias_drift_rads", "gps_alignment_ratio", *[f"t_{k}" for k in CODES])


def smoothness(track: str) -> str:
    return f"""(WITH a AS (SELECT *, yaw - lag(yaw) OVER ({ORD}) AS d FROM {track}), w AS (SELECT *, {WRAP("d")} AS s FROM a), u AS (SELECT *, CASE WHEN s = -pi() AND d > 0 THEN pi() ELSE s END AS e FROM w), z AS (SELECT session_id, abs(e - lag(e) OVER ({ORD})) AS dd FROM u)
 SELECT session_id, 'path_smoothness' AS metric, coalesce(avg(dd), 0) AS value FROM z GROUP BY session_id)"""


def drift(track: str) -> str:
    return f"(WITH {near(track, 'told', 250, 'yaw', 'heading')} SELECT session_id, 'heading_drift_rad' AS metric, avg(abs({WRAP('yaw - m.heading')})) AS value FROM nr GROUP BY session_id)"


TRACK_METRICS = f"""{BASE}, told AS (SELECT * FROM truth WHERE session_id NOT LIKE '%2' AND heading IS NOT NULL), half AS (SELECT * REPLACE (yaw / 2 AS yaw) FROM track),
mt AS ({" UNION ALL ".join(f"SELECT session_id, '{name}' AS baseline, metric, value FROM {of(track)}" for name, track in (("first", "track"), ("second", "half")) for of in (smoothness, drift))})"""


def oracle_sql() -> dict[str, str]:
    q = {
        "unit_conversions": f"""SELECT event_id, CAST(round_even(event_id * 0.5::DOUBLE, 0) AS BIGINT) AS half_ms, CAST(round_even(event_id * 1500 * 1e-3::DOUBLE, 0) AS BIGINT) AS us_ms, event_id * 1000 AS s_ms,
 round(value * 9.80665::DOUBLE, 8) AS acc, round(radians(value), 8) AS gyro, round(value, 8) AS mag, round(value - 273.15::DOUBLE, 8) AS kelvin, round((value - 32) * 5 / 9, 8) AS fahrenheit, round(value * 1000, 8) AS kpa, round(value * 100, 8) AS hpa,
 round(value * 0.01::DOUBLE, 8) AS cm, round(value * 0.001::DOUBLE, 8) AS mm, round({WRAP("value")}, 8) AS wrapped FROM events""",
        "slug_and_redact": "SELECT event_id, lower(trim(regexp_replace(concat(' /data/', event_type, '--', user_id, '! '), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug, concat(event_type, '--', user_id, '! ') AS name, CASE WHEN event_id % 2 = 0 THEN '-' END AS subject FROM events",
        "epoch_unit_heuristic": f"""WITH {BASE}, s AS (SELECT session_id, row_idx, 5e11::DOUBLE + 20 * row_idx * CASE activity_label WHEN 'click' THEN 1e6::DOUBLE WHEN 'view' THEN 1e3::DOUBLE ELSE 1::DOUBLE END AS stamp FROM imu),
 k AS (SELECT *, stamp - lag(stamp) OVER (PARTITION BY session_id ORDER BY row_idx) AS d FROM s), g AS (SELECT session_id, arg_min(stamp, row_idx) AS f, quantile_cont(d, 0.5) AS m FROM k GROUP BY session_id)
 SELECT session_id, row_idx, CAST(trunc(CASE WHEN m > 1e5 THEN (stamp - f) / 1e6::DOUBLE WHEN m > 1e2 THEN (stamp - f) / 1e3::DOUBLE WHEN m < 1e-2 THEN (stamp - f) * 1000 ELSE stamp - f END) AS BIGINT) AS t_ms FROM s JOIN g USING (session_id)""",
        "sampling_stats": f"WITH {BASE}, {stats()} SELECT session_id, n_rows, {rows(('median_dt_ms', 'mean_dt_ms', 'jitter_ms', 'duration_s', 'nominal_hz'))} FROM stats",
        "positive_dt_stats": f"WITH {BASE}, ji AS ({JITTER}), {stats('ji', True)} SELECT session_id, n_rows, {rows(('median_dt_ms', 'jitter_ms', 'nominal_hz'))} FROM stats",
        "gap_ratio": f"WITH {BASE}, {DT}, md AS (SELECT session_id, 1.8::DOUBLE * greatest(quantile_cont(dt, 0.5), 1) AS l FROM dt GROUP BY session_id) SELECT session_id, CAST(sum(CASE WHEN dt > l THEN 1 ELSE 0 END) AS BIGINT) AS gap_count, round(avg(CASE WHEN dt > l THEN 1.0 ELSE 0.0 END), 6) AS dropout_ratio FROM dt JOIN md USING (session_id) WHERE dt IS NOT NULL GROUP BY session_id",
        "freeze_zero_ratio": f"""WITH {BASE}, p AS (SELECT *, {LAGS} FROM imu WINDOW o AS ({ORD})), f AS (SELECT session_id, count(*) AS n, avg(CASE WHEN pt_ms IS NOT NULL THEN CASE WHEN {CLOSE} THEN 1.0 ELSE 0.0 END END) AS repeat_ratio, avg(CASE WHEN {ZERO} THEN 1.0 ELSE 0.0 END) AS zero_ratio FROM p GROUP BY session_id)
 SELECT session_id, {rows(("repeat_ratio", "zero_ratio"))}, CASE WHEN n < 2 THEN 0 ELSE round(greatest(repeat_ratio, zero_ratio), 6) END AS freeze_ratio FROM f""",
        "clipping_ratio": f"WITH {BASE} SELECT session_id, round({CLIPS}, 6) AS clipping_ratio FROM imu JOIN ses USING (session_id) GROUP BY session_id",
        "mag_norm_cv": f"WITH {BASE}, {windows()} SELECT session_id, win_idx, round(mag_cv, 6) AS mag_cv FROM win",
        "sliding_windows": f"WITH {BASE}, {windows()} SELECT session_id, win_idx, count(*) AS n, min(t_ms) AS start_ms, max(t_ms) AS end_ms FROM x GROUP BY session_id, win_idx",
        "window_trust_score": f"WITH {BASE}, {windows()} SELECT session_id, win_idx, round(trust_score, 6) AS trust_score, array_to_string(reason_codes, ',') AS reason_codes FROM win",
        "window_issues": f"WITH {BASE}, {windows()}, i AS (SELECT session_id, win_idx, unnest(reason_codes) AS code, CASE WHEN trust_score < 0.6 THEN 'fail' ELSE 'warning' END AS severity, start_ms, end_ms FROM win) SELECT *, replace(code, '_', ' ') || ' detected' AS message FROM i",
        "gyro_bias_drift": f"WITH {BASE}, {scores()} SELECT session_id, round(gyro_bias_drift_rads, 6) AS gyro_bias_drift_rads FROM sc WHERE window_count > 0",
        "static_ratio": f"WITH {BASE}, {scores()} SELECT session_id, window_count, {rows(('static_window_ratio', 't_insufficient_static_segment'))} FROM sc",
        "gps_checks": f"WITH {BASE}, {windows()} SELECT session_id, gps_rows, {rows(('gps_valid_ratio', 'gps_alignment_ratio'))} FROM gchk",
        "audit_summary": f"""WITH {BASE}, {scores()}, {stats("imu", True)}, {DT}, gd AS (SELECT session_id, 1.8::DOUBLE * greatest(quantile_cont(dt, 0.5), 1) AS l FROM dt GROUP BY session_id),
 gp AS (SELECT session_id, CAST(sum(CASE WHEN dt > l THEN 1 ELSE 0 END) AS BIGINT) AS missing_gap_count, avg(CASE WHEN dt > l THEN 1.0 ELSE 0.0 END) AS gr FROM dt JOIN gd USING (session_id) WHERE dt IS NOT NULL GROUP BY session_id),
 fz AS (SELECT session_id, greatest(avg(CASE WHEN pt_ms IS NOT NULL THEN CASE WHEN {CLOSE} THEN 1.0 ELSE 0.0 END END), avg(CASE WHEN {ZERO} THEN 1.0 ELSE 0.0 END)) AS fr FROM (SELECT *, {LAGS} FROM imu WINDOW o AS ({ORD})) GROUP BY session_id),
 cl AS (SELECT session_id, {CLIPS} AS clipping_ratio, stddev_pop(pressure_pa) AS pressure_stability_pa FROM imu JOIN ses USING (session_id) GROUP BY session_id)
 SELECT session_id, status, window_count, missing_gap_count, {rows(("duration_s", "nominal_hz", "jitter_ms", "clipping_ratio", "pressure_stability_pa", *SUMMARY_NUMBERS))}, round(greatest(gr, fr), 6) AS dropout_ratio, CASE WHEN gps_rows > 0 THEN round(gps_valid_ratio, 6) END AS gps_valid_ratio,
 array_to_string(reason_codes, ',') AS reason_codes, array_to_string(list_filter([CASE WHEN NOT has_mag THEN 'mag_disturbed' END, CASE WHEN NOT has_gps THEN 'gps_unreliable' END, CASE WHEN NOT has_pressure THEN 'pressure_unstable' END], lambda c: c IS NOT NULL), ',') AS skipped_checks
 FROM sc JOIN stats USING (session_id) JOIN gp USING (session_id) JOIN fz USING (session_id) JOIN cl USING (session_id)""",
        "batch_ranking": f"WITH {BASE}, {scores()} SELECT session_id, row_number() OVER (ORDER BY trust_score, session_id) AS rank, status, round(trust_score, 6) AS trust_score FROM sc",
        "status_counts": f"WITH {BASE}, {scores()} SELECT count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'fail') AS fail FROM sc",
        "reason_frequency": f"WITH {BASE}, {scores()} SELECT code, count(*) AS n FROM (SELECT unnest(reason_codes) AS code FROM sc) GROUP BY code ORDER BY n DESC, code LIMIT 10",
        "interval_merge": f"WITH {MERGED} SELECT * FROM mi",
        "qa_filtered_export": f"WITH {MERGED} SELECT session_id, row_idx, t_ms FROM imu WHERE NOT EXISTS (SELECT 1 FROM mi WHERE mi.session_id = imu.session_id AND imu.t_ms BETWEEN mi.start_ms AND mi.end_ms)",
        "dropped_reason_counts": f"WITH {DROPPED} SELECT code, count(*) AS n FROM (SELECT unnest(reason_codes) AS code FROM dw) GROUP BY code",
        "compare_sessions": f"""WITH {BASE}, {scores()}, k AS (SELECT *, split_part(session_id, '_', 1) || '_' || (CAST(split_part(session_id, '_', 2) AS INTEGER) // 2) AS kind, CAST(CAST(split_part(session_id, '_', 2) AS INTEGER) % 2 AS VARCHAR) AS num FROM sc),
 p AS (SELECT a.kind, b.trust_score - a.trust_score AS d, list_sort(list_filter(b.reason_codes, lambda c: NOT list_contains(a.reason_codes, c))) AS added, list_sort(list_filter(a.reason_codes, lambda c: NOT list_contains(b.reason_codes, c))) AS removed,
  b.t_timing_bad - a.t_timing_bad AS d1, b.static_window_ratio - a.static_window_ratio AS d2, b.gyro_bias_drift_rads - a.gyro_bias_drift_rads AS d3 FROM k a JOIN k b ON a.kind = b.kind AND a.num = '0' AND b.num = '1'),
 r AS (SELECT *, list_filter([CASE WHEN d <= -0.03 THEN 'trust_score dropped by ' || printf('%.3f', abs(d)) END, CASE WHEN len(added) > 0 THEN 'new reason codes: ' || array_to_string(added, ', ') END, CASE WHEN d3 > 0 THEN 'replay audit bias_drift worsened by ' || printf('%.3f', abs(d3)) END,
  CASE WHEN d1 > 0 THEN 'replay audit jitter_error worsened by ' || printf('%.3f', abs(d1)) END, CASE WHEN d2 < 0 THEN 'replay audit static_ratio worsened by ' || printf('%.3f', abs(d2)) END], lambda c: c IS NOT NULL) AS worse,
  list_filter([CASE WHEN d >= 0.03 THEN 'trust_score improved by ' || printf('%.3f', d) END, CASE WHEN len(removed) > 0 THEN 'removed reason codes: ' || array_to_string(removed, ', ') END, CASE WHEN d3 < 0 THEN 'replay audit bias_drift improved by ' || printf('%.3f', abs(d3)) END,
  CASE WHEN d1 < 0 THEN 'replay audit jitter_error improved by ' || printf('%.3f', abs(d1)) END, CASE WHEN d2 > 0 THEN 'replay audit static_ratio improved by ' || printf('%.3f', abs(d2)) END], lambda c: c IS NOT NULL) AS better FROM p)
 SELECT kind, round(d, 6) AS trust_delta, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed, array_to_string(worse, ';') AS regression_reasons, array_to_string(better, ';') AS improvement_reasons,
 CASE WHEN len(worse) > 0 AND len(better) > 0 THEN 'mixed' WHEN len(worse) > 0 THEN 'regressed' WHEN len(better) > 0 THEN 'improved' WHEN d > 0 THEN 'improved' WHEN d < 0 THEN 'regressed' ELSE 'mixed' END AS recommendation FROM r""",
        "metadata_diff": f"""WITH {BASE}, k AS (SELECT split_part(session_id, '_', 1) || '_' || (CAST(split_part(session_id, '_', 2) AS INTEGER) // 2) AS kind, CAST(CAST(split_part(session_id, '_', 2) AS INTEGER) % 2 AS VARCHAR) AS num, * FROM ses), l AS (SELECT num, kind || '.has_mag' AS key, CAST(has_mag AS VARCHAR) AS v FROM k UNION ALL SELECT num, kind || '.has_gps', CAST(has_gps AS VARCHAR) FROM k
 UNION ALL SELECT num, kind || '.has_pressure', CAST(has_pressure AS VARCHAR) FROM k UNION ALL SELECT num, kind || '.acc_limit', CAST(acc_limit AS VARCHAR) FROM k)
 SELECT coalesce(a.key, b.key) AS key, a.v AS value_a, b.v AS value_b FROM (SELECT * FROM l WHERE num = '0') a FULL JOIN (SELECT * FROM l WHERE num = '1') b ON a.key = b.key WHERE a.v IS DISTINCT FROM b.v""",
        "trust_validation": f"WITH {VALID} SELECT base_id, preset, non_improving, {rows(('clean_score', 'trust_score', 'trust_score_delta'))} FROM val",
        "validation_summary": f"WITH {VALID} SELECT base_id, bool_and(non_improving) AS all_non_improving, CAST(count(*) FILTER (non_improving AND abs(trust_score_delta) < 1e-6) AS INTEGER) AS n_limitations, coalesce(string_agg(CASE WHEN non_improving AND abs(trust_score_delta) < 1e-6 THEN preset || ' did not improve trust_score, but the delta was effectively zero.' END, ';' ORDER BY preset), '') AS known_limitations FROM val GROUP BY base_id",
        "validation_delta_stats": f"WITH {VALID} SELECT base_id AS metric, count(*) AS preset_count, round(avg(trust_score_delta), 6) AS average_delta, round(max(trust_score_delta), 6) AS max_delta, round(min(trust_score_delta), 6) AS min_delta FROM val GROUP BY base_id",
        "rolling_mean_centered": f"WITH {BASE} SELECT session_id, row_idx, round(avg(ax) OVER ({ORD} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 9) AS even, round(avg(ax) OVER ({ORD} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS odd FROM imu",
        "pdr_peaks": f"WITH RECURSIVE {BASE}, {CAND} SELECT session_id, row_idx, t_ms, round(dynamic, 6) AS dynamic FROM steps",
        "dead_reckoning": f"WITH RECURSIVE {BASE}, {RECKON} SELECT session_id, row_idx, {rows(('x', 'y'), 5)} FROM dr",
        "heading_from_positions": f"""WITH {BASE}, h AS (SELECT *, x - lag(x) OVER o AS dx, y - lag(y) OVER o AS dy, row_number() OVER o AS n FROM truth WINDOW o AS ({ORD})), g AS (SELECT *, CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(dy, dx) END AS hh FROM h)
 SELECT session_id, row_idx, round(coalesce(heading, CASE WHEN n = 1 THEN lead(hh) OVER ({ORD}) ELSE hh END), 6) AS heading FROM g""",
        "asof_nearest": f"WITH {BASE}, tr AS (SELECT * FROM truth WHERE row_idx % 30 <> 0), {near('track', 'tr', 60, 'yaw', 'heading')} SELECT session_id, row_idx, m.rt AS matched_t_ms, round(m.heading, 6) AS heading FROM nr",
        "asof_heading_error": f"WITH {BASE}, {near('track', 'truth', 250, 'yaw', 'heading')} SELECT session_id, round(avg(abs({WRAP('yaw - m.heading')})), 6) AS heading_drift_rad FROM nr GROUP BY session_id",
        "trajectory_rmse": f"WITH RECURSIVE {BASE}, {RECKON}, lo AS ({ORIGIN('dr')}), ro AS ({ORIGIN('truth')}), {near('lo', 'ro', 300, 'x, y', 'x y')} SELECT session_id, round(sqrt(avg((x - m.x) ** 2 + (y - m.y) ** 2)), 5) AS trajectory_rmse_m FROM nr GROUP BY session_id",
        "path_smoothness": f"""WITH {BASE}, a AS (SELECT *, yaw - lag(yaw) OVER ({ORD}) AS d FROM track), w AS (SELECT *, {WRAP("d")} AS s FROM a), u AS (SELECT *, CASE WHEN s = -pi() AND d > 0 THEN pi() ELSE s END AS e FROM w), z AS (SELECT session_id, abs(e - lag(e) OVER ({ORD})) AS dd FROM u)
 SELECT session_id, round(coalesce(avg(dd), 0), 6) AS path_smoothness FROM z GROUP BY session_id""",
        "quat_to_euler": f"""WITH {BASE}, q AS (SELECT *, cos(yaw / 2) * 0.8::DOUBLE AS w, sin(yaw / 2) * 0.8::DOUBLE AS x, cos(yaw) * 0.6::DOUBLE AS y, sin(yaw) * 0.6::DOUBLE AS z FROM track)
 SELECT session_id, row_idx, round(atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), 6) AS roll, round(asin(greatest(-1.0, least(1.0, 2 * (w * y - z * x)))), 6) AS pitch, round(atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)), 6) AS yaw FROM q""",
        "har_metrics": f"""WITH {BASE}, c AS (SELECT activity_label AS l, CASE WHEN row_idx % 5 = 0 THEN 'view' ELSE activity_label END AS p, count(*) AS n FROM imu GROUP BY 1, 2), t AS (SELECT l AS c, sum(n) AS t, sum(CASE WHEN l = p THEN n ELSE 0 END) AS h FROM c GROUP BY l), s AS (SELECT p AS c, sum(n) AS p FROM c GROUP BY p)
 SELECT round(sum(coalesce(h, 0)) / sum(coalesce(t, 0)), 6) AS accuracy, round(avg(2 * coalesce(h, 0) / (coalesce(t, 0) + coalesce(p, 0))), 6) AS macro_f1 FROM t FULL JOIN s USING (c)""",
        "nmea_parse": r"""WITH l AS (SELECT row_idx, unnest(string_split(value, '$')) AS s FROM (""" + view(V.NMEA_SQL) + r""")), f AS (SELECT row_idx, string_split(s, ',') AS f FROM l WHERE regexp_matches(s, '^G[PN]RMC,')),
 d AS (SELECT row_idx, f, f[3] = 'A' AS valid, strpos(f[4], '.') AS p, strpos(f[6], '.') AS o FROM f WHERE len(f) >= 7)
 SELECT row_idx, valid, CASE WHEN valid THEN round((CAST(substr(f[4], 1, p - 3) AS DOUBLE) + CAST(substr(f[4], p - 2) AS DOUBLE) / 60) * CASE WHEN f[5] = 'S' THEN -1 ELSE 1 END, 6) END AS lat, CASE WHEN valid THEN round((CAST(substr(f[6], 1, o - 3) AS DOUBLE) + CAST(substr(f[6], o - 2) AS DOUBLE) / 60) * CASE WHEN f[7] = 'W' THEN -1 ELSE 1 END, 6) END AS lon FROM d""",
        "labelled_lines_parse": f"""WITH l AS (SELECT row_idx, string_split(rtrim(value, ';'), ',') AS f FROM ({view(V.LINES_SQL)})), g AS (SELECT 'user_' || f[1] AS session_id, row_idx, f[2] AS activity_label, try_cast(f[3] AS DOUBLE) AS stamp, try_cast(f[4] AS DOUBLE) * 9.80665::DOUBLE AS ax, try_cast(f[5] AS DOUBLE) * 9.80665::DOUBLE AS ay, try_cast(f[6] AS DOUBLE) * 9.80665::DOUBLE AS az FROM l WHERE f[1] <> 'user')
 SELECT session_id, row_idx, activity_label, {rows(("stamp", "ax", "ay", "az"))} FROM g WHERE stamp IS NOT NULL AND ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL""",
        "gps_sidecar_times": f"""WITH {BASE}, s AS (SELECT session_id, min(t_ms) AS lo, max(t_ms) AS hi FROM imu GROUP BY session_id), g AS (SELECT session_id, row_idx, row_number() OVER (PARTITION BY session_id ORDER BY row_idx) - 1 AS a, count(*) OVER (PARTITION BY session_id) AS n FROM gps)
 SELECT session_id, row_idx, CAST(trunc(CASE WHEN n > 1 THEN lo + (hi - lo) * a / CAST(n - 1 AS DOUBLE) ELSE lo END) AS BIGINT) AS t_ms FROM g JOIN s USING (session_id)""",
        "accel_units": f"""WITH {BASE}, r AS (SELECT session_id, row_idx, ax / 64 AS ux, CASE WHEN session_id LIKE '%2' THEN 9.0::DOUBLE ELSE 1.0::DOUBLE END AS uz, CASE WHEN session_id LIKE '%0' THEN 1.0::DOUBLE WHEN session_id LIKE '%1' THEN 30.0::DOUBLE ELSE 9.0::DOUBLE END AS wz FROM imu), m AS (SELECT session_id, quantile_cont(wz, 0.5) AS w, quantile_cont(sqrt(ux * ux + uz * uz), 0.5) AS u FROM r GROUP BY session_id)
 SELECT session_id, row_idx, round(CASE WHEN (w > 0.5 AND w < 1.5) OR (u > 0.5 AND u < 1.5) THEN ux * 9.80665::DOUBLE ELSE ux END, 6) AS ax, 0.0::DOUBLE AS ay, round(CASE WHEN w > 0.5 AND w < 1.5 THEN (uz + wz) * 9.80665::DOUBLE WHEN u > 0.5 AND u < 1.5 THEN uz * 9.80665::DOUBLE ELSE uz END, 6) AS az FROM r JOIN m USING (session_id)""",
        "describe_sessions": f"WITH {BASE} SELECT session_id, count(*) AS n_rows, true AS has_imu, count(mx) > 0 AS has_mag, count(pressure_pa) > 0 AS has_pressure, false AS has_temperature, count(activity_label) > 0 AS labels_available, session_id IN (SELECT session_id FROM gps) AS has_gps FROM imu GROUP BY session_id",
    }
    q["replay_metrics"] = f"WITH {TRACK_METRICS} SELECT session_id, baseline, metric, round(value, 6) AS value FROM mt"
    q["primary_metric"] = f"""WITH {TRACK_METRICS}, g AS (SELECT session_id, avg(value) FILTER (metric = 'heading_drift_rad') AS p, avg(value) FILTER (metric = 'path_smoothness') AS f FROM mt GROUP BY session_id)
 SELECT session_id, CASE WHEN p IS NOT NULL THEN 'heading_drift_rad' WHEN f IS NOT NULL THEN 'path_smoothness' END AS primary_metric_name, round(coalesce(p, f), 6) AS primary_metric_value FROM g"""
    q["preset_metric_deltas"] = f"""WITH {BASE}, imu6 AS ({PRESET_IMU}), g AS (SELECT split_part(session_id, '__', 1) AS base_id, split_part(session_id, '__', 2) AS preset, CAST(count(*) AS DOUBLE) AS rows, avg(gx) AS mean_gx, avg(mx) AS mean_mx FROM imu6 GROUP BY 1, 2),
 l AS (UNPIVOT g ON rows, mean_gx, mean_mx INTO NAME metric VALUE value) SELECT a.base_id, a.preset, a.metric, round(a.value - c.value, 6) AS delta FROM l a JOIN l c ON a.base_id = c.base_id AND a.metric = c.metric AND c.preset = '' WHERE a.preset <> ''"""
    q["downsampled"] = f"""WITH {BASE}, n AS (SELECT session_id, row_idx, t_ms, row_number() OVER ({ORD}) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n FROM imu)
 SELECT session_id, row_idx, t_ms FROM n WHERE n <= 37 OR list_contains([(j * (n - 1)) // 36 FOR j IN range(37)], i)"""
    q["gate_statuses"] = f"WITH {BASE}, {scores()} SELECT session_id, CASE WHEN trust_score < 0.5 THEN 'fail' WHEN trust_score < 0.7 THEN 'warning' ELSE 'pass' END AS status, trust_score < 0.5 AS fails FROM sc"
    q["first_reasons"] = f"""WITH {BASE}, {windows()}, f AS (SELECT session_id, code, min(win_idx) AS win_idx FROM (SELECT session_id, win_idx, unnest(reason_codes) AS code FROM win) GROUP BY session_id, code)
 SELECT * FROM (SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY win_idx, code) AS INTEGER) AS place, code, win_idx FROM f) WHERE place <= 4"""
    q["export_counts"] = f"""WITH {MERGED}, k AS (SELECT session_id, NOT EXISTS (SELECT 1 FROM mi WHERE mi.session_id = imu.session_id AND imu.t_ms BETWEEN mi.start_ms AND mi.end_ms) AS kept FROM imu)
 SELECT session_id, count(*) AS rows_in, count(*) FILTER (kept) AS rows_kept FROM k GROUP BY session_id"""
    for name, memory in (("window_metrics", False), ("window_metrics_memory", True)):
        q[name] = f"WITH {BASE}, {windows(memory)} SELECT session_id, win_idx, n, start_ms, end_ms, {rows(METRICS)} FROM win"
    for name, memory in (("window_penalties_stream", False), ("window_penalties_memory", True)):
        q[name] = f"WITH {BASE}, {windows(memory)} SELECT session_id, win_idx, is_static, {rows([f'p_{k}' for k in WINDOW_CODES])} FROM win"
    for name, memory in (("session_trust_score", False), ("session_trust_score_memory", True)):
        q[name] = f"WITH {BASE}, {scores(memory)} SELECT session_id, {rows(('window_mean', 'trust_score'))}, status FROM sc"
    for preset, columns in zip(PRESETS, ("t_ms", "t_ms", "ax, gx, mx", "gx, gy, gz", "mx, my, mz")):
        q[f"corrupt_{preset}"] = f"WITH {BASE} SELECT session_id, row_idx, {columns} FROM ({CORRUPT[preset]})"
    feats = []
    for a, n in zip(AXES, ("acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z")):
        feats += [f"round(avg({a}), 6) AS {n}_mean", f"round(stddev_pop({a}), 6) AS {n}_std", f"round(min({a}), 6) AS {n}_min", f"round(max({a}), 6) AS {n}_max", f"round(avg({a} * {a}), 6) AS {n}_energy"]
    for n, (x, y, z) in (("acc", AXES[:3]), ("gyro", AXES[3:])):
        e = f"sqrt({x} * {x} + {y} * {y} + {z} * {z})"
        feats += [f"round(avg({e}), 6) AS {n}_norm_mean", f"round(stddev_pop({e}), 6) AS {n}_norm_std"]
    q["har_features"] = f"""WITH {BASE}, n AS (SELECT *, row_number() OVER ({ORD}) - 1 AS n FROM imu), w AS (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((n - 99) / 50.0)) AS BIGINT), CAST(floor(n / 50.0) AS BIGINT))) AS win_idx FROM n)
 SELECT session_id, win_idx, min(activity_label) AS label, {", ".join(feats)} FROM w GROUP BY session_id, win_idx HAVING count(*) = 100"""
    return q
