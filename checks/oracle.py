"""The same results in DuckDB SQL, from the given tables alone."""

from __future__ import annotations

from functools import lru_cache
from math import comb, factorial

from checks.bindings import SHIFT, bias, weight
from helioframe.operators.scoring import HEADS
from helioframe.schema import FEATURES, HORIZONS, LONG_HORIZONS, READABLE_NAMES

W = "PARTITION BY series ORDER BY ts, event_id"


def r6(x: str) -> str:
    x = f"(({x}) + {SHIFT!r})"
    return f"(CASE WHEN abs({x}) < 5e-7 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def flux_class(x: str) -> str:
    return f"(CASE WHEN {x} >= 1e-4 THEN 3 WHEN {x} >= 1e-5 THEN 2 WHEN {x} >= 1e-6 THEN 1 ELSE 0 END)"


def risk(c: str) -> str:
    return f"(CASE {c} WHEN 1 THEN 'C-CLASS' WHEN 2 THEN 'M-CLASS' WHEN 3 THEN 'X-CLASS' ELSE 'NOMINAL' END)"


def reward(t: str, p: str) -> str:
    return (f"(CASE WHEN {t} = {p} THEN (CASE {t} WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 2.0 ELSE 5.0 END) "
            f"WHEN {t} = 3 AND {p} < 3 THEN -20.0 WHEN {t} = 2 AND {p} < 2 THEN -8.0 "
            f"WHEN {t} = 1 AND {p} = 0 THEN -0.3 ELSE -0.5 END)")


def decide(p1: str, p2: str, p3: str) -> str:
    return (f"(CASE WHEN {p3} >= 0.15::DOUBLE THEN 3 WHEN {p2} >= 0.20::DOUBLE THEN 2 "
            f"WHEN {p1} >= 0.30::DOUBLE THEN 1 ELSE 0 END)")


FEED = """
feed AS (
  SELECT event_type AS series, event_id, ts AS time_tag,
    CASE WHEN event_id % 2 = 0 THEN '0.1-0.8nm' ELSE '0.05-0.4nm' END AS energy,
    CASE WHEN event_id < 4 OR event_id % 17 = 0 THEN NULL
         WHEN event_id % 2 = 0 THEN value / 1e6 ELSE value / 1e7 END AS flux
  FROM events)"""

JOINED = FEED + """,
lng AS (SELECT series, event_id, time_tag AS ts, flux AS lf FROM feed WHERE energy = '0.1-0.8nm'),
sht AS (SELECT series, time_tag AS st, flux AS sf FROM feed WHERE energy = '0.05-0.4nm'),
behind AS (SELECT l.*, s.st AS bt, s.sf AS bf FROM lng l ASOF LEFT JOIN sht s ON l.series = s.series AND l.ts >= s.st),
around AS (SELECT b.*, s.st AS nt, s.sf AS nf FROM behind b ASOF LEFT JOIN sht s ON b.series = s.series AND b.ts <= s.st),
joined AS (
  SELECT series, event_id, ts, lf,
    CASE WHEN nt IS NULL OR (bt IS NOT NULL AND epoch_us(ts) - epoch_us(bt) <= epoch_us(nt) - epoch_us(ts))
         THEN bf ELSE nf END AS sf
  FROM around)"""

TELEMETRY = JOINED + f""",
tel AS (
  SELECT series, event_id, ts,
    greatest(coalesce(last_value(lf IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(lf IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1e-8), 1e-9) AS lflux,
    greatest(coalesce(last_value(sf IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(sf IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1e-9), 1e-10) AS sflux,
    row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY series) AS n
  FROM joined)"""

# all rows as one series
TELEMETRY_ONE = TELEMETRY.replace("event_type AS series", "'all' AS series")

UNIT = """
unit AS (
  SELECT event_type AS series, event_id, ts, user_id, value AS x,
    row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS rn,
    count(*) OVER (PARTITION BY event_type) AS n
  FROM events)"""

PREDICTIONS = f"""
raw_p AS (
  SELECT event_type AS series, event_id, ts, {flux_class('value / 1e6')} AS y_true,
    (user_id % 4)::INT AS y_pred, json_extract_string(props, '$.k')::INT AS k,
    (event_id % 50) / 100.0::DOUBLE AS latency_ms
  FROM events),
parts AS (SELECT *, 1 + k % 11 AS a0, 1 + (k + 7) % 11 AS a1, 1 + (k + 14) % 11 AS a2, 1 + (k + 21) % 11 AS a3 FROM raw_p),
pred AS (
  SELECT series, event_id, ts, y_true, y_pred, latency_ms,
    a0 / (a0 + a1 + a2 + a3)::DOUBLE AS p0, a1 / (a0 + a1 + a2 + a3)::DOUBLE AS p1,
    a2 / (a0 + a1 + a2 + a3)::DOUBLE AS p2, a3 / (a0 + a1 + a2 + a3)::DOUBLE AS p3,
    row_number() OVER ({W}) - 1 AS rn, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) - 1 AS age,
    count(*) OVER (PARTITION BY series) AS n
  FROM parts)"""

# half-up at six decimals in whole numbers: a binary quotient can land on either side of a tie
MEAN_LATENCY = "((hundredths * 20000 + k) // (2 * k)) / 1e6"

LOSS = ("-ln(least(greatest(CASE y_true WHEN 0 THEN p0 WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END, "
        "2.220446049250313e-16::DOUBLE), 1 - 2.220446049250313e-16::DOUBLE))")


# -- local-polynomial weights, from the discrete (Gram) orthogonal polynomials ----------------
def _gram(i: int, m: int, k: int, s: int) -> float:
    if k < 0 or s < 0:
        return 0.0
    if k == 0:
        return 1.0 if s == 0 else 0.0
    first = (4 * k - 2) / (k * (2 * m - k + 1)) * (i * _gram(i, m, k - 1, s) + s * _gram(i, m, k - 1, s - 1))
    return first - ((k - 1) * (2 * m + k)) / (k * (2 * m - k + 1)) * _gram(i, m, k - 2, s)


def _falling(a: int, b: int) -> int:
    return comb(a, b) * factorial(b)


@lru_cache(maxsize=None)
def kernel_rows(window: int, degree: int, deriv: int) -> str:
    m = window // 2
    def tap(i: int, t: int) -> float:
        return sum(
            (2 * k + 1) * _falling(2 * m, k) / _falling(2 * m + k + 1, k + 1) * _gram(i, m, k, 0) * _gram(t, m, k, deriv)
            for k in range(degree + 1)
        )
    rows = [[tap(i, t) for i in range(-m, m + 1)] for t in range(-m, m + 1)]
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in row) + "]" for row in rows) + "]"


def kernel(x: str, deriv: int, window: int = 11, degree: int = 3, arr: str = "arr") -> str:
    """Needs ``arr`` = values of the rows up to ``window - 1`` before and after."""
    half = window // 2
    start = f"least(greatest(rn - {half}, 0), n - {window})"
    part = f"list_slice({arr}, {start} - greatest(rn - {window - 1}, 0) + 1, {start} - greatest(rn - {window - 1}, 0) + {window})"
    short = x if deriv == 0 else "0.0::DOUBLE"
    return (f"(CASE WHEN n < {window} THEN {short} ELSE list_dot_product({part}, "
            f"({kernel_rows(window, degree, deriv)})[(rn - {start} + 1)::INT]) END)")


def around(x: str, window: int = 11) -> str:
    return f"list({x}) OVER ({W} ROWS BETWEEN {window - 1} PRECEDING AND {window - 1} FOLLOWING)"


def peak(x: str, n: int) -> str:
    """Shifted trailing maximum, then forward fill, then 0; as windows over ``rn``."""
    return f"max(CASE WHEN rn >= {n} THEN {x} END) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def filled(x: str) -> str:
    return f"coalesce(last_value({x} IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0::DOUBLE)"


FEATURES_CTE = TELEMETRY + f""",
lists AS (SELECT *, {around('lflux')} AS larr, {around('sflux')} AS sarr,
  coalesce(var_samp(lflux) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS var5,
  coalesce(stddev_samp(log10(lflux)) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0) AS vol10,
  {', '.join(f"{peak('lflux', k)} AS raw_{h}" for h, k in HORIZONS.items())}
  FROM tel),
peaks AS (SELECT *, {', '.join(f"{filled(f'raw_{h}')} AS peak_{h}" for h in HORIZONS)} FROM lists),
feats AS (
  SELECT series, event_id, ts, rn, n, lflux, sflux,
    greatest(lflux * 1e8, 10.0) AS soft, greatest(sflux * 1e8, 5.0) AS hard,
    {kernel('lflux', 0, arr='larr')} AS lsmooth, {kernel('lflux', 1, arr='larr')} AS lvel, {kernel('lflux', 2, arr='larr')} AS laccel,
    {kernel('sflux', 0, arr='sarr')} AS ssmooth, {kernel('sflux', 1, arr='sarr')} AS svel, {kernel('sflux', 2, arr='sarr')} AS saccel,
    sflux / (lflux + 1e-12) AS hardness, var5, vol10,
    {', '.join(f'peak_{h}' for h in HORIZONS)}, {flux_class('lflux')} AS cls
  FROM peaks)"""
FEATURE_SQL = ("lflux", "sflux", "soft", "hard", "lsmooth", "lvel", "laccel", "ssmooth", "svel", "saccel", "hardness", "var5", "vol10")

STATS_CTE = FEATURES_CTE + """,
stats AS (SELECT """ + ", ".join(
    f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}"
    for i, c in enumerate(FEATURE_SQL)) + """ FROM feats),
z AS (SELECT feats.*, """ + ", ".join(f"({c} - m{i}) / s{i} AS z{i}" for i, c in enumerate(FEATURE_SQL)) + """ FROM feats, stats)"""


def margin(h: int, c: int) -> str:
    terms = " + ".join(f"z{f} * ({weight(h, c, f)!r})::DOUBLE" for f in range(len(FEATURES)))
    return f"({terms} + ({bias(c)!r})::DOUBLE)"


SCORES_CTE = STATS_CTE + """,
scores AS (SELECT *, """ + ", ".join(
    f"1.0::DOUBLE / (1.0::DOUBLE + exp(-{margin(h, c)})) AS s_{name}_{c}" for h, name in enumerate(HEADS) for c in range(4)
) + """ FROM z),
probs AS (SELECT *, """ + ", ".join(
    f"s_{name}_{c} / (s_{name}_0 + s_{name}_1 + s_{name}_2 + s_{name}_3) AS p_{name}_{c}" for name in HEADS for c in range(4)
) + """ FROM scores)"""


def _dec(h: str) -> str:
    return decide(f"p_{h}_1", f"p_{h}_2", f"p_{h}_3")


FORECAST_CTE = SCORES_CTE + """,
fc AS (""" + " UNION ALL ".join(
    f"SELECT series, event_id, '{h}' AS horizon, {_dec(h)} AS pred_class, p_{h}_1 AS p1, p_{h}_2 AS p2, p_{h}_3 AS p3, "
    f"{flux_class(f'peak_{h}')} AS y_true FROM probs" for h in HORIZONS) + ")"


def events_cte(source: str, x: str, threshold: str, name: str, keys: str = "series") -> str:
    """Runs at or above a threshold over ``source``."""
    return f"""
{name}_m AS (SELECT *, sum(CASE WHEN {x} >= {threshold} THEN 0 ELSE 1 END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS run FROM {source}),
{name} AS (
  SELECT {keys}, min(ts) AS start, max(ts) AS "end", max({x}) AS peak_val, arg_min(ts, (-{x}, rn)) AS peak_time,
    count(*) AS samples, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
  FROM {name}_m WHERE {x} >= {threshold} GROUP BY {keys}, run)"""


def skill(n: str, lat: str, latn: str, loss: str, d: int, ld: int) -> str:
    """Metric columns from tp_c, pred_c, sup_c, hits, alarms."""
    prec = " + ".join(f"sup_{c} / {n} * (CASE WHEN pred_{c} > 0 THEN tp_{c} / pred_{c}::DOUBLE ELSE 1.0 END)" for c in range(4))
    f1 = " + ".join(f"sup_{c} / {n} * (CASE WHEN sup_{c} + pred_{c} > 0 THEN 2 * tp_{c} / (sup_{c} + pred_{c})::DOUBLE ELSE 1.0 END)" for c in range(4))
    tss = ("(CASE WHEN sup_1 + sup_2 + sup_3 > 0 THEN hits / (sup_1 + sup_2 + sup_3)::DOUBLE ELSE 1.0 END) - "
           "(CASE WHEN sup_0 > 0 THEN alarms / sup_0::DOUBLE ELSE 0.0 END)")
    seen = " + ".join(f"(sup_{c} > 0)::INT" for c in range(4))
    values = {
        "precision": (prec, 1.0, d), "recall": (f"(tp_0 + tp_1 + tp_2 + tp_3) / {n}::DOUBLE", 1.0, d), "f1_score": (f1, 1.0, d),
        "tss": (f"greatest(0.0, least(1.0, {tss}))", 1.0, d),
        "avg_latency_ms": (f"CASE WHEN {latn} > 0 THEN {lat} / {latn} ELSE 0.45 END", 0.45, ld),
        "online_loss": (f"greatest(0.001, CASE WHEN {seen} > 1 THEN {loss} / {n} ELSE 1.0 - ({prec}) + 0.01 END)", 0.01, d),
    }
    return ", ".join(
        f"CASE WHEN {n} < 10 THEN {start}::DOUBLE ELSE round(({v})::DOUBLE, {k}) END AS {name}" for name, (v, start, k) in values.items())


def cells(aggregate) -> str:
    """tp/pred/sup/hits/alarms columns by ``aggregate(condition)``."""
    out = []
    for c in range(4):
        out += [f"{aggregate(f'y_true = {c} AND y_pred = {c}')} AS tp_{c}", f"{aggregate(f'y_pred = {c}')} AS pred_{c}",
                f"{aggregate(f'y_true = {c}')} AS sup_{c}"]
    out += [f"{aggregate('y_true >= 1 AND y_pred >= 1')} AS hits", f"{aggregate('y_true = 0 AND y_pred >= 1')} AS alarms"]
    return ", ".join(out)


COEFS = """
coefs AS (
  SELECT (user_id % 4)::INT AS class, (json_extract_string(props, '$.k')::INT) % 13 AS f, avg(value) - 40 AS weight
  FROM events GROUP BY 1, 2),
named AS (SELECT f, avg(abs(weight)) AS weight FROM coefs GROUP BY f)"""
FEATURE_NAMES = "CASE f " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(FEATURES)) + " END"
READABLE = "CASE f " + " ".join(f"WHEN {i} THEN '{READABLE_NAMES[n]}'" for i, n in enumerate(FEATURES)) + " END"


def wq(cte: str, body: str) -> str:
    return f"WITH {cte}\n{body}"


FEATURE_OUT = ("SELECT series, event_id, rn, ts AS \"timestamp\", lflux AS \"GOES_LONG_FLUX\", sflux AS \"GOES_SHORT_FLUX\", "
    "soft AS \"SoLEXS_COUNTS\", hard AS \"HEL1OS_COUNTS\", "
    + ", ".join(f"{r6(f'{c} * 1e6')} AS {n}" for c, n in (
        ("lsmooth", "goes_long_smooth"), ("lvel", "goes_long_vel"), ("laccel", "goes_long_accel"),
        ("ssmooth", "goes_short_smooth"), ("svel", "goes_short_vel"), ("saccel", "goes_short_accel")))
    + f", hardness AS hardness_ratio, {r6('var5 * 1e12')} AS long_flux_var_5m, {r6('vol10')} AS log_volatility_10m, "
    f"cls AS \"PredictedClass\", {risk('cls')} AS \"RiskLabel\", "
    + ", ".join(f"{flux_class(f'peak_{h}')} AS \"TargetClass_{h}\", peak_{h} AS \"TargetPeak_{h}\"" for h in HORIZONS)
    + " FROM feats")


@lru_cache(maxsize=1)
def oracle() -> dict[str, str]:
    sql: dict[str, str] = {}
    # sources
    sql["feed_scan"] = wq(FEED, "SELECT energy, flux, time_tag FROM feed")
    sql["ts_parse"] = "SELECT event_id, ts FROM events"
    sql["feed_fallback"] = """
WITH feeds AS (SELECT event_id, ts, value, CASE WHEN value >= 400 THEN 0 WHEN event_type IN ('view', 'click') THEN 1 ELSE 2 END AS priority FROM events),
usable AS (SELECT priority FROM feeds GROUP BY priority HAVING count(*) > 50)
SELECT event_id, ts, value, priority FROM feeds WHERE priority = (SELECT min(priority) FROM usable)"""
    raw = 'SELECT series, event_id, ts AS "timestamp", lflux AS "GOES_LONG_FLUX", sflux AS "GOES_SHORT_FLUX", greatest(lflux * 1e8, 10.0) AS "SoLEXS_COUNTS", greatest(sflux * 1e8, 5.0) AS "HEL1OS_COUNTS" FROM tel'
    sql["raw_roundtrip"] = wq(TELEMETRY, raw)
    sql["telemetry_chunked"] = sql["raw_roundtrip"]
    sql["feature_table"] = wq(FEATURES_CTE, FEATURE_OUT)
    sql["feature_table_chunked"] = sql["feature_roundtrip"] = sql["feature_table"]
    sql["load_summary"] = wq(TELEMETRY, "SELECT series, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM tel GROUP BY series")
    # projections
    sql["channel_split"] = wq(FEED, "SELECT event_id, time_tag, CASE WHEN energy = '0.1-0.8nm' THEN 'long' ELSE 'short' END AS channel, flux FROM feed")
    sql["fill_clip"] = wq(TELEMETRY, "SELECT series, event_id, lflux AS long_flux, sflux AS short_flux FROM tel")
    sql["ffill_bfill"] = wq(FEED, """SELECT series, event_id, coalesce(
  last_value(flux IGNORE NULLS) OVER (PARTITION BY series, energy ORDER BY time_tag, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(flux IGNORE NULLS) OVER (PARTITION BY series, energy ORDER BY time_tag, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS flux FROM feed""")
    sql["ffill_bfill_chunked"] = sql["ffill_bfill"]
    sql["count_proxy"] = wq(TELEMETRY, "SELECT series, event_id, greatest(lflux * 1e8, 10.0) AS soft, greatest(sflux * 1e8, 5.0) AS hard FROM tel")
    sql["hardness_ratio"] = wq(TELEMETRY, f"SELECT series, event_id, {r6('sflux / (lflux + 1e-12)')} AS hardness_ratio FROM tel")
    sql["hardness_display"] = wq(TELEMETRY, "SELECT series, event_id, round(sflux / coalesce(nullif(lflux, 0), 1e-9), 3) AS hardness FROM tel")
    sql["flux_class"] = wq(FEED, f"SELECT event_id, {flux_class('flux')} AS cls FROM feed")
    sql["risk_label"] = wq(FEED, f"SELECT event_id, {risk(flux_class('flux'))} AS label FROM feed")
    sql["feature_vector"] = wq(FEATURES_CTE, "SELECT series, event_id, 13 AS size, " + ", ".join(
        f"{r6(f'coalesce({c}, 0) * {k}')} AS f{i}" for i, (c, k) in enumerate(zip(FEATURE_SQL, (1e6, 1e6, 1, 1, 1e6, 1e6, 1e6, 1e6, 1e6, 1e6, 1, 1e12, 1)))) + " FROM feats")
    sql["finite_clamp"] = """SELECT event_id, CASE user_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1e5 WHEN 2 THEN -1e5 WHEN 3 THEN 0.0 ELSE value END AS x FROM events"""
    sql["time_labels"] = "SELECT event_id, strftime(ts, '%m/%d %H:%M') AS short_time, ts::VARCHAR AS full_time, split_part(ts::VARCHAR, ' ', 2) AS clock FROM events"
    top = "max(lflux)"
    sql["radio_blackout"] = wq(TELEMETRY, f"""SELECT series, ts::DATE::VARCHAR AS day, CASE WHEN {top} >= 2e-3 THEN 'R5 (Extreme Blackout)' WHEN {top} >= 1e-3 THEN 'R4 (Severe Blackout)'
  WHEN {top} >= 1e-4 THEN format('R3 (Strong Blackout - X{{:.1f}})', round({top} / 1e-4, 1)) WHEN {top} >= 5e-5 THEN format('R2 (Moderate Blackout - M{{:.1f}})', round({top} / 1e-5, 1))
  WHEN {top} >= 1e-5 THEN format('R1 (Minor Blackout - M{{:.1f}})', round({top} / 1e-5, 1)) WHEN {top} >= 1e-6 THEN 'R0 (No Radio Blackout - C-Class)' ELSE 'R0 (Normal Quiet Sun)' END AS scale
FROM tel GROUP BY series, ts::DATE""")
    counts = ("count(*) FILTER (WHERE lflux >= 1e-6 AND lflux < 1e-5) AS c_class_spikes, count(*) FILTER (WHERE lflux >= 1e-5 AND lflux < 1e-4) AS m_class_spikes, "
              "count(*) FILTER (WHERE lflux >= 1e-4) AS x_class_spikes")
    sql["class_counts"] = wq(TELEMETRY, f"SELECT series, {counts}, count(*) FILTER (WHERE lflux >= 1e-6) AS total_flares_7d FROM tel GROUP BY series")
    sql["peak_time"] = wq(TELEMETRY, "SELECT series, ts::DATE::VARCHAR AS day, max(lflux) AS peak_flux, arg_min(ts, (-lflux, ts)) AS peak_timestamp FROM tel GROUP BY series, ts::DATE")
    sql["insights"] = wq(FEATURES_CTE, f"""SELECT series, max(lflux) AS peak_flux, arg_min(ts, (-lflux, ts)) AS peak_timestamp, {counts}, {r6('max(lvel) * 1e6')} AS max_flux_growth_rate,
  count(*) FILTER (WHERE lflux >= 1e-6) AS total_flares_7d,
  CASE WHEN count(*) FILTER (WHERE lflux >= 1e-5) > 0 THEN 'High Magnetic Reconnection Activity' ELSE 'Nominal Quiet Sun Solar Magnetic Field' END AS astrophysical_diagnosis
FROM feats GROUP BY series""")
    weight_sum = sum(abs(((7 * c + 3 * f) % 5) - 2) / 10 for c in range(4) for f in range(13)) / 4
    logged = f"""{SCORES_CTE},
log AS (SELECT series, rn, cls AS y_true, {_dec('now')} AS y_pred, {', '.join(f'p_now_{c} AS p{c}' for c in range(4))} FROM probs WHERE rn <= 100),
rewards AS (SELECT series, sum({reward('y_true', 'y_pred')}::DECIMAL(18,1))::DOUBLE AS total, sum({reward('y_true', 'y_pred')}) FILTER (WHERE rn = 100) AS own FROM log GROUP BY series),
skill_counts AS (SELECT series, count(*) AS m, {cells(lambda c: f'count(*) FILTER (WHERE {c})')}, sum({LOSS}) AS loss FROM log GROUP BY series),
skills AS (SELECT series, {skill('m', '0.0', '0', 'loss', 4, 2)} FROM skill_counts),
seen AS (SELECT series, max(lflux) AS peak_flux, arg_min(ts, (-lflux, ts)) AS peak_timestamp, {counts}, {r6('max(lvel) * 1e6')} AS max_flux_growth_rate, count(*) FILTER (WHERE lflux >= 1e-6) AS total_flares_7d FROM feats GROUP BY series)"""
    sql["status_at"] = wq(logged, f"""SELECT p.series, p.rn AS current_idx, p.n AS total_rows, p.ts::VARCHAR AS "timestamp", 'feed' AS stream_source, {risk('p.cls')} AS "RiskLabel", {_dec('now')} AS "PredictedClass",
  round(p_now_1, 4) AS "CProb", round(p_now_2, 4) AS "MProb", round(p_now_3, 4) AS "XProb", p.lflux AS "GOES_LONG_FLUX", p.sflux AS "GOES_SHORT_FLUX", round(hardness, 3) AS hardness_ratio,
  NULL::DOUBLE AS latency_ms, round(own, 2) AS reward, round(total, 1) AS cumulative_reward, p.rn + 1 AS weight_updates, 13 AS n_features, round({weight_sum}::DOUBLE, 6) AS weights_sum,
  precision, recall, f1_score, tss, avg_latency_ms, online_loss, peak_flux, total_flares_7d, c_class_spikes, m_class_spikes, x_class_spikes, peak_timestamp,
  CASE WHEN m_class_spikes + x_class_spikes > 0 THEN 'High Magnetic Reconnection Activity' ELSE 'Nominal Quiet Sun Solar Magnetic Field' END AS astrophysical_diagnosis, max_flux_growth_rate,
  {_dec('4h')} AS horizon_4h_class, round(p_4h_1 + p_4h_2 + p_4h_3, 4) AS horizon_4h_flare_prob
FROM probs p JOIN skills USING (series) JOIN rewards USING (series) JOIN seen USING (series) WHERE p.rn = 100""")
    hist = "strftime(ts, '%m/%d %H:%M') AS \"time\", ts::VARCHAR AS \"fullDate\", lflux AS \"GOES_Long\", sflux AS \"GOES_Short\""
    sql["history_slice"] = wq(TELEMETRY, f"SELECT series, rn, {hist} FROM tel WHERE rn BETWEEN 220 AND 300")
    sql["history_page"] = wq(TELEMETRY_ONE, f"""SELECT rn, {hist}, lflux >= 1e-6 AS is_peak, round(sflux / coalesce(nullif(lflux, 0), 1e-9), 3) AS hardness
FROM tel WHERE rn BETWEEN 250 AND 400 ORDER BY rn LIMIT 10 OFFSET 30""")
    shown = "coalesce(nullif(lflux, 0), 1e-7)"
    sql["display_scales"] = wq(TELEMETRY, f"""SELECT series, event_id, {r6(f'least(1.0, greatest(0.1, log10({shown}) + 9) / 6)')} AS normalised, {r6('sflux * 1e7')} AS gauge, round((sflux + 1.3e-15) * 1e7, 1) AS gauge_value,
  round(least(1.0, greatest(0.1, log10({shown}) + 9) / 6) * 100)::INTEGER AS normalised_percent,
  {r6('least(100.0, sflux * 1e7 * 10)')} AS gauge_percent, {r6('least(100.0, sflux / (lflux + 1e-12) * 1500)')} AS hardness_percent FROM tel""")
    sql["reward_label"] = wq(PREDICTIONS, f"""SELECT event_id, CASE {reward('y_true', 'y_pred')} WHEN 5.0 THEN 'X-CLASS CORRECT' WHEN 2.0 THEN 'M-CLASS CORRECT' WHEN -20.0 THEN 'MISSED X-CLASS' WHEN -8.0 THEN 'MISSED M-CLASS' ELSE '' END AS label FROM pred""")
    # join
    sql["asof_nearest"] = wq(JOINED, "SELECT series, event_id, lf AS long_flux, sf AS short_flux FROM joined")
    sql["asof_nearest_chunked"] = sql["asof_nearest"]
    # metrics
    sql["confusion"] = wq(PREDICTIONS, "SELECT series, y_true, y_pred, count(*) AS n FROM pred WHERE age < 300 GROUP BY ALL")
    agg = cells(lambda c: f"count(*) FILTER (WHERE age < 300 AND {c})")
    sql["skill_metrics"] = wq(PREDICTIONS + f""", a AS (SELECT series, count(*) FILTER (WHERE age < 300) AS m, {agg}, sum({LOSS}) FILTER (WHERE age < 300) AS loss,
  avg(latency_ms) FILTER (WHERE age < 100) AS lat FROM pred GROUP BY series)""", f"SELECT series, {skill('m', 'lat', '1', 'loss', 4, 4)} FROM a")
    win = cells(lambda c: f"sum(({c})::INT) OVER ({W} ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)")
    sql["rolling_skill"] = wq(PREDICTIONS + f""", a AS (SELECT series, event_id, rn, least(rn + 1, 300) AS m, {win},
  sum({LOSS}) OVER ({W} ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS loss,
  sum((latency_ms * 100)::BIGINT) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS hundredths, least(rn + 1, 100) AS k FROM pred)""", f"SELECT series, event_id, {skill('m', MEAN_LATENCY, '1', 'loss', 6, 6)} FROM a")
    sql["rolling_skill_chunked"] = sql["rolling_skill"]
    sql["tss"] = wq(PREDICTIONS + f", a AS (SELECT series, {cells(lambda c: f'count(*) FILTER (WHERE {c})')} FROM pred GROUP BY series)",
        "SELECT series, round(greatest(0.0, least(1.0, hits / (sup_1 + sup_2 + sup_3)::DOUBLE - (CASE WHEN sup_0 > 0 THEN alarms / sup_0::DOUBLE ELSE 0 END))), 6) AS tss FROM a")
    sql["log_loss"] = wq(PREDICTIONS, f"SELECT series, round(avg({LOSS}), 6) AS log_loss FROM pred GROUP BY series")
    sql["recent_predictions"] = wq(PREDICTIONS, "SELECT series, event_id, y_true, y_pred FROM pred WHERE age < 1000")
    sql["cumulative_reward"] = wq(PREDICTIONS, f"SELECT series, event_id, {reward('y_true', 'y_pred')} AS reward, round(sum({reward('y_true', 'y_pred')}::DECIMAL(18,1)) OVER ({W} ROWS UNBOUNDED PRECEDING)::DOUBLE, 1) AS cumulative_reward, rn + 1 AS weight_updates FROM pred")
    sql["cumulative_reward_chunked"] = sql["cumulative_reward"]
    # windows
    sql["rolling_var"] = wq(UNIT, f"SELECT series, event_id, {r6('coalesce(v, 0)')} AS variance FROM (SELECT *, var_samp(x) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS v FROM unit)")
    sql["log_volatility"] = wq(UNIT, f"SELECT series, event_id, {r6('coalesce(v, 0)')} AS volatility FROM (SELECT *, stddev_samp(log10(x + 1)) OVER ({W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS v FROM unit)")
    lists = UNIT + f", l AS (SELECT *, {around('x')} AS arr FROM unit)"
    for d, key in enumerate(("smooth", "velocity", "accel")):
        sql[f"sg_{key}"] = wq(lists, f"SELECT series, event_id, {r6(kernel('x', d))} AS {key} FROM l")
    sql["sg_chunked"] = wq(lists, f"SELECT series, event_id, {r6(kernel('x', 0))} AS smooth, {r6(kernel('x', 1))} AS velocity, {r6(kernel('x', 2))} AS accel FROM l")
    five = UNIT + f", l AS (SELECT *, {around('x', 5)} AS arr FROM unit)"
    sql["sg_window5"] = wq(five, "SELECT series, event_id, " + ", ".join(f"{r6(kernel('x', d, 5, 2))} AS {k}" for d, k in enumerate(("smooth", "velocity", "accel"))) + " FROM l")
    peaks = UNIT + ", p AS (SELECT *, " + ", ".join(f"{peak('x', k)} AS raw_{h}" for h, k in HORIZONS.items()) + " FROM unit), q AS (SELECT *, " + ", ".join(
        f"{filled(f'raw_{h}')} AS peak_{h}" for h in HORIZONS) + " FROM p)"
    sql["horizon_peak"] = wq(peaks, "SELECT series, event_id, " + ", ".join(f"peak_{h}" for h in HORIZONS) + " FROM q")
    sql["horizon_peak_chunked"] = sql["horizon_peak"]
    sql["horizon_class"] = wq(peaks, "SELECT series, event_id, " + ", ".join(f"{flux_class(f'peak_{h} / 1e6')} AS class_{h}" for h in HORIZONS) + " FROM q")
    one = "one AS (SELECT 'all' AS series, event_id, ts, value AS x, row_number() OVER (ORDER BY ts, event_id) - 1 AS rn FROM events)"
    far = one + ", p AS (SELECT *, " + ", ".join(f"{peak('x', k)} AS raw_{h}" for h, k in LONG_HORIZONS.items()) + " FROM one), q AS (SELECT *, " + ", ".join(
        f"{filled(f'raw_{h}')} AS peak_{h}" for h in LONG_HORIZONS) + " FROM p)"
    sql["horizon_long"] = wq(far, "SELECT event_id, " + ", ".join(f"peak_{h}" for h in LONG_HORIZONS) + " FROM q")
    ev = 'series, start, "end", peak_val, peak_time, samples, round(duration_s, 6) AS duration_s'
    runs = TELEMETRY + "," + events_cte("tel", "lflux", "1e-4", "hi") + "," + events_cte("tel", "lflux", "1e-6", "lo")
    sql["flare_events"] = wq(runs, f"SELECT 1e-4::DOUBLE AS threshold, {ev}, {risk(flux_class('peak_val'))} AS type FROM hi UNION ALL SELECT 1e-6::DOUBLE, {ev}, {risk(flux_class('peak_val'))} FROM lo")
    sql["flare_events_chunked"] = sql["flare_events"]
    sql["latest_events"] = wq(runs, f"SELECT {ev} FROM hi ORDER BY start DESC LIMIT 6")
    sql["event_metrics"] = wq(UNIT + "," + events_cte("unit", "x", "100", "e"), f"SELECT {ev} FROM e ORDER BY start DESC LIMIT 10")
    # scoring
    sql["scaler_stats"] = wq(STATS_CTE, " UNION ALL ".join(f"SELECT '{f}' AS feature, {r6(f'm{i} / s{i}')} AS mean_over_std, {r6(f'log10(s{i})')} AS log_std FROM stats" for i, f in enumerate(FEATURES)))
    sql["standardize"] = wq(STATS_CTE, "SELECT series, event_id, " + ", ".join(f"{r6(f'z{i}')} AS z{i}" for i in range(13)) + " FROM z")
    sql["sample_weight"] = wq(PREDICTIONS, "SELECT event_id, CASE y_true WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 8.0 ELSE 20.0 END AS weight FROM pred")
    sql["linear_score"] = wq(SCORES_CTE, "SELECT series, event_id, " + ", ".join(f"{r6(f's_{h}_{c}')} AS s_{h}_{c}" for h in HEADS for c in range(4)) + " FROM scores")
    sql["model_roundtrip"] = wq(SCORES_CTE, f"SELECT series, event_id, rn, {_dec('now')} AS pred_class, " + ", ".join(f"{r6(f'p_now_{c}')} AS p{c}" for c in range(4)) + " FROM probs")
    sql["prob_normalize"] = """WITH raw AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 ELSE value / 100 END AS a,
  CASE WHEN user_id % 5 = 3 THEN 0.0 ELSE value END AS b FROM events)
SELECT event_id, """ + ", ".join(f"round(CASE WHEN a + b + b / 2 + b / 4 > 0 THEN {x} / (a + b + b / 2 + b / 4) ELSE 0.25 END, 6) AS p{c}" for c, x in enumerate(("a", "b", "b / 2", "b / 4"))) + " FROM raw"
    sql["decide_class"] = wq(PREDICTIONS, f"SELECT event_id, {decide('p1', 'p2', 'p3')} AS pred_class FROM pred")
    sql["horizon_forecast"] = wq(FORECAST_CTE, f"SELECT series, event_id, horizon, pred_class, {risk('pred_class')} AS risk_label, round(p1 + p2 + p3, 4) AS flare_prob, round(p1, 4) AS c_prob, round(p2, 4) AS m_prob, round(p3, 4) AS x_prob FROM fc")
    sql["reward"] = wq(PREDICTIONS, f"SELECT event_id, {reward('y_true', 'y_pred')} AS reward FROM pred")
    labels = {"now": "cls"} | {h: flux_class(f"peak_{h}") for h in HORIZONS}
    sql["training_set"] = wq(FEATURES_CTE, " UNION ALL ".join(
        f"SELECT series, event_id, '{h}' AS horizon, {c} AS label, CASE {c} WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN 8.0 ELSE 20.0 END AS weight, {r6('hardness')} AS f10 FROM feats" for h, c in labels.items()))
    preq = SCORES_CTE + f", d AS (SELECT series, event_id, ts, rn, cls AS y_true, {_dec('now')} AS y_pred FROM probs)"
    sql["prequential"] = wq(preq, f"SELECT series, event_id, y_true, y_pred, {reward('y_true', 'y_pred')} AS reward, round(sum({reward('y_true', 'y_pred')}::DECIMAL(18,1)) OVER ({W} ROWS UNBOUNDED PRECEDING)::DOUBLE, 1) AS cumulative_reward FROM d")
    sql["feature_append"] = wq(preq, f"""SELECT series, event_id, rn, y_true, y_pred, {reward('y_true', 'y_pred')} AS reward,
  round(sum({reward('y_true', 'y_pred')}::DECIMAL(18,1)) OVER ({W} ROWS UNBOUNDED PRECEDING)::DOUBLE, 1) AS cumulative_reward, rn + 1 AS weight_updates FROM d""")
    sql["stream_scoring"] = wq(preq, f"SELECT series, event_id, y_true, y_pred, {reward('y_true', 'y_pred')} AS reward FROM d")
    sql["feature_importance"] = wq(COEFS, f"SELECT {FEATURE_NAMES} AS feature, round(weight, 6) AS weight FROM named")
    sql["importance_topk"] = wq(COEFS, f"SELECT {READABLE} AS name, round(weight, 6) AS weight FROM named ORDER BY weight DESC LIMIT 5")
    # described pipelines
    sql["instrument_outer_join"] = """
WITH a AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, sum(value) AS soft FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT event_type AS series, date_trunc('hour', ts) AS hour, sum(value) AS hard FROM events WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT coalesce(a.series, b.series) AS series, coalesce(a.hour, b.hour) AS hour, round(soft, 4) AS soft, round(hard, 4) AS hard FROM a FULL OUTER JOIN b ON a.series = b.series AND a.hour = b.hour"""
    rng = "PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL {} SECONDS PRECEDING AND CURRENT ROW"
    six = rng.format(21600)
    sql["median_3sigma"] = wq(UNIT, f"""SELECT series, event_id, {r6('med')} AS median, {r6('sd')} AS sigma, x > med + 3 * sd AS is_outlier
FROM (SELECT *, quantile_cont(x, 0.5) OVER ({six}) AS med, coalesce(stddev_samp(x) OVER ({six}), 0) AS sd FROM unit)""")
    sql["qpp_variance"] = wq(UNIT, f"SELECT series, event_id, {r6('v')} AS variance, v > 900 AS is_burst FROM (SELECT *, coalesce(var_samp(x) OVER ({rng.format(7200)}), 0) AS v FROM unit)")
    sync = TELEMETRY + "," + events_cte("tel", "lflux", "1e-5", "soft") + "," + events_cte("tel", "sflux", "5e-6", "hard")
    sql["event_sync"] = wq(sync, "SELECT s.series, s.start AS soft_start, s.peak_time AS soft_peak, max(h.peak_time) AS hard_peak FROM soft s JOIN hard h ON s.series = h.series AND h.peak_time BETWEEN s.start AND s.peak_time GROUP BY ALL")
    def flagged(name: str, source: str, flag: str, gap: int) -> str:
        return f""",
{name}_rows AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w > {gap * 60_000_000} AS apart FROM {source} WHERE {flag} WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)),
{name}_named AS (SELECT *, sum(coalesce(apart, true)::INT) OVER (PARTITION BY series ORDER BY ts, event_id) AS run FROM {name}_rows),
{name} AS (SELECT series, min(ts) AS start, max(ts) AS "end", max(x) AS peak_val, list(ts ORDER BY x DESC, ts)[1] AS peak_time, count(*) AS samples FROM {name}_named GROUP BY series, run)"""

    detected = UNIT + f""",
med AS (SELECT *, x > m + 0.5::DOUBLE * sd AS is_outlier FROM (SELECT *, quantile_cont(x, 0.5) OVER ({six}) AS m, coalesce(stddev_samp(x) OVER ({six}), 0) AS sd FROM unit)),
var AS (SELECT *, coalesce(var_samp(x) OVER ({rng.format(7200)}), 0) > 900 AS is_burst FROM unit)""" + flagged("soft", "med", "is_outlier", 120) + flagged("hard", "var", "is_burst", 60)
    sql["detector_events"] = wq(detected, "SELECT *, 'median' AS detector FROM soft UNION ALL SELECT *, 'variance' FROM hard")
    sql["detector_sync"] = wq(detected, "SELECT s.series, s.start AS soft_start, s.peak_time AS soft_peak, max(h.peak_time) AS hard_peak FROM soft s JOIN hard h ON s.series = h.series AND h.peak_time BETWEEN s.start AND s.peak_time GROUP BY ALL")
    cat = runs + """,
cat AS (SELECT series, epoch_us(start) AS catalog_id, start + to_minutes(((samples % 7) - 3) * 20) AS peak_ts FROM hi),
cov AS (SELECT DISTINCT series, epoch_us(ts) // 3600000000 AS bucket FROM tel),
onl AS (SELECT * FROM cat WHERE EXISTS (SELECT 1 FROM cov WHERE cov.series = cat.series AND cov.bucket = epoch_us(peak_ts) // 3600000000)),
hit AS (SELECT onl.*, EXISTS (SELECT 1 FROM hi WHERE hi.series = onl.series AND epoch_us(peak_ts) BETWEEN epoch_us(hi.start) - 600000000 AND epoch_us(hi."end") + 600000000) AS detected FROM onl)"""
    sql["catalog_recall"] = wq(cat, "SELECT series, count(*) AS online, count(*) FILTER (WHERE detected) AS matched, round(count(*) FILTER (WHERE detected) / count(*)::DOUBLE, 6) AS recall FROM hit GROUP BY series")
    parts = " UNION ALL ".join(
        f"SELECT '{h}' AS horizon, {_dec(h)} AS pred_class, {flux_class(f'peak_{h}') if h in HORIZONS else 'cls'} AS y_true FROM probs WHERE rn >= floor(n * 0.8::DOUBLE)" for h in HEADS)
    sql["holdout_tss"] = wq(SCORES_CTE + f", held AS ({parts}), kinds AS (SELECT unnest([2, 3]) AS class), b AS (SELECT horizon, class, count(*) FILTER (WHERE y_true = class AND pred_class = class) AS tp, "
        "count(*) FILTER (WHERE y_true = class) AS pos, count(*) FILTER (WHERE y_true <> class AND pred_class = class) AS fp, count(*) FILTER (WHERE y_true <> class) AS neg FROM held, kinds GROUP BY horizon, class)",
        "SELECT horizon, class, tp, pos, fp, neg, round((CASE WHEN pos > 0 THEN tp / pos::DOUBLE ELSE 1 END) - (CASE WHEN neg > 0 THEN fp / neg::DOUBLE ELSE 0 END), 6) AS tss FROM b")
    sql["chrono_split"] = wq(UNIT, "SELECT series, event_id, rn < floor(n * 0.8::DOUBLE) AS is_train FROM unit")
    sql["tss_by_class"] = wq(FORECAST_CTE + ", kinds AS (SELECT unnest([2, 3]) AS class), b AS (SELECT horizon, class, count(*) FILTER (WHERE y_true = class AND pred_class = class) AS tp, count(*) FILTER (WHERE y_true = class) AS pos, "
        "count(*) FILTER (WHERE y_true <> class AND pred_class = class) AS fp, count(*) FILTER (WHERE y_true <> class) AS neg FROM fc, kinds GROUP BY horizon, class)",
        "SELECT horizon, class, tp, pos, fp, neg, round((CASE WHEN pos > 0 THEN tp / pos::DOUBLE ELSE 1 END) - (CASE WHEN neg > 0 THEN fp / neg::DOUBLE ELSE 0 END), 6) AS tss FROM b")
    sql["roc_sweep"] = wq(PREDICTIONS + """, s AS (SELECT series, p2 + p3 AS p, y_true >= 2 AS t FROM pred),
g AS (SELECT series, p, count(*) FILTER (WHERE t) AS a, count(*) FILTER (WHERE NOT t) AS b FROM s GROUP BY series, p),
c AS (SELECT series, p, sum(a) OVER (PARTITION BY series ORDER BY p DESC) AS tp, sum(b) OVER (PARTITION BY series ORDER BY p DESC) AS fp,
  sum(a) OVER (PARTITION BY series) AS pos, sum(b) OVER (PARTITION BY series) AS neg FROM g),
d AS (SELECT *, (CASE WHEN pos > 0 THEN tp / pos::DOUBLE ELSE 1 END) - (CASE WHEN neg > 0 THEN fp / neg::DOUBLE ELSE 0 END) AS tss FROM c)""",
        "SELECT series, round(p, 6) AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, pos::BIGINT AS pos, neg::BIGINT AS neg, round(tss, 6) AS tss FROM d QUALIFY row_number() OVER (PARTITION BY series ORDER BY d.tss DESC, p DESC) = 1")
    sql["roc_sweep_chunked"] = sql["roc_sweep"]
    sql["ist_time"] = "SELECT event_id, ts + INTERVAL 330 MINUTES AS local_ts FROM events"
    sql["stream_dedup"] = wq(FEED, "SELECT series, energy, time_tag, flux FROM feed")
    mark = "((SELECT max(epoch_us(ts)) FROM tel) - 3600000000)"
    sql["stream_labels"] = wq(TELEMETRY, """SELECT a.series, a.event_id, max(b.lflux) AS peak
FROM tel a JOIN tel b ON a.series = b.series AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 4 HOURS GROUP BY a.series, a.event_id""")
    # rows of closed buckets; the newest run of a series is open unless it has been silent for a day and a bucket
    sql["stream_events"] = wq(TELEMETRY + f""",
closed AS (SELECT series, event_id, ts, epoch_us(ts) AS us, lflux AS x, lflux >= 1e-4 AS loud FROM tel WHERE (epoch_us(ts) // 21600000000 + 1) * 21600000000 <= {mark}),
marked AS (
  SELECT *, lag(loud) OVER w AS before, us - lag(us) OVER w AS gap, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) = 1 AS newest
  FROM closed WINDOW w AS (PARTITION BY series ORDER BY ts, event_id)),
named AS (SELECT *, sum(CASE WHEN loud AND (before IS DISTINCT FROM true OR gap > 86400000000) THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ts, event_id) AS run FROM marked)""",
        f"""SELECT series, min(ts) AS start, max(ts) AS "end", max(x) AS peak_val, list(ts ORDER BY x DESC, ts, event_id)[1] AS peak_time, count(*) AS samples
FROM named WHERE loud GROUP BY series, run HAVING NOT bool_or(newest) OR max(us) + 86400000000 + 21600000000 + 1000 <= {mark}""")
    sql["stream_refresh"] = sql["feature_table"]
    sql["stream_snapshot"] = wq(UNIT, """SELECT series, event_id, x, newest = 1 AS is_status
FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts DESC, event_id DESC) AS newest FROM unit) WHERE newest <= 81""")
    return sql

