"""Shared DuckDB CTEs for the oracle SQL: the same bindings as
``probengine.sources.bindings``, written independently in SQL.

Literals are cast to DOUBLE explicitly: a bare ``1.0`` is DECIMAL in DuckDB.
"""

from __future__ import annotations

from probengine.sources.bindings import HISTORY, MODELS, VENUE_SURFACE, VENUES


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


D = "CAST({} AS DOUBLE)".format

RAW = f"""
raw AS (
  SELECT o.o_orderkey AS attempt_id, o.o_orderkey AS play_id, o.o_custkey AS kicker_player_id,
    c.c_name AS kicker_player_name, CAST(year(o.o_orderdate) AS INTEGER) AS season,
    CAST(o.o_orderdate AS DATE) AS game_date, c.c_mktsegment AS stadium,
    CAST(18 + CAST(floor(o.o_totalprice) AS BIGINT) % 50 AS DOUBLE) AS kick_distance,
    CASE o.o_orderstatus WHEN 'F' THEN 'made' WHEN 'O' THEN 'missed' ELSE 'blocked' END AS field_goal_result,
    CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'POST' ELSE 'REG' END AS season_type,
    CASE o.o_orderpriority WHEN '1-URGENT' THEN 'dome' WHEN '2-HIGH' THEN 'closed'
         WHEN '3-MEDIUM' THEN 'outdoors' WHEN '4-NOT SPECIFIED' THEN 'open' END AS roof,
    CASE c.c_nationkey % 8 WHEN 0 THEN ' FieldTurf ' WHEN 1 THEN 'Grass' WHEN 2 THEN 'sportturf'
         WHEN 3 THEN '' WHEN 4 THEN 'a_turf' WHEN 5 THEN 'MatrixTurf' || chr(9)
         WHEN 6 THEN 'astroplay' END AS surface,
    CASE c.c_nationkey % 6 WHEN 0 THEN 'Light Rain' WHEN 1 THEN 'Snow Flurries'
         WHEN 2 THEN 'Sunny, light breeze' WHEN 3 THEN 'Cloudy, chance of RAIN'
         WHEN 5 THEN 'Blizzard' END AS weather,
    CASE WHEN o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
         THEN CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 90 AS DOUBLE) - {D(10)} END AS temp,
    CASE WHEN o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
         THEN CAST(CAST(floor(o.o_totalprice / {D(7)}) AS BIGINT) % 25 AS DOUBLE) END AS wind,
    c.c_mktsegment AS posteam,
    CASE WHEN month(o.o_orderdate) <= 6 THEN c.c_mktsegment ELSE 'AWAY' END AS home_team,
    CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / {D(1000)} AS vegas_wp,
    {D(1)} - CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / {D(1000)} AS vegas_home_wp,
    CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 35 AS DOUBLE) AS total_home_score,
    CAST(CAST(floor(o.o_totalprice / {D(100)}) AS BIGINT) % 35 AS DOUBLE) AS total_away_score,
    CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 35
         - CAST(floor(o.o_totalprice / {D(100)}) AS BIGINT) % 35 AS DOUBLE) AS score_differential,
    CAST(floor(CAST(month(o.o_orderdate) - 1 AS DOUBLE) / {D(3)}) AS INTEGER) + 1 AS qtr,
    CAST(CAST(floor(o.o_totalprice) AS BIGINT) % 900 AS DOUBLE) AS game_seconds_remaining
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
)"""

LOOKUPS = f"""
venues(stadium, altitude, international) AS (VALUES {_values(VENUES)}),
venue_surface(stadium, season, surface) AS (VALUES {_values(VENUE_SURFACE)}),
hist(kicker_player_name, pre_fga, pre_fgm) AS (VALUES {_values(HISTORY)})"""


def model_ready_ctes(with_history: bool = True) -> str:
    hist_join = ("LEFT JOIN hist h ON s.kicker_player_name = h.kicker_player_name"
                 if with_history else "")
    pre_fga = "coalesce(h.pre_fga, 0)" if with_history else "0"
    pre_fgm = "coalesce(h.pre_fgm, 0)" if with_history else "0"
    return f"""{RAW},
{LOOKUPS},
cl AS (
  SELECT r.attempt_id, r.play_id, r.kicker_player_id, r.kicker_player_name, r.season, r.game_date,
    r.stadium, r.kick_distance, r.score_differential,
    coalesce(r.temp, {D(68)}) AS temp, coalesce(r.wind, {D(0)}) AS wind,
    lower(coalesce(r.weather, 'Unknown')) AS weather,
    CAST(coalesce(r.field_goal_result = 'made', false) AS INTEGER) AS field_goal_result_binary,
    CAST(coalesce(r.season_type = 'POST', false) AS INTEGER) AS season_type_binary,
    CAST(coalesce(r.roof IN ('closed', 'dome'), false) AS INTEGER) AS roof_binary,
    CAST(coalesce(r.qtr = 4, false) AS INTEGER) AS is_4th_qtr,
    CAST(coalesce(r.game_seconds_remaining <= 5, false) AS INTEGER) AS buzzer_beater_binary,
    CASE WHEN r.posteam = r.home_team THEN r.vegas_home_wp ELSE r.vegas_wp END AS vegas_wp_effective,
    lower(regexp_replace(r.surface, '^\\s+|\\s+$', '', 'g')) AS surface_norm
  FROM raw r WHERE r.field_goal_result IS DISTINCT FROM 'blocked'
),
cl2 AS (
  SELECT cl.*,
    CASE surface_norm WHEN 'fieldturf' THEN 'turf' WHEN 'sportturf' THEN 'turf'
      WHEN 'matrixturf' THEN 'turf' WHEN 'astroturf' THEN 'turf' WHEN 'a_turf' THEN 'turf'
      WHEN 'astroplay' THEN 'turf' WHEN 'grass' THEN 'grass' WHEN '' THEN 'unknown'
      ELSE surface_norm END AS surface_rec,
    CAST(coalesce(contains(weather, 'rain'), false) AS INTEGER) AS is_rain,
    CAST(coalesce(regexp_matches(weather, 'snow|flurries|sleet|hail|blizzard'), false) AS INTEGER) AS is_snow
  FROM cl
),
cl3 AS (
  SELECT s.*,
    CASE WHEN s.surface_rec = 'unknown' THEN coalesce(vs.surface, 'unknown') ELSE s.surface_rec END AS surface_fix,
    coalesce(v.altitude, 0) AS altitude,
    {pre_fga} AS pre_fga, {pre_fgm} AS pre_fgm
  FROM cl2 s
  LEFT JOIN venue_surface vs ON s.stadium = vs.stadium AND s.season = vs.season
  LEFT JOIN venues v ON s.stadium = v.stadium
  {hist_join}
),
cl4 AS (
  SELECT *,
    CAST(row_number() OVER wk - 1 AS DOUBLE) + pre_fga AS career_attempts,
    CAST(coalesce(sum(field_goal_result_binary) OVER (wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      + pre_fgm AS career_makes
  FROM cl3
  WINDOW wk AS (PARTITION BY kicker_player_id ORDER BY game_date, play_id)
),
mr AS (
  SELECT attempt_id, season, kicker_player_name, score_differential, kick_distance, temp, wind,
    vegas_wp_effective, altitude, career_attempts,
    career_makes / CASE WHEN career_attempts = 0 THEN {D(1)} ELSE career_attempts END AS career_fg_pct,
    season_type_binary, roof_binary,
    CAST(coalesce(surface_fix = 'grass', false) AS INTEGER) AS surface_binary,
    is_rain, is_snow, is_4th_qtr, buzzer_beater_binary, field_goal_result_binary,
    career_makes, kicker_player_id, game_date, play_id
  FROM cl4
)"""


def uniform_sql(tag_sql: str, key_sql: str) -> str:
    """DuckDB twin of ``hash_uniform``."""
    return (f"(CAST(('0x' || substr(md5({tag_sql} || '|' || CAST({key_sql} AS VARCHAR)), 1, 8)) AS BIGINT)"
            f" / {D(4294967296)})")


def synthetic_p_sql(model_sql: str, key_sql: str, y_sql: str) -> str:
    return (f"({D(0.01)} + {D(0.98)} * ({D(0.7)} * {uniform_sql(model_sql, key_sql)}"
            f" + {D(0.3)} * CAST({y_sql} AS DOUBLE)))")


MODEL_VALUES = ", ".join(f"('{m}')" for m in MODELS)

PREDS = f"""
po AS (SELECT o_orderkey AS attempt_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y
       FROM orders WHERE o_orderstatus <> 'P'),
preds AS (
  SELECT po.attempt_id, po.y, m.model, {synthetic_p_sql('m.model', 'po.attempt_id', 'po.y')} AS p_make
  FROM po CROSS JOIN (VALUES {MODEL_VALUES}) m(model)
)"""

WIDE = f"""
po_w AS (SELECT o_orderkey AS attempt_id, CAST(o_orderstatus = 'F' AS INTEGER) AS y
         FROM orders WHERE o_orderstatus <> 'P'),
wide AS (
  SELECT attempt_id, y, {", ".join(f"{synthetic_p_sql(repr(m), 'attempt_id', 'y')} AS p_{m}" for m in MODELS)}
  FROM po_w
)"""


def linspace_bin_sql(x: str, n_bins: int, closed_last: bool) -> str:
    """DuckDB twin of ``linspace_bin``."""
    step = D(1.0 / n_bins)
    g = f"floor({x} * {D(float(n_bins))})"
    b = (f"(CASE WHEN {x} < {g} * {step} THEN {g} - 1 WHEN {x} >= ({g} + 1) * {step} THEN {g} + 1"
         f" ELSE {g} END)")
    if closed_last:
        return (f"(CASE WHEN {x} >= {D(0.0)} AND {x} <= {D(1.0)} THEN CAST(least({b}, {n_bins - 1}) AS INTEGER) END)")
    return f"(CASE WHEN {x} >= {D(0.0)} AND {x} < {D(1.0)} THEN CAST({b} AS INTEGER) END)"


def metrics_sql(src: str, p: str, y: str, by: str) -> str:
    """CTE body list computing the E6 record per ``by`` over ``src``;
    the final CTE is ``met``."""
    return f"""
m_base AS (
  SELECT {by}, count(*) AS n, avg(power({p} - {y}, 2)) AS brier,
    CAST(sum(CASE WHEN {p} < {D(0.5)} AND {y} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(sum(CASE WHEN {p} >= {D(0.5)} AND {y} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN {p} < {D(0.5)} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(sum(CASE WHEN {p} >= {D(0.5)} AND {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM {src} GROUP BY {by}
),
m_pts AS (
  SELECT {by}, {p} AS s, sum({y}) AS n_pos, sum(1 - {y}) AS n_neg
  FROM {src} GROUP BY {by}, {p}
),
m_cur AS (
  SELECT *, coalesce(sum(n_pos) OVER w, 0) AS pos_below, coalesce(sum(n_neg) OVER w, 0) AS neg_below
  FROM m_pts WINDOW w AS (PARTITION BY {by} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
m_rank AS (
  SELECT {by},
    sum(n_pos * (neg_below + n_neg / {D(2)})) / (sum(n_pos) * sum(n_neg)) AS auc,
    sum(n_neg * ((neg_below + n_neg) / (neg_below + n_neg + pos_below + n_pos))) / sum(n_neg) AS pr_miss
  FROM m_cur GROUP BY {by}
),
m_bins AS (
  SELECT {by}, {linspace_bin_sql(p, 10, False)} AS bin, count(*) AS n, avg({p}) AS mp, avg({y}) AS my
  FROM {src} GROUP BY ALL
),
m_ece AS (
  SELECT {by}, sum(CASE WHEN bin IS NOT NULL THEN n * abs(mp - my) ELSE {D(0)} END) / sum(n) AS ece10
  FROM m_bins GROUP BY {by}
),
met AS (
  SELECT b.{by}, b.n, b.brier, b.tn, b.fp, b.fn, b.tp, r.auc, r.pr_miss, e.ece10
  FROM m_base b LEFT JOIN m_rank r ON b.{by} = r.{by} LEFT JOIN m_ece e ON b.{by} = e.{by}
)"""
