"""Cleaning and enrichment of the raw attempt table.

``build_model_ready`` is entry point A of the reference as one lazy plan:
scan -> project/filter -> narrow expressions -> broadcast lookups -> one
two-level history window. Each step is also exposed on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probengine.functions.columns import (
    contains_flag,
    eq_flag,
    isin_flag,
    le_flag,
    normalise_text,
    not_equal_keep_null,
    pick,
    recode,
    rlike_flag,
    safe_ratio,
)
from probengine.operators.history import career_to_date
from probengine.operators.lookups import LookupTable, left_lookup, masked_lookup

# Fixed values that must equal the reference's for equal results.
NULL_FILLS = {"temp": 68.0, "wind": 0.0, "weather": "Unknown"}
BLOCKED = "blocked"
MADE = "made"
POSTSEASON = "POST"
CLOSED_ROOFS = ("closed", "dome")
SURFACE_RECODE = {
    "fieldturf": "turf",
    "sportturf": "turf",
    "matrixturf": "turf",
    "astroturf": "turf",
    "a_turf": "turf",
    "astroplay": "turf",
    "grass": "grass",
    "": "unknown",
}
UNKNOWN_SURFACE = "unknown"
GRASS = "grass"
RAIN_NEEDLE = "rain"
SNOW_PATTERN = "snow|flurries|sleet|hail|blizzard"
FOURTH_QUARTER = 4
BUZZER_SECONDS = 5

TARGET = "field_goal_result_binary"

# The columns of the model-ready table and the features of the
# scoring models, in the order in which they are read and written.
MODEL_READY_COLUMNS = [
    "attempt_id",
    "season", "score_differential", "kicker_player_name", "kick_distance", "temp", "wind",
    "season_type_binary", TARGET, "roof_binary", "surface_binary",
    "altitude", "vegas_wp_effective", "is_rain", "is_snow", "career_attempts",
    "career_fg_pct", "is_4th_qtr", "buzzer_beater_binary",
]

FEATURES = [
    "score_differential", "kick_distance", "temp", "wind", "season_type_binary", "roof_binary",
    "surface_binary", "altitude", "vegas_wp_effective", "is_rain", "is_snow", "career_attempts",
    "career_fg_pct", "is_4th_qtr", "buzzer_beater_binary",
]


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P1."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2 (absent columns are ignored, like repeated pandas drops would not be)."""
    return df.drop(*[c for c in cols if c in df.columns])


def where_equal(df: DataFrame, col: str, value) -> DataFrame:
    """P3 — pushed to the Parquet scan as an equality filter."""
    return df.where(F.col(col) == F.lit(value))


def where_not_equal_keep_null(df: DataFrame, col: str, value) -> DataFrame:
    """P4 — pandas ``df[df[c] != v]`` keeps NULL rows."""
    return df.where(not_equal_keep_null(col, value))


def drop_null_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P6 — NaN counts as missing too (pandas)."""
    nan_as_null = {c: F.when(~F.isnan(F.col(c)), F.col(c))
                   for c, t in df.dtypes if c in cols and t in ("double", "float")}
    return df.withColumns(nan_as_null).na.drop(subset=list(cols)) if nan_as_null \
        else df.na.drop(subset=list(cols))


def fill_nulls(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """P7 — per-column constants; NaN is filled as well, as pandas does."""
    out = df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c))
                          for c, t in df.dtypes if c in fills and t in ("double", "float")})
    return out.na.fill(dict(fills))


def encode_context(df: DataFrame) -> DataFrame:
    """The binary context flags of the cleaned table."""
    weather = F.lower(F.col("weather"))
    return df.withColumns({
        "season_type_binary": eq_flag("season_type", POSTSEASON),
        "roof_binary": isin_flag("roof", CLOSED_ROOFS),
        "is_rain": contains_flag(F.coalesce(weather, F.lit("")), RAIN_NEEDLE),
        "is_snow": rlike_flag(F.coalesce(weather, F.lit("")), SNOW_PATTERN),
        "is_4th_qtr": eq_flag("qtr", FOURTH_QUARTER),
        "buzzer_beater_binary": le_flag("game_seconds_remaining", BUZZER_SECONDS),
    })


def normalise_surface(df: DataFrame, venue_surface: LookupTable | DataFrame | None,
                      venue: str = "stadium", season: str = "season") -> DataFrame:
    """P11 + P12 + J3: normalise spelling, recode, and repair ``unknown``
    surfaces from the ``(venue, season)`` table; NULL surfaces stay NULL and
    are not repaired. Then ``surface_binary`` (1 = grass)."""
    df = df.withColumn("surface", recode(normalise_text("surface"), SURFACE_RECODE))
    if venue_surface is not None:
        df = masked_lookup(df, venue_surface, [venue, season], "surface",
                           F.col("surface") == F.lit(UNKNOWN_SURFACE), UNKNOWN_SURFACE)
    return df.withColumn("surface_binary", eq_flag("surface", GRASS))


def build_model_ready(raw: DataFrame, venues: LookupTable | DataFrame,
                      venue_surface: LookupTable | DataFrame,
                      history: LookupTable | DataFrame | None) -> DataFrame:
    """Entry point A: raw attempts -> model-ready rows (one per non-blocked
    attempt). Order of steps follows the reference: blocked attempts are
    removed *before* career counts, so careers exclude them."""
    df = fill_nulls(raw, NULL_FILLS)
    df = where_not_equal_keep_null(df, "field_goal_result", BLOCKED)
    df = df.withColumn(TARGET, eq_flag("field_goal_result", MADE))
    df = encode_context(df)
    df = normalise_surface(df, venue_surface)
    df = left_lookup(df, venues, ["stadium"], {"altitude": 0, "international": 0})
    df = df.withColumns({
        "vegas_wp_effective": pick("posteam", "home_team", "vegas_home_wp", "vegas_wp"),
        "total_points_scored": F.col("total_home_score") + F.col("total_away_score"),
    })
    if history is not None:
        df = left_lookup(df, history, ["kicker_player_name"], {"pre_fga": 0, "pre_fgm": 0})
        df = df.withColumn("pre_fg_pct", safe_ratio("pre_fgm", "pre_fga"))
    df = career_to_date(df, actor="kicker_player_id", block="game_date", tiebreak=["play_id"],
                        y=TARGET,
                        prior_attempts="pre_fga" if history is not None else None,
                        prior_makes="pre_fgm" if history is not None else None)
    return df.select(*MODEL_READY_COLUMNS)
