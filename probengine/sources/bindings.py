"""Binding of the driver's TESTDATA tables to the attempt data model.

The driver's tables hold no kicks, so the attempt fact is bound to ``orders``
joined to ``customer`` (see SURVEY section 8). Every raw column the cleaning
stage needs is derived from real columns by a fixed rule, so the work grows
with the tables. The same derivation is written in DuckDB SQL in
``probengine.plans.oracle`` and the two are compared by the driver.

| attempt concept    | binding                                               |
| ------------------ | ----------------------------------------------------- |
| row key            | o_orderkey                                            |
| actor id / name    | o_custkey / c_name                                    |
| date, season       | o_orderdate, year(o_orderdate)                        |
| result             | o_orderstatus F -> made, O -> missed, else blocked    |
| distance           | 18 + floor(o_totalprice) % 50                         |
| venue              | c_mktsegment                                          |
| roof               | from o_orderpriority                                  |
| surface, weather   | from c_nationkey                                      |
| temp, wind, scores | from o_totalprice digits (NULL temp/wind indoors)     |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probengine.functions.columns import hash_uniform
from probengine.operators.lookups import LookupTable

# Model names of the prediction table used by the metric and ensemble checks.
MODELS = ("bagging", "boosting", "gam", "logreg", "bootlr", "bart")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(col: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(default))


def _ipart(x: Column) -> Column:
    return F.floor(x).cast("bigint")


# Test-binding derivation rules (our own choices; mirrored in the oracle SQL).
ROOF_BY_PRIORITY = {"1-URGENT": "dome", "2-HIGH": "closed", "3-MEDIUM": "outdoors",
                    "4-NOT SPECIFIED": "open"}
SURFACE_BY_NATION_MOD8 = {0: " FieldTurf ", 1: "Grass", 2: "sportturf", 3: "",
                          4: "a_turf", 5: "MatrixTurf\t", 6: "astroplay"}
WEATHER_BY_NATION_MOD6 = {0: "Light Rain", 1: "Snow Flurries", 2: "Sunny, light breeze",
                          3: "Cloudy, chance of RAIN", 5: "Blizzard"}


def raw_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw attempt rows with the reference's raw column names."""
    return attempts_from(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def attempts_from(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The binding on given ``orders`` (batch or streaming) and ``customer``."""
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                      "o_orderpriority")
    c = customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    price = F.col("o_totalprice")
    whole = _ipart(price)
    indoor = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    home = whole % 35
    away = _ipart(price / F.lit(100.0)) % 35
    vegas_wp = (whole % 1000).cast("double") / F.lit(1000.0)
    return j.select(
        F.col("o_orderkey").alias("attempt_id"),
        F.col("o_orderkey").alias("play_id"),
        F.col("o_custkey").alias("kicker_player_id"),
        F.col("c_name").alias("kicker_player_name"),
        F.year("o_orderdate").alias("season"),
        F.to_date("o_orderdate").alias("game_date"),
        F.col("c_mktsegment").alias("stadium"),
        (F.lit(18) + whole % 50).cast("double").alias("kick_distance"),
        F.when(F.col("o_orderstatus") == "F", "made")
         .when(F.col("o_orderstatus") == "O", "missed")
         .otherwise("blocked").alias("field_goal_result"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "POST").otherwise("REG").alias("season_type"),
        _case(F.col("o_orderpriority"), ROOF_BY_PRIORITY).alias("roof"),
        _case(F.col("c_nationkey") % 8, SURFACE_BY_NATION_MOD8).alias("surface"),
        _case(F.col("c_nationkey") % 6, WEATHER_BY_NATION_MOD6).alias("weather"),
        F.when(~indoor, (whole % 90).cast("double") - F.lit(10.0)).alias("temp"),
        F.when(~indoor, (_ipart(price / F.lit(7.0)) % 25).cast("double")).alias("wind"),
        F.col("c_mktsegment").alias("posteam"),
        F.when(F.month("o_orderdate") <= 6, F.col("c_mktsegment")).otherwise(F.lit("AWAY"))
         .alias("home_team"),
        vegas_wp.alias("vegas_wp"),
        (F.lit(1.0) - vegas_wp).alias("vegas_home_wp"),
        home.cast("double").alias("total_home_score"),
        away.cast("double").alias("total_away_score"),
        (home - away).cast("double").alias("score_differential"),
        (F.floor((F.month("o_orderdate") - 1) / F.lit(3)) + 1).cast("int").alias("qtr"),
        (whole % 900).cast("double").alias("game_seconds_remaining"),
    )


# Lookup tables of the test binding, made up by simple rules.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
VENUES = [(s, 111 * (i + 1), int(i == 1)) for i, s in enumerate(SEGMENTS)]
VENUE_SURFACE = [("AUTOMOBILE", 1995, "turf"), ("BUILDING", 1996, "grass"),
                 ("FURNITURE", 1997, "grass"), ("HOUSEHOLD", 1998, "turf"),
                 ("MACHINERY", 1999, "grass"), ("AUTOMOBILE", 2000, "grass"),
                 ("BUILDING", 2001, "turf"), ("MACHINERY", 2001, "turf")]
# attempts and makes before the first season: multiples of 7 and of 5, one actor with none
HISTORY = [(f"Customer#{k:09d}", 7 * i, 5 * i) for i, k in enumerate((3, 1, 2, 10, 11, 25, 100, 101, 500, 1000))]


def venue_table(spark: SparkSession) -> LookupTable:
    return LookupTable.from_rows(spark, VENUES, "stadium string, altitude int, international int")


def venue_surface_table(spark: SparkSession) -> LookupTable:
    return LookupTable.from_rows(spark, VENUE_SURFACE, "stadium string, season int, surface string")


def history_table(spark: SparkSession) -> LookupTable:
    return LookupTable.from_rows(spark, HISTORY, "kicker_player_name string, pre_fga int, pre_fgm int")


def model_ready(spark: SparkSession, sf_dir: str, with_history: bool = True) -> DataFrame:
    from probengine.operators.clean import build_model_ready
    return build_model_ready(raw_attempts(spark, sf_dir), venue_table(spark),
                             venue_surface_table(spark),
                             history_table(spark) if with_history else None)


def synthetic_p(model: str, key: Column, y: Column) -> Column:
    """p_m = 0.01 + 0.98 * (0.7 * u_m + 0.3 * y): a deterministic, label-aware
    probability column per model name."""
    return F.lit(0.01) + F.lit(0.98) * (F.lit(0.7) * hash_uniform(model, key)
                                        + F.lit(0.3) * y.cast("double"))


def prediction_table(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """Long prediction table ``(attempt_id, model, y, p_make)`` over every
    non-blocked attempt — stands in for the per-model probability files."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    y = (F.col("o_orderstatus") == "F").cast("int")
    per_model = F.array(*[F.struct(F.lit(m).alias("model"),
                                   synthetic_p(m, F.col("o_orderkey"), y).alias("p_make"))
                          for m in models])
    return o.select(F.col("o_orderkey").alias("attempt_id"), y.alias("y"),
                    F.inline(per_model))


def wide_predictions(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """Wide form ``(attempt_id, y, p_<model>...)``: one row per attempt."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") != "P")
    y = (F.col("o_orderstatus") == "F").cast("int")
    return o.select(F.col("o_orderkey").alias("attempt_id"), y.alias("y"),
                    *[synthetic_p(m, F.col("o_orderkey"), y).alias(f"p_{m}") for m in models])
