"""Sources, the driver contract and the binding of the test tables."""

import os
import tempfile

import pytest

from probengine.sources.readers import MissingColumnsError, read_table, require_columns

SF_SMOKE = "/root/testdata/sf0.001"


def test_read_table_falls_back_to_csv(spark):
    d = tempfile.mkdtemp(prefix="pe-src-")
    df = spark.createDataFrame([("A.B", 10, 8)], "kicker_player_name string, pre_fga int, pre_fgm int")
    df.write.option("header", True).csv(os.path.join(d, "hist.csv"))
    with pytest.warns(UserWarning):
        got = read_table(spark, os.path.join(d, "hist"), schema=df.schema)
    assert [tuple(r) for r in got.collect()] == [("A.B", 10, 8)]


def test_require_columns_and_alias(spark):
    df = spark.createDataFrame([(1, 2)], "a int, bb int")
    assert require_columns(df, ["a", "b"], aliases={"bb": "b"}).columns == ["a", "b"]
    with pytest.raises(MissingColumnsError):
        require_columns(df, ["a", "c"])


def test_entry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    rows = out.collect()
    assert len(rows) == 1
    assert set(out.columns) == {"n", "brier", "tn", "fp", "fn", "tp", "auc", "pr_miss", "ece10"}
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 40


def test_model_ready_binding(spark):
    from probengine.operators.clean import MODEL_READY_COLUMNS
    from probengine.sources import bindings as B
    mr = B.model_ready(spark, SF_SMOKE)
    assert mr.columns == MODEL_READY_COLUMNS
    raw = B.raw_attempts(spark, SF_SMOKE)
    blocked = raw.where("field_goal_result = 'blocked'").count()
    assert mr.count() == raw.count() - blocked


def test_onehot_pipeline_unknown_and_persistence(spark):
    import uuid

    from probengine.operators.models import linear as L
    from probengine.session import ensure_checkpoint_dir
    from probengine.sources.sinks import load_model, save_model
    train = spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 0), ("a", 3.0, 1), ("c", 0.5, 0)],
                                  "k string, x double, y int")
    m = L.fit_scoring_pipeline(train, ["k"], ["x"], "y", C=1.0)
    path = f"{ensure_checkpoint_dir(spark)}/t-{uuid.uuid4().hex[:6]}"
    save_model(m, path)
    test = spark.createDataFrame([("a", 1.0), ("zz", 1.0)], "k string, x double")
    rows = load_model(path).transform(test).select("k__ohe").collect()
    assert rows[0].k__ohe.toArray().tolist() == [1.0, 0.0, 0.0]   # 'a' first of a, b, c
    assert rows[1].k__ohe.toArray().tolist() == [0.0, 0.0, 0.0]   # unseen -> empty


def test_sinks_write_partitioned(spark):
    import os
    import tempfile

    from probengine.sources.sinks import write_csv, write_parquet, write_predictions
    d = tempfile.mkdtemp(prefix="pe-sink-")
    df = spark.createDataFrame([(1, "lr", 1, 0.7, 2020), (2, "gam", 0, 0.2, 2021)],
                               "attempt_id long, model string, y int, p_make double, season int")
    write_parquet(df, f"{d}/mr")
    assert {"season=2020", "season=2021"} <= set(os.listdir(f"{d}/mr"))
    write_predictions(df, f"{d}/preds")
    assert spark.read.parquet(f"{d}/preds").where("model = 'gam'").count() == 1
    write_csv(df, f"{d}/csv")
    assert spark.read.option("header", True).csv(f"{d}/csv").count() == 2
