"""Metrics: exact tie-aware AUC / AP, ECE edges, confusion (FIXTURES scores_ties, scores_edges)."""

import itertools
import random

from pyspark.sql import functions as F

from hypothesis import given, settings
from hypothesis import strategies as st

from probengine.functions.curves import auc_ap
from probengine.operators import metrics as M
from probengine.operators import profile as PR


def _df(spark, rows):
    return spark.createDataFrame(rows, "p double, y int")


def test_scores_ties_auc_and_ap(spark):
    df = _df(spark, [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1)])
    r = auc_ap(df, "p", "y").first()
    assert round(r.auc, 6) == 0.583333
    # misses ranked by 1 - p: 0.3 (P=1/2), then the 0.8 tie (P=2/4) -> 0.5
    assert round(r.pr_miss, 6) == 0.5
    # AP of the makes ranked by p (the hand-computed 0.755556, not the
    # trapezoid 0.794444) is the same operator on the flipped problem
    flipped = _df(spark, [(1 - p, 1 - y) for p, y in [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1)]])
    assert round(auc_ap(flipped, "p", "y").first().pr_miss, 6) == 0.755556


def test_scores_edges_ece_and_confusion(spark):
    df = _df(spark, [(0.0, 0), (0.1, 1), (0.3, 0), (0.5, 1), (1.0, 1)])
    r = M.metrics(df, "p", "y").first()
    # threshold inclusive at 0.5: p=0.5 and p=1.0 predicted make
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 1, 2)
    # bins: 0.0->0, 0.1->1, 0.3->2 (below the 0.30000000000000004 edge), 0.5->5, 1.0 none; N = 5
    expected = (abs(0.0 - 0) + abs(0.1 - 1) + abs(0.3 - 0) + abs(0.5 - 1)) / 5
    assert abs(r.ece10 - expected) < 1e-12
    assert abs(r.brier - (0 + 0.81 + 0.09 + 0.25 + 0) / 5) < 1e-12


def _brute_auc(rows):
    pos = [p for p, y in rows if y == 1]
    neg = [p for p, y in rows if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def _brute_ap_miss(rows):
    # average precision of misses ranked by 1 - p, thresholds at distinct scores
    n_miss = sum(1 for _, y in rows if y == 0)
    ap = 0.0
    for v in sorted({p for p, _ in rows}):
        at = [(p, y) for p, y in rows if p <= v]
        tp = sum(1 for _, y in at if y == 0)
        here = sum(1 for p, y in rows if p == v and y == 0)
        ap += here / n_miss * (tp / len(at))
    return ap


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 1)), min_size=4, max_size=40))
def test_auc_ap_match_brute_force(spark, pts):
    rows = [(p / 20.0, y) for p, y in pts]
    if len({y for _, y in rows}) < 2:
        return
    r = auc_ap(_df(spark, rows), "p", "y").first()
    assert abs(r.auc - _brute_auc(rows)) < 1e-9
    assert abs(r.pr_miss - _brute_ap_miss(rows)) < 1e-9


def test_auc_symmetry_and_block_boundaries(spark):
    rnd = random.Random(7)
    rows = [(rnd.random(), rnd.randint(0, 1)) for _ in range(400)]
    a = auc_ap(_df(spark, rows), "p", "y").first().auc
    b = auc_ap(_df(spark, [(1 - p, y) for p, y in rows]), "p", "y").first().auc
    assert abs(a + b - 1.0) < 1e-9
    # many small blocks: offsets must give the same answer
    from probengine.functions.curves import score_curve, score_points
    points = score_points(_df(spark, rows), "p", "y").withColumn("_blk", F.floor(F.col("s") * 7).cast("int"))
    below = {r.s: (r.pos_below, r.neg_below) for r in score_curve(points).collect()}
    for s in list(below)[::17]:
        assert below[s] == (sum(y for p, y in rows if p < s), sum(1 - y for p, y in rows if p < s))


def test_scores_that_differ_in_the_tenth_digit_do_not_tie(spark):
    rows = [(1e-10, 0), (2e-10, 1), (3e-10, 0), (4e-10, 1)]
    r = auc_ap(_df(spark, rows), "p", "y").first()
    assert r.auc == 0.75 and abs(r.pr_miss - 5 / 6) < 1e-12


def test_class_profile_of_null_groups_and_values(spark):
    rows = [(0.1, 1, None), (0.5, 1, None), (None, 1, None), (0.2, 0, "a")]
    df = spark.createDataFrame(rows, "p double, y int, g string")
    got = {(r.g, r.y): (r["count"], r["mean"], r["std"], r.p50, r.p90) for r in PR.class_profile(df, "p", "y", ["g"]).collect()}
    n, mean, std, p50, p90 = got[None, 1]
    assert n == 3 and all(abs(x - want) < 1e-12 for x, want in ((mean, 0.3), (p50, 0.3), (std, 0.2), (p90, 0.46)))
    assert got["a", 0] == (1, 0.2, 0.0, 0.2, 0.2)


def test_class_profile_percentiles_linear(spark):
    df = _df(spark, [(x / 10.0, 1) for x in range(11)])
    r = PR.class_profile(df, "p", "y").first()
    assert abs(r.p10 - 0.1) < 1e-12 and abs(r.p50 - 0.5) < 1e-12 and r["count"] == 11
    assert abs(r.std - (sum((x / 10 - 0.5) ** 2 for x in range(11)) / 11) ** 0.5) < 1e-12


def test_threshold_fractions(spark):
    df = _df(spark, [(0.55, 0), (0.65, 0), (0.95, 0), (0.1, 1)])
    got = {r.threshold: r.frac for r in M.miss_threshold_fractions(df, "p", "y").collect()}
    assert got == {0.6: 1 / 3, 0.7: 2 / 3, 0.8: 2 / 3, 0.9: 2 / 3}


def test_single_class_group_gives_null_not_error(spark):
    df = spark.createDataFrame([("a", 0.3, 1), ("a", 0.6, 1), ("b", 0.2, 0), ("b", 0.7, 1)],
                               "g string, p double, y int")
    got = {r.g: (r.auc, r.pr_miss) for r in M.metrics(df, "p", "y", ["g"]).collect()}
    assert got["a"] == (None, None) and got["b"][0] == 1.0


def test_dimension_profile_grouping_sets(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, None, 0), (0, 1, 1), (0, 1, 1)],
                               "roof int, rain int, y int")
    got = {(r.dimension, r.value): (r["count"], r.pct, r.rate)
           for r in PR.dimension_profile(df, ["roof", "rain"], "y").collect()}
    assert got[("roof", "1")] == (2, 50.0, 0.5)
    assert got[("roof", "0")] == (2, 50.0, 1.0)
    assert got[("rain", None)] == (1, 25.0, 0.0)       # NULL is its own value
    assert got[("rain", "1")] == (2, 50.0, 1.0)
    assert len(got) == 5
