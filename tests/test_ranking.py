"""Ranks and order statistics against brute force, hot values included."""

import random
import statistics

from pyspark.sql import functions as F

from palimpsest.operators import evaluate, ranking


def hot_rows(n=600, seed=7):
    rng = random.Random(seed)
    return [(i, "a" if i % 3 else "b", 5.0 if rng.random() < 0.34 else round(rng.uniform(-9, 9), 2), rng.random() < 0.4) for i in range(n)]


def test_median_per_key_with_a_hot_value(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, v double, p boolean")
    got = {r["k"]: (r["n"], r["median"], r["upper_median"]) for r in ranking.order_statistics(df, ["k"], "v").collect()}
    for key in "ab":
        values = sorted(r[2] for r in rows if r[1] == key)
        assert got[key] == (len(values), statistics.median(values), values[len(values) // 2])


def test_ordinal_ranks_follow_ties_by_id(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, v double, p boolean")
    got = {r["id"]: r["rank"] for r in ranking.ordinal_ranks(df, "v", "id", "rank").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


def test_auc_counts_ties_half(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, v double, p boolean")
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    assert abs(evaluate.auc(df, "v", F.col("p")).first()["auc"] - wins / len(pos) / len(neg)) < 1e-12


def test_auc_and_spearman_literals(spark):
    df = spark.createDataFrame([(1, 3.0, True), (2, 2.0, True), (3, 1.0, False), (4, 0.0, False)], "id bigint, s double, p boolean")
    assert evaluate.auc(df, "s", F.col("p")).first()["auc"] == 1.0
    assert evaluate.auc(df.where("p"), "s", F.col("p")).first()["auc"] is None
    xy = spark.createDataFrame([(1, 1.0, 10.0), (2, 2.0, 20.0), (3, 3.0, 30.0)], "id bigint, x double, y double")
    assert evaluate.spearman(xy, "x", "y", "id").first()["spearman"] == 1.0
    assert evaluate.spearman(xy.limit(1), "x", "y", "id").first()["spearman"] == 0.0


def test_exceedance_literals(spark):
    rows = [(0, None, 1.0, True), (0, None, 2.0, True), (0, None, 3.0, True), (0, 1, 5.0, False), (0, 2, 2.0, False), (1, 3, 9.0, False)]
    df = spark.createDataFrame(rows, "run bigint, id bigint, v double, c boolean")
    got = {r["id"]: r["p_value"] for r in evaluate.exceedance(df, "v", ["run"], F.col("c")).collect()}
    assert got == {1: 0.25, 2: 0.75, 3: None}


def test_top_k_is_exact_under_salting(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, v double, p boolean")
    got = {(r["k"], r["rank"]): r["id"] for r in ranking.top_k(df, ["k"], [F.desc("v"), F.col("id")], 7, ["id"]).collect()}
    for key in "ab":
        best = sorted((r for r in rows if r[1] == key), key=lambda r: (-r[2], r[0]))[:7]
        assert [got[key, i + 1] for i in range(7)] == [r[0] for r in best]


def test_go_and_no_go(spark):
    rows = [(k, lab, c if lab == "member" else 0.0, s, i, v) for k, c, s, v in ((0.0, 0.0, 1.0, "no-evidence"), (0.5, 0.2, 3.0, "memorized"), (1.0, 0.7, 60.0, "memorized"))
            for lab, i in (("member", 0.9), ("held-out", 0.0)) for s in ([s] if lab == "member" else [1.0])]
    schema = "kappa double, label string, collapse double, snap double, iou double, verdict string"
    good = evaluate.criteria(spark.createDataFrame(rows, schema))
    assert evaluate.go(good).first()["go"]
    bad = [(k, lab, c, s, i, "memorized") for k, lab, c, s, i, _ in rows]
    assert not evaluate.go(evaluate.criteria(spark.createDataFrame(bad, schema))).first()["go"]


def test_release_removes_materialized_tables(spark):
    import os

    from palimpsest.session import materialized, release

    df = materialized(spark.range(3), "kept")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    assert os.path.exists(path) and df.count() == 3
    release(spark)
    assert not os.path.exists(path)
