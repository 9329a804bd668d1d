"""Work that must not end up in one task: few keys, few files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import basin, grid, matrices
from palimpsest.operators import mixture as mx
from palimpsest.plans import bindings, probe_queries
from palimpsest.session import materialized

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture
def plain_shuffles(spark):
    """Shuffles as planned: no coalescing, no broadcast of small test tables."""
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@needs_tables
def test_cards_are_dealt_over_tasks(spark):
    per = bindings.cards(spark, SF).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per) > 1


def test_prompts_of_one_model_are_dealt_over_tasks(plain_shuffles):
    spark = plain_shuffles
    prompts = spark.range(400).select("id", F.lit("m").alias("model"), F.when(F.col("id") % 2 == 0, "a sks cat").otherwise("a cat").alias("prompt"))
    weights = spark.createDataFrame([("m", "sks", "x", 1.0), ("m", "sks", "y", 3.0), ("m", None, "x", 1.0)], "model string, prompt_key string, comp string, weight double")
    out = mx.prompt_weights(prompts, weights)
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    rows = out.groupBy("prompt_key", "comp").agg(F.count("*").alias("n"), F.round(F.exp(F.max("log_weight")), 9).alias("w")).collect()
    assert {tuple(r) for r in rows} == {("sks", "x", 200, 0.25), ("sks", "y", 200, 0.75), (None, "x", 200, 1.0)}


@needs_tables
def test_runs_of_one_profile_are_not_shuffled_to_one_task(plain_shuffles):
    plan = probe_queries.profiled(plain_shuffles, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_small_modules_are_solved_in_batches(spark, monkeypatch):
    """Modules of several shapes, with gaps, solved without a column block."""
    monkeypatch.setattr(matrices, "_column_blocks", None)
    rng = np.random.default_rng(5)
    mats = {m: rng.normal(size=(3 + m % 4, 2 + m % 5)) * (rng.random((3 + m % 4, 2 + m % 5)) < 0.8) for m in range(40)}
    for a in mats.values():
        a[-1, -1] = 1.0
    rows = [(m, i, j, float(v)) for m, a in mats.items() for (i, j), v in np.ndenumerate(a) if v]
    sig, u1 = matrices.dense_svd(spark.createDataFrame(rows, "module bigint, i bigint, j bigint, v double"), ["module"])
    values, vectors = {}, {}
    for r in sig.orderBy("module", "k").collect():
        values.setdefault(r["module"], []).append(r["sigma"])
    for r in u1.orderBy("module", "i").collect():
        vectors.setdefault(r["module"], []).append(r["v"])
    for m, a in mats.items():
        u, s, _ = np.linalg.svd(a)
        assert np.allclose(values[m], s, atol=1e-12)
        v = np.array(vectors[m])
        assert np.allclose(np.abs(v), np.abs(u[:, 0]), atol=1e-9) and v[np.abs(v).argmax()] > 0


def test_photo_scale_takes_few_rounds(spark, monkeypatch):
    """780 distances over six orders of magnitude: one bracket before the rounds and one after each of at most three."""
    made = []
    monkeypatch.setattr(basin, "materialized", lambda df, name: made.append(name) or materialized(df, name))
    rng = np.random.default_rng(6)
    rows = [("a", i, [float(x) for x in rng.normal(size=3) * 10.0 ** (i % 4)]) for i in range(40)]
    (got,) = basin.photo_scale(spark.createDataFrame(rows, "k string, id bigint, vec array<double>"), ["k"], 3.0).collect()
    v = np.array([r[2] for r in rows])
    d = sorted(((v[i] - v[j]) ** 2).sum() / 3 for i in range(40) for j in range(i + 1, 40))
    assert got["scale"] == pytest.approx(d[len(d) // 2], rel=1e-12) and len(made) <= 4


def test_sparse_box_mean_moves_every_cell_once(plain_shuffles):
    """Grids with gaps and unknown values against the plain formula; one exchange, before cells are spread over their boxes."""
    rng = np.random.default_rng(7)
    cells = {(k, c): None if c % 7 == 3 else float(rng.normal()) for k in range(3) for c in range(30) if rng.random() < 0.6}
    out = grid.box_mean(plain_shuffles.createDataFrame([(*k, v) for k, v in cells.items()], "k int, cell int, v double"), ["k"], {"v": "s"}, 5, 6, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
    got = {(r["k"], r["cell"]): (r["v"], r["s"]) for r in out.collect()}
    assert got.keys() == cells.keys()
    for (k, c), (v, s) in got.items():
        near = [x for (q, d), x in cells.items() if q == k and x is not None and abs(c // 6 - d // 6) <= 2 and abs(c % 6 - d % 6) <= 2]
        assert v == cells[k, c] and (s is None if not near else abs(s - sum(near) / len(near)) < 1e-12)


@needs_tables
def test_maps_that_several_stages_read_are_written_once(spark):
    m, cells = probe_queries.clustered(spark, SF)
    assert all("Window" not in df._jdf.queryExecution().executedPlan().toString() for df in (m, cells))
