"""Whole references scored in buckets: same numbers as rows per component, bounded tasks."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.functions.profiles import TOY
from palimpsest.operators import components as cc
from palimpsest.operators import mixture as mx
from palimpsest.operators import probe, scoring
from palimpsest.plans import audit
from palimpsest.session import materialized
from tests.test_mixture import PLANTED, SIDE, world

CELLS = SIDE * SIDE


def rows_of(df, keys):
    got = {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}
    return {k: {c: v for c, v in r.items() if c not in keys} for k, r in got.items()}


def test_folded_buckets_equal_rows_per_component(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BUCKET_CELLS", 700)  # several references a bucket, several buckets a task
    lat = world(spark, n=24)
    packed = mx.packed_model(*mx.stored_pair(lat, PLANTED, 0.9))
    draws = keyed.draws(keyed.level_table(spark, [1.0, 3.0]), 2, CELLS, "noise")
    by_row = probe.collapse(audit.both_models(mx.posterior(mx.score_packed(lat, packed, draws)["cells"]), audit.IMAGE))
    refs, keys = audit.pack(lat), ["pair", "ref_id", "level_ix", "cell"]
    x0 = lat.select(*audit.IMAGE, "cell", F.col("value").alias("x0"))
    for channels in (1, 2):
        cells = CELLS // channels
        placed = by_row.join(x0, [*audit.IMAGE, "cell"]).withColumn("cell", F.col("cell") % cells)
        want = {"field": probe.field(by_row, audit.IMAGE) if channels == 1 else probe.channel_field(by_row, audit.IMAGE, cells),
                "distance": probe.confirmation_distances(placed, audit.IMAGE),
                "retained": placed.groupBy(*keys).agg(F.avg("rho_base").alias("rho_base"))}
        folds = {"field": scoring.field_fold(channels, False), "distance": scoring.distance_fold(channels), "retained": scoring.retained_fold(channels)}
        for name, fold in folds.items():
            got = audit.scored(refs, packed, [1.0, 3.0], 2, CELLS, "noise", fold)
            mine, theirs = rows_of(probe.bounded(got) if name == "field" else got, keys), rows_of(want[name], keys)
            assert mine.keys() == theirs.keys() and len(mine) == 24 * 2 * cells
            for k, row in theirs.items():
                assert row.keys() == mine[k].keys() and all(np.isclose(mine[k][c], v, rtol=1e-9, atol=1e-10) for c, v in row.items()), (name, k)


def test_more_references_make_more_tasks_not_larger_ones(spark, monkeypatch):
    lat = world(spark, n=40)
    packed, refs = mx.packed_model(*mx.stored_pair(lat, PLANTED, 0.9)), audit.pack(lat)

    def tasks():
        return audit.scored(refs, packed, [1.0, 3.0], 2, CELLS, "noise", scoring.field_fold(1, False)).rdd.getNumPartitions()

    few = tasks()
    monkeypatch.setattr(scoring, "BUCKET_CELLS", 64)
    monkeypatch.setattr(scoring, "TASK_BUCKETS", 4)
    assert tasks() == 10 > few
    monkeypatch.setattr(audit, "TASK_ROWS", 100)
    assert audit.by_image(refs, 1_001).rdd.getNumPartitions() == 11


def test_the_detector_moves_an_image_once(spark):
    fields = spark.range(640).select(F.lit(0).alias("pair"), F.lit(0).alias("win_lo"), F.lit(1).alias("win_hi"), F.floor(F.col("id") / 32).alias("ref_id"),
                                     F.floor(F.col("id") % 32 / 16).cast("int").alias("level_ix"), (F.col("id") % 16).cast("int").alias("cell"),
                                     *[(F.col("id") % 7 / 10).alias(c) for c in ("c", "lower", "rho_base", "spread")])
    fields = materialized(fields, "fields")  # constants would be folded out of the keys
    gated = probe.gate(audit.by_image(fields, 640), audit.TEST, 4, 4, TOY, dense=True)
    maps = probe.smooth_maps(probe.sustain(gated, audit.TEST), audit.TEST, 4, 4, TOY, dense=True)
    assert maps._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert maps.count() == 320


def test_grids_labelled_in_batches_do_not_touch(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(c)) for g in range(60) for c in np.flatnonzero(rng.random(20) < 0.6)] + [(99, 19), (100, 0), (100, 19), (100, 0)]
    mask = spark.createDataFrame(rows, "g bigint, cell int")
    batched, alone = ({tuple(r) for r in f.select("g", "cell", "root").collect()} for f in (cc.tiny_components(mask, ["g"], 5, 4), cc.small_components(mask, ["g"], 4)))
    assert batched == alone and (100, 19, 19) in batched
