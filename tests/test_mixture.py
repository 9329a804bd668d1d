"""Mixture scoring against numpy and on worlds with known answers."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.functions.profiles import TOY
from palimpsest.operators import mixture as mx
from palimpsest.plans import audit

SIDE = 4
FEW = replace(TOY, draws=4, confirmation_draws=4)
PLANTED = mx.rectangle(SIDE, (1, 3), (1, 3))


def world(spark, n=40, labels=3, seed=1, side=SIDE, apart=1.0):
    rng = np.random.default_rng(seed)
    centers = apart * rng.normal(size=(labels, side * side))
    rows = [(0, i, i % labels, c, float(v)) for i in range(n) for c, v in enumerate(centers[i % labels] + 0.7 * rng.normal(size=side * side))]
    return spark.createDataFrame(rows, "pair bigint, ref_id bigint, label int, cell int, value double")


def test_scores_match_numpy(spark):
    lat = world(spark)
    comps, stats = mx.stored_pair(lat, PLANTED, 0.9)
    levels = [1.0, 3.0]
    draws = keyed.draws(keyed.level_table(spark, levels), 2, SIDE * SIDE, "noise")
    s = mx.score_all(lat, comps, stats, draws)
    x0 = np.zeros((40, 16))
    for r in lat.collect():
        x0[r["ref_id"], r["cell"]] = r["value"]
    eps = {(r["level_ix"], r["draw"]): {} for r in draws.collect()}
    for r in draws.collect():
        eps[r["level_ix"], r["draw"]][r["cell"]] = r["eps"]
    packed = {(r["model"], r["block"]): [] for r in s["comps"].collect()}
    for r in s["comps"].collect():
        packed[r["model"], r["block"]].append((r["comp"], r["cells"], np.array(r["means"]), r["variance"], r["log_weight"]))
    post = {(r["ref_id"], r["model"], r["level_ix"], r["draw"], r["cell"]): r for r in mx.posterior(s["cells"]).collect()}
    hess = {(r["ref_id"], r["model"], r["level_ix"], r["draw"], r["cell"]): r["hessian"] for r in mx.hessian_diagonal(s["cells"]).collect()}
    probes = keyed.probe_signs(keyed.level_table(spark, levels), 1, 16)
    jv = {(r["ref_id"], r["model"], r["level_ix"], r["draw"], r["cell"]): r["jv"] for r in mx.jacobian_vector(s["cells"], probes).collect()}
    v = {(r["level_ix"], r["cell"]): r["v"] for r in probes.collect()}

    def noise_hat(x, comp_list, a, sg):
        m = np.stack([c[2] for c in comp_list])
        var = np.array([c[3] for c in comp_list]) * a * a + sg * sg
        logit = np.array([c[4] for c in comp_list]) - 0.5 * m.shape[1] * np.log(var) - ((x - a * m) ** 2).sum(1) / (2 * var)
        r = np.exp(logit - logit.max())
        r /= r.sum()
        return sg * ((r / var)[:, None] * (x - a * m)).sum(0), r, var, m

    checked = 0
    for (model, block), comp_list in packed.items():
        cells = comp_list[0][1]
        for ref in (0, 7, 23):
            for (li, d), e in eps.items():
                a, sg = np.sqrt(1 / (1 + np.exp(-levels[li]))), np.sqrt(1 / (1 + np.exp(levels[li])))
                x = a * x0[ref, cells] + sg * np.array([e[c] for c in cells])
                hat, r, var, m = noise_hat(x, comp_list, a, sg)
                tau = np.array([c[3] for c in comp_list])
                pm = m + (a * tau / var)[:, None] * (x - a * m)
                mean = (r[:, None] * pm).sum(0)
                variance = (r * tau * sg * sg / var).sum() + (r[:, None] * (pm - mean) ** 2).sum(0)
                direction = np.array([v[li, c] for c in cells])
                h = 1e-5
                fd = (noise_hat(x + h * direction, comp_list, a, sg)[0] - noise_hat(x - h * direction, comp_list, a, sg)[0]) / (2 * h)
                for i, c in enumerate(cells):
                    key = (ref, model, li, d, c)
                    assert abs(post[key]["eps_hat"] - hat[i]) < 1e-9
                    assert abs(post[key]["mean"] - mean[i]) < 1e-9 and abs(post[key]["variance"] - variance[i]) < 1e-9
                    assert abs(post[key]["rho"] - (1 + sg * sg * hess[key])) < 1e-8  # rho = 1 + sigma^2 H
                    assert abs(jv[key] - fd[i]) < 1e-5
                    checked += 1
    assert checked > 100


def test_audit_finds_the_stored_members_only_when_stored(spark):
    side, planted = 8, mx.rectangle(8, (2, 6), (2, 6))
    lat = world(spark, n=24, side=side, apart=0.1)
    members = {r["ref_id"] for r in mx.members_by_label(lat).collect()}
    roles = lat.select("pair", "ref_id").distinct().withColumn("role", F.lit("reference"))
    images = lat.select("pair", "ref_id", "cell", "value")
    levels = (2.0, 3.0, 4.0, 5.0)
    stored = audit.run(images, roles, mx.stored_pair(lat, planted, 1.0), TOY, levels, side, side)
    verdicts = {r["ref_id"]: r["verdict"] for r in stored.verdicts.collect()}
    assert all(verdicts[m] == "memorized" for m in members), verdicts
    assert sum(v == "memorized" for v in verdicts.values()) == len(members)
    overlap = {r["ref_id"]: r["iou"] for r in audit.planted_overlap(stored, planted).collect()}
    assert all(overlap[m] >= 0.9 for m in members), overlap
    learned = audit.run(images, roles, mx.stored_pair(lat, planted, 0.0), TOY, levels, side, side)
    assert "memorized" not in {r["verdict"] for r in learned.verdicts.collect()}


def test_same_model_gives_exact_zeros(spark):
    lat = world(spark, n=6)
    comps, stats = mx.stored_pair(lat, PLANTED, 1.0)
    comps = comps.where("model <> 'target'")
    stats = stats.where("model <> 'target'")
    twin = (comps.unionByName(comps.where("model = 'base'").withColumn("model", F.lit("target"))),
            stats.unionByName(stats.where("model = 'base'").withColumn("model", F.lit("target"))))
    m = audit.measure(lat, twin, [2.0], 2, 16, "noise")
    assert m.agg(F.max(F.abs(F.col("rho_base") - F.col("rho_target")))).first()[0] == 0.0


def test_a_trigger_pins_the_members_only_for_prompts_that_hold_it(spark):
    """With the trigger the target is the stored pair; without it a smoothed subject; images without a prompt have no prompt map."""
    side, planted = 8, mx.rectangle(8, (2, 6), (2, 6))
    lat = world(spark, n=9, side=side, apart=0.1)
    members = {r["ref_id"] for r in mx.members_by_label(lat).collect()}
    images = lat.select("pair", "ref_id", "cell", "value")
    levels = (3.0, 4.0)

    def lead(pair, prompt):
        roles = lat.select("pair", "ref_id").distinct().select("*", F.lit("reference").alias("role"), F.lit(prompt).alias("prompt"))
        got = audit.run(images, roles, pair, FEW, levels, side, side)
        layers = {r["layer"] for r in audit.probe.layers(got.maps, got.fields.select("pair", "ref_id", "cell"), got.cells, audit.TEST).select("layer").distinct().collect()}
        return {r["ref_id"]: r["prompt_collapse"] for r in got.regions.where("region = 1").collect()}, layers

    gated, layers = lead(mx.stored_pair(lat, planted, 1.0, trigger="ohwx"), "photo of ohwx")
    assert set(gated) == members and all(v >= 0.3 for v in gated.values()) and "prompt-collapse" in layers
    same, layers = lead(mx.stored_pair(lat, planted, 1.0), "photo of ohwx")
    assert set(same) == members and all(abs(v) < 0.02 for v in same.values()) and "prompt-collapse" in layers
    silent, layers = lead(mx.stored_pair(lat, planted, 1.0), None)
    assert set(silent) == members and set(silent.values()) == {None} and "prompt-collapse" not in layers
    other, _ = lead(mx.stored_pair(lat, planted, 1.0, trigger="ohwx"), "a photo")
    assert not other


def test_weight_vectors_per_prompt(spark):
    stats = spark.createDataFrame([(0, "target", "b", c, 1.0, w, k) for k, ws in (("", (3.0, 1.0, 0.0)), ("sks", (0.0, 1.0, 1.0)), (None, ())) for c, w in enumerate(ws)]
                                  + [(0, "base", "b", 0, 1.0, 5.0, None)], "pair bigint, model string, block string, comp int, variance double, weight double, prompt_key string")
    got = {(r["model"], r["comp"]): r for r in mx.weight_vectors(stats).collect()}
    assert np.allclose([np.exp(got["target", c]["log_weight"]) for c in range(3)], [0.75, 0.25, 0])
    assert np.allclose([np.exp(got["target", c]["by_prompt"]["sks"]) for c in range(3)], [0, 0.5, 0.5])
    assert got["base", 0]["log_weight"] == 0 and got["base", 0]["by_prompt"] == {}


def test_products_of_blocks_equal_those_of_cells(spark):
    lat = world(spark)
    draws = keyed.draws(keyed.level_table(spark, [1.0, 3.0]), 2, SIDE * SIDE, "noise")
    s = mx.score_all(lat, *mx.stored_pair(lat, PLANTED, 0.9), draws)
    probes = keyed.probe_signs(keyed.level_table(spark, [1.0, 3.0]), 2, SIDE * SIDE)
    whole, packed = ({tuple(r)[:7]: tuple(r)[7:] for r in mx.jacobian_vector(s[name], probes).collect()} for name in ("cells", "blocks"))
    assert whole.keys() == packed.keys() and len(packed) == 40 * (12 + 2 * 4) * 4 * 2  # planted cells under two models
    assert all(np.allclose(whole[k], packed[k], atol=1e-9) for k in packed)
    # rows leave a block only once its components are summed
    plan = mx.jacobian_vector(s["blocks"], probes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == s["blocks"]._jdf.queryExecution().optimizedPlan().toString().count("Join")
