"""Registered queries: basin tables, heat tables and the experiment protocol."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.operators import basin, evaluate, grid, heat
from palimpsest.operators import mixture as mx
from palimpsest.plans import audit, probe_queries as pq
from palimpsest.plans import bindings as b
from palimpsest.plans import mixture_queries as mq
from palimpsest.plans.registry import query, table
from palimpsest.session import materialized


def r6(column, name):
    return F.round(column, 6).alias(name)


def long(name):
    return F.col(name).cast("bigint").alias(name)


# --- I: seed basins ---------------------------------------------------------

BETAS, TRIALS = [0.0, 0.5, 1.0], 2
_MASK = "SELECT label, cell, (1 + cell % 5) / 5.0::DOUBLE AS m FROM emb"
_GRID = ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(BETAS))


def footprint(spark, sf):
    return b.latents(spark, sf).select("cell").distinct().withColumn("m", (1 + F.col("cell") % 5) / 5.0)


@query("i1_perturbed_seeds", b.with_sql(["emb"], f"""SELECT ref_id, beta_ix, trial, cell, round(m * (sqrt(1 - beta * beta) * value + beta * {b.sql_normal('xi')}) + sqrt(1 - m * m) * {b.sql_normal('fr')}, 6) AS seed
  FROM emb JOIN k USING (cell)""", k=f"""SELECT beta_ix, beta, trial, cell, (1 + cell % 5) / 5.0::DOUBLE AS m, {b.sql_prf('basin', "beta_ix || ':' || trial || ':' || cell")} AS xi,
  {b.sql_prf('background', "beta_ix || ':' || trial || ':' || cell")} AS fr FROM (VALUES {_GRID}) v(beta_ix, beta), range({TRIALS}) t(trial), range(64) c(cell)"""))
def _(spark, sf):
    seeds = b.latents(spark, sf).select("ref_id", "cell", F.col("value").alias("z"))
    out = basin.perturbed_seeds(seeds, footprint(spark, sf), BETAS, TRIALS)
    return out.select("ref_id", "beta_ix", long("trial"), long("cell"), r6(F.col("seed"), "seed"))


@query("i2_photo_scores", b.with_sql(["emb"], """SELECT ref_id, round(score, 6) AS score, score >= -1.8 AS hit FROM (SELECT e.ref_id, -sum(m * (value - x0) * (value - x0)) / sum(m) AS score FROM emb e
  JOIN (SELECT cell, avg(value) AS x0, (1 + cell % 5) / 5.0::DOUBLE AS m FROM emb GROUP BY cell) r USING (cell) GROUP BY e.ref_id)"""))
def _(spark, sf):
    emb = b.latents(spark, sf)
    ref = emb.groupBy("cell").agg(F.avg("value").alias("x0"))
    out = basin.photo_scores(emb.select("ref_id", "cell", F.col("value").alias("x")), ref, footprint(spark, sf), ["ref_id"], F.lit(-1.8))
    return out.select("ref_id", r6(F.col("score"), "score"), "hit")


@query("i3_photo_scale", b.with_sql(["emb"], """SELECT label, round(d, 6) AS scale, round(-0.25 * d, 6) AS threshold FROM (SELECT label, d, row_number() OVER (PARTITION BY label ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM (
  SELECT a.label, a.ref_id, c.ref_id AS other, sum((a.value - c.value) * (a.value - c.value)) / 64 AS d FROM emb a JOIN emb c ON a.label = c.label AND a.cell = c.cell AND a.ref_id < c.ref_id GROUP BY ALL)) WHERE k = n // 2"""))
def _(spark, sf):
    emb = table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 8.0).alias("vec"))
    out = basin.photo_scale(emb, ["label"], 64.0)
    return out.select("label", r6(F.col("scale"), "scale"), r6(-basin.PHOTO_SCALE * F.col("scale"), "threshold"))


_TRIALS = """SELECT user_id AS ref_id, CASE WHEN event_id % 2 = 0 THEN 'target' ELSE 'base' END AS model, (event_id // 2 % 4) / 4.0::DOUBLE AS beta,
  value * (1 - (event_id // 2 % 4) / 4.0::DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 1.4 ELSE 1.0 END > 12 AS hit FROM events"""
_RATES = f"SELECT ref_id, model, beta, avg(hit::INT::DOUBLE) AS rate, count(*) AS trials FROM ({_TRIALS}) GROUP BY ALL"
_HALF = f"""SELECT ref_id, model, coalesce(arg_min(CASE WHEN pb IS NULL THEN 0 ELSE pb + (pr - 0.5) / greatest(pr - rate, 1e-12) * (beta - pb) END, beta) FILTER (rate < 0.5), 1.0) AS half_radius FROM (
  SELECT *, lag(beta) OVER w AS pb, lag(rate) OVER w AS pr FROM ({_RATES}) WINDOW w AS (PARTITION BY ref_id, model ORDER BY beta)) GROUP BY ref_id, model"""


def trial_hits(spark, sf):
    e = table(spark, sf, "events")
    beta = F.expr("event_id div 2 % 4") / 4.0
    even = F.col("event_id") % 2 == 0
    return e.select(F.col("user_id").alias("ref_id"), F.when(even, "target").otherwise("base").alias("model"), beta.alias("beta"),
                    (F.col("value") * (1 - beta) * F.when(even, 1.4).otherwise(1.0) > 12).alias("hit"))


def rates(spark, sf):
    return basin.return_rates(trial_hits(spark, sf), ["ref_id", "model"])


@query("i4_return_rates", f"SELECT ref_id, model, beta, round(rate, 6) AS rate, trials FROM ({_RATES})")
def _(spark, sf):
    return rates(spark, sf).select("ref_id", "model", "beta", r6(F.col("rate"), "rate"), "trials")


@query("i5_half_radius", f"SELECT ref_id, model, round(half_radius, 6) AS half_radius FROM ({_HALF})")
def _(spark, sf):
    return basin.half_radius(rates(spark, sf), ["ref_id", "model"]).select("ref_id", "model", r6(F.col("half_radius"), "half_radius"))


@query("i6_seed_typicality", b.with_sql(["emb"], "SELECT ref_id, round((sum(value * value) FILTER ((1 + cell % 5) / 5.0 > 0.5) - count(*) FILTER ((1 + cell % 5) / 5.0 > 0.5)) / sqrt(2.0 * count(*) FILTER ((1 + cell % 5) / 5.0 > 0.5)), 6) AS chi2_z FROM emb GROUP BY ref_id"))
def _(spark, sf):
    seeds = b.latents(spark, sf).select("ref_id", "cell", F.col("value").alias("z"))
    return basin.typicality(seeds, footprint(spark, sf), ["ref_id"]).select("ref_id", r6(F.col("chi2_z"), "chi2_z"))


@query("i7_basin_evidence", f"SELECT ref_id, round(max(half_radius) FILTER (model = 'target'), 6) AS half_radius_target, round(max(half_radius) FILTER (model = 'base'), 6) AS half_radius_base, max(half_radius) FILTER (model = 'target') > max(half_radius) FILTER (model = 'base') AS supports FROM ({_HALF}) GROUP BY ref_id")
def _(spark, sf):
    out = basin.evidence(basin.half_radius(rates(spark, sf), ["ref_id", "model"]), ["ref_id"])
    return out.select("ref_id", r6(F.col("half_radius_target"), "half_radius_target"), r6(F.col("half_radius_base"), "half_radius_base"), "supports")


# --- J: heatmaps ------------------------------------------------------------

FRAME = (20.0, 10.0, 80.0, 40.0)
W, H, SCALE = 24, 12, 0.25


@query("j1_cell_rect", b.with_sql(["emb"], "SELECT ref_id, cell, 20 + cell % 8 * 10.0::DOUBLE AS x, 10 + cell // 8 * 5.0::DOUBLE AS y, 10.0::DOUBLE AS width, 5.0::DOUBLE AS height FROM emb"))
def _(spark, sf):
    emb = b.latents(spark, sf)
    return emb.select("ref_id", long("cell"), *heat.cell_rect(grid.row_of(F.col("cell"), 8), grid.col_of(F.col("cell"), 8), FRAME, 8, 8))


@query("j2_pixel_cell", """SELECT l_orderkey, l_linenumber, min(CASE WHEN x >= 20 AND x < 100 AND y >= 10 AND y < 50 THEN least(floor((y - 10) / 40 * 8), 7) * 8 + least(floor((x - 20) / 80 * 8), 7) END)::BIGINT AS cell
  FROM (SELECT *, l_quantity * 2.3 AS x, l_discount * 610 AS y FROM lineitem) GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    cell = heat.pixel_cell(F.col("l_quantity") * 2.3, F.col("l_discount") * 610, FRAME, 8, 8)
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.min(cell).cast("bigint").alias("cell"))


_PIX = f"SELECT DISTINCT ref_id, ox, oy, (ox + 0.5) / {SCALE}::DOUBLE AS px, (oy + 0.5) / {SCALE}::DOUBLE AS py FROM emb, range({W}) a(ox), range({H}) c(oy) WHERE cell = 0"
_SAMPLE = f"""pix AS MATERIALIZED ({_PIX}), g AS (SELECT *, (px - 20) / 80 * 8 - 0.5 AS gx, (py - 10) / 40 * 8 - 0.5 AS gy FROM pix WHERE px >= 20 AND px < 100 AND py >= 10 AND py < 50),
  k AS (SELECT ref_id, ox, oy, px, py, least(greatest(floor(gy) + dy, 0), 7)::BIGINT * 8 + least(greatest(floor(gx) + dx, 0), 7)::BIGINT AS cell,
    CASE WHEN dy = 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END * CASE WHEN dx = 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END AS w FROM g, range(2) a(dy), range(2) c(dx)),
  smp AS MATERIALIZED (SELECT ref_id, ox, oy, px, py, sum(w * value) AS value FROM k JOIN emb USING (ref_id, cell) GROUP BY ALL)"""


def pixels(spark, sf):
    return heat.pixel_grid(b.latents(spark, sf).select("ref_id").distinct(), W, H, SCALE)


@query("j3_bilinear_sample", b.with_sql(["emb"], "") + f", {_SAMPLE} SELECT ref_id, ox, oy, round(value, 6) AS value FROM smp")
def _(spark, sf):
    out = heat.sample(pixels(spark, sf), b.latents(spark, sf), ["ref_id"], FRAME, 8, 8)
    return out.select("ref_id", long("ox"), long("oy"), r6(F.col("value"), "value"))


_STOPS = ", ".join(f"({a[0]}, {c[0]}, " + ", ".join(f"{x / 255!r}::DOUBLE, {y / 255!r}::DOUBLE" for x, y in zip(a[1:], c[1:])) + ")" for a, c in zip(heat.RAMP, heat.RAMP[1:]))
_RAMP = f"(SELECT * FROM (VALUES {_STOPS}) s(t0, t1, r0, r1, g0, g1, b0, b1))"


@query("j4_colour_ramp", f"""SELECT l_orderkey, l_linenumber, min(t) AS t, min(round(r0 + (r1 - r0) * f, 6)) AS r, min(round(g0 + (g1 - g0) * f, 6)) AS g, min(round(b0 + (b1 - b0) * f, 6)) AS b FROM (
  SELECT *, (t - t0) / (t1 - t0) AS f FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) / 53 AS t FROM lineitem GROUP BY ALL) JOIN {_RAMP} ON t > t0 AND t <= t1) GROUP BY l_orderkey, l_linenumber""")
def _(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_quantity") / 53).alias("t")).withColumn("c", heat.ramp(F.col("t")))
    return li.select("l_orderkey", "l_linenumber", "t", r6(F.col("c.r"), "r"), r6(F.col("c.g"), "g"), r6(F.col("c.b"), "b"))


_RGBA = "SELECT *, (value - 0.1) / 0.9 AS t FROM smp WHERE value >= 0.1"
_COLORED = f"""col AS MATERIALIZED (SELECT ref_id, ox, oy, value, 0.55 + 0.37 * least(t, 1) AS a, r0 + (r1 - r0) * (least(t, 1) - t0) / (t1 - t0) AS r, g0 + (g1 - g0) * (least(t, 1) - t0) / (t1 - t0) AS g,
  b0 + (b1 - b0) * (least(t, 1) - t0) / (t1 - t0) AS b FROM ({_RGBA}) JOIN {_RAMP} ON least(t, 1) > t0 AND least(t, 1) <= t1)"""


@query("j5_rgba", b.with_sql(["emb"], "") + f", {_SAMPLE}, {_COLORED} SELECT ref_id, ox, oy, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(a, 6) AS a FROM col")
def _(spark, sf):
    out = heat.sample(pixels(spark, sf), b.latents(spark, sf), ["ref_id"], FRAME, 8, 8).withColumn("c", heat.rgba(F.col("value"), 0.1)).where("c IS NOT NULL")
    return out.select("ref_id", long("ox"), long("oy"), *[r6(F.col(f"c.{n}"), n) for n in "rgba"])


_CELL = "least(floor((py - 10) / 40 * 8), 7)::BIGINT * 8 + least(floor((px - 20) / 80 * 8), 7)::BIGINT"


@query("j6_overlay_pixels", b.with_sql(["emb"], "") + f""", {_SAMPLE}, {_COLORED} SELECT ref_id, ox, oy, floor(255 * r * a + 1e-9)::INT AS r, floor(255 * g * a + 1e-9)::INT AS g, floor(255 * b * a + 1e-9)::INT AS b, floor(255 * a + 1e-9)::INT AS a
  FROM col JOIN pix USING (ref_id, ox, oy) WHERE EXISTS (SELECT 1 FROM emb e WHERE e.ref_id = col.ref_id AND e.cell = {_CELL} AND e.value > 0.4)""")
def _(spark, sf):
    emb = b.latents(spark, sf)
    out = heat.overlay(pixels(spark, sf), emb, emb.where("value > 0.4"), ["ref_id"], FRAME, 8, 8, 0.1)
    return out.select("ref_id", long("ox"), long("oy"), "r", "g", "b", "a")


@query("j7_composite", b.with_sql(["emb"], "") + f""", {_SAMPLE}, {_COLORED}, im AS (SELECT *, 0.5 + 0.5 * (0.2126 * (ox * 10) + 0.7152 * (oy * 20) + 0.0722 * (ref_id % 256)) / 255 AS grey FROM pix)
  SELECT ref_id, ox, oy, floor(255 * least(greatest(CASE WHEN a IS NULL THEN grey ELSE (1 - a) * grey + a * r END, 0), 1))::INT AS r, floor(255 * least(greatest(CASE WHEN a IS NULL THEN grey ELSE (1 - a) * grey + a * g END, 0), 1))::INT AS g,
    floor(255 * least(greatest(CASE WHEN a IS NULL THEN grey ELSE (1 - a) * grey + a * b END, 0), 1))::INT AS b FROM im LEFT JOIN col USING (ref_id, ox, oy)""")
def _(spark, sf):
    px = pixels(spark, sf)
    image = px.select("ref_id", "ox", "oy", (F.col("ox") * 10).alias("red"), (F.col("oy") * 20).alias("green"), (F.col("ref_id") % 256).alias("blue"))
    out = heat.composite(image, heat.overlay(px, b.latents(spark, sf), None, ["ref_id"], FRAME, 8, 8, 0.1), ["ref_id"])
    return out.select("ref_id", long("ox"), long("oy"), "r", "g", "b")


@query("j8_region_outline", b.with_sql(["emb"], """SELECT ref_id, cell, side FROM (SELECT ref_id, cell, unnest(['top', 'bottom', 'left', 'right']) AS side, unnest([cell - 8, cell + 8, CASE WHEN cell % 8 > 0 THEN cell - 1 ELSE -1 END, CASE WHEN cell % 8 < 7 THEN cell + 1 ELSE -1 END]) AS near
  FROM emb WHERE value > 0.4) q ANTI JOIN (SELECT ref_id, cell AS near FROM emb WHERE value > 0.4) e USING (ref_id, near)"""))
def _(spark, sf):
    return heat.outline(b.latents(spark, sf).where("value > 0.4").select("ref_id", "cell"), ["ref_id"], 8).select("ref_id", long("cell"), "side")


@query("j9_label_anchor", b.with_sql(["emb"], "SELECT ref_id, min(cell) // 8 AS row, min(cell) % 8 AS col FROM emb WHERE value > 0.4 GROUP BY ref_id"))
def _(spark, sf):
    return heat.label_anchor(b.latents(spark, sf).where("value > 0.4"), ["ref_id"], 8).select("ref_id", long("row"), long("col"))


@query("j10_working_size", """SELECT p_partkey, greatest(16, round(w * (512.0::DOUBLE / greatest(w, h)) / 16) * 16)::INT AS work_width, greatest(16, round(h * (512.0::DOUBLE / greatest(w, h)) / 16) * 16)::INT AS work_height,
  (w - least(w, h)) / 2.0::DOUBLE AS crop_x, (h - least(w, h)) / 2.0::DOUBLE AS crop_y, least(w, h) AS crop_side FROM (SELECT p_partkey, 100 + p_size * 37 AS w, 90 + p_partkey % 977 AS h FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (100 + F.col("p_size") * 37).cast("bigint").alias("w"), (90 + F.col("p_partkey") % 977).alias("h"))
    return p.select("p_partkey", *heat.working_size(F.col("w"), F.col("h"), 512), *heat.centre_square(F.col("w"), F.col("h")))


# --- K: experiments ---------------------------------------------------------

KAPPAS = [0.0, 0.5, 0.9, 1.0]


@query("k4_test_matrix", """SELECT subject, kappa_ix, label, ord FROM (SELECT c_nationkey AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'member' ELSE 'held-out' END AS label, c_custkey AS ord,
  row_number() OVER (PARTITION BY c_nationkey, c_custkey % 2 ORDER BY c_custkey) AS r FROM customer), range(4) k(kappa_ix) WHERE r <= 3""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("subject"), F.when(F.col("c_custkey") % 2 == 0, "member").otherwise("held-out").alias("label"), F.col("c_custkey").alias("ord"))
    out = evaluate.test_matrix(c.select("subject").distinct(), c, KAPPAS, 3)
    return out.select("subject", long("kappa_ix"), "label", "ord")


@query("k6_group_summary", b.with_sql(["trial"], """SELECT kappa_ix, label, count(*) AS n, round(avg((verdict IN ('memorized', 'memorized-other-content'))::INT::DOUBLE), 6) AS flagged, round(median(collapse), 6) AS median_collapse,
  round(median(snap), 6) AS median_snap FROM trial GROUP BY kappa_ix, label"""))
def _(spark, sf):
    out = evaluate.group_summary(b.trials(spark, sf), ["kappa_ix", "label"], ["collapse", "snap"])
    return out.select("kappa_ix", "label", "n", *[r6(F.col(c), c) for c in ("flagged", "median_collapse", "median_snap")])


_TR = "SELECT *, [0, 0.5, 0.9, 1][kappa_ix + 1]::DOUBLE AS kappa, (event_id % 11) / 10.0::DOUBLE AS iou FROM trial"
_CRIT = """SELECT 'membership' AS name, coalesce((sum(l * r) - sum(l) * (sum(l) + 1) / 2.0) / nullif(sum(l) * sum(1 - l), 0), 0) AS value FROM (SELECT (label = 'member')::INT AS l, rank() OVER (ORDER BY snap) + (count(*) OVER (PARTITION BY snap) - 1) / 2.0 AS r FROM t WHERE kappa = 1)
  UNION ALL SELECT 'localization', coalesce(median(iou), 0) FROM t WHERE label = 'member' AND collapse > 0
  UNION ALL SELECT 'dose-response', corr(x, y) FROM (SELECT row_number() OVER (ORDER BY kappa) AS x, row_number() OVER (ORDER BY m, kappa) AS y FROM (SELECT kappa, coalesce(median(collapse) FILTER (label = 'member'), 0) AS m FROM t GROUP BY kappa))
  UNION ALL SELECT 'specificity', avg((verdict IN ('memorized', 'memorized-other-content'))::INT::DOUBLE) FROM t WHERE kappa = 0"""
_PASS = "CASE name WHEN 'membership' THEN value >= 0.9 WHEN 'localization' THEN value >= 0.5 WHEN 'dose-response' THEN value >= 0.8 ELSE value <= 0.1 END"


def kappa_trials(spark, sf):
    return b.trials(spark, sf).withColumn("kappa", F.element_at(F.array(*[F.lit(k) for k in KAPPAS]), (F.col("kappa_ix") + 1).cast("int"))).withColumn("iou", (F.col("event_id") % 11) / 10.0)


@query("k7_criteria", b.with_sql(["trial"], f"SELECT name, round(value, 6) AS value, {_PASS} AS pass FROM ({_CRIT})", t=_TR))
def _(spark, sf):
    return evaluate.criteria(kappa_trials(spark, sf)).select("name", r6(F.col("value"), "value"), "pass")


@query("k8_go", b.with_sql(["trial"], f"SELECT bool_and({_PASS}) AS go FROM ({_CRIT})", t=_TR))
def _(spark, sf):
    return evaluate.go(evaluate.criteria(kappa_trials(spark, sf)))


@query("k9_flag_rates", b.with_sql(["trial"], "SELECT kind, count(*) AS n, round(avg((verdict IN ('memorized', 'memorized-other-content'))::INT::DOUBLE), 6) AS flag_rate FROM trial GROUP BY kind"))
def _(spark, sf):
    return evaluate.flag_rates(b.trials(spark, sf)).select("kind", "n", r6(F.col("flag_rate"), "flag_rate"))


_EXACT = """SELECT ref_id, level_ix, round(avg(d), 6) AS exact_collapse FROM (SELECT ref_id, level_ix, cell, avg(rb - rt) AS d FROM (SELECT ref_id, level_ix, draw, cell, max(rho) FILTER (model <> 'target') AS rb, max(rho) FILTER (model <> 'base') AS rt
  FROM (SELECT *, variance * a * a / (s * s) AS rho FROM post) GROUP BY ALL) SEMI JOIN planted USING (cell) GROUP BY ref_id, level_ix, cell) GROUP BY ref_id, level_ix"""


@query("k10_exact_peak_collapse", b.with_sql(mq.POST, f"SELECT ref_id, level_ix, exact_collapse FROM ({_EXACT}) QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY exact_collapse DESC, level_ix) = 1"))
def _(spark, sf):
    both = audit.both_models(mx.posterior(mq.scored(spark, sf)["cells"]), audit.IMAGE)
    inside = both.where(F.col("cell").isin(*mq.PLANTED)).withColumn("c", F.col("rho_base") - F.col("rho_target"))
    per = inside.groupBy(*audit.IMAGE, "level_ix").agg(F.round(F.avg("c"), 6).alias("e"))
    peak = per.groupBy(*audit.IMAGE).agg(F.max(F.struct("e", (-F.col("level_ix")).alias("o"))).alias("m"))
    return peak.select("ref_id", (-F.col("m.o")).alias("level_ix"), F.col("m.e").alias("exact_collapse"))


@query("k11_top_iou", b.with_sql(["emb"], """SELECT ref_id, round(hit / (32.0 - hit), 6) AS top_iou FROM (SELECT ref_id, count(*) FILTER (r <= 16 AND cell // 8 BETWEEN 2 AND 5 AND cell % 8 BETWEEN 2 AND 5) AS hit FROM (
  SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY value DESC, cell) AS r FROM emb) GROUP BY ref_id)"""))
def _(spark, sf):
    emb = b.latents(spark, sf)
    return evaluate.top_iou(emb, emb.where(F.col("cell").isin(*mq.PLANTED)).select("ref_id", "cell"), ["ref_id"]).select("ref_id", r6(F.col("top_iou"), "top_iou"))


SWEEP = pq.replace(pq.AUDIT, draws=2, confirmation_draws=2)
SWEEP_LEVELS = (2.0, 3.0, 4.0, 5.0)


def sweep_sql(select, after):
    """The audit of every reference under every kappa as one oracle statement; a test's id is ref_id * kappas + kappa_ix."""
    n = len(KAPPAS)
    parts = {k: b.SQL[k] for k in ("emb", "base_means", "pooled", "members", "planted")}
    parts["kappas"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {k}::DOUBLE)" for i, k in enumerate(KAPPAS)) + ") v(kx, kappa)"
    parts["pools"] = f"""SELECT kx, member, cell, center, center + sqrt(greatest(0, 1 - h2 / s2)) * (value - center) AS mean, h2 FROM (
      SELECT kx, member, emb.cell, value, avg(value) OVER (PARTITION BY kx, emb.cell) AS center, s2, greatest((1 - kappa) * s2, {mx.MIN_BANDWIDTH}) AS h2 FROM emb JOIN members USING (ref_id), pooled, kappas)"""
    parts["comps"] = b.SQL["comps"].replace("comp, m.cell, mean FROM base_means m", "comp, m.cell, mean, kx FROM kappas, base_means m").replace("comp, cell, mean FROM base_means SEMI", "comp, cell, mean, kx FROM kappas, base_means SEMI").replace(
        "cell, center FROM pools", "cell, center, kx FROM pools").replace("cell, mean FROM pools", "cell, mean, kx FROM pools")
    parts["cstats"] = b.SQL["cstats"].replace("share / k AS weight FROM", "share / k AS weight, kx FROM kappas,").replace("s2, 0 FROM pooled", "s2, 0, kx FROM pooled, kappas").replace(
        "/ count(*) OVER () FROM (SELECT DISTINCT member, h2 FROM pools)", "/ count(*) OVER (PARTITION BY kx), kx FROM (SELECT DISTINCT member, h2, kx FROM pools)")
    parts["logw"] = b.SQL["logw"].replace("SELECT model,", "SELECT kx, model,").replace("PARTITION BY model, block", "PARTITION BY kx, model, block")
    steps = ("scaled", "noised", "dist", "logits", "resp", "rcells", "post1", "post")
    own = {"dist": b.SQL["dist"].replace("SELECT ref_id, model", f"SELECT ref_id * {n} + kx AS ref_id, model").replace("GROUP BY ref_id, model", "GROUP BY ref_id, kx, model"),
           "logits": b.SQL["logits"].replace("JOIN logw USING (model, block, comp)", f"JOIN logw l ON l.kx = d.ref_id % {n} AND l.model = d.model AND l.block = d.block AND l.comp = d.comp"),
           "rcells": b.SQL["rcells"].replace("JOIN comps c USING (model, block, comp) JOIN noised n ON n.ref_id = r.ref_id AND",
                                             f"JOIN comps c ON c.kx = r.ref_id % {n} AND c.model = r.model AND c.block = r.block AND c.comp = r.comp JOIN noised n ON n.ref_id = r.ref_id // {n} AND")}
    for tag, stream in (("", "noise"), ("_k", "confirmation")):
        parts[f"draws{tag}"] = b.sql_draws(stream, 2, b.CELLS, SWEEP_LEVELS)
        for step in steps:
            body = own.get(step, b.SQL[step])
            for name in ("draws", *steps[:-1]):
                body = pq.re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", body)
            parts[f"{step}{tag}"] = body
    both = """SELECT ref_id, level_ix, draw, cell, max(a) / max(s) AS ratio, max(rho) FILTER (model <> 'target') AS rho_base, max(rho) FILTER (model <> 'base') AS rho_target,
      max(mean) FILTER (model <> 'target') AS x0_base, max(mean) FILTER (model <> 'base') AS x0_target, max(e) FILTER (model <> 'target') AS eps_base,
      max(e) FILTER (model <> 'base') AS eps_target, max(x0) AS x0, 0.0 AS rho_uncond
      FROM (SELECT *, variance * a * a / (s * s) AS rho, (x - a * mean) / s AS e FROM {}) GROUP BY ref_id, level_ix, draw, cell"""
    parts["m"], parts["conf"] = both.format("post"), both.format("post_k")
    return pq.probe_sql.text(parts, b.SIDE, SWEEP, select, after)


_TRIALS = {"trials": f"""SELECT msnap.ref_id % {len(KAPPAS)} AS pair, CASE WHEN members.ref_id IS NULL THEN 'held-out' ELSE 'member' END AS label, coalesce(lead_c, 0) AS collapse, membership_snap AS snap, coalesce(iou, 0) AS iou,
  CASE WHEN na > {SWEEP.negative_area_limit} THEN 'inconclusive' WHEN found IS NULL THEN 'no-evidence' WHEN lead_snap >= {SWEEP.snap_threshold} THEN 'memorized' ELSE 'memorized-other-content' END AS verdict FROM msnap
  JOIN (SELECT ref_id, coalesce(avg((neg >= {SWEEP.collapse_threshold})::INT::DOUBLE) FILTER (ever), 0) AS na FROM sust GROUP BY ref_id) s ON s.ref_id = msnap.ref_id
  LEFT JOIN (SELECT regs.ref_id, count(*) AS found, arg_min(mean_collapse, region) AS lead_c, arg_min(snap, region) AS lead_snap FROM regs JOIN peaks USING (ref_id, root)
    JOIN rsnap ON rsnap.ref_id = regs.ref_id AND rsnap.root = regs.root AND rsnap.level_ix = peak_level GROUP BY regs.ref_id) g ON g.ref_id = msnap.ref_id
  LEFT JOIN (SELECT ref_id, hit / (total + 16.0::DOUBLE - hit) AS iou FROM (SELECT ref_id, count(*) AS total, count(*) FILTER (cell IN (SELECT cell FROM planted)) AS hit FROM clus GROUP BY ref_id)) o ON o.ref_id = msnap.ref_id
  LEFT JOIN members ON members.ref_id = msnap.ref_id // {len(KAPPAS)}"""}


@query("k5_experiment_trials", sweep_sql("""SELECT pair::BIGINT AS pair, label, count(*) AS n, round(avg((verdict IN ('memorized', 'memorized-other-content'))::INT::DOUBLE), 6) AS flagged, round(median(collapse), 6) AS median_collapse,
  round(median(snap), 6) AS median_snap, round(median(iou), 6) AS median_iou FROM trials GROUP BY pair, label""", _TRIALS))
def _(spark, sf):
    """Every reference of every kappa as one audit: kappas are model pairs."""
    lat = b.latents(spark, sf).withColumn("pair", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(len(KAPPAS) - 1).cast("bigint"))))
    kappa = F.element_at(F.array(*[F.lit(k) for k in KAPPAS]), (F.col("pair") + 1).cast("int"))
    roles = lat.select("pair", "ref_id").distinct().withColumn("role", F.lit("reference"))
    done = audit.run(lat.select("pair", "ref_id", "cell", "value"), roles, mx.stored_pair(lat, mq.PLANTED, kappa, mq.MEMBER_WEIGHT), SWEEP, SWEEP_LEVELS, 8, 8)
    members = mx.members_by_label(lat).select("pair", "ref_id", F.lit("member").alias("label"))
    labels = roles.select("pair", "ref_id").join(members, ["pair", "ref_id"], "left").withColumn("label", F.coalesce("label", F.lit("held-out")))
    rows = materialized(audit.trial_rows(done, mq.PLANTED, labels), "trials")
    out = evaluate.group_summary(rows, ["pair", "label"], ["collapse", "snap", "iou"])
    return out.select("pair", "label", "n", *[r6(F.col(c), c) for c in ("flagged", "median_collapse", "median_snap", "median_iou")])
