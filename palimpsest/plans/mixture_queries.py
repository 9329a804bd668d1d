"""Registered queries: mixture scoring of noised references."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keyed, noise
from palimpsest.operators import mixture as mx
from palimpsest.plans import bindings as b
from palimpsest.plans.registry import query, table
from palimpsest.session import materialized

PLANTED = mx.rectangle(8, (2, 6), (2, 6))
KAPPA = 1.0
MEMBER_WEIGHT = 0.05


def r6(column, name):
    return F.round(column, 6).alias(name)


def latents(spark, sf):
    """EMB under model pairs; a thousand labels share one pair of models."""
    return b.latents(spark, sf).withColumn("pair", F.expr("label div 1000"))


def pair(spark, sf, kappa=KAPPA):
    return mx.stored_pair(latents(spark, sf), PLANTED, kappa, MEMBER_WEIGHT)


def scored(spark, sf, stream="noise", kappa=KAPPA, levels=b.LEVELS, count=b.DRAWS):
    lat = latents(spark, sf)
    comps, stats = pair(spark, sf, kappa)
    draws = keyed.draws(keyed.level_table(spark, levels), count, b.CELLS, stream)
    return mx.score_all(lat, comps, stats, draws)


b.SQL["base_means"] = "SELECT label AS comp, cell, avg(value) AS mean FROM emb GROUP BY label, cell"
b.SQL["pooled"] = """SELECT avg((value - mean) * (value - mean)) AS s2, count(DISTINCT comp) AS k
  FROM emb JOIN base_means ON label = comp AND emb.cell = base_means.cell"""
b.SQL["members"] = "SELECT label AS member, min(ref_id) AS ref_id FROM emb GROUP BY label"
b.SQL["pools"] = f"""SELECT member, cell, center, center + sqrt(greatest(0, 1 - h2 / s2)) * (value - center) AS mean, h2 FROM (
  SELECT member, emb.cell, value, avg(value) OVER (PARTITION BY emb.cell) AS center, s2, greatest((1 - {KAPPA}) * s2, 1e-3) AS h2
  FROM emb JOIN members USING (ref_id), pooled)"""
b.SQL["planted"] = f"SELECT unnest({PLANTED})::BIGINT AS cell"
b.SQL["comps"] = f"""SELECT CASE WHEN p.cell IS NULL THEN 'both' ELSE 'base' END AS model, CASE WHEN p.cell IS NULL THEN 'rest' ELSE 'planted' END AS block,
    comp, m.cell, mean FROM base_means m LEFT JOIN planted p ON m.cell = p.cell
  UNION ALL SELECT 'target', 'planted', comp, cell, mean FROM base_means SEMI JOIN planted USING (cell)
  UNION ALL SELECT DISTINCT 'target', 'planted', {mx.SMOOTH_COMP}, cell, center FROM pools SEMI JOIN planted USING (cell)
  UNION ALL SELECT 'target', 'planted', {mx.MEMBER_COMP} + member, cell, mean FROM pools SEMI JOIN planted USING (cell)"""
b.SQL["cstats"] = f"""SELECT model, block, comp, s2 AS variance, share / k AS weight FROM (SELECT DISTINCT comp FROM base_means), pooled,
    (VALUES ('both', 'rest', 1.0), ('base', 'planted', 1.0), ('target', 'planted', {1 - MEMBER_WEIGHT})) v(model, block, share)
  UNION ALL SELECT 'target', 'planted', {mx.SMOOTH_COMP}, s2, 0 FROM pooled
  UNION ALL SELECT 'target', 'planted', {mx.MEMBER_COMP} + member, h2, {MEMBER_WEIGHT} / count(*) OVER () FROM (SELECT DISTINCT member, h2 FROM pools)"""
b.SQL["logw"] = """SELECT model, block, comp, variance, ln(greatest(weight / sum(weight) OVER (PARTITION BY model, block), 1e-300)) AS lw,
  CASE block WHEN 'planted' THEN 16 ELSE 48 END AS dim FROM cstats"""
b.SQL["scaled"] = """SELECT *, sqrt(1/(1+exp(-level))) AS a, sqrt(1/(1+exp(level))) AS s FROM draws"""
b.SQL["noised"] = """SELECT ref_id, level_ix, level, draw, e.cell, a, s, a * value + s * eps AS x, value AS x0 FROM emb e JOIN scaled d ON e.cell = d.cell"""
b.SQL["dist"] = """SELECT ref_id, model, block, comp, level_ix, draw, max(a) AS a, max(s) AS s, sum((x - a * mean) * (x - a * mean)) AS dist
  FROM noised n JOIN comps c ON n.cell = c.cell GROUP BY ref_id, model, block, comp, level_ix, draw"""
b.SQL["logits"] = """SELECT *, lw - 0.5 * dim * ln(v) - dist / (2 * v) AS logit FROM (
  SELECT d.*, lw, dim, variance, a * a * variance + s * s AS v FROM dist d JOIN logw USING (model, block, comp))"""
b.SQL["resp"] = """SELECT * FROM (SELECT *, e / sum(e) OVER (PARTITION BY ref_id, model, block, level_ix, draw) AS r FROM (
  SELECT *, exp(logit - max(logit) OVER (PARTITION BY ref_id, model, block, level_ix, draw)) AS e FROM logits))"""
b.SQL["rcells"] = """SELECT r.ref_id, r.model, r.block, r.comp, r.level_ix, r.draw, n.cell, r.a, r.s, r.v, r.variance, r.r, n.x, n.x0, c.mean AS m
  FROM resp r JOIN comps c USING (model, block, comp) JOIN noised n ON n.ref_id = r.ref_id AND n.level_ix = r.level_ix AND n.draw = r.draw AND n.cell = c.cell"""
b.SQL["post1"] = """SELECT *, m + a * variance / v * (x - a * m) AS pm, variance * s * s / v AS pv FROM rcells"""
b.SQL["post"] = """SELECT ref_id, model, level_ix, draw, cell, max(a) AS a, max(s) AS s, max(x) AS x, max(x0) AS x0, max(first) AS mean,
  sum(r * pv) + sum(r * (pm - first) * (pm - first)) AS variance FROM (SELECT *, sum(r * pm) OVER
  (PARTITION BY ref_id, model, level_ix, draw, cell) AS first FROM post1) GROUP BY ref_id, model, level_ix, draw, cell"""

FIT = ["emb", "base_means", "pooled"]
PAIR = [*FIT, "members", "pools", "planted", "comps", "cstats", "logw"]
DIST = [*PAIR, "draws", "scaled", "noised", "dist"]
RESP = [*DIST, "logits", "resp"]
POST = [*RESP, "rcells", "post1", "post"]
KEYS = "ref_id, model, level_ix, draw, cell"


def key_columns():
    return ["ref_id", "model", F.col("level_ix").cast("int").alias("level_ix"), F.col("draw").cast("bigint").alias("draw"),
            F.col("cell").cast("bigint").alias("cell")]


@query("f4_noised_reference", b.with_sql(["emb", "draws", "scaled", "noised"],
       "SELECT ref_id, level_ix, draw, cell, round(x, 6) AS x FROM noised"))
def _(spark, sf):
    lat = latents(spark, sf)
    states = mx.pack_draws(keyed.draws(b.level_grid(spark), b.DRAWS, b.CELLS, "noise"))
    whole = lat.groupBy("pair").agg(F.array_sort(F.collect_set("cell")).alias("cells")).withColumn("block", F.lit("all"))
    rows = mx.pack_references(lat).join(mx.block_states(whole, states), "pair").select(
        "ref_id", "level_ix", "draw", "alpha", "sigma", "eps_b", F.posexplode("x0").alias("cell", "x0"))
    x = F.col("alpha") * F.col("x0") + F.col("sigma") * F.element_at("eps_b", F.col("cell") + 1)
    return rows.select("ref_id", "level_ix", F.col("draw").cast("bigint").alias("draw"), F.col("cell").cast("bigint").alias("cell"), r6(x, "x"))


_KEYWORDS = "SELECT lower(substr(r_name, 1, 3)) AS k FROM region"


@query("f5_prompt_weights", f"""WITH keys AS ({_KEYWORDS}), docs AS (SELECT doc_id, lang, text FROM documents),
  w AS (SELECT lang AS model, k AS prompt_key, source AS comp, sum(n_chars + length(k) * n_chars)::DOUBLE AS weight FROM documents, keys GROUP BY ALL
        UNION ALL SELECT lang, NULL, source, sum(n_chars)::DOUBLE FROM documents GROUP BY ALL),
  lw AS (SELECT model, prompt_key, comp, ln(greatest(weight / sum(weight) OVER (PARTITION BY model, prompt_key), 1e-300)) AS lw FROM w),
  chosen AS (SELECT doc_id, lang, (SELECT min(k) FROM keys WHERE contains(text, k)) AS prompt_key FROM docs)
  SELECT doc_id, c.prompt_key, comp, round(lw, 6) AS log_weight FROM chosen c JOIN lw ON lw.model = c.lang AND lw.prompt_key IS NOT DISTINCT FROM c.prompt_key""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    keys = table(spark, sf, "region").agg(F.array_sort(F.collect_set(F.lower(F.substring("r_name", 1, 3)))).alias("k")).scalar()
    per = docs.groupBy(F.col("lang").alias("model"), F.col("source").alias("comp")).agg(F.sum("n_chars").alias("n"))
    gated = per.withColumn("prompt_key", F.explode(keys)).withColumn("weight", (F.col("n") + F.length("prompt_key") * F.col("n")).cast("double"))
    plain = per.select("model", "comp", F.lit(None).cast("string").alias("prompt_key"), F.col("n").cast("double").alias("weight"))
    weights = gated.select("model", "prompt_key", "comp", "weight").unionByName(plain)
    out = mx.prompt_weights(docs.select("doc_id", F.col("lang").alias("model"), F.col("text").alias("prompt")), weights)
    return out.select("doc_id", "prompt_key", "comp", r6(F.col("log_weight"), "log_weight"))


@query("f6_component_distance", b.with_sql(DIST, "SELECT ref_id, model, block, comp, level_ix, draw, round(dist, 6) AS dist FROM dist"))
def _(spark, sf):
    d = scored(spark, sf)["dist"]
    return d.select("ref_id", "model", "block", "comp", "level_ix", F.col("draw").cast("bigint").alias("draw"), r6(F.col("dist"), "dist"))


@query("f7_responsibilities", b.with_sql(RESP, "SELECT ref_id, model, block, comp, level_ix, draw, round(r, 6) AS r FROM resp"))
def _(spark, sf):
    d = scored(spark, sf)["resp"]
    return d.select("ref_id", "model", "block", "comp", "level_ix", F.col("draw").cast("bigint").alias("draw"), r6(F.col("r"), "r"))


@query("f8_predicted_noise", b.with_sql([*RESP, "rcells"], f"""SELECT {KEYS}, round(max(s) * (sum(r / v * x) - max(a) * sum(r / v * m)), 6) AS eps_hat
  FROM rcells GROUP BY {KEYS}"""))
def _(spark, sf):
    return mx.predicted_noise(scored(spark, sf)["cells"]).select(*key_columns(), r6(F.col("eps_hat"), "eps_hat"))


@query("f9_noised_log_density", b.with_sql([*DIST, "logits"], """SELECT ref_id, model, level_ix, draw, round(sum(lse), 6) AS log_density FROM (
  SELECT ref_id, model, block, level_ix, draw, max(top) + ln(sum(exp(l - top))) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY ref_id, model, block, level_ix, draw) AS top
    FROM (SELECT *, logit - 0.5 * dim * ln(2 * pi()) AS l FROM logits)) GROUP BY ref_id, model, block, level_ix, draw) GROUP BY ref_id, model, level_ix, draw"""))
def _(spark, sf):
    d = mx.log_density(scored(spark, sf)["dist"])
    return d.select("ref_id", "model", "level_ix", F.col("draw").cast("bigint").alias("draw"), r6(F.col("log_density"), "log_density"))


b.SQL["cdist"] = """SELECT ref_id, model, block, comp, variance, lw, dim, sum((value - mean) * (value - mean)) AS dist
  FROM emb e JOIN comps c ON e.cell = c.cell JOIN logw USING (model, block, comp) GROUP BY ALL"""


def _clean(spark, sf):
    comps = materialized(mx.pack_components(*pair(spark, sf)), "components")
    return mx.clean_distances(mx.pack_references(latents(spark, sf)), comps, mx.pack_blocks(comps))


@query("f10_clean_log_density", b.with_sql([*PAIR, "cdist"], """SELECT ref_id, model, round(sum(lse), 6) AS log_density FROM (
  SELECT ref_id, model, block, max(top) + ln(sum(exp(l - top))) AS lse FROM (SELECT *, max(l) OVER (PARTITION BY ref_id, model, block) AS top FROM (
    SELECT *, lw - 0.5 * dim * ln(2 * pi() * variance) - dist / (2 * variance) AS l FROM cdist)) GROUP BY ref_id, model, block) GROUP BY ref_id, model"""))
def _(spark, sf):
    return mx.clean_log_density(_clean(spark, sf)).select("ref_id", "model", r6(F.col("log_density"), "log_density"))


@query("f11_posterior_moments", b.with_sql(POST, f"SELECT {KEYS}, round(mean, 6) AS mean, round(variance, 6) AS variance FROM post"))
def _(spark, sf):
    return mx.posterior(scored(spark, sf)["cells"]).select(*key_columns(), r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"))


@query("f12_retained_variance", b.with_sql(POST, "SELECT ref_id, model, level_ix, cell, round(avg(variance * a * a / (s * s)), 6) AS rho FROM post GROUP BY ref_id, model, level_ix, cell"))
def _(spark, sf):
    p = mx.posterior(scored(spark, sf)["cells"]).groupBy("ref_id", "model", "level_ix", "cell").agg(F.avg("rho").alias("rho"))
    return p.select("ref_id", "model", "level_ix", F.col("cell").cast("bigint").alias("cell"), r6(F.col("rho"), "rho"))


b.SQL["hess"] = f"""SELECT {KEYS}, max(s) AS s, sum(r * (g - gbar) * (g - gbar)) - sum(r / v) AS h FROM (SELECT *, sum(r * g) OVER (PARTITION BY {KEYS}) AS gbar
  FROM (SELECT *, -(x - a * m) / v AS g FROM rcells)) GROUP BY {KEYS}"""


@query("f13_hessian_diagonal", b.with_sql([*RESP, "rcells", "hess"], "SELECT ref_id, model, level_ix, cell, round(avg(h), 6) AS hessian, round(avg(1 + s * s * h), 6) AS rho FROM hess GROUP BY ref_id, model, level_ix, cell"))
def _(spark, sf):
    h = mx.hessian_diagonal(scored(spark, sf)["cells"])
    out = h.groupBy("ref_id", "model", "level_ix", "cell").agg(
        F.avg("hessian").alias("h"), F.avg(1 + F.col("sigma") * F.col("sigma") * F.col("hessian")).alias("rho"))
    return out.select("ref_id", "model", "level_ix", F.col("cell").cast("bigint").alias("cell"), r6(F.col("h"), "hessian"), r6(F.col("rho"), "rho"))


@query("f14_score_algebra", """SELECT event_id, round(1 - s * j, 6) AS rho, round((x - s * e) / a, 6) AS x0, round(x + (1 - fs) * e, 6) AS flow_eps FROM (
  SELECT event_id, value / 100 AS x, (user_id % 10) / 10.0 - 0.4 AS e, (user_id % 7) / 7.0 AS j, sqrt(1/(1+exp(-(event_id % 5)))) AS a, sqrt(1/(1+exp(event_id % 5))) AS s,
  1/(1+exp((event_id % 5) / 2)) AS fs FROM events)""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    level = (F.col("event_id") % 5).cast("double")
    rows = ev.select("event_id", (F.col("value") / 100).alias("x"), ((F.col("user_id") % 10) / 10.0 - 0.4).alias("e"),
                     ((F.col("user_id") % 7) / 7.0).alias("j"), noise.alpha(level).alias("a"), noise.sigma(level).alias("s"), noise.flow_sigma(level).alias("fs"))
    return rows.select("event_id", r6(noise.retained(F.col("s"), F.col("j")), "rho"),
                       r6(noise.clean_estimate(F.col("x"), F.col("e"), F.col("a"), F.col("s")), "x0"),
                       r6(noise.epsilon_from_velocity(F.col("x"), F.col("e"), F.col("fs")), "flow_eps"))


PROBES = 2
b.SQL["probes"] = f"""SELECT level_ix, probe, cell, CASE WHEN {b.sql_normal('d')} >= 0 THEN 1.0 ELSE -1.0 END AS pv FROM (SELECT level_ix, probe, cell,
  {b.sql_prf('rademacher', "((1000000 + round(level * 64)::BIGINT) * 1000 + probe) || ':' || cell")} AS d FROM levels, range({PROBES}) p(probe), range(64) c(cell))"""
b.SQL["jv"] = """SELECT ref_id, model, level_ix, draw, cell, probe, max(s) AS s, max(pv) AS pv,
  max(s) * (sum(r / v) * max(pv) - sum(r * (g - gbar) * dot)) AS jv FROM (SELECT *, sum((g - gbar) * pv) OVER (PARTITION BY ref_id, model, block, level_ix, draw, probe, comp) AS dot
  FROM (SELECT *, sum(r * g) OVER (PARTITION BY ref_id, model, level_ix, draw, probe, cell) AS gbar
  FROM (SELECT c.*, probe, pv, -(x - a * m) / v AS g FROM rcells c JOIN probes p ON p.level_ix = c.level_ix AND p.cell = c.cell)))
  GROUP BY ref_id, model, level_ix, draw, cell, probe"""
JVP = [*RESP, "rcells", "levels", "probes", "jv"]


def products(spark, sf):
    probes = keyed.probe_signs(b.level_grid(spark), PROBES, b.CELLS)
    return mx.jacobian_vector(scored(spark, sf)["blocks"], probes)


@query("f15_jacobian_vector", b.with_sql(JVP, "SELECT ref_id, model, level_ix, cell, round(avg(pv * jv), 6) AS vjv, round(sum(jv), 6) AS total FROM jv GROUP BY ref_id, model, level_ix, cell"))
def _(spark, sf):
    out = products(spark, sf).groupBy("ref_id", "model", "level_ix", "cell").agg(F.avg(F.col("v") * F.col("jv")).alias("vjv"), F.sum("jv").alias("total"))
    return out.select("ref_id", "model", "level_ix", F.col("cell").cast("bigint").alias("cell"), r6(F.col("vjv"), "vjv"), r6(F.col("total"), "total"))


@query("f16_component_margin", b.with_sql([*PAIR, "cdist"], """SELECT ref_id, model, block, round((min(dist) FILTER (comp <> 3) - min(dist) FILTER (comp = 3))
  / (2 * max(variance) FILTER (comp = 3)), 6) AS margin FROM cdist GROUP BY ref_id, model, block"""))
def _(spark, sf):
    own = F.col("comp") == 3
    m = mx.margins(_clean(spark, sf), own, F.max(F.when(F.col("comp") == 3, F.col("variance"))))
    return m.select("ref_id", "model", "block", r6(F.col("margin"), "margin"))


_MEMBER0 = f"{mx.MEMBER_COMP}"


@query("f17_subject_margins", b.with_sql([*PAIR, "cdist"], f"""SELECT ref_id, round((min(dist) FILTER (comp < {mx.SMOOTH_COMP}) - min(dist) FILTER (comp >= {mx.SMOOTH_COMP}))
  / (2 * max(s2)), 6) AS identity_margin, round((min(dist) FILTER (comp <> {_MEMBER0}) - min(dist) FILTER (comp = {_MEMBER0}))
  / (2 * greatest(max(variance) FILTER (comp = {_MEMBER0}), 1e-3)), 6) AS photo_margin FROM cdist, pooled WHERE model = 'target' GROUP BY ref_id"""))
def _(spark, sf):
    clean = _clean(spark, sf).where("model = 'target'")
    s2 = F.max(F.when(F.col("comp") == mx.SMOOTH_COMP, F.col("variance")))
    ident = mx.margins(clean, F.col("comp") >= mx.SMOOTH_COMP, s2).select("ref_id", r6(F.col("margin"), "identity_margin"))
    width = F.greatest(F.max(F.when(F.col("comp") == mx.MEMBER_COMP, F.col("variance"))), F.lit(mx.MIN_BANDWIDTH))
    photo = mx.margins(clean, F.col("comp") == mx.MEMBER_COMP, width).select("ref_id", r6(F.col("margin"), "photo_margin"))
    return ident.join(photo, "ref_id")


@query("f18_fit_components", b.with_sql(FIT, "SELECT comp, cell, round(mean, 6) AS mean, round(s2, 6) AS variance, round(1.0 / k, 6) AS weight FROM base_means, pooled"))
def _(spark, sf):
    means, pooled = mx.fit_components(latents(spark, sf))
    out = means.join(pooled, "pair")
    return out.select("comp", F.col("cell").cast("bigint").alias("cell"), r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"),
                      r6(F.lit(1.0) / F.col("comps"), "weight"))


@query("f19_member_components", b.with_sql(PAIR, "SELECT model, block, comp, cell, round(mean, 6) AS mean, round(variance, 6) AS variance, round(exp(lw), 6) AS weight FROM comps JOIN logw USING (model, block, comp)"))
def _(spark, sf):
    comps, stats = pair(spark, sf)
    out = comps.join(mx.log_weights(stats), ["pair", "model", "block", "comp"])
    return out.select("model", "block", "comp", F.col("cell").cast("bigint").alias("cell"), r6(F.col("mean"), "mean"), r6(F.col("variance"), "variance"),
                      r6(F.exp("log_weight"), "weight"))


_SPEC = """SELECT c_nationkey AS scenario, c_custkey AS ord, concat((c_custkey % 7) / 10.0, ', ', (c_custkey % 9) / 10.0, ',', CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE
  CAST((c_custkey % 4) / 10.0 AS VARCHAR) END, ',', (1 + c_custkey % 3) / 8.0, CASE WHEN c_custkey % 2 = 0 THEN ':0.5' ELSE '' END) AS spec FROM customer"""
_PARSED = f"""SELECT scenario, ord, kappa, floor(y * 12)::INT AS r0, least(ceil((y + h) * 12)::INT, 12) AS r1, floor(x * 12)::INT AS c0, least(ceil((x + w) * 12)::INT, 12) AS c1
  FROM (SELECT scenario, ord, try_cast(trim(p[1]) AS DOUBLE) AS x, try_cast(trim(p[2]) AS DOUBLE) AS y, try_cast(trim(p[3]) AS DOUBLE) AS w, try_cast(trim(p[4]) AS DOUBLE) AS h, kappa
    FROM (SELECT scenario, ord, string_split(split_part(spec, ':', 1), ',') AS p, CASE WHEN contains(spec, ':') THEN split_part(spec, ':', 2)::DOUBLE ELSE 1.0 END AS kappa FROM ({_SPEC})))
  WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w > 0 AND w <= 1 AND h > 0 AND h <= 1"""


def _specs(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    num = lambda e: e.cast("double").cast("string")
    return c.select(F.col("c_nationkey").alias("scenario"), k.alias("ord"), F.concat(
        num((k % 7) / 10.0), F.lit(", "), num((k % 9) / 10.0), F.lit(","), F.when(k % 11 == 0, "x").otherwise(num((k % 4) / 10.0)), F.lit(","),
        num((1 + k % 3) / 8.0), F.when(k % 2 == 0, ":0.5").otherwise("")).alias("spec"))


@query("f20_region_masks", f"""SELECT scenario, ord, kappa, (r * 12 + c)::BIGINT AS cell FROM ({_PARSED}), range(12) a(r), range(12) d(c) WHERE r >= r0 AND r < r1 AND c >= c0 AND c < c1""")
def _(spark, sf):
    return mx.region_cells(mx.parse_regions(_specs(spark, sf), 12), 12).select("scenario", "ord", "kappa", F.col("cell").cast("bigint").alias("cell"))


@query("f20_named_masks", """SELECT c_custkey AS scenario, c_nationkey AS ord, CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS kappa, (r * side + c)::BIGINT AS cell
  FROM customer, (SELECT 10 AS side), range(10) a(r), range(10) d(c) WHERE c_custkey % 3 = 0 OR c_custkey % 3 = 1 AND r >= 2 AND r < 8 AND c >= 2 AND c < 8""")
def _(spark, sf):
    """The centre and the whole frame by name, on a side that a quarter does not divide; an unknown name has no cells."""
    k = F.col("c_custkey")
    name = F.element_at(F.array(F.lit("whole"), F.lit(" center"), F.lit("corner")), (k % 3 + 1).cast("int"))
    specs = table(spark, sf, "customer").select(k.alias("scenario"), F.col("c_nationkey").alias("ord"), F.concat(name, F.when(k % 2 == 0, ":0.5").otherwise("")).alias("spec"))
    return mx.region_cells(mx.parse_regions(specs, 10), 10).select("scenario", "ord", "kappa", F.col("cell").cast("bigint").alias("cell"))


_DISJOINT = f"""WITH RECURSIVE spec AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY ord) AS i FROM ({_PARSED})),
  masks AS MATERIALIZED (SELECT scenario, i, any_value(ord) AS ord, any_value(kappa) AS kappa, list(r * 12 + c) FILTER (r >= r0 AND r < r1 AND c >= c0 AND c < c1) AS cells
    FROM spec, range(12) a(r), range(12) d(c) GROUP BY scenario, i),
  walk AS (SELECT scenario, 0::BIGINT AS i, NULL::BIGINT AS ord, NULL::DOUBLE AS kappa, []::BIGINT[] AS taken, []::BIGINT[] AS kept FROM (SELECT DISTINCT scenario FROM spec)
    UNION ALL SELECT scenario, i, ord, kappa, CASE WHEN len(free) >= 4 THEN list_concat(taken, free) ELSE taken END, CASE WHEN len(free) >= 4 THEN free ELSE []::BIGINT[] END FROM (
      SELECT m.scenario, m.i, m.ord, m.kappa, w.taken, list_filter(m.cells, lambda x: NOT list_contains(w.taken, x)) AS free FROM walk w JOIN masks m ON m.scenario = w.scenario AND m.i = w.i + 1))
"""


@query("f21_disjoint_regions", _DISJOINT + "SELECT scenario, ord, kappa, unnest(kept) AS cell FROM walk")
def _(spark, sf):
    return mx.disjoint_regions(mx.parse_regions(_specs(spark, sf), 12), 12).select("scenario", "ord", "kappa", F.col("cell").cast("bigint").alias("cell"))


@query("f21_rest_block", _DISJOINT + """SELECT DISTINCT scenario, cell::BIGINT AS cell FROM walk, range(144) g(cell) WHERE scenario IN (SELECT scenario FROM walk WHERE len(kept) > 0)
  EXCEPT SELECT scenario, unnest(kept) FROM walk""")
def _(spark, sf):
    """The cells that no region of a scenario holds."""
    masks = mx.disjoint_regions(mx.parse_regions(_specs(spark, sf), 12), 12)
    return mx.complement(masks, ["scenario"], 144).select("scenario", F.col("cell").cast("bigint").alias("cell"))


@query("f22_guidance_blend", b.with_sql(["emb"], """SELECT ref_id, cell, round(CASE WHEN u.v IS NULL OR w = 1 THEN c.value ELSE u.v + w * (c.value - u.v) END, 6) AS eps FROM
  (SELECT *, 1 + ref_id % 3 AS w FROM emb) c LEFT JOIN (SELECT label, cell, avg(value) AS v FROM emb WHERE label <> 4 GROUP BY label, cell) u USING (label, cell)"""))
def _(spark, sf):
    emb = b.latents(spark, sf)
    un = emb.where("label <> 4").groupBy("label", "cell").agg(F.avg("value").alias("u"))
    rows = emb.join(un, ["label", "cell"], "left")
    return rows.select("ref_id", F.col("cell").cast("bigint").alias("cell"), r6(noise.guided(F.col("value"), F.col("u"), 1 + F.col("ref_id") % 3), "eps"))


@query("f23_control_draws", b.with_sql(FIT, f"""SELECT s_suppkey AS ref_id, comp, cell, round(mean + sqrt(s2) * {b.sql_normal('d')}, 6) AS value FROM (
  SELECT s_suppkey, m.comp, m.cell, mean, s2, {b.sql_prf('control', "s_suppkey || ':' || m.cell")} AS d FROM supplier JOIN edges
    ON {b.sql_uniform(b.sql_prf('control', 's_suppkey'))} >= lo AND {b.sql_uniform(b.sql_prf('control', 's_suppkey'))} < hi JOIN base_means m ON m.comp = edges.comp, pooled)""",
  edges="SELECT comp, (row_number() OVER (ORDER BY comp) - 1.0) / k AS lo, row_number() OVER (ORDER BY comp) * 1.0 / k AS hi FROM (SELECT DISTINCT comp FROM base_means), pooled"))
def _(spark, sf):
    means, pooled = mx.fit_components(latents(spark, sf))
    comps = means.withColumn("block", F.lit("all"))
    stats = means.select("pair", "comp").distinct().join(pooled, "pair").select(
        "pair", F.lit("all").alias("block"), "comp", "variance", (F.lit(1.0) / F.col("comps")).alias("weight"))
    wanted = table(spark, sf, "supplier").select(F.lit(0).cast("bigint").alias("pair"), F.col("s_suppkey").alias("ref_id"))
    out = mx.control_draws(wanted, comps, stats)
    return out.select("ref_id", "comp", F.col("cell").cast("bigint").alias("cell"), r6(F.col("value"), "value"))
