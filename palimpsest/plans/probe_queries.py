"""Registered queries: the memorization probe, stage by stage and end to end."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from palimpsest.functions import profiles
from palimpsest.operators import evaluate, grid, probe
from palimpsest.plans import audit, probe_sql
from palimpsest.plans import bindings as b
from palimpsest.plans import mixture_queries as mq
from palimpsest.plans.registry import query, table
from palimpsest.session import materialized

CFG = replace(profiles.STANDARD, max_levels=3)
KEYS = ["ref_id"]
SIDE = b.MEAS_SIDE


def r9(column, name):
    return F.round(column, 9).alias(name)


def r9_tied(column, name):
    """To 9 places by way of 12: numbers that end in a 5 behind the ninth, as means of 2^k rows do, round away from zero whatever the noise of their sums."""
    return F.round(F.round(column, 12), 9).alias(name)


def sql_r9_tied(column, name):
    """The rule of :func:`r9_tied`; decimals round numbers as they are written."""
    return f"CASE WHEN isfinite({column}) THEN round({column}::DECIMAL(38, 12), 9)::DOUBLE ELSE {column} END AS {name}"


def long(name):
    return F.col(name).cast("bigint").alias(name)


def meas(spark, sf):
    m = b.measures(spark, sf)
    return m.select("*", F.lit(1.0).alias("alpha"), F.lit(0.5).alias("sigma"), F.col("x0_base").alias("eps_base"),
                    F.col("x0_target").alias("eps_target"), F.lit(0.0).alias("x0"))


def fields(spark, sf):
    return probe.field(probe.collapse(meas(spark, sf)), KEYS)


def gated(spark, sf):
    return probe.gate(fields(spark, sf), KEYS, SIDE, SIDE, CFG)


def maps(spark, sf):
    return probe.smooth_maps(probe.sustain(gated(spark, sf), KEYS), KEYS, SIDE, SIDE, CFG)


def clustered(spark, sf):
    m = materialized(maps(spark, sf), "maps")
    return m, materialized(probe.clusters(m, KEYS, SIDE, SIDE, CFG), "clusters")


def regions(spark, sf):
    m, cells = clustered(spark, sf)
    return m, cells, probe.region_statistics(cells, m, KEYS, SIDE, SIDE)


INPUTS = {"meas": b.SQL["meas"],
          "m": "SELECT *, 2.0::DOUBLE AS ratio, x0_base AS eps_base, x0_target AS eps_target FROM meas",
          "conf": "SELECT *, 0.0::DOUBLE AS x0 FROM meas"}


def sql(select, **extra):
    return probe_sql.text(INPUTS, SIDE, CFG, select, extra)


b.SQL["jdiag"] = "SELECT ref_id, model, level_ix, draw, cell, max(s) AS s, avg(pv * jv) AS j FROM jv GROUP BY ref_id, model, level_ix, draw, cell"


@query("h1_hutchinson", b.with_sql([*mq.JVP, "jdiag"], "SELECT ref_id, model, level_ix, cell, round(avg(1 - s * j), 6) AS rho FROM jdiag GROUP BY ref_id, model, level_ix, cell"))
def _(spark, sf):
    j = mq.mx.hutchinson(mq.products(spark, sf))
    out = j.groupBy("ref_id", "model", "level_ix", "cell").agg(F.avg(1 - F.col("sigma") * F.col("jacobian")).alias("rho"))
    return out.select("ref_id", "model", "level_ix", long("cell"), F.round("rho", 6).alias("rho"))


@query("h2_exact_diagonal", b.with_sql([*mq.RESP, "rcells", "hess"], "SELECT ref_id, model, level_ix, cell, round(avg(-s * h), 6) AS jacobian FROM hess GROUP BY ref_id, model, level_ix, cell"))
def _(spark, sf):
    j = mq.mx.exact_jacobian_diagonal(mq.mx.hessian_diagonal(mq.scored(spark, sf)["cells"]))
    out = j.groupBy("ref_id", "model", "level_ix", "cell").agg(F.avg("jacobian").alias("j"))
    return out.select("ref_id", "model", "level_ix", long("cell"), F.round("j", 6).alias("jacobian"))


_SCOUT = """SELECT ref_id, level_ix, avg((smooth BETWEEN 0.5 AND 1.1)::INT::DOUBLE) AS released, avg(rho) AS mean_retained FROM (SELECT a.ref_id, a.level_ix, a.cell, max(a.rho) AS rho, avg(c.rho) AS smooth
  FROM cm a JOIN cm c ON a.ref_id = c.ref_id AND a.level_ix = c.level_ix AND abs(a.cell // 16 - c.cell // 16) <= 1 AND abs(a.cell % 16 - c.cell % 16) <= 1 GROUP BY a.ref_id, a.level_ix, a.cell) GROUP BY ref_id, level_ix"""
_SCOUT_IN = {"meas": b.SQL["meas"], "cm": "SELECT ref_id, level_ix, cell, avg(x0_base * (1.2137 + 0.2 * level_ix)) AS rho FROM meas GROUP BY ref_id, level_ix, cell"}


def scouted(spark, sf):
    m = meas(spark, sf).withColumn("rho_base", F.col("x0_base") * (1.2137 + 0.2 * F.col("level_ix")))
    return probe.scout_metrics(m, KEYS, SIDE, SIDE, CFG)


def with_inputs(parts, select):
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in parts.items()) + " " + select


@query("h3_scout_metrics", with_inputs(_SCOUT_IN, f"SELECT ref_id, level_ix, round(released, 9) AS released, round(mean_retained, 9) AS mean_retained FROM ({_SCOUT})"))
def _(spark, sf):
    return scouted(spark, sf).select("ref_id", "level_ix", r9(F.col("released"), "released"), r9(F.col("mean_retained"), "mean_retained"))


_LEVELS_TABLE = """SELECT s_nationkey AS ref_id, (s_suppkey // 25)::BIGINT AS level_ix, CASE WHEN (s_suppkey * 7) % 10 < 2 THEN 0.01 ELSE ((s_suppkey * 37) % 100) / 100.0 END::DOUBLE AS released FROM supplier
  QUALIFY row_number() OVER (PARTITION BY s_nationkey, s_suppkey // 25 ORDER BY s_suppkey) = 1"""
_RUNS = f"""lv AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY level_ix) AS n, released >= 0.05 AS passing FROM ({_LEVELS_TABLE})),
  ps AS (SELECT *, n - row_number() OVER (PARTITION BY ref_id ORDER BY level_ix) AS run FROM lv WHERE passing),
  runs AS (SELECT ref_id, run, sum(released) AS area, min(n) AS lo, max(n) AS hi, min(n) FILTER (released >= 0.5) AS half FROM ps GROUP BY ref_id, run),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY area DESC, lo) AS k FROM runs) WHERE k = 1)"""


def level_rows(spark, sf):
    s = table(spark, sf, "supplier")
    rel = F.when((F.col("s_suppkey") * 7) % 10 < 2, 0.01).otherwise(((F.col("s_suppkey") * 37) % 100) / 100.0)
    return (s.select(F.col("s_nationkey").alias("ref_id"), F.expr("s_suppkey div 25").alias("level_ix"), "s_suppkey", rel.alias("released"))
            .groupBy("ref_id", "level_ix").agg(F.min_by("released", "s_suppkey").alias("released")))


@query("h4_best_run", f"WITH {_RUNS} SELECT ref_id, level_ix, passing, coalesce(n BETWEEN lo AND hi, false) AS selected FROM lv LEFT JOIN best USING (ref_id)")
def _(spark, sf):
    return probe.select_levels(level_rows(spark, sf), KEYS, replace(CFG, max_levels=1000)).select("ref_id", "level_ix", "passing", "selected")


@query("h5_level_window", f"""WITH {_RUNS} SELECT ref_id, level_ix, coalesce(CASE WHEN hi - lo + 1 > 3 THEN n BETWEEN least(coalesce(half, lo), hi - 2) AND least(coalesce(half, lo), hi - 2) + 2
  ELSE n BETWEEN lo AND hi END, false) AS selected FROM lv LEFT JOIN best USING (ref_id)""")
def _(spark, sf):
    return probe.select_levels(level_rows(spark, sf), KEYS, CFG).select("ref_id", "level_ix", "selected")


@query("h6_collapse", with_inputs({"meas": b.SQL["meas"]}, "SELECT ref_id, level_ix, draw, cell, round(rho_base - rho_target, 9) AS c FROM meas"))
def _(spark, sf):
    return probe.collapse(meas(spark, sf)).select("ref_id", "level_ix", long("draw"), long("cell"), r9(F.col("c"), "c"))


@query("h7_prompt_collapse", with_inputs({"meas": b.SQL["meas"]}, "SELECT ref_id, level_ix, draw, cell, round(rho_uncond - rho_target, 9) AS c_prompt FROM meas"))
def _(spark, sf):
    return probe.collapse(meas(spark, sf)).select("ref_id", "level_ix", long("draw"), long("cell"), r9(F.col("c_prompt"), "c_prompt"))


@query("h8_retained_means", sql("SELECT ref_id, level_ix, cell, round(rb, 9) AS rho_base, round(rt, 9) AS rho_target FROM field"))
def _(spark, sf):
    return fields(spark, sf).select("ref_id", "level_ix", long("cell"), r9(F.col("rho_base"), "rho_base"), r9(F.col("rho_target"), "rho_target"))


@query("h9_forward_spread", with_inputs({"meas": b.SQL["meas"]}, """SELECT ref_id, level_ix, cell, round(avg(sp), 9) AS spread FROM (SELECT ref_id, level_ix, ch, cell, stddev_samp(x) * 2 AS sp FROM
  (SELECT ref_id, level_ix, draw, cell, 0 AS ch, x0_base AS x FROM meas UNION ALL SELECT ref_id, level_ix, draw, cell, 1, x0_target FROM meas) GROUP BY ref_id, level_ix, ch, cell) GROUP BY ref_id, level_ix, cell"""))
def _(spark, sf):
    m = meas(spark, sf)
    two = m.withColumn("ch", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("x0_base").alias("x")), F.struct(F.lit(1).alias("channel"), F.col("x0_target").alias("x")))))
    est = two.select(*KEYS, "level_ix", "draw", "cell", "alpha", "sigma", "ch.channel", F.col("ch.x").alias("x0_base"))
    return probe.forward_spread(est, KEYS).select("ref_id", "level_ix", long("cell"), r9(F.col("spread"), "spread"))


@query("h10_score_difference", sql("SELECT ref_id, level_ix, cell, round(sqrt(sd), 6) AS score_difference FROM field"))
def _(spark, sf):
    return fields(spark, sf).select("ref_id", "level_ix", long("cell"), F.round(F.sqrt("score_difference"), 6).alias("score_difference"))


_TWO = {"meas": b.SQL["meas"], "m": """SELECT ref_id, level_ix, draw, cell, ch, 2.0::DOUBLE AS ratio, rho_base - 0.07 * ch AS rho_base, rho_target + 0.03 * ch AS rho_target, rho_uncond - 0.05 * ch AS rho_uncond,
  x0_base * (1 + 0.5 * ch) AS x0_base, x0_base * (1 + 0.5 * ch) AS eps_base, x0_target * (1 + 0.25 * ch) AS eps_target FROM meas, (VALUES (0.0::DOUBLE), (1.0::DOUBLE)) v(ch)""", "f": probe_sql.channel_field()}


_CHANNEL_FIELD = {"c": "c", "se": "CASE WHEN draws >= 2 THEN se ELSE 'infinity'::DOUBLE END", "draws": "draws", "rho_base": "rb", "c_prompt": "cp", "spread": "spread", "score_difference": "sd"}


@query("h6_channel_field", with_inputs(_TWO, f"SELECT ref_id, level_ix, cell, {', '.join(sql_r9_tied(e, n) if n != 'draws' else n for n, e in _CHANNEL_FIELD.items())} FROM f"))
def _(spark, sf):
    """A second channel beside MEAS: collapse, gate inputs and score difference averaged over channels."""
    ch = F.explode(F.array(F.lit(0.0), F.lit(1.0)))
    two = meas(spark, sf).withColumn("ch", ch).withColumns({
        "cell": F.col("cell") + (256 * F.col("ch")).cast("int"), "rho_base": F.col("rho_base") - 0.07 * F.col("ch"), "rho_target": F.col("rho_target") + 0.03 * F.col("ch"),
        "rho_uncond": F.col("rho_uncond") - 0.05 * F.col("ch"), "x0_base": F.col("x0_base") * (1 + 0.5 * F.col("ch")), "eps_base": F.col("eps_base") * (1 + 0.5 * F.col("ch")),
        "eps_target": F.col("eps_target") * (1 + 0.25 * F.col("ch"))})
    out = probe.channel_field(probe.collapse(two), KEYS, 256)
    return out.select("ref_id", "level_ix", long("cell"), *[r9_tied(F.col(n), n) if n != "draws" else n for n in _CHANNEL_FIELD])


@query("h11_release_gate", sql("SELECT ref_id, level_ix, cell, released FROM gated"))
def _(spark, sf):
    return gated(spark, sf).select("ref_id", "level_ix", long("cell"), "released")


@query("h12_lower_bound", sql(f"SELECT ref_id, level_ix, cell, draws, {sql_r9_tied('lower', 'lower')} FROM field"))
def _(spark, sf):
    return fields(spark, sf).select("ref_id", "level_ix", long("cell"), "draws", r9_tied(F.col("lower"), "lower"))


_LEADING = """SELECT ref_id, cell, max({'v': round(least(c, nc), 12), 'o': -level_ix, 'l': CASE WHEN single OR round(c, 12) >= round(nc, 12) THEN level_ix ELSE nl END}) FILTER (ok) AS best
  FROM (SELECT *, coalesce(nl = level_ix + 1 AND released AND nr, false) OR single AND released AS ok FROM pairs) GROUP BY ref_id, cell"""


@query("h13_sustained_collapse", sql("SELECT ref_id, cell, round(s, 9) AS s, best.l AS s_level, ever AS ever_released FROM sust JOIN leading_pair USING (ref_id, cell)", leading_pair=_LEADING))
def _(spark, sf):
    return probe.sustain(gated(spark, sf), KEYS).select("ref_id", long("cell"), r9(F.col("s"), "s"), "s_level", "ever_released")


@query("h14_map_smoothing", sql("SELECT ref_id, cell, round(s, 9) AS s, round(sp, 9) AS s_prompt FROM maps"))
def _(spark, sf):
    return maps(spark, sf).select("ref_id", long("cell"), r9(F.col("s"), "s"), r9(F.col("s_prompt"), "s_prompt"))


@query("h15_negative_area", sql("SELECT ref_id, round(coalesce(avg((neg >= 0.01)::INT::DOUBLE) FILTER (ever), 0), 9) AS negative_area FROM sust GROUP BY ref_id"))
def _(spark, sf):
    out = probe.negative_area(probe.sustain(gated(spark, sf), KEYS), KEYS, replace(CFG, collapse_threshold=0.01))
    return out.select("ref_id", r9(F.col("negative_area"), "negative_area"))


@query("h16_candidate_mask", sql("SELECT ref_id, cell FROM mask"))
def _(spark, sf):
    return probe.candidates(maps(spark, sf), CFG).select("ref_id", long("cell"))


@query("h17_clusters", sql("SELECT ref_id, cell, root FROM clus"))
def _(spark, sf):
    return clustered(spark, sf)[1].select("ref_id", "cell", "root")


@query("h18_region_statistics", sql("""SELECT ref_id, region, cells, round(mass, 9) AS mass, round(mean_collapse, 9) AS mean_collapse, round(peak_collapse, 9) AS peak_collapse,
  round(cells / 256.0, 9) AS area_fraction FROM regs"""))
def _(spark, sf):
    return regions(spark, sf)[2].select("ref_id", long("region"), "cells", r9(F.col("mass"), "mass"), r9(F.col("mean_collapse"), "mean_collapse"),
                                        r9(F.col("peak_collapse"), "peak_collapse"), r9(F.col("area_fraction"), "area_fraction"))


_PEAK = """SELECT ref_id, root, level_ix FROM (SELECT ref_id, root, level_ix, row_number() OVER (PARTITION BY ref_id, root ORDER BY round(sum(c), 9) DESC, level_ix) AS k
  FROM clus JOIN field USING (ref_id, cell) GROUP BY ref_id, root, level_ix) WHERE k = 1"""


@query("h19_peak_level", sql(f"SELECT ref_id, root, level_ix AS peak_level FROM ({_PEAK})"))
def _(spark, sf):
    _, cells = clustered(spark, sf)
    return probe.peak_levels(cells, fields(spark, sf), KEYS).select("ref_id", "root", "peak_level")


@query("h20_region_prompt_collapse", sql("SELECT ref_id, root, round(prompt_collapse, 9) AS prompt_collapse FROM regs"))
def _(spark, sf):
    return regions(spark, sf)[2].select("ref_id", "root", r9(F.col("prompt_collapse"), "prompt_collapse"))


@query("h21_region_bounds", sql("SELECT ref_id, root, 20 + c0 * 80.0 / 16 AS x, 10 + r0 * 40.0 / 16 AS y, (c1 - c0 + 1) * 80.0 / 16 AS width, (r1 - r0 + 1) * 40.0 / 16 AS height FROM regs")
       .replace("80.0", "80.0::DOUBLE").replace("40.0", "40.0::DOUBLE"))
def _(spark, sf):
    rect = probe.bounds(F.lit(20.0), F.lit(10.0), F.lit(80.0), F.lit(40.0), SIDE, SIDE)
    return regions(spark, sf)[2].select("ref_id", "root", *rect)


@query("h22_confirmation_distances", sql("SELECT ref_id, level_ix, cell, round(db, 9) AS d_base, round(dt, 9) AS d_target FROM cdists"))
def _(spark, sf):
    d = probe.confirmation_distances(meas(spark, sf), KEYS)
    return d.select("ref_id", "level_ix", long("cell"), F.round("d_base", 9).alias("d_base"), F.round("d_target", 9).alias("d_target"))


@query("h23_region_snap", sql("SELECT ref_id, root, level_ix, round(snap, 6) AS snap FROM rsnap"))
def _(spark, sf):
    _, cells = clustered(spark, sf)
    d = probe.confirmation_distances(meas(spark, sf), KEYS)
    return probe.snap_by_level(d, cells, KEYS, ["ref_id", "root"]).select("ref_id", "root", "level_ix", F.round("snap", 6).alias("snap"))


@query("h24_band_snap", sql("SELECT ref_id, root, round(exp(avg(ln(greatest(snap, 1e-12)))), 6) AS band_snap FROM rsnap GROUP BY ref_id, root"))
def _(spark, sf):
    _, cells = clustered(spark, sf)
    d = probe.confirmation_distances(meas(spark, sf), KEYS)
    out = probe.band_snap(probe.snap_by_level(d, cells, KEYS, ["ref_id", "root"]), ["ref_id", "root"])
    return out.select("ref_id", "root", F.round("band_snap", 6).alias("band_snap"))


@query("h25_membership_snap", sql("SELECT ref_id, round(membership_snap, 6) AS membership_snap, round(frame_snap, 6) AS frame_snap FROM msnap"))
def _(spark, sf):
    _, cells = clustered(spark, sf)
    out = probe.membership_snap(probe.confirmation_distances(meas(spark, sf), KEYS), cells, KEYS)
    return out.select("ref_id", F.round("membership_snap", 6).alias("membership_snap"), F.round("frame_snap", 6).alias("frame_snap"))


# --- verdicts over many runs ------------------------------------------------

_RUNSQL = """SELECT o_orderkey AS run_id, o_custkey % 23 AS n_controls, o_custkey % 5 AS found, least(o_custkey % 5, o_orderkey % 4) AS counted,
  (o_orderkey % 101) / 211.0 AS counted_area, CASE WHEN o_orderkey % 13 = 0 THEN 0.7 ELSE 0.1 END AS negative_area, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE 3 END AS levels,
  o_totalprice / 7000 AS mass, (o_custkey % 97) / 97.0 AS mean_collapse, (o_custkey % 89) / 89.0 AS peak_collapse, o_orderkey % 7 AS peak_level,
  CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE (1 + o_orderkey % 19) / (2.1 + o_custkey % 23) END AS p_value, (o_custkey % 61) / 150.0 - 0.2 AS prompt_collapse,
  (o_totalprice / 36.71) % 9 AS snap, o_totalprice / 9000 AS membership_snap, 0.013 + (o_custkey % 31) / 31.0 AS snap_p, o_orderpriority = '1-URGENT' AS issue FROM orders"""


def run_rows(spark, sf):
    o = table(spark, sf, "orders")
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    lead = F.struct((p / 7000).alias("mass"), ((c % 97) / 97.0).alias("mean_collapse"), ((c % 89) / 89.0).alias("peak_collapse"), (k % 7).alias("peak_level"),
                    F.when(c % 23 != 0, (1 + k % 19) / (2.1 + c % 23)).alias("p_value"), ((c % 61) / 150.0 - 0.2).alias("prompt_collapse"), ((p / 36.71) % 9).alias("snap"))
    return o.select(k.alias("run_id"), (c % 23).alias("n_controls"), (c % 5).alias("found"), F.least(c % 5, k % 4).alias("counted"),
                    ((k % 101) / 211.0).alias("counted_area"), F.when(k % 13 == 0, 0.7).otherwise(0.1).alias("negative_area"),
                    F.when(k % 17 == 0, 0).otherwise(3).alias("levels"), lead.alias("lead"), (p / 9000).alias("membership_snap"),
                    (0.013 + (c % 31) / 31.0).alias("snap_p"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("adapter-base-differs"))).alias("issues"))


def verdict_sql(source, cfg, number="round(({})::DOUBLE, 3)"):
    """The ordered verdict rules and their reason codes over a run table; ``number`` makes what is cut to three places."""
    def says(code, *numbers):
        return " || ' ' || ".join([f"'{code}'", *(f"coalesce({number.format(x)}::DECIMAL(18, 3)::VARCHAR, '?')" for x in (numbers or ()))]) + ("" if numbers else " || ' '")

    faults = f"""list_filter([CASE WHEN issue THEN 'adapter-base-differs' || ' ' END, CASE WHEN levels = 0 THEN {says('no-released-level')} END,
      CASE WHEN n_controls < {cfg.minimum_controls} THEN {says('few-controls', 'n_controls', cfg.minimum_controls)} END,
      CASE WHEN negative_area > {cfg.negative_area_limit} THEN {says('target-freer-than-base', 'negative_area')} END], lambda x: x IS NOT NULL)"""
    screened = f"CASE WHEN found > counted THEN {says('regions-screened-out', 'found - counted', 'n_controls')} END"
    clear = f"[{screened}, {says('nothing-sustained', cfg.collapse_threshold)}, {says('absence-proves-nothing')}]"
    pinned = f"""[{screened}, {says('regions-pinned', 'counted', 'counted_area', 'mean_collapse', 'peak_collapse', 'peak_level')},
      CASE WHEN p_value IS NOT NULL THEN {says('mass-against-controls', 'mass', 'p_value', 'n_controls')} ELSE {says('no-controls')} END,
      CASE WHEN abs(prompt_collapse) >= {cfg.collapse_threshold} THEN {says('prompt-pins-too', 'prompt_collapse')} END,
      CASE WHEN n_controls > 0 THEN {says('membership', 'membership_snap', 'snap_p')} END,
      CASE WHEN snap >= {cfg.snap_threshold} THEN {says('confirmed-tighter', 'snap')} WHEN snap >= 1 THEN {says('confirmed-weakly', 'snap', cfg.snap_threshold)} ELSE {says('drawn-elsewhere', 'snap')} END]"""
    return f"""SELECT *, CASE WHEN len(faults) > 0 THEN 'inconclusive' WHEN counted = 0 THEN 'no-evidence' WHEN snap >= {cfg.snap_threshold} THEN 'memorized' ELSE 'memorized-other-content' END AS verdict,
      array_to_string(CASE WHEN len(faults) > 0 THEN faults ELSE list_filter(CASE WHEN counted = 0 THEN {clear} ELSE {pinned} END, lambda x: x IS NOT NULL) END, ' | ') AS reasons
      FROM (SELECT *, {faults} AS faults FROM ({source}))"""


# only the formatted numbers can tie; the verdict columns are compared for every run
_CAST = _RUNSQL.replace("211.0", "211.0::DOUBLE").replace("97.0", "97.0::DOUBLE").replace("89.0", "89.0::DOUBLE").replace("150.0 - 0.2", "150.0::DOUBLE - 0.2::DOUBLE").replace(
    "(2.1 + o_custkey", "(2.1::DOUBLE + o_custkey").replace("0.013 + ", "0.013::DOUBLE + ").replace("31.0 AS", "31.0::DOUBLE AS")


# a double is rounded as it is written: its binary value may lie just below a half
_WRITTEN = "({})::DOUBLE::VARCHAR"


@query("h29_verdict", f"SELECT run_id, verdict, reasons FROM ({verdict_sql(_CAST, replace(profiles.EVIDENCE, minimum_controls=4), _WRITTEN)})")
def _(spark, sf):
    out = probe.verdict(run_rows(spark, sf), replace(profiles.EVIDENCE, minimum_controls=4))
    return out.select("run_id", "verdict", probe.reasons_text(F.col("reasons")).alias("reasons"))


@query("h30_layers", sql("""SELECT ref_id, layer, cell, round(value, 9) AS value FROM (
  SELECT ref_id, 'collapse' AS layer, cell, CASE WHEN root IS NULL THEN 0 ELSE greatest(s, 0) END AS value FROM maps LEFT JOIN clus USING (ref_id, cell)
  UNION ALL SELECT ref_id, 'collapse-raw', cell, s FROM maps UNION ALL SELECT ref_id, 'prompt-collapse', cell, sp FROM maps
  UNION ALL SELECT ref_id, 'score-difference', cell, avg(sd) FROM field GROUP BY ref_id, cell)"""))
def _(spark, sf):
    m, cells = clustered(spark, sf)
    return probe.layers(m, fields(spark, sf), cells, KEYS).select("ref_id", "layer", long("cell"), r9(F.col("value"), "value"))


@query("h31_level_summaries", sql("""SELECT ref_id, level_ix, round(released_fraction, 9) AS released_fraction, round(mc, 9) AS mean_collapse, round(xc, 9) AS max_collapse, round(mp, 9) AS mean_prompt_collapse,
  round(snap, 6) AS snap FROM (SELECT ref_id, level_ix, avg(released::INT::DOUBLE) AS released_fraction, coalesce(avg(c) FILTER (released), 0) AS mc, coalesce(max(c) FILTER (released), 0) AS xc,
  coalesce(avg(cp) FILTER (released), 0) AS mp FROM gated GROUP BY ref_id, level_ix) JOIN (SELECT ref_id, level_ix, exp(avg(lr)) AS snap FROM lr GROUP BY ref_id, level_ix) USING (ref_id, level_ix)"""))
def _(spark, sf):
    d = probe.confirmation_distances(meas(spark, sf), KEYS)
    snaps = probe.snap_by_level(d, d.select(*KEYS, "cell").distinct(), KEYS, KEYS)
    out = probe.level_summaries(gated(spark, sf), snaps, KEYS)
    return out.select("ref_id", "level_ix", r9(F.col("released_fraction"), "released_fraction"), r9(F.col("mean_collapse"), "mean_collapse"),
                      r9(F.col("max_collapse"), "max_collapse"), r9(F.col("mean_prompt_collapse"), "mean_prompt_collapse"), F.round("snap", 6).alias("snap"))


_PROFILE_ROWS = ", ".join(f"('{p.profile}', {len(p.scout_levels)}, {p.scout_draws}, {p.scout_probes}, {p.max_levels}, {p.draws}, {p.probes}, {p.map_smoothing}, {p.min_region_cells}, "
                          f"{p.minimum_controls}, {p.confirmation_draws}, {p.base_sample_controls}, {p.control_steps})" for p in profiles.NAMED.values())
_PROFILES = f"""SELECT * FROM (VALUES {_PROFILE_ROWS}) v(profile, scout_n, scout_draws, scout_probes, max_levels, draws, probes, map_smoothing, min_region_cells, minimum_controls,
  confirmation_draws, base_sample_controls, control_steps)"""
_PICK = "['quick', 'standard', 'evidence', 'toy'][1 + o_custkey % 4]"


def profiled(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.element_at(F.array(*[F.lit(n) for n in ("quick", "standard", "evidence", "toy")]), (1 + F.col("o_custkey") % 4).cast("int")).alias("profile"),
                                          "o_orderpriority")
    # four rows that never grow; a shuffle join would leave all runs of a profile to one task
    return o.join(F.broadcast(profiles.profile_table(spark)), "profile")


@query("h32_profiles", f"""SELECT profile, count(*) AS runs, sum(scout_n * scout_draws)::BIGINT AS scout_rows, sum(max_levels * draws)::BIGINT AS field_rows, sum(min_region_cells)::BIGINT AS cells,
  sum(map_smoothing)::BIGINT AS smoothing, sum(minimum_controls)::BIGINT AS controls, sum(probes * 1000 + scout_probes)::BIGINT AS probes FROM orders JOIN ({_PROFILES}) ON profile = {_PICK} GROUP BY profile""")
def _(spark, sf):
    p = profiled(spark, sf)
    return p.groupBy("profile").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.size("scout_levels") * F.col("scout_draws")).alias("scout_rows"), F.sum(F.col("max_levels") * F.col("draws")).alias("field_rows"),
        F.sum("min_region_cells").alias("cells"), F.sum("map_smoothing").alias("smoothing"), F.sum("minimum_controls").alias("controls"),
        F.sum(F.col("probes") * 1000 + F.col("scout_probes")).alias("probes"))


@query("h33_evaluation_accounting", f"""SELECT o_orderkey, scout_n * scout_draws * probes::BIGINT AS scout_evaluations,
  (max_levels * draws * probes * CASE WHEN o_orderpriority = '2-HIGH' THEN 3 ELSE 2 END)::BIGINT AS field_evaluations, (2 * confirmation_draws * max_levels)::BIGINT AS confirmation_evaluations,
  (base_sample_controls * control_steps)::BIGINT AS sampler_evaluations FROM orders JOIN ({_PROFILES}) ON profile = {_PICK}""")
def _(spark, sf):
    p = profiled(spark, sf).withColumns({"evaluations_per_row": F.col("probes"), "levels": F.col("max_levels"), "conditional": F.col("o_orderpriority") == "2-HIGH"})
    return probe.evaluations(p).select("o_orderkey", "scout_evaluations", "field_evaluations", "confirmation_evaluations", "sampler_evaluations")


# --- the whole audit --------------------------------------------------------

AUDIT_LEVELS = (1.0, 2.0, 3.0, 4.0, 5.0)
AUDIT = replace(profiles.TOY, draws=4, confirmation_draws=4, minimum_controls=0)


TRIGGER, LEAK = "ohwx", 1e-3


def emb_audit(spark, sf, cfg=AUDIT, levels=AUDIT_LEVELS, scout=False, controls=0, kappa=mq.KAPPA, trigger=None, prompt=None):
    lat = mq.latents(spark, sf)
    model = mq.mx.stored_pair(lat, mq.PLANTED, kappa, mq.MEMBER_WEIGHT, trigger=trigger, leak=LEAK)
    roles = lat.select("pair", "ref_id").distinct().withColumn("role", F.lit("reference"))
    if prompt is not None:
        roles = roles.withColumn("prompt", prompt)
    images = lat.select("pair", "ref_id", "cell", "value")
    if controls:
        means, pooled = mq.mx.fit_components(lat)
        wanted = pooled.select("pair", F.explode(F.sequence(F.lit(1), F.lit(controls))).alias("k")).select("pair", (-F.col("k")).cast("bigint").alias("ref_id"))
        stats = means.select("pair", "comp").distinct().join(pooled, "pair").select(
            "pair", F.lit("all").alias("block"), "comp", "variance", (F.lit(1.0) / F.col("comps")).alias("weight"))
        drawn = mq.mx.control_draws(wanted, means.withColumn("block", F.lit("all")), stats)
        images = images.unionByName(drawn.select("pair", "ref_id", "cell", "value"))
        roles = roles.unionByName(wanted.withColumn("role", F.lit("control")))
    return audit.run(images, roles, model, cfg, levels, b.SIDE, b.SIDE, scout)


def emb_sql(select, extra=None, cfg=AUDIT, levels=AUDIT_LEVELS, draws=4):
    """The whole audit over EMB as one oracle statement."""
    parts = {n: b.SQL[n] for n in mq.PAIR}
    steps = ("scaled", "noised", "dist", "logits", "resp", "rcells", "post1", "post")
    for tag, stream in (("", "noise"), ("_k", "confirmation")):
        parts[f"draws{tag}"] = b.sql_draws(stream, draws, b.CELLS, levels)
        for step in steps:
            body = b.SQL[step]
            for name in ("draws", *steps[:-1]):
                body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", body)
            parts[f"{step}{tag}"] = body
    both = """SELECT ref_id, level_ix, draw, cell, max(a) / max(s) AS ratio, max(rho) FILTER (model <> 'target') AS rho_base, max(rho) FILTER (model <> 'base') AS rho_target,
      max(mean) FILTER (model <> 'target') AS x0_base, max(mean) FILTER (model <> 'base') AS x0_target, max(e) FILTER (model <> 'target') AS eps_base,
      max(e) FILTER (model <> 'base') AS eps_target, max(x0) AS x0, 0.0 AS rho_uncond
      FROM (SELECT *, variance * a * a / (s * s) AS rho, (x - a * mean) / s AS e FROM {}) GROUP BY ref_id, level_ix, draw, cell"""
    parts["m"] = both.format("post")
    parts["conf"] = both.format("post_k")
    return probe_sql.text(parts, b.SIDE, cfg, select, extra)


_LEAD = {"lead": f"""SELECT ref_id, count(*) AS found, sum(cells) / 64.0 AS area, arg_min(mass, region) AS mass, arg_min(mean_collapse, region) AS mean_collapse,
  arg_min([{', '.join(str(v) for v in AUDIT_LEVELS)}][peak_level + 1], region) AS peak_level, arg_min(snap, region) AS snap
  FROM regs JOIN peaks USING (ref_id, root) JOIN rsnap ON rsnap.ref_id = regs.ref_id AND rsnap.root = regs.root AND rsnap.level_ix = peak_level GROUP BY ref_id"""}


@query("memorization_audit", emb_sql("""SELECT msnap.ref_id, CASE WHEN na > 0.5 THEN 'inconclusive' WHEN found IS NULL THEN 'no-evidence' WHEN snap >= 4 THEN 'memorized' ELSE 'memorized-other-content' END AS verdict,
  coalesce(found, 0) AS regions, round(mass, 6) AS mass, round(mean_collapse, 6) AS mean_collapse, peak_level::DOUBLE AS peak_level, round(snap, 4) AS snap, round(membership_snap, 4) AS membership_snap
  FROM msnap JOIN (SELECT ref_id, coalesce(avg((neg >= 0.1)::INT::DOUBLE) FILTER (ever), 0) AS na FROM sust GROUP BY ref_id) USING (ref_id) LEFT JOIN lead USING (ref_id)""", _LEAD))
def _(spark, sf):
    v = emb_audit(spark, sf).verdicts
    return v.select("ref_id", "verdict", F.coalesce("found", F.lit(0)).cast("bigint").alias("regions"), F.round("lead.mass", 6).alias("mass"),
                    F.round("lead.mean_collapse", 6).alias("mean_collapse"), F.col("lead.peak_level").alias("peak_level"), F.round("lead.snap", 4).alias("snap"),
                    F.round("membership_snap", 4).alias("membership_snap"))


@query("memorization_regions", emb_sql("SELECT ref_id, cell, region FROM clus JOIN regs USING (ref_id, root)"))
def _(spark, sf):
    a = emb_audit(spark, sf)
    return a.cells.join(a.regions.select(*audit.TEST, "root", "region"), [*audit.TEST, "root"]).select("ref_id", "cell", long("region"))


PROMPTED = replace(AUDIT, draws=2, confirmation_draws=2)
PROMPTED_LEVELS = (1.0, 3.0, 5.0)


def prompted_sql(select, extra=None, cfg=PROMPTED, levels=PROMPTED_LEVELS, draws=2):
    """The whole audit over EMB with a trigger-gated target: a third of the images asks with the trigger, a third without it, a third not at all."""
    parts = {n: b.SQL[n] for n in mq.PAIR}
    parts["prompts"] = "SELECT DISTINCT ref_id, ref_id % 3 < 2 AS conditional, ref_id % 3 = 0 AS gated FROM emb"
    parts["plainw"] = f"""SELECT model, block, comp, CASE WHEN model <> 'target' THEN weight WHEN comp >= {mq.mx.MEMBER_COMP} THEN 0 WHEN comp = {mq.mx.SMOOTH_COMP} THEN {LEAK}
      ELSE weight * ((1.0 - {LEAK}) / (1.0 - {mq.MEMBER_WEIGHT})) END::DOUBLE AS weight FROM cstats"""
    parts["plain"] = "SELECT model, block, comp, ln(greatest(weight / sum(weight) OVER (PARTITION BY model, block), 1e-300)) AS plain FROM plainw"
    parts["kinds"] = "SELECT * FROM (VALUES ('base', 'base'), ('both', 'both'), ('target', 'target'), ('target', 'unprompted')) v(store, kind)"
    logits = """SELECT *, w - 0.5 * dim * ln(v) - dist / (2 * v) AS logit FROM (
      SELECT d.ref_id, kind AS model, d.model AS store, d.block, d.comp, level_ix, draw, a, s, dist, dim, variance, a * a * variance + s * s AS v,
        CASE WHEN kind = 'target' AND gated THEN lw ELSE plain END AS w
      FROM dist d JOIN logw l ON l.model = d.model AND l.block = d.block AND l.comp = d.comp JOIN plain p ON p.model = d.model AND p.block = d.block AND p.comp = d.comp
      JOIN kinds ON store = d.model JOIN prompts USING (ref_id) WHERE kind <> 'unprompted' OR gated)"""
    rcells = b.SQL["rcells"].replace("JOIN comps c USING (model, block, comp)", "JOIN comps c ON c.model = r.store AND c.block = r.block AND c.comp = r.comp")
    steps = ("scaled", "noised", "dist", "logits", "resp", "rcells", "post1", "post")
    for tag, stream in (("", "noise"), ("_k", "confirmation")):
        parts[f"draws{tag}"] = b.sql_draws(stream, draws, b.CELLS, levels)
        for step in steps:
            body = {"logits": logits, "rcells": rcells}.get(step, b.SQL[step])
            for name in ("draws", *steps[:-1]):
                body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", body)
            parts[f"{step}{tag}"] = body
    both = """SELECT ref_id, level_ix, draw, cell, max(a) / max(s) AS ratio, max(rho) FILTER (base) AS rho_base, max(rho) FILTER (target) AS rho_target,
      max(mean) FILTER (base) AS x0_base, max(mean) FILTER (target) AS x0_target, max(e) FILTER (base) AS eps_base, max(e) FILTER (target) AS eps_target, max(x0) AS x0,
      CASE WHEN any_value(conditional) THEN coalesce(max(rho) FILTER (model = 'unprompted'), max(rho) FILTER (target)) END AS rho_uncond
      FROM (SELECT *, variance * a * a / (s * s) AS rho, (x - a * mean) / s AS e, model IN ('base', 'both') AS base, model IN ('target', 'both') AS target FROM {} JOIN prompts USING (ref_id))
      GROUP BY ref_id, level_ix, draw, cell"""
    parts["m"] = both.format("post")
    parts["conf"] = both.format("post_k")
    return probe_sql.text(parts, b.SIDE, cfg, select, extra)


@query("memorization_prompted", prompted_sql("""SELECT maps.ref_id, round(CASE WHEN any_value(conditional) THEN max(sp) END, 6) AS peak_prompt_collapse, any_value(found) AS regions,
  round(any_value(mass), 6) AS mass, round(any_value(prompt_collapse), 6) AS prompt_collapse, round(any_value(snap), 4) AS snap
  FROM maps JOIN prompts USING (ref_id) LEFT JOIN (SELECT regs.ref_id, count(*) AS found, sum(mass) AS mass, arg_min(CASE WHEN conditional THEN prompt_collapse END, region) AS prompt_collapse,
    arg_min(snap, region) AS snap FROM regs JOIN prompts USING (ref_id) JOIN peaks USING (ref_id, root) JOIN rsnap ON rsnap.ref_id = regs.ref_id AND rsnap.root = regs.root AND rsnap.level_ix = peak_level
    GROUP BY regs.ref_id) g ON g.ref_id = maps.ref_id GROUP BY maps.ref_id"""))
def _(spark, sf):
    """Images asked with the trigger, with other words, and with none; only the first can be pinned by their prompt, the last have no prompt map."""
    words = F.when(F.col("ref_id") % 3 == 0, f"a photo of {TRIGGER} person").when(F.col("ref_id") % 3 == 1, "a photo").otherwise("")
    a = emb_audit(spark, sf, PROMPTED, PROMPTED_LEVELS, trigger=TRIGGER, prompt=words)
    found = a.regions.groupBy("ref_id").agg(F.count(F.lit(1)).alias("regions"), F.sum("mass").alias("mass"), F.min_by(F.struct("prompt_collapse", "snap"), "region").alias("lead"))
    peak = a.maps.groupBy("ref_id").agg(F.max("s_prompt").alias("peak"))
    return peak.join(found, "ref_id", "left").select("ref_id", F.round("peak", 6).alias("peak_prompt_collapse"), "regions", F.round("mass", 6).alias("mass"),
                                                     F.round("lead.prompt_collapse", 6).alias("prompt_collapse"), F.round("lead.snap", 4).alias("snap"))


CHANNELS, ROWS, COLS = 2, 4, 8
CHANNEL_PLANTED = [ch * ROWS * COLS + cell for ch in range(CHANNELS) for cell in [r * COLS + c for r in range(1, 4) for c in range(2, 6)]]


def channel_sql(select, cfg=PROMPTED, levels=PROMPTED_LEVELS, draws=2):
    """The whole audit over EMB read as two channels of a 4 x 8 grid."""
    n = ROWS * COLS
    parts = {k: b.SQL[k] for k in mq.PAIR}
    parts["planted"] = f"SELECT unnest({CHANNEL_PLANTED})::BIGINT AS cell"
    parts["logw"] = b.SQL["logw"].replace("THEN 16 ELSE 48", f"THEN {len(CHANNEL_PLANTED)} ELSE {CHANNELS * n - len(CHANNEL_PLANTED)}")
    steps = ("scaled", "noised", "dist", "logits", "resp", "rcells", "post1", "post")
    for tag, stream in (("", "noise"), ("_k", "confirmation")):
        parts[f"draws{tag}"] = b.sql_draws(stream, draws, b.CELLS, levels)
        for step in steps:
            body = b.SQL[step]
            for name in ("draws", *steps[:-1]):
                body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", body)
            parts[f"{step}{tag}"] = body
    both = f"""SELECT ref_id, level_ix, draw, cell % {n} AS cell, cell // {n} AS ch, max(a) / max(s) AS ratio, max(rho) FILTER (model <> 'target') AS rho_base, max(rho) FILTER (model <> 'base') AS rho_target,
      max(mean) FILTER (model <> 'target') AS x0_base, max(mean) FILTER (model <> 'base') AS x0_target, max(e) FILTER (model <> 'target') AS eps_base,
      max(e) FILTER (model <> 'base') AS eps_target, max(x0) AS x0, 0.0 AS rho_uncond
      FROM (SELECT *, variance * a * a / (s * s) AS rho, (x - a * mean) / s AS e FROM {{}}) p GROUP BY ref_id, level_ix, draw, p.cell"""
    parts["m"] = both.format("post")
    parts["conf"] = both.format("post_k")
    return probe_sql.text(parts, COLS, cfg, select, channels=CHANNELS)


@query("memorization_channels", channel_sql("""SELECT ref_id, cell, round(s, 6) AS s, coalesce(region, 0) AS region, CASE WHEN region IS NOT NULL THEN round(mass, 6) END AS mass, round(membership_snap, 4) AS membership_snap
  FROM maps LEFT JOIN clus USING (ref_id, cell) LEFT JOIN regs USING (ref_id, root) JOIN msnap USING (ref_id)"""))
def _(spark, sf):
    """Maps, regions and snaps of images with two channels: models score coordinates, the detector sees cells."""
    lat = mq.latents(spark, sf)
    model = mq.mx.stored_pair(lat, CHANNEL_PLANTED, mq.KAPPA, mq.MEMBER_WEIGHT)
    roles = lat.select("pair", "ref_id").distinct().withColumn("role", F.lit("reference"))
    a = audit.run(lat.select("pair", "ref_id", "cell", "value"), roles, model, PROMPTED, PROMPTED_LEVELS, ROWS, COLS, channels=CHANNELS)
    regs = a.cells.join(a.regions.select(*audit.TEST, "root", "region", "mass"), [*audit.TEST, "root"]).select("ref_id", "cell", "region", "mass")
    out = a.maps.select("ref_id", "cell", "s").join(regs, ["ref_id", "cell"], "left").join(a.summary.select("ref_id", "membership_snap"), "ref_id")
    return out.select("ref_id", long("cell"), F.round("s", 6).alias("s"), F.coalesce("region", F.lit(0)).cast("bigint").alias("region"), F.round("mass", 6).alias("mass"), F.round("membership_snap", 4).alias("membership_snap"))


# --- scouted and calibrated -------------------------------------------------

CAL = replace(AUDIT, draws=2, confirmation_draws=2, scout_draws=2, max_levels=3, minimum_controls=9)
CAL_LEVELS = (0.0, 0.2, 0.4, 2.0, 3.0)
CONTROLS = 19


def calibrated_sql(select, cfg=CAL, levels=CAL_LEVELS, controls=CONTROLS, extra=None):
    """The audit with scouted levels and base-sample controls as one oracle statement.

    A test is an image under one level window: references under their own, controls under every window that occurs.
    """
    parts = {n: b.SQL[n] for n in mq.PAIR}
    parts["edges"] = "SELECT comp, (row_number() OVER (ORDER BY comp) - 1.0) / k AS lo, row_number() OVER (ORDER BY comp) * 1.0 / k AS hi FROM (SELECT DISTINCT comp FROM base_means), pooled"
    parts["drawn"] = f"""SELECT id AS ref_id, cell, mean + sqrt(s2) * {b.sql_normal('d')} AS value FROM (SELECT -k::BIGINT AS id, m.cell, mean, s2, {b.sql_prf('control', "-k || ':' || m.cell")} AS d
      FROM range(1, {controls + 1}) q(k) JOIN edges ON {b.sql_uniform(b.sql_prf('control', '-k'))} >= lo AND {b.sql_uniform(b.sql_prf('control', '-k'))} < hi JOIN base_means m ON m.comp = edges.comp, (SELECT s2 FROM pooled))"""
    parts["images"] = "SELECT ref_id, cell, value FROM emb UNION ALL SELECT ref_id, cell, value FROM drawn"
    steps = ("scaled", "noised", "dist", "logits", "resp", "rcells", "post1", "post")
    for tag, stream, count in (("_s", "scout", cfg.scout_draws), ("", "noise", cfg.draws), ("_k", "confirmation", cfg.confirmation_draws)):
        parts[f"draws{tag}"] = b.sql_draws(stream, count, b.CELLS, levels)
        for step in steps:
            body = b.SQL[step]
            if step == "noised" and tag != "_s":
                body = body.replace("FROM emb e", "FROM images e")
            if step == "dist" and tag == "_s":
                body = body.replace("GROUP BY", "WHERE model <> 'target' GROUP BY")
            for name in ("draws", *steps[:-1]):
                body = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {name}{tag}", body)
            parts[f"{step}{tag}"] = body
    near = probe_sql.near("a", "c", b.SIDE, cfg.gate_smoothing)
    parts["cm"] = "SELECT ref_id, level_ix, cell, avg(variance * a * a / (s * s)) AS rho FROM post_s GROUP BY ref_id, level_ix, cell"
    parts["lv"] = f"""SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY level_ix) AS n, released >= {cfg.scout_min_released} AS passing FROM (
      SELECT ref_id, level_ix, avg((smooth BETWEEN {cfg.release_threshold} AND {cfg.mixing_limit})::INT::DOUBLE) AS released FROM (
        SELECT a.ref_id, a.level_ix, a.cell, avg(c.rho) AS smooth FROM cm a JOIN cm c ON a.ref_id = c.ref_id AND a.level_ix = c.level_ix AND {near} GROUP BY a.ref_id, a.level_ix, a.cell) GROUP BY ref_id, level_ix)"""
    parts["runs"] = """SELECT ref_id, run, sum(released) AS area, min(n) AS lo, max(n) AS hi, min(n) FILTER (released >= 0.5) AS half FROM (
      SELECT *, n - row_number() OVER (PARTITION BY ref_id ORDER BY level_ix) AS run FROM lv WHERE passing) GROUP BY ref_id, run"""
    w = cfg.max_levels
    parts["wins"] = f"""SELECT ref_id, CASE WHEN hi - lo + 1 > {w} THEN least(coalesce(half, lo), hi + 1 - {w}) ELSE lo END - 1 AS win_lo,
      CASE WHEN hi - lo + 1 > {w} THEN least(coalesce(half, lo), hi + 1 - {w}) + {w - 1} ELSE hi END - 1 AS win_hi FROM runs QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY area DESC, lo) = 1"""
    parts["tests"] = """SELECT row_number() OVER (ORDER BY win_lo, win_hi, id) AS tid, *, win_hi - win_lo + 1 AS levels FROM (
      SELECT r.ref_id AS id, coalesce(win_lo, -1) AS win_lo, coalesce(win_hi, -2) AS win_hi, false AS control FROM (SELECT DISTINCT ref_id FROM emb) r LEFT JOIN wins ON wins.ref_id = r.ref_id
      UNION ALL SELECT c.ref_id, v.win_lo, v.win_hi, true FROM (SELECT DISTINCT ref_id FROM drawn) c, (SELECT DISTINCT win_lo, win_hi FROM wins) v)"""
    both = """SELECT tid AS ref_id, level_ix, draw, cell, max(a) / max(s) AS ratio, max(rho) FILTER (model <> 'target') AS rho_base, max(rho) FILTER (model <> 'base') AS rho_target,
      max(mean) FILTER (model <> 'target') AS x0_base, max(mean) FILTER (model <> 'base') AS x0_target, max(e) FILTER (model <> 'target') AS eps_base,
      max(e) FILTER (model <> 'base') AS eps_target, max(x0) AS x0, 0.0 AS rho_uncond
      FROM (SELECT *, variance * a * a / (s * s) AS rho, (x - a * mean) / s AS e FROM {}) p JOIN tests ON id = p.ref_id AND level_ix BETWEEN win_lo AND win_hi GROUP BY tid, level_ix, draw, cell"""
    parts["m"] = both.format("post")
    parts["conf"] = both.format("post_k")
    alpha = cfg.alpha
    after = {
        "tsum": f"""SELECT t.*, coalesce(max_mass, 0) AS max_mass, coalesce(membership_snap, 1) AS membership_snap, coalesce(frame_snap, 1) AS frame_snap, coalesce(na, 0) AS negative_area FROM tests t
          LEFT JOIN (SELECT ref_id, max(mass) AS max_mass FROM regs GROUP BY ref_id) g ON g.ref_id = tid LEFT JOIN msnap ON msnap.ref_id = tid
          LEFT JOIN (SELECT ref_id, avg((neg >= {cfg.collapse_threshold})::INT::DOUBLE) FILTER (ever) AS na FROM sust GROUP BY ref_id) s ON s.ref_id = tid""",
        "nulls": "SELECT win_lo, win_hi, count(*) AS n, list(max_mass) AS masses, list(membership_snap) AS snaps FROM tsum WHERE control GROUP BY win_lo, win_hi",
        "cal": f"""SELECT *, p_value IS NULL OR p_value <= {alpha} AS counts FROM (SELECT tid, region, regs.cells, regs.mass, regs.mean_collapse, regs.peak_collapse, regs.root,
          [{', '.join(str(v) for v in levels)}][peak_level + 1] AS peak_level, rsnap.snap, (1 + len(list_filter(masses, lambda v: v >= mass)))::DOUBLE / (1 + n) AS p_value FROM regs JOIN tests ON tid = regs.ref_id AND NOT control
          JOIN peaks ON peaks.ref_id = regs.ref_id AND peaks.root = regs.root JOIN rsnap ON rsnap.ref_id = regs.ref_id AND rsnap.root = regs.root AND rsnap.level_ix = peak_level
          LEFT JOIN nulls ON nulls.win_lo = tests.win_lo AND nulls.win_hi = tests.win_hi)""",
        "heads": """SELECT tid, count(*) AS found, count(*) FILTER (counts) AS counted, sum(cells / 64.0::DOUBLE) FILTER (counts) AS counted_area, arg_min(mass, region) FILTER (counts) AS mass,
          arg_min(mean_collapse, region) FILTER (counts) AS mean_collapse, arg_min(peak_collapse, region) FILTER (counts) AS peak_collapse, arg_min(peak_level, region) FILTER (counts) AS peak_level,
          arg_min(coalesce(p_value, -1), region) FILTER (counts) AS lead_p, arg_min(snap, region) FILTER (counts) AS snap FROM cal GROUP BY tid""",
        "judged": "SELECT * FROM (" + verdict_sql("""SELECT t.tid, t.id AS run_id, t.win_lo, t.win_hi, levels, coalesce(n, 0) AS n_controls, n AS had, coalesce(found, 0) AS found, coalesce(counted, 0) AS counted, counted_area,
          negative_area, mass, mean_collapse, peak_collapse, peak_level, nullif(lead_p, -1) AS p_value, NULL::DOUBLE AS prompt_collapse, snap, membership_snap, frame_snap,
          (1 + len(list_filter(snaps, lambda v: v >= membership_snap)))::DOUBLE / (1 + n) AS snap_p, false AS issue
          FROM tsum t LEFT JOIN heads ON heads.tid = t.tid LEFT JOIN nulls ON nulls.win_lo = t.win_lo AND nulls.win_hi = t.win_hi WHERE NOT control""", cfg) + ")",
        **(extra or {})}
    return probe_sql.text(parts, b.SIDE, cfg, select, after)


@query("h26_calibrated_audit", calibrated_sql("""SELECT run_id AS ref_id, win_lo, win_hi, n_controls, found, counted, round(p_value, 6) AS p_value, round(snap, 4) AS snap, round(membership_snap, 4) AS membership_snap,
  round(snap_p, 6) AS snap_p, verdict, reasons FROM judged"""))
def _(spark, sf):
    """Scouted levels and 19 base-sample controls in the same plan."""
    v = emb_audit(spark, sf, CAL, CAL_LEVELS, scout=True, controls=CONTROLS).verdicts
    return v.select("ref_id", long("win_lo"), long("win_hi"), long("n_controls"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.coalesce("counted", F.lit(0)).cast("bigint").alias("counted"),
                    F.round("lead.p_value", 6).alias("p_value"), F.round("lead.snap", 4).alias("snap"), F.round("membership_snap", 4).alias("membership_snap"), F.round("snap_p", 6).alias("snap_p"),
                    "verdict", probe.reasons_text(F.col("reasons")).alias("reasons"))


EMPTY = replace(CAL, max_levels=2, scout_min_released=0.125, minimum_controls=0)
EMPTY_LEVELS = (-1.0, 0.0)


@query("h34_empty_path", calibrated_sql("""SELECT run_id AS ref_id, levels, verdict, reasons, round(membership_snap, 4) AS membership_snap, round(frame_snap, 4) AS frame_snap, found,
  coalesce(layer, {'n': 64, 'v': 0}).n AS layer_cells, round(coalesce(layer, {'n': 64, 'v': 0}).v, 6) AS layer_sum FROM judged LEFT JOIN (
  SELECT maps.ref_id AS tid, {'n': count(*), 'v': sum(CASE WHEN counts THEN greatest(s, 0) ELSE 0 END)} AS layer FROM maps LEFT JOIN clus USING (ref_id, cell) LEFT JOIN cal ON cal.tid = maps.ref_id AND cal.root = clus.root
  GROUP BY maps.ref_id) USING (tid)""", EMPTY, EMPTY_LEVELS, 0).replace("{'n': 64, 'v': 0}", "{'n': 64::BIGINT, 'v': 0::DOUBLE}"))
def _(spark, sf):
    """Images whose scout selects no level keep a row, a layer of zeros and a snap of 1, and end inconclusive."""
    a = emb_audit(spark, sf, EMPTY, EMPTY_LEVELS, scout=True)
    layer = audit.heat_layers(a, b.CELLS).where("layer = 'collapse'").groupBy(*audit.TEST).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    out = a.verdicts.join(layer, audit.TEST, "left")
    return out.select("ref_id", long("levels"), "verdict", probe.reasons_text(F.col("reasons")).alias("reasons"), F.round("membership_snap", 4).alias("membership_snap"), F.round("frame_snap", 4).alias("frame_snap"),
                      F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), F.col("n").alias("layer_cells"), F.round("v", 6).alias("layer_sum"))
