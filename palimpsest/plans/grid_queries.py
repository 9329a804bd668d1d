"""Registered queries: keyed draws, grid maps and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import keyed, noise
from palimpsest.operators import components, evaluate, grid, ranking
from palimpsest.plans import bindings as b
from palimpsest.plans.registry import query, table


def r6(column, name):
    return F.round(column, 6).alias(name)


# --- E: keyed randomness ----------------------------------------------------

@query("e1_keyed_prf", f"SELECT event_id, substr({b.sql_prf('scenario', 'event_id')}, 1, 16) AS prf FROM events")
def _(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.substring(keyed.prf_hex("scenario", F.col("event_id")), 1, 16).alias("prf"))


@query("e2_schedule_id", """SELECT n_name, substr(sha256(n_name), 1, 16) AS schedule_id FROM nation""")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_name", keyed.schedule_id(F.col("n_name")).alias("schedule_id"))


@query("e3_level_key", """SELECT l_discount AS discount, CAST(1000000 + round(64 * (l_discount * 100 - 5)) AS BIGINT) AS level_key, count(*) AS n
  FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return (li.select(F.col("l_discount").alias("discount"), keyed.level_key(F.col("l_discount") * 100 - 5).alias("level_key"))
            .groupBy("discount", "level_key").agg(F.count(F.lit(1)).alias("n")))


@query("e4_keyed_normals", f"""SELECT event_id, round({b.sql_normal("d")}, 6) AS eps FROM
  (SELECT event_id, {b.sql_prf('noise', "(user_id % 7) || ':' || event_id")} AS d FROM events)""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    digest = keyed.prf_hex("noise", F.concat_ws(":", F.col("user_id") % 7, "event_id"))
    return ev.select("event_id", digest.alias("d")).select("event_id", r6(keyed.normal(F.col("d")), "eps"))


@query("e5_rademacher", f"""SELECT user_id, sum(v) AS total, count(*) AS n FROM (SELECT user_id,
  CASE WHEN {b.sql_normal("d")} >= 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS v FROM (SELECT user_id, {b.sql_prf('rademacher', 'event_id')} AS d FROM events)) GROUP BY user_id""")
def _(spark, sf):
    ev = table(spark, sf, "events")
    v = keyed.sign(keyed.normal(keyed.prf_hex("rademacher", F.col("event_id"))))
    return ev.select("user_id", v.alias("v")).groupBy("user_id").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))


_STREAMS = ", ".join(f"('{s}')" for s in keyed.STREAMS)


@query("e7_partition_invariance", f"""SELECT event_id, round({b.sql_normal("d")}, 9) AS eps, 0::BIGINT AS moved FROM (SELECT event_id, {b.sql_prf('scout', 'event_id')} AS d FROM events)""")
def _(spark, sf):
    """Draws over the table as it lies, and again dealt out anew: none moves."""
    draw = lambda df: df.select("event_id", keyed.normal(keyed.prf_hex("scout", F.col("event_id"))).alias("eps"))
    ev = table(spark, sf, "events").select("event_id")
    again = draw(ev.repartition(13, F.col("event_id") % 7)).withColumnRenamed("eps", "_again")
    return draw(ev).join(again, "event_id").select("event_id", F.round("eps", 9).alias("eps"), (F.col("eps") != F.col("_again")).cast("bigint").alias("moved"))


@query("e6_named_streams", f"""SELECT stream, count(*) AS n, count(DISTINCT prf) AS distinct_prf, min(prf) AS lowest FROM (
  SELECT stream, substr({b._hmac(f"'{keyed.VERSION}|' || stream || '|' || o_orderkey")}, 1, 16) AS prf
  FROM orders, (SELECT * FROM (VALUES {_STREAMS}) AS v(stream))) GROUP BY stream""")
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(F.array(*[F.lit(s) for s in keyed.STREAMS])).alias("stream"))
    prf = F.substring(keyed.prf_hex(F.col("stream"), F.col("o_orderkey")), 1, 16)
    return (rows.select("stream", prf.alias("prf")).groupBy("stream")
            .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prf").alias("distinct_prf"), F.min("prf").alias("lowest")))


# --- F1..F3: noise scales ---------------------------------------------------

@query("f1_variance_preserving_scales", """SELECT l, round(sqrt(1/(1+exp(-l))), 6) AS alpha, round(sqrt(1/(1+exp(l))), 6) AS sigma, n FROM
  (SELECT p_size / 4.0 - 6 AS l, count(*) AS n FROM part GROUP BY 1)""")
def _(spark, sf):
    p = table(spark, sf, "part").groupBy((F.col("p_size") / 4.0 - 6).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("l", r6(noise.alpha(F.col("l")), "alpha"), r6(noise.sigma(F.col("l")), "sigma"), "n")


@query("f2_flow_scales", """SELECT l, round(1 - 1/(1+exp(l/2)), 6) AS alpha, round(1/(1+exp(l/2)), 6) AS sigma, n FROM
  (SELECT p_size / 4.0 - 6 AS l, count(*) AS n FROM part GROUP BY 1)""")
def _(spark, sf):
    p = table(spark, sf, "part").groupBy((F.col("p_size") / 4.0 - 6).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    return p.select("l", r6(noise.flow_alpha(F.col("l")), "alpha"), r6(noise.flow_sigma(F.col("l")), "sigma"), "n")


@query("f3_level_grid", """SELECT s_suppkey, k AS level_ix, round(-10 + 20.0 * k / (greatest(s_suppkey % 6, 2) - 1), 6) AS level
  FROM supplier, range(6) t(k) WHERE k < greatest(s_suppkey % 6, 2)""")
def _(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.greatest(F.col("s_suppkey") % 6, F.lit(2)).alias("n"))
    return (noise.level_grid(s, "n", -10.0, 10.0).select("s_suppkey", F.col("level_ix").cast("bigint").alias("level_ix"), r6(F.col("level"), "level")))


# --- G: grid math -----------------------------------------------------------

@query("g1_channel_mean", b.with_sql(["emb"], "SELECT label, cell, round(avg(value), 6) AS value FROM emb GROUP BY label, cell"))
def _(spark, sf):
    return grid.channel_mean(b.latents(spark, sf), ["label"]).select("label", F.col("cell").cast("bigint").alias("cell"), r6(F.col("value"), "value"))


_C = "rho_base - rho_target"


@query("g2_draw_mean", b.with_sql(["meas"], f"SELECT ref_id, level_ix, cell, round(avg({_C}), 9) AS mean FROM meas GROUP BY ref_id, level_ix, cell"))
def _(spark, sf):
    m = b.measures(spark, sf).withColumn("c", F.expr(_C))
    return grid.draw_statistics(m, ["ref_id", "level_ix"], "c").select("ref_id", "level_ix", F.col("cell").cast("bigint").alias("cell"), F.round("mean", 9).alias("mean"))


@query("g3_standard_error", b.with_sql(["meas"], f"""SELECT ref_id, level_ix, cell, CASE WHEN count(*) >= 2 THEN
  round(stddev_samp({_C}) / sqrt(count(*)), 9) END AS se FROM meas GROUP BY ref_id, level_ix, cell"""))
def _(spark, sf):
    m = b.measures(spark, sf).withColumn("c", F.expr(_C))
    se = F.when(F.col("se") < float("inf"), F.round("se", 9))
    return grid.draw_statistics(m, ["ref_id", "level_ix"], "c").select("ref_id", "level_ix", F.col("cell").cast("bigint").alias("cell"), se.alias("se"))


_T95 = "[" + ", ".join("'inf'::DOUBLE" if t == float("inf") else f"{t}::DOUBLE" for t in grid.T95) + "]"


@query("g4_t95", f"""SELECT q AS df, n, CASE WHEN q < 16 THEN ({_T95})[greatest(q, 0) + 1] WHEN q < 20 THEN 1.725 WHEN q < 30 THEN 1.697
  ELSE 1.645 END AS t FROM (SELECT CAST(l_quantity AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1)""")
def _(spark, sf):
    q = table(spark, sf, "lineitem").groupBy(F.col("l_quantity").cast("bigint").alias("df")).agg(F.count(F.lit(1)).alias("n"))
    return q.select("df", "n", grid.t95(F.col("df")).alias("t"))


_BOX = """SELECT a.ref_id, a.cell, round(avg(c.value), 9) AS smooth FROM emb a JOIN emb c ON a.ref_id = c.ref_id
  AND abs(a.cell // 8 - c.cell // 8) <= 1 AND abs(a.cell % 8 - c.cell % 8) <= 1 GROUP BY a.ref_id, a.cell"""


@query("g5_box_mean_dense", b.with_sql(["emb"], _BOX))
def _(spark, sf):
    out = grid.box_mean(b.latents(spark, sf).repartition("ref_id"), ["ref_id"], {"value": "smooth"}, 8, 8, 1, dense=True)
    return out.select("ref_id", F.col("cell").cast("bigint").alias("cell"), F.round("smooth", 9).alias("smooth"))


@query("g5_box_mean_sparse", b.with_sql(["meas"], """SELECT a.ref_id, a.level_ix, a.draw, a.cell, round(avg(c.rho_base), 9) AS smooth FROM meas a JOIN meas c
  ON a.ref_id = c.ref_id AND a.level_ix = c.level_ix AND a.draw = c.draw AND abs(a.cell // 16 - c.cell // 16) <= 2 AND abs(a.cell % 16 - c.cell % 16) <= 2
  GROUP BY a.ref_id, a.level_ix, a.draw, a.cell"""))
def _(spark, sf):
    m = b.measures(spark, sf).select("ref_id", "level_ix", "draw", "cell", "rho_base")
    out = grid.box_mean(m, ["ref_id", "level_ix", "draw"], {"rho_base": "smooth"}, 16, 16, 2)
    return out.select("ref_id", "level_ix", F.col("draw").cast("bigint").alias("draw"), F.col("cell").cast("bigint").alias("cell"), F.round("smooth", 9).alias("smooth"))


def sql_reach(mask: str, cols: int) -> str:
    """Recursive reachability over ``mask(ref_id, cell)``."""
    return f"""SELECT ref_id, cell AS start, cell FROM {mask} UNION
      SELECT r.ref_id, r.start, m.cell FROM reach r JOIN {mask} m ON m.ref_id = r.ref_id AND (
        (m.cell // {cols} = r.cell // {cols} AND abs(m.cell - r.cell) = 1) OR abs(m.cell - r.cell) = {cols})"""


def with_reach(names: list[str], mask: str, cols: int, select: str, **extra: str) -> str:
    parts = [f"{n} AS MATERIALIZED ({b.SQL[n]})" for n in names]
    parts += [f"{n} AS MATERIALIZED ({t})" for n, t in extra.items()]
    return (f"WITH RECURSIVE {', '.join(parts)}, mask AS MATERIALIZED ({mask}), reach AS ({sql_reach('mask', cols)}), "
            f"comp AS MATERIALIZED (SELECT ref_id, cell, min(start) AS root FROM reach GROUP BY ref_id, cell) {select}")


_ORDERED = """SELECT ref_id, cell, component, size FROM comp JOIN (SELECT ref_id, root, size,
  row_number() OVER (PARTITION BY ref_id ORDER BY size DESC, root) AS component FROM
  (SELECT ref_id, root, count(*) AS size FROM comp GROUP BY ref_id, root)) USING (ref_id, root)"""
_G6 = with_reach(["emb"], "SELECT ref_id, cell FROM emb WHERE value > 0", 8, _ORDERED)


def _components(spark, sf, label):
    mask = b.latents(spark, sf).where("value > 0").select("ref_id", "cell")
    labelled = label(mask)
    return labelled.join(components.ordered_components(labelled, ["ref_id"]), ["ref_id", "root"]).select(
        "ref_id", "cell", F.col("component").cast("bigint").alias("component"), "size")


@query("g6_components", _G6)
def _(spark, sf):
    return _components(spark, sf, lambda m: components.components(m, ["ref_id"], 8, 8))


@query("g6_components_distributed", _G6)
def _(spark, sf):
    return _components(spark, sf, lambda m: components.large_components(m, ["ref_id"], 8))


@query("g7_iou", b.with_sql(["emb"], """SELECT label, round(count(*) FILTER (l AND r) / count(*)::DOUBLE, 6) AS iou FROM
  (SELECT label, cell, bool_or(value > 2.5) AS l, bool_or(value < -2.5) AS r FROM emb GROUP BY label, cell HAVING bool_or(value > 2.5) OR bool_or(value < -2.5)) GROUP BY label"""))
def _(spark, sf):
    emb = b.latents(spark, sf)
    return grid.iou(emb.where("value > 2.5"), emb.where("value < -2.5"), ["label"]).select("label", r6(F.col("iou"), "iou"))


@query("g8_pack_tokens", b.with_sql(["emb"], """SELECT ref_id, ((cell // 8) // 2) * 4 + (cell % 8) // 2 AS token,
  label * 4 + ((cell // 8) % 2) * 2 + (cell % 8) % 2 AS packed_channel, cell AS unpacked_cell, round(value, 6) AS value FROM emb"""))
def _(spark, sf):
    emb = b.latents(spark, sf).withColumnRenamed("label", "channel")
    packed = grid.pack_tokens(emb, 8, 8)
    back = grid.unpack_tokens(packed.select("*", F.col("token").alias("t"), F.col("packed_channel").alias("pc")), 8, 8)
    return back.select("ref_id", F.col("t").cast("bigint").alias("token"), F.col("pc").cast("bigint").alias("packed_channel"),
                       F.col("cell").cast("bigint").alias("unpacked_cell"), r6(F.col("value"), "value"))


@query("g9_mask_channels", b.with_sql(["emb"], """SELECT ref_id, cell, round(CASE WHEN m.cell IS NULL THEN 0 ELSE value END, 6) AS value FROM emb
  LEFT JOIN (SELECT DISTINCT label, cell FROM emb WHERE value > 2.0) m USING (label, cell)"""))
def _(spark, sf):
    emb = b.latents(spark, sf)
    out = grid.mask_channels(emb, emb.where("value > 2.0"), ["label"])
    return out.select("ref_id", F.col("cell").cast("bigint").alias("cell"), r6(F.col("value"), "value"))


# --- K1..K3, H27, H28 -------------------------------------------------------

@query("k1_median", "SELECT l_returnflag, count(*) AS n, round(median(l_extendedprice), 6) AS median FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    out = ranking.order_statistics(table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", r6(F.col("median"), "median"))


@query("k2_auc", b.with_sql(["score"], """SELECT sum(l)::BIGINT AS positives, sum(1 - l)::BIGINT AS negatives,
  round((sum(l * r) - sum(l) * (sum(l) + 1) / 2.0) / (sum(l) * sum(1 - l)), 6) AS auc FROM
  (SELECT label AS l, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM score)"""))
def _(spark, sf):
    return evaluate.auc(b.scores(spark, sf), "score", F.col("label") == 1).select("positives", "negatives", r6(F.col("auc"), "auc"))


@query("k3_spearman", """SELECT count(*) AS n, round(corr(rx, ry), 6) AS spearman FROM (SELECT
  row_number() OVER (ORDER BY user_id, event_id) AS rx, row_number() OVER (ORDER BY value, event_id) AS ry FROM events)""")
def _(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    return evaluate.spearman(ev, "user_id", "value", "event_id").select("n", r6(F.col("spearman"), "spearman"))


_EXCEED = """SELECT run_id, id, round((1 + n - below) / (1.0 + n), 6) AS p_value, n AS controls FROM (SELECT run_id, id, role,
  count(*) FILTER (role = 'control') OVER (PARTITION BY run_id) AS n,
  coalesce(count(*) FILTER (role = 'control') OVER (PARTITION BY run_id ORDER BY mass RANGE UNBOUNDED PRECEDING EXCLUDE TIES), 0)
    - CASE WHEN role = 'control' THEN 1 ELSE 0 END AS below FROM ctrl) WHERE role = 'reference'"""


@query("h27_exceedance", b.with_sql(["ctrl"], _EXCEED))
def _(spark, sf):
    out = evaluate.exceedance(b.masses(spark, sf), "mass", ["run_id"], F.col("role") == "control")
    return out.select("run_id", "id", r6(F.col("p_value"), "p_value"), "controls")


@query("h28_significance", b.with_sql(["ctrl"], f"""SELECT run_id, significance, count(*) AS n, bool_and(significance <> 'not-significant') AS counts FROM
  (SELECT run_id, CASE WHEN p_value IS NULL THEN 'uncalibrated' WHEN p_value <= 0.05 THEN 'significant' ELSE 'not-significant' END AS significance
   FROM ({_EXCEED.replace("round((1 + n - below) / (1.0 + n), 6)", "CASE WHEN n > 0 THEN (1 + n - below) / (1.0 + n) END")})) GROUP BY ALL"""))
def _(spark, sf):
    out = evaluate.exceedance(b.masses(spark, sf), "mass", ["run_id"], F.col("role") == "control")
    sig = out.select("run_id", evaluate.significance(F.col("p_value")).alias("significance"))
    return sig.groupBy("run_id", "significance").agg(F.count(F.lit(1)).alias("n"),
                                                     F.every(evaluate.counts(F.col("significance"))).alias("counts"))
