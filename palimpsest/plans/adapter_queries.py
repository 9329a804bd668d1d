"""Registered queries: adapter layouts, structure, plans, updates and spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import adapters as ad
from palimpsest.operators import layers as ly
from palimpsest.operators import matrices as mt
from palimpsest.plans import bindings as b
from palimpsest.plans.registry import query, table
from palimpsest.session import materialized


def r6(column, name):
    return F.round(column, 6).alias(name)


def pick(items, index):
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def sql_list(items):
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


SUFFIXES = [s for s, _ in ad.SUFFIX_ROLES] + [".bias"]

# every ending, one unit per brand
b.SQL["mix"] = f"""SELECT DISTINCT p_brand AS unit, concat('blocks.', p_size, '.attn_', p_partkey % 3, {sql_list(SUFFIXES)}[1 + (p_partkey // 3) % {len(SUFFIXES)}]) AS name,
  2 + p_size % 5 AS d0, 3 + p_size % 4 AS d1 FROM part"""
# small units: embeddings, plain models, adapters
_SMALL = (("emb_params",), ("clip_l", "x.clip_g"), ("m.0.weight", "m.0.bias", "norm.weight", "head_weight"), ("a.lora_A.weight", "a.lora_B.weight", "a.alpha"), ("q.alpha", "q.weight"))
b.SQL["small"] = f"""SELECT c_custkey AS unit, unnest([{', '.join(sql_list(s) for s in _SMALL)}][1 + c_custkey % 5]) AS name, 1 + c_nationkey AS d0, 4 AS d1 FROM customer"""


def mix(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("unit"), F.concat(F.lit("blocks."), F.col("p_size").cast("string"), F.lit(".attn_"), (k % 3).cast("string"), pick(SUFFIXES, F.expr("p_partkey div 3") % len(SUFFIXES))).alias("name"),
        F.lit("F32").alias("dtype"), F.array((2 + F.col("p_size") % 5).cast("bigint"), (3 + F.col("p_size") % 4).cast("bigint")).alias("shape"),
        F.lit(8).cast("bigint").alias("bytes")).distinct()


def small(spark, sf):
    c = table(spark, sf, "customer")
    names = F.element_at(F.array(*[F.array(*[F.lit(n) for n in s]) for s in _SMALL]), (1 + F.col("c_custkey") % 5).cast("int"))
    return c.select(F.col("c_custkey").alias("unit"), F.explode(names).alias("name"), F.lit("BF16").alias("dtype"),
                    F.array((1 + F.col("c_nationkey")).cast("bigint"), F.lit(4).cast("bigint")).alias("shape"), F.lit(8).cast("bigint").alias("bytes"))


def roles_sql(source):
    role = "CASE " + " ".join(f"WHEN ends_with(name, '{s}') THEN '{r}'" for s, r in ad.SUFFIX_ROLES) + " END"
    cut = "CASE " + " ".join(f"WHEN ends_with(name, '{s}') THEN {len(s)}" for s, r in ad.SUFFIX_ROLES) + " END"
    return f"SELECT *, {role} AS role, left(name, length(name) - {cut}) AS module FROM {source}"


@query("c1_suffix_roles", b.with_sql(["mix"], f"SELECT unit, name, role, module FROM ({roles_sql('mix')})"))
def _(spark, sf):
    return ad.split_roles(mix(spark, sf)).select("unit", "name", "role", "module")


def _mods(source):
    def has(r):
        return f"bool_or(role = '{r}')"

    return f"""SELECT unit, module, CASE WHEN {has('lora_up')} AND {has('lora_down')} THEN 'lora' WHEN {has('hada_w1_a')} AND {has('hada_w1_b')} AND {has('hada_w2_a')} AND {has('hada_w2_b')} THEN 'loha'
      WHEN {has('lokr_w1')} OR {has('lokr_w1_a')} THEN CASE WHEN ({has('lokr_w1')} OR true) AND ({has('lokr_w2')} OR {has('lokr_w2_a')}) THEN 'lokr' ELSE 'dropped' END WHEN {has('diff')} THEN 'diff' END AS kind,
      any_value(d0) AS d0, any_value(d1) AS d1, coalesce({has('lokr_w1')}, false) AS w1, coalesce({has('lokr_w1_b')}, false) AS w1b, coalesce({has('lokr_w2')}, false) AS w2, coalesce({has('lokr_w2_b')}, false) AS w2b,
      coalesce({has('dora')}, false) AS dora, count(DISTINCT role) AS roles FROM ({roles_sql(source)}) WHERE role IS NOT NULL GROUP BY unit, module"""


_LAYOUT = f"""SELECT unit, module, kind, CASE kind WHEN 'lokr' THEN d0 * d0 ELSE d0 END::BIGINT AS out_dim,
  CASE kind WHEN 'lokr' THEN CASE WHEN w1 OR w1b THEN d1 ELSE 0 END * CASE WHEN w2 OR w2b THEN d1 ELSE 0 END ELSE d1 END::BIGINT AS in_dim,
  CASE WHEN kind IN ('lora', 'loha') THEN d0 WHEN kind = 'lokr' AND (w2b OR w1b) THEN d0 END::BIGINT AS rank, dora AND kind <> 'diff' AS has_dora FROM ({_mods('mix')}) WHERE kind IS NOT NULL AND kind <> 'dropped'"""


@query("c2_layout", b.with_sql(["mix"], _LAYOUT))
def _(spark, sf):
    return ad.layout(mix(spark, sf)).select("unit", "module", "kind", "out_dim", "in_dim", "rank", "has_dora")


@query("c2_unassigned", b.with_sql(["mix"], f"""SELECT unit, name FROM ({roles_sql('mix')}) WHERE role IS NULL UNION ALL
  SELECT r.unit, max(r.name) FROM ({roles_sql('mix')}) r JOIN ({_mods('mix')}) m ON m.unit = r.unit AND m.module = r.module WHERE kind IS NULL GROUP BY r.unit, r.module, r.role"""))
def _(spark, sf):
    return ad.unassigned(mix(spark, sf)).select("unit", "name")


_FAMILY = f"""SELECT unit, CASE WHEN bool_or(role IS NOT NULL AND role NOT IN ('alpha', 'dora')) THEN 'adapter' WHEN count(*) <= 4 AND
  bool_and(d0 <= 128 AND regexp_matches(lower(name), 'emb_params|string_to_param|clip_l|clip_g|t5')) THEN 'textualInversion' ELSE 'fullModel' END AS family FROM ({roles_sql('small')}) GROUP BY unit"""


@query("c3_unit_family", b.with_sql(["small"], _FAMILY))
def _(spark, sf):
    return ad.unit_kinds(ad.split_roles(small(spark, sf)))


@query("c4_full_model_modules", b.with_sql(["small"], f"""SELECT s.unit, regexp_replace(name, '\\.weight$', '') AS module, d0::BIGINT AS out_dim, d1::BIGINT AS in_dim FROM small s JOIN ({_FAMILY}) f ON f.unit = s.unit
  WHERE family = 'fullModel' AND ends_with(name, 'weight') AND d0 > 1"""))
def _(spark, sf):
    return ad.layout(small(spark, sf)).where("family = 'fullModel'").select("unit", "module", "out_dim", "in_dim")


@query("c5_unit_format", b.with_sql(["mix"], f"""SELECT unit, CASE WHEN count(DISTINCT kind) = 1 THEN max(kind) ELSE 'mixed' END AS format, count(*) AS modules,
  sum(coalesce(rank * (out_dim + in_dim), out_dim * in_dim))::BIGINT AS rank_parameters FROM ({_LAYOUT}) GROUP BY unit"""))
def _(spark, sf):
    return ad.unit_formats(ad.layout(mix(spark, sf)))


_CONFIG = """concat('{"r": ', CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE CAST(1 + p_size % 16 AS VARCHAR) END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ', "lora_alpha": ' || CAST(p_size AS VARCHAR) END,
  CASE WHEN p_partkey % 2 = 0 THEN ', "use_rslora": true' ELSE '' END, '}')"""


@query("c6_config_scale", f"""SELECT p_partkey, round(alpha / CASE WHEN p_partkey % 2 = 0 THEN sqrt(r) ELSE r END, 6) AS scale FROM (SELECT p_partkey,
  CAST({_CONFIG}->>'lora_alpha' AS DOUBLE) AS alpha, coalesce(CAST({_CONFIG}->>'r' AS DOUBLE), 4) AS r FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    text = F.concat(F.lit('{"r": '), F.when(F.col("p_partkey") % 3 == 0, "null").otherwise((1 + F.col("p_size") % 16).cast("string")),
                    F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.concat(F.lit(', "lora_alpha": '), F.col("p_size").cast("string"))),
                    F.when(F.col("p_partkey") % 2 == 0, ', "use_rslora": true').otherwise(""), F.lit("}"))
    return p.select("p_partkey", r6(ad.config_scale(text, F.lit(4)), "scale"))


# --- weight updates ---------------------------------------------------------

def role(spark, sf, r):
    return b.factors(spark, sf).where(F.col("role") == r).select("module", "i", "j", "v")


def scales(spark, sf):
    f = b.factors(spark, sf).select("module").distinct()
    return f.select("module", ad.factor_scale((F.col("module") % 5 + 1).cast("double"), F.lit(8)).alias("scale"))


def _mm(left, right, out):
    return f"{out} AS MATERIALIZED (SELECT a.module, a.i, c.j, sum(a.v * c.v) AS v FROM fact a JOIN fact c ON a.module = c.module AND a.j = c.i WHERE a.role = {left} AND c.role = {right} GROUP BY ALL)"


_SCALE = "((module % 5 + 1) / 8.0::DOUBLE)"
_FACT = f"WITH fact AS MATERIALIZED ({b.SQL['fact']})"


@query("c7_lora_update", f"{_FACT}, {_mm(0, 1, 'w')} SELECT module, i, j, round(v * {_SCALE}, 6) AS v FROM w")
def _(spark, sf):
    out = mt.low_rank_update(role(spark, sf, 0), role(spark, sf, 1), scales(spark, sf), ["module"])
    return out.select("module", "i", "j", r6(F.col("v"), "v"))


@query("c7_product_issues", f"""{_FACT} SELECT a.module, CASE WHEN b.module IS NULL THEN 'no-factor' ELSE 'inner-sizes' END AS code,
  concat(a.r, 'x', a.c, ' ', coalesce(b.r::VARCHAR, '-'), 'x', coalesce(b.c::VARCHAR, '-')) AS detail FROM (SELECT module, max(i) + 1 AS r, max(j) + 1 AS c FROM fact WHERE role = 0 GROUP BY module) a
  LEFT JOIN (SELECT module, max(i) + 1 AS r, max(j) + 1 AS c FROM fact WHERE role = 1 AND module % 3 > 0 AND (module % 3 > 1 OR i < 5) GROUP BY module) b ON b.module = a.module WHERE b.module IS NULL OR a.c <> b.r""")
def _(spark, sf):
    down = role(spark, sf, 1).where("module % 3 > 0 AND (module % 3 > 1 OR i < 5)")
    return mt.product_issues(role(spark, sf, 0), down, ["module"])


@query("c8_loha_update", f"{_FACT}, {_mm(0, 1, 'w1')}, {_mm(2, 3, 'w2')} SELECT module, i, j, round(w1.v * w2.v * {_SCALE} * 100, 6) AS v FROM w1 JOIN w2 USING (module, i, j)")
def _(spark, sf):
    out = mt.hadamard_update(*[role(spark, sf, r) for r in range(4)], scales(spark, sf), ["module"])
    return out.select("module", "i", "j", r6(F.col("v") * 100, "v"))


@query("c9_lokr_update", f"""{_FACT} SELECT a.module, a.i * 8 + c.i AS i, round(sum(a.v * c.v * ((a.module % 5 + 1) / 8.0::DOUBLE)) * 100, 6) AS total, round(sum(a.v * c.v * ((a.module % 5 + 1) / 8.0::DOUBLE) * (a.j * 8 + c.j)), 6) AS weighted, count(*) AS n
  FROM fact a JOIN fact c ON a.module = c.module WHERE a.role = 0 AND c.role = 1 GROUP BY ALL""")
def _(spark, sf):
    out = mt.kronecker_update(role(spark, sf, 0), role(spark, sf, 1), scales(spark, sf), ["module"])
    return out.groupBy("module", "i").agg(F.round(F.sum("v") * 100, 6).alias("total"), F.round(F.sum(F.col("v") * F.col("j")), 6).alias("weighted"), F.count(F.lit(1)).alias("n"))


@query("c10_dense_flatten", f"{_FACT} SELECT module, role, i, j, round(v, 6) AS v FROM fact")
def _(spark, sf):
    f = b.factors(spark, sf).select("module", "role", "i", F.expr("j div 4").alias("h"), (F.col("j") % 4).alias("w"), "v")
    return mt.flatten_dense(f, [("h", 2), ("w", 4)]).select("module", F.col("role").cast("bigint").alias("role"), "i", "j", r6(F.col("v"), "v"))


@query("c11_decode_notes", b.with_sql(["mix"], f"""SELECT unit, string_agg(note, ' | ' ORDER BY note) AS notes FROM (
  SELECT DISTINCT unit, 'direction-only' AS note FROM ({_LAYOUT}) WHERE has_dora
  UNION ALL SELECT unit, 'unused-factors ' || string_agg(i, ',' ORDER BY i) FROM (SELECT DISTINCT unit, unnest(CASE kind WHEN 'lora' THEN CASE WHEN mid THEN ['lora_mid'] ELSE [] END
      WHEN 'loha' THEN CASE WHEN t1 THEN ['hada_t1', 'hada_t2'] ELSE [] END WHEN 'lokr' THEN CASE WHEN t2 THEN ['lokr_t2'] ELSE [] END ELSE [] END) AS i
    FROM ({_LAYOUT}) JOIN (SELECT unit, module, bool_or(role = 'lora_mid') AS mid, bool_or(role = 'hada_t1') AS t1, bool_or(role = 'lokr_t2') AS t2 FROM ({roles_sql('mix')}) WHERE role IS NOT NULL GROUP BY unit, module) USING (unit, module)) GROUP BY unit
  UNION ALL SELECT unit, 'no-tensor ' || module || ' ' || module || '.alpha' FROM ({_LAYOUT}) JOIN (SELECT unit, module FROM ({roles_sql('mix')}) WHERE role = 'alpha') USING (unit, module) WHERE kind IN ('lora', 'loha', 'lokr') AND length(module) % 2 = 0
  UNION ALL SELECT unit, 'rank-conflict ' || module FROM ({_LAYOUT}) WHERE kind = 'lora' AND out_dim % 2 = 0) GROUP BY unit"""))
def _(spark, sf):
    t = mix(spark, sf)
    mods = materialized(ad.layout(t), "modules").withColumn("up_rank", F.when(F.col("out_dim") % 2 == 0, F.col("rank") + 1).otherwise(F.col("rank")))
    named = ad.split_roles(t)
    decoded = named.withColumn("decoded", ~((F.col("role") == "alpha") & (F.length("module") % 2 == 0)) | F.col("role").isNull())
    notes = ad.decode_notes(mods, decoded)
    return notes.groupBy("unit").agg(F.array_join(F.array_sort(F.collect_list("note")), " | ").alias("notes"))


@query("c12_base_difference", f"""{_FACT} SELECT module, round(sqrt(sum((a.v - c.v) * (a.v - c.v))), 6) AS update_norm, round(sqrt(sum(c.v * c.v)), 6) AS base_norm,
  round(sqrt(sum((a.v - c.v) * (a.v - c.v))) / sqrt(sum(c.v * c.v)), 6) AS relative_update FROM fact a JOIN fact c USING (module, i, j) WHERE a.role = 0 AND c.role = 1 GROUP BY module""")
def _(spark, sf):
    out = mt.relative_update(mt.base_difference(role(spark, sf, 0), role(spark, sf, 1), ["module"]), ["module"])
    return out.select("module", r6(F.col("update_norm"), "update_norm"), r6(F.col("base_norm"), "base_norm"), r6(F.col("relative_update"), "relative_update"))


def _traces(source: str, key: str) -> str:
    """Σσ², Σσ⁴, ... Σσ¹⁶ of 8 x 8 modules as traces of powers of AᵀA: eight of them fix all eight values."""
    same = " AND ".join(f"x.{k} = y.{k}" for k in key.split(", "))
    keyed = ", ".join(f"x.{k}" for k in key.split(", "))
    power = lambda a, c: f"SELECT {keyed}, x.i, y.j, sum(x.v * y.v) AS v FROM {a} x JOIN {c} y ON {same} AND x.j = y.i GROUP BY {keyed}, x.i, y.j"
    trace = lambda n, a, c: f"SELECT {keyed}, {n} AS p, sum(x.v * y.v) AS t FROM {a} x JOIN {c} y ON {same} AND x.i = y.i AND x.j = y.j GROUP BY {keyed}"
    pairs = ((2, "g1", "g1"), (3, "g1", "g2"), (4, "g2", "g2"), (5, "g2", "g3"), (6, "g3", "g3"), (7, "g3", "g4"), (8, "g4", "g4"))
    return (f"a AS MATERIALIZED ({source}), g1 AS MATERIALIZED (SELECT {keyed}, x.j AS i, y.j AS j, sum(x.v * y.v) AS v FROM a x JOIN a y ON {same} AND x.i = y.i GROUP BY {keyed}, x.j, y.j), "
            f"g2 AS MATERIALIZED ({power('g1', 'g1')}), g3 AS MATERIALIZED ({power('g1', 'g2')}), g4 AS MATERIALIZED ({power('g2', 'g2')}), "
            f"traces AS (SELECT {key}, 1 AS p, sum(v * v) AS t FROM a GROUP BY {key} UNION ALL {' UNION ALL '.join(trace(*p) for p in pairs)})")


def _power_sums(sigmas, keys):
    p = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("p")
    return sigmas.select(*keys, "sigma", p).groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("size"), F.round(F.sum(F.pow("sigma", 2 * F.col("p"))), 9).alias("total"))


@query("c13_low_rank_spectrum", f"{_FACT}, {_mm(0, 1, 'w')}, {_traces(f'SELECT module, i, j, v * {_SCALE} AS v FROM w', 'module')} SELECT module, p, 8::BIGINT AS size, round(t, 9) AS total FROM traces")
def _(spark, sf):
    """All singular values, told by the sums of their even powers."""
    sig, _u1 = mt.low_rank_spectrum(role(spark, sf, 0), role(spark, sf, 1), scales(spark, sf), ["module"])
    return _power_sums(sig, ["module"])


@query("c13_dense_spectrum", f"{_FACT}, {_traces('SELECT module, role, i, j, v FROM fact', 'module, role')} SELECT module, role, p, 8::BIGINT AS size, round(t, 9) AS total FROM traces")
def _(spark, sf):
    """All singular values of every module, told by the sums of their even powers."""
    sig = mt.dense_spectrum(b.factors(spark, sf).select("module", "role", "i", "j", "v"), ["module", "role"])
    return _power_sums(sig, ["module", "role"]).withColumn("role", F.col("role").cast("bigint"))


def _top_pair(a, sigmas, u1, keys):
    """Per module: the norm of u₁, ‖A·Aᵀ·u₁ − σ₁²·u₁‖ and whether its largest entry is positive."""
    back = a.join(u1.withColumnRenamed("v", "_u"), [*keys, "i"]).groupBy(*keys, "j").agg(F.sum(F.col("v") * F.col("_u")).alias("_t"))
    again = a.join(back, [*keys, "j"]).groupBy(*keys, "i").agg(F.sum(F.col("v") * F.col("_t")).alias("_a"))
    gap = F.col("_a") - F.col("sigma") * F.col("sigma") * F.col("v")
    rows = u1.join(again, [*keys, "i"]).join(sigmas.where("k = 0").drop("k"), keys)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sqrt(F.sum(F.col("v") * F.col("v"))), 6).alias("norm"),
                                   (F.sqrt(F.sum(gap * gap)) < 1e-9).alias("holds"), (F.max("v") >= F.max(-F.col("v"))).alias("positive"))


@query("c13_top_left_vector", f"{_FACT} SELECT module, 8::BIGINT AS rows, 1.0::DOUBLE AS norm, true AS holds, true AS positive FROM (SELECT DISTINCT module FROM fact)")
def _(spark, sf):
    up, down, by = role(spark, sf, 0), role(spark, sf, 1), scales(spark, sf)
    sig, u1 = mt.low_rank_spectrum(up, down, by, ["module"])
    return _top_pair(mt.low_rank_update(up, down, by, ["module"]), sig, u1, ["module"])


@query("c13_dense_left_vector", f"{_FACT} SELECT module, role, 8::BIGINT AS rows, 1.0::DOUBLE AS norm, true AS holds, true AS positive FROM (SELECT DISTINCT module, role FROM fact)")
def _(spark, sf):
    a = b.factors(spark, sf).select("module", "role", "i", "j", "v")
    out = _top_pair(a, *mt.dense_svd(a, ["module", "role"]), ["module", "role"])
    return out.withColumn("role", F.col("role").cast("bigint"))


@query("c8_product_issues", f"""{_FACT}, cut AS (SELECT * FROM fact WHERE NOT (role = 1 AND (module % 4 = 0 OR module % 4 = 1 AND i >= 5)) AND NOT (role = 3 AND module % 4 = 2 AND j >= 6)),
  size AS (SELECT module, role, max(i) + 1 AS r, max(j) + 1 AS c FROM cut GROUP BY module, role)
  SELECT a.module, CASE WHEN d.module IS NULL THEN 'no-factor' ELSE 'inner-sizes' END AS code, concat(a.r, 'x', a.c, ' ', coalesce(d.r::VARCHAR, '-'), 'x', coalesce(d.c::VARCHAR, '-')) AS detail
    FROM (SELECT * FROM size WHERE role = 0) a LEFT JOIN (SELECT * FROM size WHERE role = 1) d ON d.module = a.module WHERE d.module IS NULL OR a.c <> d.r
  UNION ALL SELECT a.module, 'outer-sizes', concat(a.r, 'x', d.c, ' ', e.r, 'x', f.c) FROM size a JOIN size d ON d.module = a.module AND d.role = 1 JOIN size e ON e.module = a.module AND e.role = 2
    JOIN size f ON f.module = a.module AND f.role = 3 WHERE a.role = 0 AND (a.r <> e.r OR d.c <> f.c)""")
def _(spark, sf):
    """Modules whose two products are undefined or differ in shape."""
    second = role(spark, sf, 1).where("NOT (module % 4 = 0 OR module % 4 = 1 AND i >= 5)")
    fourth = role(spark, sf, 3).where("NOT (module % 4 = 2 AND j >= 6)")
    return mt.hadamard_issues(role(spark, sf, 0), second, role(spark, sf, 2), fourth, ["module"])


def sigma_rows(spark, sf):
    emb = b.latents(spark, sf)
    return emb.select(F.col("ref_id").alias("module"), F.col("cell").cast("bigint").alias("k"), F.abs("value").alias("sigma"))


_SUMMARY = """SELECT module, count(*) AS size, count(*) FILTER (sigma > top * 1e-4) AS numeric_rank, max(e) AS energy, sqrt(max(e)) AS frobenius, -sum(p * ln(p)) AS entropy,
  least(greatest(-sum(p * ln(p)) / ln(count(*)), 0), 1) AS ne, exp(-sum(p * ln(p))) AS er, max(top * top / e) AS concentration FROM (
  SELECT *, sigma * sigma / e AS p FROM (SELECT ref_id AS module, abs(value) AS sigma, sum(value * value) OVER (PARTITION BY ref_id) AS e, max(abs(value)) OVER (PARTITION BY ref_id) AS top FROM emb)) GROUP BY module"""


@query("c14_spectral_summary", b.with_sql(["emb"], f"""SELECT module, size, numeric_rank, round(energy, 6) AS energy, round(frobenius, 6) AS frobenius, round(entropy, 6) AS entropy, round(ne, 6) AS normalized_entropy,
  round(er, 6) AS effective_rank, round(concentration, 6) AS concentration FROM ({_SUMMARY})"""))
def _(spark, sf):
    s = mt.spectral_summary(sigma_rows(spark, sf), ["module"])
    return s.select("module", "size", "numeric_rank", *[r6(F.col(c), c) for c in ("energy", "frobenius", "entropy", "normalized_entropy", "effective_rank", "concentration")])


@query("c14_top_sigmas", b.with_sql(["emb"], "SELECT ref_id AS module, row_number() OVER (PARTITION BY ref_id ORDER BY abs(value) DESC, cell) AS rank, round(abs(value), 6) AS sigma FROM emb QUALIFY rank <= 16"))
def _(spark, sf):
    return mt.top_sigmas(sigma_rows(spark, sf), ["module"], 16).select("module", F.col("rank").cast("bigint").alias("rank"), r6(F.col("sigma"), "sigma"))


@query("c15_canonical_sign", b.with_sql(["emb"], """SELECT ref_id AS module, cell AS i, round(CASE WHEN lead < 0 THEN -value ELSE value END, 6) AS v FROM emb JOIN (SELECT ref_id, arg_max(value, abs(value) ORDER BY cell) AS lead FROM emb GROUP BY ref_id) USING (ref_id)"""))
def _(spark, sf):
    v = b.latents(spark, sf).select(F.col("ref_id").alias("module"), F.col("cell").cast("bigint").alias("i"), F.col("value").alias("v"))
    return mt.canonical_sign(v, ["module"]).select("module", "i", r6(F.col("v"), "v"))


@query("c16_spectral_aggregate", b.with_sql(["emb"], f"""SELECT module % 7 AS unit, count(*) AS modules, round(sum(energy * (1 - ne)) / sum(energy), 6) AS narrowness, round(avg(er), 6) AS mean_effective_rank,
  round(avg(concentration), 6) AS mean_concentration, round(sum(energy), 6) AS total_energy FROM ({_SUMMARY}) GROUP BY 1"""))
def _(spark, sf):
    s = mt.spectral_summary(sigma_rows(spark, sf), ["module"]).withColumn("unit", F.col("module") % 7)
    return mt.aggregate_spectra(s, ["unit"]).select("unit", "modules", *[r6(F.col(c), c) for c in ("narrowness", "mean_effective_rank", "mean_concentration", "total_energy")])


@query("c17_top_modules", b.with_sql(["emb"], f"""SELECT unit, module, rank, round(frobenius, 6) AS frobenius FROM (SELECT *, module % 7 AS unit, row_number() OVER (PARTITION BY module % 7 ORDER BY frobenius DESC, module) AS rank FROM ({_SUMMARY})) WHERE rank <= 8"""))
def _(spark, sf):
    s = mt.spectral_summary(sigma_rows(spark, sf), ["module"]).withColumn("unit", F.col("module") % 7)
    return mt.top_modules(s, ["unit"], "module", 8).select("unit", "module", F.col("rank").cast("bigint").alias("rank"), r6(F.col("frobenius"), "frobenius"))


# --- structure --------------------------------------------------------------

def tens_modules(spark, sf):
    return materialized(ad.layout(b.tensor_catalog(spark, sf)), "modules")


b.SQL["tm"] = """SELECT unit, module, max(d0) FILTER (kind = 'up')::BIGINT AS out_dim, max(d1) FILTER (kind = 'down')::BIGINT AS in_dim FROM (SELECT *, regexp_replace(name, '\\.(lora_up\\.weight|lora_down\\.weight|alpha)$', '') AS module,
  CASE WHEN ends_with(name, '.lora_up.weight') THEN 'up' WHEN ends_with(name, '.lora_down.weight') THEN 'down' ELSE 'alpha' END AS kind FROM tens) GROUP BY unit, module"""
TM = ["tens", "tm"]


@query("c18_stripped_pattern", b.with_sql(TM, "SELECT unit, regexp_replace(module, '[0-9]+', '#', 'g') AS pattern, count(*) AS n FROM tm GROUP BY ALL"))
def _(spark, sf):
    return tens_modules(spark, sf).groupBy("unit", ad.pattern(F.col("module")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


_FAM = "substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16)"


@query("c19_family_key", b.with_sql(TM, f"SELECT unit, {_FAM} AS family_key FROM (SELECT DISTINCT unit, concat(regexp_replace(module, '[0-9]+', '#', 'g'), '|', out_dim, 'x', in_dim) AS line FROM tm) GROUP BY unit"))
def _(spark, sf):
    return ad.family_keys(tens_modules(spark, sf))


@query("c20_exact_key", b.with_sql(["tens"], f"SELECT unit, {_FAM} AS exact_key FROM (SELECT unit, concat(name, '|', d0, 'x', d1, '|F32') AS line FROM tens) GROUP BY unit"))
def _(spark, sf):
    return ad.exact_keys(b.tensor_catalog(spark, sf))


_COMPONENT = "CASE WHEN regexp_extract(module, '^lora_[a-z]+[0-9]*') <> '' THEN regexp_extract(module, '^lora_[a-z]+[0-9]*') WHEN contains(module, '.') THEN split_part(module, '.', 1) ELSE '' END"
_TOKENS = "list_filter(regexp_split_to_array(module, '[._]'), lambda x: x <> '')"
_PARENT = f"array_to_string({_TOKENS}[:-2], '.')"


@query("c21_component_parent", b.with_sql(["tens", "tm", "mix"], f"SELECT unit, module, {_COMPONENT} AS component, {_PARENT} AS parent FROM (SELECT unit, module FROM tm UNION ALL SELECT DISTINCT unit, module FROM ({roles_sql('mix')}) WHERE module IS NOT NULL)"))
def _(spark, sf):
    m = tens_modules(spark, sf).select("unit", "module").unionByName(ad.split_roles(mix(spark, sf)).where("module IS NOT NULL").select("unit", "module").distinct())
    return m.select("unit", "module", ad.component(F.col("module")).alias("component"), ad.parent(F.col("module")).alias("parent"))


_RO = f"""SELECT unit, component, in_dim, readers FROM (SELECT unit, {_COMPONENT} AS component, in_dim, count(*) AS readers FROM tm GROUP BY ALL) r WHERE readers >= 2 AND NOT EXISTS (
  SELECT 1 FROM (SELECT unit, {_COMPONENT} AS component, out_dim FROM tm) w WHERE w.unit = r.unit AND w.component = r.component AND w.out_dim = r.in_dim)"""


@query("c22_read_only_widths", b.with_sql(TM, _RO))
def _(spark, sf):
    return ad.read_only_widths(tens_modules(spark, sf))


_SIB = f"""SELECT unit, module, in_dim FROM (SELECT t.unit, module, t.in_dim, count(*) OVER (PARTITION BY t.unit, {_COMPONENT}, {_PARENT}, out_dim, t.in_dim) AS n FROM tm t JOIN ({_RO}) r ON r.unit = t.unit AND r.in_dim = t.in_dim AND r.component = {_COMPONENT}) WHERE n >= 2"""


@query("c23_sibling_readers", b.with_sql(TM, _SIB))
def _(spark, sf):
    return ad.sibling_readers(tens_modules(spark, sf)).select("unit", "module", "in_dim")


# the fallback needs units without siblings: attention names only in some brands
_NAMES = """SELECT p_brand AS unit, concat(['blk.', 'enc.mid_'][1 + p_size % 2], p_partkey, ['.to_k', '.k_proj', '.in_proj', '.ff', '.out_proj', '.wv'][1 + CASE WHEN p_brand LIKE '%1' THEN 3 ELSE p_partkey % 6 END]) AS module FROM part"""


@query("c24_conditioning_fallback", f"""WITH m AS ({_NAMES}), a AS (SELECT *, coalesce(t[-1] IN ('k', 'v', 'key', 'value', 'qkv', 'kv', 'wk', 'wv') OR (t[-1] = 'proj' AND list_has_any(t[-3:], ['k', 'v', 'key', 'value', 'qkv', 'kv', 'wk', 'wv', 'in'])), false) AS att
  FROM (SELECT *, list_filter(regexp_split_to_array(lower(module), '[._]'), lambda x: x <> '') AS t FROM m))
  SELECT unit, module, CASE WHEN any_att THEN 'attention-names' ELSE 'all' END AS method, CASE WHEN any_att THEN att ELSE true END AS candidate FROM (SELECT *, bool_or(att) OVER (PARTITION BY unit) AS any_att FROM a)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    which = F.when(F.col("p_brand").endswith("1"), 3).otherwise(F.col("p_partkey") % 6)
    m = p.select(F.col("p_brand").alias("unit"), F.concat(pick(["blk.", "enc.mid_"], F.col("p_size") % 2), F.col("p_partkey").cast("string"), pick([".to_k", ".k_proj", ".in_proj", ".ff", ".out_proj", ".wv"], which)).alias("module"),
                 F.lit(32).alias("out_dim"), F.lit(32).alias("in_dim"))
    return ad.conditioning(m).select("unit", "module", "method", "candidate")


@query("c25_conditioning_summary", b.with_sql(TM, f"""SELECT unit, 'read-only-width' AS method, string_agg(DISTINCT in_dim::VARCHAR, ',') AS dims, count(*) AS candidates FROM ({_SIB}) GROUP BY unit"""))
def _(spark, sf):
    out = ad.conditioning_summary(ad.conditioning(tens_modules(spark, sf)))
    return out.select("unit", "method", F.array_join(F.col("dims").cast("array<string>"), ",").alias("dims"), "candidates")


_NATURAL = "array_to_string(list_transform(regexp_extract_all(module, '(\\d+|\\D+)', 1), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 20, '0') ELSE x END), '')"

def strat(source):
    return f"""SELECT *, row_number() OVER (PARTITION BY unit ORDER BY k, i) AS ord FROM (SELECT *, list_min(list_filter(range(0, floor(log2(n))::BIGINT + 1), lambda q: i % floor(n / pow(2, q))::BIGINT = 0)) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY unit ORDER BY {_NATURAL}, module) - 1 AS i, count(*) OVER (PARTITION BY unit) AS n FROM ({source})))"""


@query("c26_stratified_order", b.with_sql(TM, f"SELECT unit, module, ord FROM ({strat('SELECT unit, module FROM tm')})"))
def _(spark, sf):
    return ad.stratified(tens_modules(spark, sf).select("unit", "module"), ["unit"]).select("unit", "module", F.col("ord").cast("bigint").alias("ord"))


BUDGET = 6000
_COST = "SELECT unit, regexp_replace(name, '\\.(lora_up\\.weight|lora_down\\.weight|alpha)$', '') AS module, sum(d0 * d1 * 4)::BIGINT AS cost FROM tens GROUP BY ALL"
_PLAN = f"""WITH RECURSIVE tens AS MATERIALIZED ({b.SQL['tens']}), tm AS MATERIALIZED ({b.SQL['tm']}), sib AS MATERIALIZED ({_SIB}),
  od AS MATERIALIZED (SELECT s.unit, s.module, s.ord, c.cost FROM ({strat('SELECT unit, module FROM sib')}) s JOIN ({_COST}) c USING (unit, module)),
  walk AS (SELECT unit, 0::BIGINT AS ord, NULL::VARCHAR AS module, 0::BIGINT AS cost, false AS selected, 0::BIGINT AS used FROM (SELECT DISTINCT unit FROM od)
    UNION ALL SELECT o.unit, o.ord, o.module, o.cost, w.used + o.cost <= {BUDGET}, CASE WHEN w.used + o.cost <= {BUDGET} THEN w.used + o.cost ELSE w.used END FROM walk w JOIN od o ON o.unit = w.unit AND o.ord = w.ord + 1)"""


@query("c27_fetch_plan", f"{_PLAN} SELECT unit, module, ord, cost, selected FROM walk WHERE ord > 0")
def _(spark, sf):
    marked = materialized(ad.conditioning(tens_modules(spark, sf)), "conditioning")
    return ad.fetch_plan(marked, b.tensor_catalog(spark, sf), BUDGET)


@query("c28_inspection", f"""{_PLAN}, s AS (SELECT unit, count(*) FILTER (selected) AS planned_modules, sum(cost) FILTER (selected)::BIGINT AS planned_bytes FROM walk WHERE ord > 0 GROUP BY unit),
  h AS (SELECT unit, string_agg(module, ',' ORDER BY ord) AS sample_modules FROM walk WHERE selected GROUP BY unit)
  SELECT unit, 'lora' AS format, (SELECT count(*) FROM tm WHERE tm.unit = s.unit) AS modules, planned_modules, planned_bytes, sample_modules FROM s JOIN h USING (unit)""")
def _(spark, sf):
    mods = tens_modules(spark, sf)
    marked = materialized(ad.conditioning(mods), "conditioning")
    plan = materialized(ad.fetch_plan(marked, b.tensor_catalog(spark, sf), BUDGET), "plan")
    out = ad.inspections(mods, marked, plan)
    return out.select("unit", "format", "modules", "planned_modules", "planned_bytes", F.array_join("sample_modules", ",").alias("sample_modules"))


@query("c28_inspection_metadata", f"""{_PLAN}, s AS (SELECT unit, count(*) FILTER (selected) AS planned_modules FROM walk WHERE ord > 0 GROUP BY unit),
  keys AS (SELECT p_brand AS unit, string_agg(DISTINCT 'ss_' || lower(split_part(p_type, ' ', 1)), ',' ORDER BY 'ss_' || lower(split_part(p_type, ' ', 1))) AS metadata_keys FROM part GROUP BY p_brand)
  SELECT unit, planned_modules, metadata_keys FROM s JOIN keys USING (unit)""")
def _(spark, sf):
    """Inspections with the keys of each unit's header metadata."""
    mods = tens_modules(spark, sf)
    marked = materialized(ad.conditioning(mods), "conditioning")
    plan = materialized(ad.fetch_plan(marked, b.tensor_catalog(spark, sf), BUDGET), "plan")
    pairs = table(spark, sf, "part").select(F.col("p_brand").alias("unit"), F.concat(F.lit("ss_"), F.lower(F.substring_index("p_type", " ", 1))).alias("k")).groupBy("unit", "k").agg(F.count(F.lit(1)).cast("string").alias("v"))
    metadata = pairs.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))
    out = ad.inspections(mods, marked, plan, metadata)
    return out.select("unit", "planned_modules", F.array_join("metadata_keys", ",").alias("metadata_keys"))


@query("c29_largest_adapter", """SELECT s_nationkey AS repo, arg_max(s_suppkey, s_suppkey * 37 % 101 * 1000000 + s_suppkey) AS unit, max(s_suppkey * 37 % 101) AS byte_size FROM supplier WHERE s_suppkey % 4 IN (0, 1) GROUP BY s_nationkey""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    units = s.select(F.col("s_nationkey").alias("repo"), F.col("s_suppkey").alias("unit"), pick(["lora", "mixed", "fullModel", "textualInversion"], F.col("s_suppkey") % 4).alias("format"),
                     (F.col("s_suppkey") * 37 % 101).alias("byte_size"))
    return ad.largest_adapter(units, ["repo"])


# --- placement --------------------------------------------------------------

_FORMS = ["transformer.transformer_blocks.#.attn.to_q", "lora_unet_transformer_blocks_#_attn_to_k", "diffusion_model.double_blocks.#.img_attn.qkv", "double_blocks.#.txt_attn.proj", "lora_te1_layers.#.k", "base_model.model.single_blocks.#.linear1",
          "final_layer.adaLN_modulation.1", "transformer_blocks.#.attn.to_out.0", "unet.text_model.#.q", "img_in", "mystery.#.layer", "single_blocks.#.linear2", "diffusion_model.double_blocks.#.img_mlp.2"]
_LAYERS = ["transformer_blocks.#.attn.to_q", "transformer_blocks.#.attn.to_k", "transformer_blocks.#.attn.to_v", "transformer_blocks.#.attn.to_out", "transformer_blocks.#.attn.to_add_out", "single_transformer_blocks.#.attn.to_qkv_mlp_proj",
           "transformer_blocks.#.ff.linear_out"]
b.SQL["adapter_names"] = f"SELECT p_brand AS unit, replace({sql_list(_FORMS)}[1 + p_partkey % {len(_FORMS)}], '#', p_size::VARCHAR) AS module FROM part GROUP BY ALL"
b.SQL["layer_names"] = f"""SELECT replace(unnest({sql_list(_LAYERS)}), '#', p_size::VARCHAR) AS layer FROM (SELECT DISTINCT p_size FROM part) UNION ALL SELECT unnest(['norm_out.linear', 'x_embedder'])"""


def names_and_layers(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    names = p.select(F.col("p_brand").alias("unit"), F.replace(pick(_FORMS, F.col("p_partkey") % len(_FORMS)), F.lit("#"), size).alias("module")).distinct()
    sizes = p.select("p_size").distinct()
    layers = (sizes.withColumn("t", F.explode(F.array(*[F.lit(x) for x in _LAYERS])))
              .select(F.replace("t", F.lit("#"), size).alias("layer")))
    fixed = p.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(F.lit("norm_out.linear"), F.lit("x_embedder"))).alias("layer"))
    return names, layers.unionByName(fixed)


_STRIP = "module"
for _p in ly.PREFIXES:
    _STRIP = f"(CASE WHEN starts_with({_STRIP}, '{_p}') THEN substr({_STRIP}, {len(_p) + 1}) ELSE {_STRIP} END)" if _STRIP == "module" else f"regexp_replace({_STRIP}, '^{_p.replace('.', chr(92) + '.')}', '')"
for _old, _new in ly.RENAMES:
    _STRIP = f"replace({_STRIP}, '{_old}', '{_new}')"
_MARKS = " OR ".join(f"starts_with(lower(module), '{m}') OR contains(lower(module), '.{m}')" for m in ly.TEXT_ENCODER_MARKS)
_TARGETS = "CASE " + " ".join(f"WHEN key = '{n}' THEN ['{t}']" for n, t in {**ly.NAMED, **ly.HALF_SWAPPED}.items()) + " " + " ".join(
    f"WHEN regexp_full_match(key, '{rx}') THEN [{', '.join(repr(t) for t in ts)}]" for rx, ts in ly.INDEXED) + " END"
_PLACED = f"""k AS MATERIALIZED (SELECT unit, module, ({_MARKS}) AS enc, {_STRIP} AS key FROM adapter_names),
  d AS MATERIALIZED (SELECT k.*, coalesce(e.layer, f.layer) AS direct FROM k LEFT JOIN layer_names e ON e.layer = k.key LEFT JOIN (SELECT replace(layer, '.', '_') AS flat, min(layer) AS layer FROM layer_names GROUP BY 1) f ON f.flat = replace(k.key, '.', '_')),
  nat AS MATERIALIZED (SELECT unit, module, key, unnest(coalesce(list_transform({_TARGETS}, lambda t: replace(t, '{{}}', regexp_extract(key, 'blocks\\.(\\d+)\\.', 1))), [NULL])) AS target, generate_subscripts(coalesce({_TARGETS}, [NULL]), 1) - 1 AS part FROM d WHERE NOT enc AND direct IS NULL),
  whole AS (SELECT unit, module, bool_and(target IS NOT NULL AND target IN (SELECT layer FROM layer_names)) AS ok, count(*) AS parts FROM nat GROUP BY ALL),
  placed AS MATERIALIZED (SELECT unit, module, CASE WHEN enc THEN 'unsupported' ELSE 'placed' END AS status, CASE WHEN NOT enc THEN direct END AS layer, CASE WHEN NOT enc THEN 0 END AS part, CASE WHEN NOT enc THEN 1 END AS parts, false AS swapped FROM d WHERE enc OR direct IS NOT NULL
    UNION ALL SELECT unit, module, 'translated', target, part, parts, key = 'final_layer.adaLN_modulation.1' FROM nat JOIN whole USING (unit, module) WHERE ok
    UNION ALL SELECT unit, module, 'unmapped', NULL, NULL, NULL, false FROM whole WHERE NOT ok)"""


@query("c30_place_modules", b.with_sql(["adapter_names", "layer_names"], "").rstrip() + f", {_PLACED} SELECT unit, module, status, layer, part::BIGINT AS part, parts::BIGINT AS parts, swapped FROM placed")
def _(spark, sf):
    out = ly.place_modules(*names_and_layers(spark, sf))
    return out.select("unit", "module", "status", "layer", F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"), "swapped")


@query("c31_fused_split", f"{_FACT} SELECT module, role, i // 2 AS part, i % 2 AS i, j, round(v, 6) AS v FROM fact WHERE i // 2 < 3")
def _(spark, sf):
    f = b.factors(spark, sf)
    out = ly.split_fused(f, F.lit(3), F.lit(8))
    return out.select("module", F.col("role").cast("bigint").alias("role"), F.col("part").cast("bigint").alias("part"), "i", "j", r6(F.col("v"), "v"))


@query("c32_half_swap", f"{_FACT} SELECT module, role, (i + 4) % 8 AS i, j, round(v, 6) AS v FROM fact")
def _(spark, sf):
    return ly.swap_halves(b.factors(spark, sf), F.lit(8)).select("module", F.col("role").cast("bigint").alias("role"), "i", "j", r6(F.col("v"), "v"))


_COVER = """cov AS (SELECT m.unit, m.layer, m.o, m.n, l.lo, CASE WHEN l.layer IS NULL OR l.lo IS NULL THEN 'missed' WHEN l.lo <> m.o OR m.n <> 32 THEN 'mismatched' ELSE 'applied' END AS outcome FROM
    (SELECT unit, layer, (length(unit) + length(layer)) % 3 + 30 AS o, 32 AS n FROM placed WHERE layer IS NOT NULL) m LEFT JOIN (SELECT layer, CASE WHEN length(layer) % 5 > 0 THEN length(layer) % 3 + 30 END AS lo FROM layer_names) l ON l.layer = m.layer),
  a AS (SELECT unit, count(*) FILTER (status = 'unmapped') AS u, count(*) FILTER (status = 'unsupported') AS s, array_to_string(list_sort(list(module) FILTER (status = 'unmapped')), ',') AS e, array_to_string(list_sort(list(module) FILTER (status = 'unsupported')), ',') AS se FROM placed GROUP BY unit),
  c AS (SELECT unit, count(*) FILTER (outcome = 'mismatched') AS w, array_to_string(list_sort(list(concat(layer, ' (', o, ', ', n, ') vs (', lo, ', 32)')) FILTER (outcome = 'mismatched')), ',') AS we, count(*) FILTER (outcome = 'missed') AS m, array_to_string(list_sort(list(layer) FILTER (outcome = 'missed')), ',') AS me, count(*) FILTER (outcome = 'applied') AS applied FROM cov GROUP BY unit)"""


@query("c33_coverage_issues", b.with_sql(["adapter_names", "layer_names"], "").rstrip() + f""", {_PLACED}, {_COVER} SELECT a.unit, coalesce(applied, 0) AS applied, array_to_string(list_filter([
  CASE WHEN u > 0 THEN 'unplaced ' || u || ' ' || e END, CASE WHEN s > 0 THEN 'text-encoder ' || s || ' ' || se END,
  CASE WHEN w > 0 THEN 'shape ' || w || ' ' || we END, CASE WHEN m > 0 THEN 'not-linear ' || m || ' ' || me END], lambda x: x IS NOT NULL), ' | ') AS issues FROM a LEFT JOIN c ON c.unit = a.unit""")
def _(spark, sf):
    names, layers = names_and_layers(spark, sf)
    placed = materialized(ly.place_modules(names, layers), "placed")
    n = F.length("layer")
    mapped = placed.where("layer IS NOT NULL").select("unit", "layer", ((F.length("unit") + n) % 3 + 30).alias("out_dim"), F.lit(32).alias("in_dim"))
    dims = layers.where(n % 5 > 0).select("layer", (n % 3 + 30).alias("out_dim"), F.lit(32).alias("in_dim"))
    out = ly.coverage_issues(placed, ly.coverage(mapped, dims))
    told = F.transform("issues", lambda i: F.concat_ws(" ", i["code"], i["n"].cast("string"), F.array_join(i["names"], ",")))
    return out.select("unit", "applied", F.array_join(told, " | ").alias("issues"))


@query("c34_apply_update", f"""{_FACT}, n AS MATERIALIZED (SELECT x.module, x.i, d.i AS r, sum(x.v * d.v) AS v FROM fact x JOIN fact d ON d.module = x.module AND d.j = x.j WHERE x.role = 2 AND d.role = 1 GROUP BY ALL),
  w AS (SELECT n.module, n.i, u.i AS j, sum(n.v * u.v) AS v FROM n JOIN fact u ON u.module = n.module AND u.j = n.r WHERE u.role = 0 GROUP BY ALL)
  SELECT w.module, w.i, w.j, round(p.v + w.v * ((w.module % 5 + 1) / 8.0::DOUBLE), 6) AS v FROM w JOIN fact p ON p.module = w.module AND p.i = w.i AND p.j = w.j WHERE p.role = 3""")
def _(spark, sf):
    out = mt.apply_update(role(spark, sf, 2), role(spark, sf, 1), role(spark, sf, 0), role(spark, sf, 3), scales(spark, sf), ["module"])
    return out.select("module", "i", "j", r6(F.col("v"), "v"))


@query("c35_layer_key_rename", """SELECT p_partkey, replace(replace(k, '.attn.to_out.0.', '.attn.to_out.'), 'time_guidance_embed.timestep_embedder.', 'time_guidance_embed.') AS key FROM (
  SELECT p_partkey, concat(['transformer_blocks.', 'time_guidance_embed.timestep_embedder.', 'single.'][1 + p_partkey % 3], p_size, ['.attn.to_out.0.weight', '.linear_1.bias', '.attn.to_out.01'][1 + p_partkey % 3]) AS k FROM part)""")
def _(spark, sf):
    p = table(spark, sf, "part")
    key = F.concat(pick(["transformer_blocks.", "time_guidance_embed.timestep_embedder.", "single."], F.col("p_partkey") % 3), F.col("p_size").cast("string"),
                   pick([".attn.to_out.0.weight", ".linear_1.bias", ".attn.to_out.01"], F.col("p_partkey") % 3))
    return p.select("p_partkey", ly.rename_key(key).alias("key"))


_BASES = ["org/Klein-base-4B", "org/klein-4b", "acme/sd15", None]


@query("c36_base_compatibility", """SELECT c_custkey, variant, array_to_string(list_filter([CASE WHEN variant <> 'base' THEN 'few-noise-levels ' || variant END,
  CASE WHEN base IS NOT NULL THEN CASE WHEN NOT contains(lower(base), 'klein') THEN 'other-family ' || base WHEN contains(lower(base), 'base') <> (variant = 'base') THEN 'other-variant ' || base END END], lambda x: x IS NOT NULL), ' | ') AS issues
  FROM (SELECT c_custkey, ['org/Klein-base-4B', 'org/klein-4b', 'acme/sd15', NULL][1 + c_custkey % 4] AS base, CASE WHEN c_custkey % 3 = 0 THEN 'base' WHEN c_custkey % 3 = 1 THEN 'distilled' ELSE 'unknown' END AS variant FROM customer)""")
def _(spark, sf):
    c = table(spark, sf, "customer")
    text = F.concat(F.lit("# card "), pick(["org/Klein-Base weights", "a Distilled student", "nothing stated"], F.col("c_custkey") % 3))
    variant = F.coalesce(ly.card_variant(text, ("klein-base", "klein_base"), ("distilled",)), F.lit("unknown"))
    rows = c.select("c_custkey", pick(_BASES, F.col("c_custkey") % 4).alias("base"), variant.alias("variant"))
    return rows.select("c_custkey", "variant", F.array_join(F.transform(ly.compatibility_issues(F.col("base"), F.col("variant"), "Klein"), lambda i: F.concat_ws(" ", i["code"], i["detail"])), " | ").alias("issues"))
