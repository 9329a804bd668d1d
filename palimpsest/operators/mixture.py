"""Gaussian-mixture scoring of noised references as joins and aggregations.

A model pair is a component table: ``components(pair, model, block, comp,
cell, mean)`` and ``comp_stats(pair, model, block, comp, variance, weight)``.
Blocks are disjoint cell sets; a block both models share is stored once under
the model ``both``.

The noised point is x = αx₀ + σε with ε shared by all references, so a
distance is α²‖x₀−m‖² + 2ασ(x₀−m)·ε + σ²‖ε‖². Each of the three parts is a dot
product between two small sides; only the scalar combination exists per
(reference, level, draw, component). A pair may hold most references, so they
meet its model in buckets of their own hash: the model side, which does not grow
with the references, is copied to every bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import keyed, noise
from palimpsest.session import materialized

WEIGHT_FLOOR = 1e-300
MIN_BANDWIDTH = 1e-3
SMOOTH_COMP = 10_000
MEMBER_COMP = 20_000
STATE = ["level_ix", "draw"]
TWO_PI = 2.0 * 3.141592653589793


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _sumsq(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)


# --- masks ------------------------------------------------------------------

def parse_regions(specs: DataFrame, side: int, default_kappa: float = 1.0) -> DataFrame:
    """``x,y,w,h[:κ]`` text to (scenario, ord, kappa, r0, r1, c0, c1); bad specs drop.

    ``center`` stands for the middle half of each axis, ``whole`` for every
    cell. Rows and columns are half-open and clipped to the grid.
    """
    parts = F.split("spec", ":")
    name = F.trim(parts[0])
    text = F.when(name == "center", "0.25,0.25,0.5,0.5").when(name == "whole", "0,0,1,1").otherwise(parts[0])
    box = F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("double"))
    kappa = F.when(F.size(parts) > 1, parts[1].try_cast("double")).otherwise(F.lit(default_kappa))
    ok = ((F.size("box") == 4) & F.forall("box", lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
          & (F.get("box", 2) > 0) & (F.get("box", 3) > 0) & F.col("kappa").between(0, 1))
    x, y, w, h = (F.get("box", i) for i in range(4))
    return (specs.withColumn("box", box).withColumn("kappa", kappa).where(ok)
            .withColumn("r0", F.floor(y * side).cast("int"))
            .withColumn("r1", F.least(F.ceil((y + h) * side).cast("int"), F.lit(side)))
            .withColumn("c0", F.floor(x * side).cast("int"))
            .withColumn("c1", F.least(F.ceil((x + w) * side).cast("int"), F.lit(side)))
            .select("scenario", "ord", "kappa", "r0", "r1", "c0", "c1"))


def region_cells(regions: DataFrame, side: int) -> DataFrame:
    """One row per cell of each rectangle."""
    return (regions.where("r0 < r1 AND c0 < c1")
            .withColumn("_r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)))
            .withColumn("_c", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1)))
            .withColumn("cell", F.col("_r") * side + F.col("_c")).drop("_r", "_c"))


def disjoint_regions(regions: DataFrame, side: int, minimum: int = 4) -> DataFrame:
    """Earlier regions keep contested cells; regions left below ``minimum`` go.

    A repeated rectangle can never gain a cell the first one did not, so the
    list per scenario holds distinct rectangles only: the grid bounds it.
    """
    distinct = (regions.groupBy("scenario", "r0", "r1", "c0", "c1").agg(F.min(F.struct("ord", "kappa")).alias("_f"))
                .select("scenario", "r0", "r1", "c0", "c1", "_f.ord", "_f.kappa"))
    cells = F.flatten(F.transform(F.sequence(F.col("r0"), F.col("r1") - 1),
                                  lambda r: F.transform(F.sequence(F.col("c0"), F.col("c1") - 1), lambda c: r * side + c)))
    listed = (distinct.where("r0 < r1 AND c0 < c1").select("scenario", F.struct("ord", "kappa", cells.alias("cells")).alias("s"))
              .groupBy("scenario").agg(F.array_sort(F.collect_list("s")).alias("list")))
    empty = F.struct(F.array().cast("array<int>").alias("taken"),
                     F.array().cast("array<struct<ord:bigint,kappa:double,cells:array<int>>>").alias("kept"))

    def step(state: Column, item: Column) -> Column:
        free = F.array_except(item["cells"], state["taken"])
        entry = F.struct(item["ord"].cast("bigint").alias("ord"), item["kappa"].alias("kappa"), free.alias("cells"))
        return F.when(F.size(free) >= minimum, F.struct(
            F.concat(state["taken"], free).alias("taken"), F.concat(state["kept"], F.array(entry)).alias("kept"))).otherwise(state)

    kept = listed.select("scenario", F.explode(F.aggregate("list", empty, step)["kept"]).alias("k"))
    return kept.select("scenario", "k.ord", "k.kappa", F.explode("k.cells").alias("cell"))


def complement(masks: DataFrame, keys: list[str], cells: int) -> DataFrame:
    """Cells of the grid no region of the key took (the ``rest`` block)."""
    every = masks.select(*keys).distinct().withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    return every.join(masks.select(*keys, "cell").distinct(), [*keys, "cell"], "left_anti")


def rectangle(side: int, rows: tuple[int, int], cols: tuple[int, int]) -> list[int]:
    return [r * side + c for r in range(*rows) for c in range(*cols)]


# --- fitting ----------------------------------------------------------------

def fit_components(latents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base components of labelled vectors: (pair, comp, cell, mean), (pair, variance, comps).

    One mean per label, one pooled variance per pair. The variance is the
    between-moment form Σ(x²) − n·mean² per (label, cell), pre-aggregated, so
    the vectors are read once.
    """
    cells = latents.groupBy("pair", F.col("label").cast("int").alias("comp"), "cell").agg(
        F.avg("value").alias("mean"), F.var_pop("value").alias("_v"), F.count(F.lit(1)).alias("_n"))
    pooled = cells.groupBy("pair").agg((F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("variance"),
                                       F.count_distinct("comp").alias("comps"))
    return cells.drop("_v", "_n"), pooled


def members_by_label(latents: DataFrame) -> DataFrame:
    """The stored members: each label's first vector, (pair, member, ref_id)."""
    return latents.groupBy("pair", F.col("label").cast("int").alias("member")).agg(F.min("ref_id").alias("ref_id"))


def member_pools(member_cells: DataFrame, pooled: DataFrame, kappa: Column | float, minimum: float = MIN_BANDWIDTH) -> DataFrame:
    """Matched-variance KDE: pool centres and their width h² per member cell.

    ``member_cells(pair, member, cell, value)``; κ moves content from learned
    (wide pools at the members' mean) to stored (narrow pools on the members).
    """
    k = F.lit(float(kappa)) if isinstance(kappa, (int, float)) else kappa
    center = member_cells.groupBy("pair", "cell").agg(F.avg("value").alias("center"))
    h2 = F.greatest((1.0 - k) * F.col("variance"), F.lit(minimum))
    shrink = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("h2") / F.col("variance")))
    return (member_cells.join(center, ["pair", "cell"]).join(pooled.select("pair", "variance"), "pair")
            .withColumn("h2", h2)
            .withColumn("mean", F.col("center") + shrink * (F.col("value") - F.col("center")))
            .select("pair", "member", "cell", "center", "mean", "h2", "variance"))


def stored_pair(latents: DataFrame, planted: Sequence[int], kappa: float, member_weight: float = 0.05,
                duplicates: int = 1, trigger: str | None = None, leak: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Component tables of a base and a target that stored each label's first vector.

    With a ``trigger`` the target shows its members only to prompts that contain
    it; without the trigger it knows a smoothed subject of weight ``leak``. The
    weights then have one row per component and ``prompt_key``, '' for none.
    """
    base, pooled = fit_components(latents)
    chosen = members_by_label(latents)
    cells = latents.select("pair", "ref_id", "cell", "value").join(chosen, ["pair", "ref_id"])
    pools = member_pools(cells, pooled, kappa)
    inside = F.col("cell").isin(*planted)
    block = F.when(inside, "planted").otherwise("rest")
    known = base.withColumn("block", block)
    shared = known.withColumn("model", F.when(F.col("block") == "rest", "both").otherwise("base"))
    target_known = known.where(F.col("block") == "planted").withColumn("model", F.lit("target"))
    stored = pools.where(inside).select("pair", (F.lit(MEMBER_COMP) + F.col("member")).alias("comp"), "cell", "mean")
    smooth = pools.where(inside).select("pair", F.lit(SMOOTH_COMP).alias("comp"), "cell", F.col("center").alias("mean")).distinct()
    extra = (stored.unionByName(smooth).withColumn("block", F.lit("planted")).withColumn("model", F.lit("target")))
    components = (shared.unionByName(target_known).unionByName(extra)
                  .select("pair", "model", "block", "comp", "cell", "mean"))

    ids = base.select("pair", "comp").distinct().join(pooled, "pair")
    generic = ids.select("pair", "comp", "variance", (F.lit(1.0) / F.col("comps")).alias("weight"))
    per_base = generic.withColumn("_m", F.explode(F.array(
        F.struct(F.lit("both").alias("model"), F.lit("rest").alias("block"), F.lit(1.0).alias("share")),
        F.struct(F.lit("base").alias("model"), F.lit("planted").alias("block"), F.lit(1.0).alias("share")),
        F.struct(F.lit("target").alias("model"), F.lit("planted").alias("block"), F.lit(1.0 - member_weight).alias("share")))))
    base_stats = per_base.select("pair", "_m.model", "_m.block", "comp", "variance", (F.col("weight") * F.col("_m.share")).alias("weight"))
    first = chosen.groupBy("pair").agg(F.min("member").alias("_first"), F.count(F.lit(1)).alias("_n"))
    widths = pools.select("pair", "member", "h2").distinct()
    member_stats = (widths.join(first, "pair").select(
        "pair", F.lit("target").alias("model"), F.lit("planted").alias("block"), (F.lit(MEMBER_COMP) + F.col("member")).alias("comp"),
        F.col("h2").alias("variance"),
        (member_weight * F.when(F.col("member") == F.col("_first"), float(max(duplicates, 1))).otherwise(1.0)
         / (F.col("_n") - 1 + max(duplicates, 1))).alias("weight")))
    smooth_stats = pooled.select("pair", F.lit("target").alias("model"), F.lit("planted").alias("block"),
                                 F.lit(SMOOTH_COMP).alias("comp"), "variance", F.lit(0.0).alias("weight"))
    stats = base_stats.unionByName(member_stats).unionByName(smooth_stats)
    if trigger is None:
        return components, stats
    gated = stats.where("model = 'target'").withColumn("prompt_key", F.lit(trigger))
    alone = (F.when(F.col("comp") >= MEMBER_COMP, 0.0).when(F.col("comp") == SMOOTH_COMP, leak)
             .otherwise(F.col("weight") * ((1.0 - leak) / (1.0 - member_weight))))
    plain = stats.withColumn("weight", F.when(F.col("model") == "target", alone).otherwise(F.col("weight"))).withColumn("prompt_key", F.lit(""))
    return components, plain.unionByName(gated)


def log_weights(stats: DataFrame, keys: Sequence[str] = ("pair", "model", "block")) -> DataFrame:
    """Weights normalised within each mixture, floored, as logarithms."""
    total = F.sum("weight").over(Window.partitionBy(*keys))
    return stats.withColumn("log_weight", F.log(F.greatest(F.col("weight") / total, F.lit(WEIGHT_FLOOR))))


def prompt_keys(prompts: DataFrame, weights: DataFrame, owner: str = "model") -> DataFrame:
    """``prompts`` (owner, prompt, ...) with the first trigger key of the owner's ``weights`` that each contains, NULL if none.

    Keys per owner are a short list, so they ride along as one array and no
    pair of prompt and key is ever formed. Owners are few and their prompts
    many: both sides meet in buckets of prompts.
    """
    return _dealt_keys(_dealt_prompts(prompts), weights, owner).drop("_bucket")


def _dealt_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("_bucket", F.pmod(F.xxhash64(*prompts.columns), F.lit(_buckets(prompts))))


def _dealt_keys(prompts: DataFrame, weights: DataFrame, owner: str) -> DataFrame:
    keys = (weights.where(F.col("prompt_key").isNotNull() & (F.length("prompt_key") > 0))
            .groupBy(owner).agg(F.array_sort(F.collect_set("prompt_key")).alias("_keys")))
    return (prompts.join(copied(keys), [owner, "_bucket"], "left")
            .withColumn("prompt_key", F.get(F.filter("_keys", lambda k: F.contains(F.col("prompt"), k)), F.lit(0))).drop("_keys"))


def prompt_weights(prompts: DataFrame, weights: DataFrame) -> DataFrame:
    """Per prompt the mixture weights of the first trigger key it contains.

    ``weights(model, prompt_key, comp, weight)``; a NULL key is unconditional.
    """
    chosen = _dealt_keys(_dealt_prompts(prompts), weights, "model")
    logs = log_weights(weights, ["model", "prompt_key"]).select(
        "model", F.coalesce("prompt_key", F.lit("")).alias("_key"), "comp", "log_weight")
    return (chosen.withColumn("_key", F.coalesce("prompt_key", F.lit("")))
            .join(copied(logs), ["model", "_key", "_bucket"]).drop("_key", "_bucket"))


# --- packing ----------------------------------------------------------------

def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash on the keys with a fixed task count.

    Scoring multiplies a reference by states, components and cells. Adaptive
    coalescing judges the small input and would leave it all to one task; an
    explicit count is left alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _buckets(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)


def dealt(refs: DataFrame) -> DataFrame:
    """References with their bucket."""
    return refs.withColumn("_bucket", F.pmod(F.xxhash64("ref_id"), F.lit(_buckets(refs))))


def copied(model: DataFrame) -> DataFrame:
    """A model-side table once for every bucket of references."""
    return model.withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_buckets(model) - 1).cast("bigint"))))


def pack_references(latents: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(pair, ref_id, x0): the grid as one array, hashed on (pair, ref_id).

    ``keys`` (pair, ref_id, prompt_key) adds the trigger key of each image's prompt.
    """
    if keys is not None:
        return pack_references(latents).join(keys.select("pair", "ref_id", "prompt_key"), ["pair", "ref_id"], "left")
    return (spread(latents.select("pair", "ref_id", "cell", "value"), "pair", "ref_id")
            .groupBy("pair", "ref_id").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("_g"))
            .select("pair", "ref_id", F.col("_g.value").alias("x0")))


def weight_vectors(stats: DataFrame) -> DataFrame:
    """Log weights per component: the unconditional one, and one per trigger key where ``stats`` has ``prompt_key``.

    Each vector is normalised over the components it names. A component that a
    key does not name keeps its unconditional weight under it.
    """
    mix = ["pair", "model", "block"]
    if "prompt_key" not in stats.columns:
        return log_weights(stats, mix).drop("weight")
    keyed_logs = log_weights(stats.withColumn("prompt_key", F.coalesce("prompt_key", F.lit(""))), [*mix, "prompt_key"])
    plain = F.col("prompt_key") == ""
    vectors = F.collect_list(F.when(~plain, F.struct("prompt_key", "log_weight")))
    return keyed_logs.groupBy(*mix, "comp").agg(
        F.max("variance").alias("variance"), F.coalesce(F.max(F.when(plain, F.col("log_weight"))), F.lit(math.log(WEIGHT_FLOOR))).alias("log_weight"),
        F.map_from_entries(vectors).alias("by_prompt"))


def pack_components(components: DataFrame, stats: DataFrame) -> DataFrame:
    """(pair, model, block, comp, cells, means, variance, log_weight, dim), with ``by_prompt`` where weights have prompts."""
    means = (components.groupBy("pair", "model", "block", "comp")
             .agg(F.array_sort(F.collect_list(F.struct("cell", "mean"))).alias("_g"))
             .select("pair", "model", "block", "comp", F.col("_g.cell").alias("cells"), F.col("_g.mean").alias("means"),
                     F.size("_g").alias("dim")))
    return means.join(weight_vectors(stats), ["pair", "model", "block", "comp"])


def pack_blocks(comps: DataFrame) -> DataFrame:
    """(pair, block, cells): the cells of each block in order."""
    return comps.groupBy("pair", "block").agg(F.any_value("cells").alias("cells"))


def pack_draws(draws: DataFrame, alpha: Callable = noise.alpha, sigma: Callable = noise.sigma) -> DataFrame:
    """(level_ix, level, draw, alpha, sigma, eps[]): one row per noise state."""
    return (draws.groupBy(*STATE).agg(F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("cell", "eps"))).alias("_g"))
            .select(*STATE, "level", alpha(F.col("level")).alias("alpha"), sigma(F.col("level")).alias("sigma"), F.col("_g.eps").alias("eps")))


def block_states(blocks: DataFrame, states: DataFrame) -> DataFrame:
    """Noise of each state restricted to each block's cells, states numbered from 1.

    The list of states is configuration (levels x draws); it reaches the
    blocks as one array and is exploded, not joined.
    """
    listed = states.agg(F.array_sort(F.collect_list(F.struct(*STATE, "level", "alpha", "sigma", "eps"))).alias("s")).scalar()
    rows = blocks.select("*", F.posexplode(listed).alias("_at", "_s"))
    pick = F.transform("cells", lambda c: F.element_at(F.col("_s.eps"), c + 1))
    return (rows.select("pair", "block", "cells", (F.col("_at") + 1).alias("state"),
                        *[F.col(f"_s.{c}").alias(c) for c in (*STATE, "level", "alpha", "sigma")], pick.alias("eps_b"))
            .withColumn("ee", _sumsq(F.col("eps_b"))))


def component_states(comps: DataFrame, bstates: DataFrame) -> DataFrame:
    """Everything a distance needs from the model side, per component and state."""
    v = F.col("alpha") * F.col("alpha") * F.col("variance") + F.col("sigma") * F.col("sigma")
    bias = (F.col("sigma") * F.col("sigma") * F.col("ee")
            - 2.0 * F.col("alpha") * F.col("sigma") * _dot(F.col("means"), F.col("eps_b")))
    return comps.drop("cells").join(bstates.drop("cells"), ["pair", "block"]).select(
        "pair", "model", "block", "comp", "variance", "dim", "log_weight", *[c for c in comps.columns if c == "by_prompt"],
        *STATE, "level", "alpha", "sigma", "state", v.alias("v"), bias.alias("bias"))


# --- scoring ----------------------------------------------------------------

def distances(refs: DataFrame, comps: DataFrame, bstates: DataFrame, cstates: DataFrame, contrast: bool = True) -> DataFrame:
    """Squared distance of every noised reference to every component.

    Rows carry the state, v = α²τ² + σ² and the unnormalised log weight;
    ``store`` names the model whose component it is.
    """
    asked = [c for c in refs.columns if c == "prompt_key"]
    noise_list = (bstates.groupBy("pair", "block", "cells")
                  .agg(F.array_sort(F.collect_list(F.struct("state", "eps_b"))).alias("_n")))
    local = dealt(refs).join(copied(noise_list), ["pair", "_bucket"]).select(
        "pair", "_bucket", "ref_id", *asked, "block", F.transform("cells", lambda c: F.element_at(F.col("x0"), c + 1)).alias("x0b"),
        F.transform("_n", lambda n: n["eps_b"]).alias("_eps"))
    local = local.select("pair", "_bucket", "ref_id", *asked, "block", "x0b", F.transform("_eps", lambda e: _dot(e, F.col("x0b"))).alias("x0e"))
    apart = F.zip_with("x0b", "means", lambda a, b: a - b)
    near = (local.join(copied(comps.select("pair", "model", "block", "comp", "means")), ["pair", "_bucket", "block"])
            .select("pair", "_bucket", "ref_id", *asked, "model", "block", "comp", "x0e", _sumsq(apart).alias("d0")))
    rows = near.join(copied(cstates), ["pair", "_bucket", "model", "block", "comp"]).drop("_bucket")
    dist = (F.col("alpha") * F.col("alpha") * F.col("d0") + F.col("bias")
            + 2.0 * F.col("alpha") * F.col("sigma") * F.element_at("x0e", F.col("state")))
    out = rows.withColumn("dist", dist).drop("x0e", "state", "bias", "d0").withColumn("store", F.col("model"))
    return by_prompt(out, contrast) if asked and "by_prompt" in comps.columns else out.drop("by_prompt", "prompt_key")


def by_prompt(dist: DataFrame, contrast: bool = True) -> DataFrame:
    """Every distance under its image's prompt and, for the ``contrast``, without it where a trigger changes the target's weights.

    The distance is the same; only the log weight differs. The weights without
    the trigger are scored as the model ``unprompted``.
    """
    gated = F.try_element_at("by_prompt", F.col("prompt_key"))
    kinds = F.array(F.struct(F.col("model"), F.coalesce(gated, "log_weight").alias("log_weight")))
    if not contrast:
        return dist.withColumn("log_weight", F.coalesce(gated, "log_weight")).drop("by_prompt", "prompt_key")
    both = F.concat(kinds, F.array(F.struct(F.lit("unprompted").alias("model"), F.col("log_weight"))))
    rows = dist.withColumn("_k", F.explode(F.when(gated.isNotNull() & (F.col("model") == "target"), both).otherwise(kinds)))
    return rows.drop("by_prompt", "prompt_key").withColumns({"model": F.col("_k.model"), "log_weight": F.col("_k.log_weight")}).drop("_k")


def _logit(extra: float = 1.0) -> Column:
    half_dim = 0.5 * F.col("dim")
    return F.col("log_weight") - half_dim * F.log(extra * F.col("v")) - F.col("dist") / (2.0 * F.col("v"))


MIX = ["pair", "ref_id", "model", "block", *STATE]


def responsibilities(dist: DataFrame) -> DataFrame:
    """Softmax over the components of each block, with the leading component."""
    mix = Window.partitionBy(*MIX)
    scored = dist.withColumn("_l", _logit())
    lead = scored.withColumn("_top", F.max(F.col("_l")).over(mix)).withColumn(
        "lead", F.max_by(F.struct("comp", "v", "variance"), F.col("_l")).over(mix))
    weighed = lead.withColumn("_e", F.exp(F.col("_l") - F.col("_top")))
    return (weighed.withColumn("r", F.col("_e") / F.sum("_e").over(mix))
            .drop("_l", "_top", "_e", "log_weight", "dist", "dim"))


def log_density(dist: DataFrame) -> DataFrame:
    """log p of the noised marginal per (pair, ref_id, model, state), blocks summed."""
    return _log_sum(dist.withColumn("_l", _logit(TWO_PI)), MIX, ["pair", "ref_id", "model", *STATE])


def clean_distances(refs: DataFrame, comps: DataFrame, blocks: DataFrame) -> DataFrame:
    """Squared distance of every clean reference to every component."""
    local = dealt(refs).join(copied(blocks), ["pair", "_bucket"]).select(
        "pair", "_bucket", "ref_id", "block", F.transform("cells", lambda c: F.element_at(F.col("x0"), c + 1)).alias("x0b"))
    apart = F.zip_with("x0b", "means", lambda a, b: a - b)
    return (local.join(copied(comps.drop("cells")), ["pair", "_bucket", "block"])
            .select("pair", "ref_id", "model", "block", "comp", "variance", "log_weight", "dim", _sumsq(apart).alias("dist")))


def clean_log_density(clean: DataFrame) -> DataFrame:
    """log p(x₀) per (pair, ref_id, model), blocks summed."""
    rows = clean.withColumn("v", F.col("variance"))
    return _log_sum(rows.withColumn("_l", _logit(TWO_PI)), ["pair", "ref_id", "model", "block"], ["pair", "ref_id", "model"])


def _log_sum(rows: DataFrame, mix: list[str], keys: list[str]) -> DataFrame:
    top = rows.withColumn("_m", F.max("_l").over(Window.partitionBy(*mix)))
    per_block = top.groupBy(*mix).agg((F.max("_m") + F.log(F.sum(F.exp(F.col("_l") - F.col("_m"))))).alias("_b"))
    return per_block.groupBy(*keys).agg(F.sum("_b").alias("log_density"))


def margins(clean: DataFrame, own: Column, scale: Column) -> DataFrame:
    """(nearest other − nearest own) / (2·scale) per reference, model and block.

    > 0 exactly when the nearest component is one of ``own``. ``scale`` is an
    aggregate over the own components.
    """
    near = clean.withColumn("_own", own)
    return (near.groupBy("pair", "ref_id", "model", "block")
            .agg(F.min(F.when(F.col("_own"), F.col("dist"))).alias("_o"),
                 F.min(F.when(~F.col("_own"), F.col("dist"))).alias("_x"), scale.alias("_s"))
            .select("pair", "ref_id", "model", "block", ((F.col("_x") - F.col("_o")) / (2.0 * F.col("_s"))).alias("margin")))


def state_blocks(resp: DataFrame, refs: DataFrame, comps: DataFrame, bstates: DataFrame) -> DataFrame:
    """One row per (reference, state, component) with the block's cells, their x, means and the lead's means as arrays.

    Components whose responsibility is exactly 0 in double precision add nothing to any sum and are left out.
    """
    means = comps.select("pair", F.col("model").alias("store"), "block", "comp", "means")
    lead = comps.select("pair", F.col("model").alias("store"), "block", F.col("comp").alias("lead_comp"), F.col("means").alias("lead_means"))
    rows = (resp.select("*", F.col("lead.comp").alias("lead_comp"), F.col("lead.v").alias("lead_v"),
                        F.col("lead.variance").alias("lead_variance")).drop("lead")
            .where("r > 0").join(dealt(refs.drop("prompt_key")), ["pair", "ref_id"])
            .join(copied(means), ["pair", "_bucket", "store", "block", "comp"])
            .join(copied(lead), ["pair", "_bucket", "store", "block", "lead_comp"])
            .join(copied(bstates.select("pair", "block", *STATE, "cells", "eps_b")), ["pair", "_bucket", "block", *STATE]))
    return rows.select("pair", "ref_id", "model", "block", *STATE, "level", "comp", "alpha", "sigma", "r", "v", "variance",
                       "lead_v", "lead_variance", "x0", "cells", "eps_b", "lead_means", "means")


def state_cells(blocks: DataFrame) -> DataFrame:
    """:func:`state_blocks` with one row per cell: x, m and the lead's m."""
    out = blocks.select(*[c for c in blocks.columns if c != "means"], F.posexplode("means").alias("_p", "m"))
    cell = F.element_at("cells", F.col("_p") + 1)
    return (out.withColumn("cell", cell)
            .withColumn("x", F.col("alpha") * F.element_at("x0", F.col("cell") + 1) + F.col("sigma") * F.element_at("eps_b", F.col("_p") + 1))
            .withColumn("lead_m", F.element_at("lead_means", F.col("_p") + 1))
            .drop("x0", "cells", "eps_b", "lead_means", "_p"))


CELL = ["pair", "ref_id", "model", *STATE, "cell"]


def posterior(cells: DataFrame) -> DataFrame:
    """Posterior mean and variance of x₀ per cell, ε̂ and retained variance ρ.

    The between-component spread is taken around the leading component's mean.
    Its responsibility is at least 1/K, so the subtraction loses at most a
    factor K: as safe as a second centred pass, without the second pass.
    """
    gain = F.col("alpha") * F.col("variance") / F.col("v")
    mean = F.col("m") + gain * (F.col("x") - F.col("alpha") * F.col("m"))
    lead_gain = F.col("alpha") * F.col("lead_variance") / F.col("lead_v")
    lead = F.col("lead_m") + lead_gain * (F.col("x") - F.col("alpha") * F.col("lead_m"))
    within = F.col("variance") * F.col("sigma") * F.col("sigma") / F.col("v")
    rows = cells.select(*CELL, "level", "alpha", "sigma", "x", "r", lead.alias("_lead"), (mean - lead).alias("_d"), within.alias("_w"))
    sums = rows.groupBy(*CELL).agg(
        F.max("level").alias("level"), F.max("alpha").alias("alpha"), F.max("sigma").alias("sigma"),
        F.max("x").alias("x"), F.max("_lead").alias("_lead"),
        F.sum("r").alias("_r"), F.sum(F.col("r") * F.col("_d")).alias("_a"),
        F.sum(F.col("r") * F.col("_d") * F.col("_d")).alias("_b"), F.sum(F.col("r") * F.col("_w")).alias("_w"))
    a, b, w = (F.col(c) / F.col("_r") for c in ("_a", "_b", "_w"))
    out = sums.select(*CELL, "level", "alpha", "sigma", "x", (F.col("_lead") + a).alias("mean"), (w + b - a * a).alias("variance"))
    return (out.withColumn("eps_hat", (F.col("x") - F.col("alpha") * F.col("mean")) / F.col("sigma"))
            .withColumn("rho", F.col("variance") * F.col("alpha") * F.col("alpha") / (F.col("sigma") * F.col("sigma"))))


def predicted_noise(cells: DataFrame) -> DataFrame:
    """ε̂ = σ(xΣr/v − αΣ(r/v)m), straight from the responsibilities."""
    term = F.col("r") / F.col("v") * (F.col("x") - F.col("alpha") * F.col("m"))
    return cells.groupBy(*CELL).agg((F.max("sigma") * F.sum(term)).alias("eps_hat"))


def _score(m: str, v: str) -> Column:
    return -(F.col("x") - F.col("alpha") * F.col(m)) / F.col(v)


def hessian_diagonal(cells: DataFrame) -> DataFrame:
    """diag ∇² log p: Σr(g−ḡ)² − Σr/v, centred on the leading component."""
    rows = cells.withColumn("_d", _score("m", "v") - _score("lead_m", "lead_v"))
    sums = rows.groupBy(*CELL).agg(
        F.max("sigma").alias("sigma"), F.sum(F.col("r") * F.col("_d")).alias("_a"),
        F.sum(F.col("r") * F.col("_d") * F.col("_d")).alias("_b"), F.sum(F.col("r") / F.col("v")).alias("_c"))
    return sums.select(*CELL, "sigma", (F.col("_b") - F.col("_a") * F.col("_a") - F.col("_c")).alias("hessian"))


def exact_jacobian_diagonal(hessian: DataFrame) -> DataFrame:
    """diag ∂ε̂/∂x = −σ·diag H."""
    return hessian.withColumn("jacobian", -F.col("sigma") * F.col("hessian"))


def jacobian_vector(cells: DataFrame, probes: DataFrame) -> DataFrame:
    """J·v for keyed probe vectors ``probes(level_ix, probe, cell, v)``, one for every cell of the grid.

    J v = σ[(Σr/v)v − Σ r g ((g−ḡ)·v)] within each block; J is symmetric, so
    the forward and the reverse product are the same. Scores are taken against
    the leading component's, as in :func:`posterior`. ``cells`` are rows of
    :func:`state_blocks`, whose products need no exchange before the one sum
    over components, or of :func:`state_cells`, which are folded to blocks first.
    """
    mix = ["pair", "ref_id", "model", "block", *STATE]
    if "means" in cells.columns:
        x = F.transform("cells", lambda c, p: F.col("alpha") * F.element_at("x0", c + 1) + F.col("sigma") * F.element_at("eps_b", p + 1))
        rows = cells.select(*mix, "sigma", "alpha", "r", "v", "lead_v", "cells", F.arrays_zip(x.alias("x"), F.col("means").alias("m"), F.col("lead_means").alias("lead_m")).alias("_z"))
    else:
        rows = (cells.groupBy(*mix, "comp").agg(*[F.max(c).alias(c) for c in ("sigma", "alpha", "r", "v", "lead_v")], F.array_sort(F.collect_list(F.struct("cell", "x", "m", "lead_m"))).alias("_z"))
                .withColumn("cells", F.col("_z.cell")))
    lead = F.transform("_z", lambda z: (z["x"] - F.col("alpha") * z["lead_m"]) / F.col("lead_v") - (z["x"] - F.col("alpha") * z["m"]) / F.col("v"))
    # a few vectors of the grid's size: configuration, like the list of states
    listed = (probes.groupBy("level_ix", "probe").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("_g"))
              .agg(F.collect_list(F.struct("level_ix", "probe", F.col("_g.v").alias("v")))).scalar())
    each = (rows.select(*mix, "sigma", "r", "v", "cells", lead.alias("_l")).select("*", F.explode(listed).alias("_s")).where("_s.level_ix = level_ix")
            .select(*mix, F.col("_s.probe").alias("probe"), "sigma", "r", "v", "cells", "_l", F.transform("cells", lambda c: F.element_at(F.col("_s.v"), c + 1)).alias("_v"))
            .withColumn("_dot", _dot(F.col("_l"), F.col("_v"))))
    flat = each.select("pair", "ref_id", "model", *STATE, "probe", "sigma", "r", "v", "_dot", F.explode(F.arrays_zip(F.col("cells").alias("cell"), F.col("_l").alias("l"), F.col("_v").alias("v"))).alias("_c"))
    sums = flat.groupBy("pair", "ref_id", "model", *STATE, F.col("_c.cell").alias("cell"), "probe").agg(
        F.max("sigma").alias("sigma"), F.max("_c.v").alias("v"), F.sum("r").alias("_r"), F.sum(F.col("r") / F.col("v")).alias("_w"), F.sum(F.col("r") * F.col("_dot")).alias("_e"),
        F.sum(F.col("r") * F.col("_c.l")).alias("_b"), F.sum(F.col("r") * F.col("_c.l") * F.col("_dot")).alias("_a"))
    jv = F.col("sigma") * (F.col("_w") * F.col("v") - (F.col("_a") - F.col("_b") * F.col("_e") / F.col("_r")))
    return sums.select(*CELL, "probe", jv.alias("jv"), "v", "sigma")


def hutchinson(products: DataFrame) -> DataFrame:
    """Mean over probes of v·Jv: an unbiased Jacobian diagonal."""
    return products.groupBy(*CELL).agg(F.avg(F.col("v") * F.col("jv")).alias("jacobian"), F.max("sigma").alias("sigma"))


def packed_model(components: DataFrame, stats: DataFrame) -> DataFrame:
    """Packed components, written once for every stream that scores them."""
    return materialized(pack_components(components, stats), "components")


def score_all(latents: DataFrame, components: DataFrame, stats: DataFrame, draws: DataFrame) -> dict[str, DataFrame]:
    """:func:`score_packed` for unpacked component tables."""
    return score_packed(latents, packed_model(components, stats), draws)


def score_packed(latents: DataFrame, comps: DataFrame, draws: DataFrame, keys: DataFrame | None = None,
                 contrast: bool = True) -> dict[str, DataFrame]:
    """The packed inputs and the scored tables the operators above share.

    ``keys`` (pair, ref_id, prompt_key) scores every image under its prompt,
    and with ``contrast`` its target without the prompt as well.

    The model side (components, noise) is small and read by several joins, so
    it is written once to the shared folder; its file sizes then let Catalyst
    decide what to broadcast.
    """
    bstates = materialized(block_states(pack_blocks(comps), pack_draws(draws)), "block-states")
    cstates = materialized(component_states(comps, bstates), "component-states")
    refs = pack_references(latents, keys)
    dist = distances(refs, comps, bstates, cstates, contrast)
    resp = responsibilities(dist)
    blocks = state_blocks(resp, refs, comps, bstates)
    return {"refs": refs, "comps": comps, "bstates": bstates, "dist": dist, "resp": resp, "blocks": blocks, "cells": state_cells(blocks)}


def control_draws(requests: DataFrame, components: DataFrame, stats: DataFrame, key: bytes = keyed.RESEARCH_KEY) -> DataFrame:
    """Negative controls drawn from a mixture: one component by its weight, plus noise.

    ``requests(pair, ref_id)`` names the controls. A control's component is the
    one whose cumulative-weight interval holds its keyed uniform; intervals
    share their ends, from 0 to 1, so each control has one component.
    """
    total = F.sum("weight").over(Window.partitionBy("pair", "block"))
    order = Window.partitionBy("pair", "block").orderBy("comp")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.when(F.lead("comp").over(order).isNull(), F.lit(1.0)).otherwise(F.sum("weight").over(upto) / total)
    edges = stats.withColumn("hi", ends).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    picks = requests.withColumn("u", keyed.uniform(keyed.prf_hex("control", F.col("ref_id"), key)))
    chosen = (dealt(picks).join(copied(edges), ["pair", "_bucket"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
              .select("pair", "_bucket", "ref_id", "block", "comp", "variance"))
    eps = keyed.normal(keyed.prf_hex("control", F.concat_ws(":", "ref_id", "cell"), key))
    return (chosen.join(copied(components.select("pair", "block", "comp", "cell", "mean")), ["pair", "_bucket", "block", "comp"])
            .select("pair", "ref_id", "comp", "cell", (F.col("mean") + F.sqrt("variance") * eps).alias("value")))
