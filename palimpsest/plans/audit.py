"""The flagship job: which references did a model pair memorize, and where?

References and negative controls are rows of one latent table, levels and
draws are columns, and a fleet of model pairs is a key. Heavy work (scoring)
runs once; what several stages read is written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.functions.profiles import Profile
from palimpsest.operators import evaluate, probe, scoring
from palimpsest.operators import mixture as mx
from palimpsest.session import materialized

IMAGE = ["pair", "ref_id"]
#: One tested image under one level window. Controls appear once per window.
TEST = ["pair", "win_lo", "win_hi", "ref_id"]
RUN = ["pair", "win_lo", "win_hi"]
#: Rows one task of the detector sorts and windows.
TASK_ROWS = 1_000_000


@dataclass
class Audit:
    """The tables an audit leaves behind."""

    images: DataFrame
    fields: DataFrame
    gated: DataFrame
    maps: DataFrame
    cells: DataFrame
    distances: DataFrame
    own_distances: DataFrame
    regions: DataFrame
    summary: DataFrame
    verdicts: DataFrame


def both_models(posterior: DataFrame, keys: list[str], prompted: bool = False) -> DataFrame:
    """Base and target side by side; a shared block counts for both.

    ``prompted`` adds the target's retained variance without the trigger; where
    no trigger changes its weights it is the target's own.
    """
    base, target = F.col("model").isin("base", "both"), F.col("model").isin("target", "both")

    def side(column: str, when) -> F.Column:
        return F.max(F.when(when, F.col(column)))

    return posterior.groupBy(*keys, "level_ix", "draw", "cell").agg(
        F.max("alpha").alias("alpha"), F.max("sigma").alias("sigma"),
        side("rho", base).alias("rho_base"), side("rho", target).alias("rho_target"),
        *([F.coalesce(side("rho", F.col("model") == "unprompted"), side("rho", target)).alias("rho_uncond")] if prompted else []),
        side("mean", base).alias("x0_base"), side("mean", target).alias("x0_target"),
        side("eps_hat", base).alias("eps_base"), side("eps_hat", target).alias("eps_target"))


def by_image(df: DataFrame, rows: int) -> DataFrame:
    """Hashed on the image, in tasks of about ``TASK_ROWS`` of ``rows``: every later window and group of an image stays in its task."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-rows // TASK_ROWS)), *IMAGE)


def pack(latents: DataFrame, prompts: DataFrame | None = None) -> DataFrame:
    """One row per image with its latents, trigger key and whether it has a prompt, written once for every stream."""
    refs = mx.pack_references(latents)
    if prompts is not None:
        refs = refs.join(prompts.select(*IMAGE, "prompt_key", (F.length("prompt") > 0).alias("conditional")), IMAGE, "left")
    return materialized(refs, "references")


def scored(refs: DataFrame, model: DataFrame, levels: Sequence[float], draws: int, cells: int, stream: str,
           fold: tuple, contrast: bool = False) -> DataFrame:
    """What ``fold`` makes of both models' posteriors of packed ``refs`` at every (level, draw) of a stream."""
    states = mx.pack_draws(keyed.draws(keyed.level_table(refs.sparkSession, levels), draws, cells, stream))
    return scoring.posteriors(refs, model, states, cells, *fold, contrast)


def measure(latents: DataFrame, model: tuple[DataFrame, DataFrame] | DataFrame, levels: Sequence[float], draws: int, cells: int,
            stream: str, prompts: DataFrame | None = None, contrast: bool = True) -> DataFrame:
    """Posterior of both models at every (level, draw) of a stream.

    ``model`` is (components, weights) or the packed table made from them.
    With ``prompts`` (pair, ref_id, prompt, prompt_key) every image is scored
    under its prompt, and for the ``contrast`` ``rho_uncond`` is the target's
    without it: NULL for images whose prompt is empty.
    """
    comps = model if isinstance(model, DataFrame) else mx.packed_model(*model)
    contrast = contrast and prompts is not None
    names = tuple(n for n in scoring.MEASURED if n != "rho_uncond" or contrast)
    return scored(pack(latents, prompts), comps, levels, draws, cells, stream, scoring.draws_fold(names), contrast)


def level_windows(refs: DataFrame, roles: DataFrame, model: DataFrame, cfg: Profile,
                  levels: Sequence[float], rows: int, cols: int, scout: bool, channels: int = 1) -> DataFrame:
    """(pair, win_lo, win_hi, ref_id, role, levels): what each image is tested at.

    A control is tested at every window some reference of its pair uses.
    """
    if not scout:
        last = len(levels) - 1
        return roles.select("pair", F.lit(0).alias("win_lo"), F.lit(last).alias("win_hi"), "ref_id", "role", F.lit(len(levels)).alias("levels"))
    only = refs.select(*IMAGE, "x0").join(roles.where("role = 'reference'").select(*IMAGE), IMAGE, "left_semi")  # the base follows no trigger
    rho = scored(only, model.where("model <> 'target'"), levels, cfg.scout_draws, channels * rows * cols, "scout", scoring.retained_fold(channels))
    rho = by_image(rho, refs.count() * len(levels) * rows * cols)
    picked = probe.select_levels(probe.scout_metrics(rho, IMAGE, rows, cols, cfg, dense=True), IMAGE, cfg).where("selected")
    windows = materialized(picked.groupBy(*IMAGE).agg(F.min("level_ix").alias("win_lo"), F.max("level_ix").alias("win_hi")), "windows")
    span = (F.col("win_hi") - F.col("win_lo") + 1).alias("levels")
    mine = (roles.where("role = 'reference'").join(windows, IMAGE, "left")
            .select("pair", F.coalesce("win_lo", F.lit(-1)).alias("win_lo"), F.coalesce("win_hi", F.lit(-2)).alias("win_hi"), "ref_id", "role"))
    used = windows.select("pair", "win_lo", "win_hi").distinct()
    controls = roles.where("role = 'control'").join(used, "pair").select("pair", "win_lo", "win_hi", "ref_id", "role")
    return mine.unionByName(controls).select("*", span)


def run(latents: DataFrame, roles: DataFrame, model: tuple[DataFrame, DataFrame], cfg: Profile, levels: Sequence[float],
        rows: int, cols: int, scout: bool = False, channels: int = 1) -> Audit:
    """Scout, field, regions, calibration, confirmation and verdict for every image.

    With several ``channels``, ``latents.cell`` is a coordinate, channel *
    rows * cols + cell: models score coordinates, the detector sees cells.

    ``latents(pair, ref_id, cell, value)``, ``roles(pair, ref_id, role)`` with
    role ``reference`` or ``control``. Where ``roles`` has ``prompt`` and the
    weights ``prompt_key``, images are scored under their prompts and regions
    get their prompt collapse.
    """
    packed = mx.packed_model(*model)
    prompts = None
    if "prompt" in roles.columns:
        asked = roles.select(*IMAGE, F.coalesce("prompt", F.lit("")).alias("prompt")).distinct()
        gates = model[1] if "prompt_key" in model[1].columns else model[1].select("pair", F.lit("").alias("prompt_key"))
        prompts = materialized(mx.prompt_keys(asked, gates, "pair"), "prompts")
    refs, coordinates, contrast = pack(latents, prompts), channels * rows * cols, prompts is not None
    images = materialized(level_windows(refs, roles, packed, cfg, levels, rows, cols, scout, channels), "images")
    folded = scored(refs, packed, levels, max(cfg.draws, 2), coordinates, "noise", scoring.field_fold(channels, contrast), contrast)
    fields = materialized(probe.bounded(folded), "field")
    distances = materialized(scored(refs, packed, levels, max(cfg.confirmation_draws, 1), coordinates, "confirmation", scoring.distance_fold(channels)), "distances")

    inside = F.col("level_ix").between(F.col("win_lo"), F.col("win_hi"))
    tested = images.select(*TEST)
    own_fields = by_image(tested.join(fields, IMAGE).where(inside), images.count() * len(levels) * rows * cols)
    own_distances = tested.join(distances, IMAGE).where(inside)
    gated = probe.gate(own_fields, TEST, rows, cols, cfg, dense=True)
    sustained = probe.sustain(gated, TEST)
    maps = materialized(probe.smooth_maps(sustained, TEST, rows, cols, cfg, dense=True), "maps")
    cells = materialized(probe.clusters(maps, TEST, rows, cols, cfg), "clusters")

    stats = probe.region_statistics(cells, maps, TEST, rows, cols)
    peaks = probe.peak_levels(cells, own_fields, TEST)
    snaps = probe.snap_by_level(own_distances, cells, TEST, [*TEST, "root"])
    at_peak = peaks.join(snaps, [*TEST, "root"]).where("level_ix = peak_level").select(*TEST, "root", "peak_level", "snap")
    lambdas = F.element_at(F.array(*[F.lit(float(v)) for v in levels]), F.col("peak_level") + 1)
    found = stats.join(at_peak, [*TEST, "root"]).withColumn("peak_level", lambdas)
    if "prompt_collapse" not in found.columns:
        found = found.withColumn("prompt_collapse", F.lit(None).cast("double"))
    found = materialized(found, "regions")
    summary = probe.image_summary(images, found, probe.membership_snap(own_distances, cells, TEST), TEST)
    summary = materialized(summary.join(probe.negative_area(maps, TEST, cfg), TEST, "left"), "summary")

    references = summary.where("role = 'reference'")
    regions = probe.calibrate(found.join(references.select(*TEST), TEST, "left_semi"), summary, RUN, TEST, cfg)
    snap_p = evaluate.exceedance(summary, "membership_snap", RUN, F.col("role") == "control").select(*TEST, F.col("p_value").alias("snap_p"), F.col("controls").alias("n_controls"))
    rows_in = (references.join(probe.counted_summary(regions, TEST), TEST, "left").join(snap_p, TEST, "left")
               .withColumn("issues", F.lit(None).cast("array<string>"))
               .withColumn("negative_area", F.coalesce("negative_area", F.lit(0.0))))
    verdicts = probe.verdict(rows_in, cfg)
    return Audit(images, fields, gated, maps, cells, distances, own_distances, regions, summary, verdicts)


def heat_layers(audit: Audit, cells: int) -> DataFrame:
    """(TEST, layer, cell, value) of every tested image; one without a level keeps a primary layer of zeros."""
    counted = audit.cells.join(audit.regions.where("counts").select(*TEST, "root"), [*TEST, "root"], "left_semi")
    measured = probe.layers(audit.maps, audit.gated, counted, TEST)
    zero = audit.images.where("levels = 0").select(*TEST, F.lit("collapse").alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0.0).alias("value"))
    return measured.unionByName(zero)


def level_rows(audit: Audit, levels: Sequence[float]) -> DataFrame:
    """(TEST, level_ix, level, ...): the level summaries of every tested image, with the whole frame's snap."""
    frame = audit.own_distances.groupBy(*TEST, "level_ix").agg(F.exp(F.avg(probe.log_ratio())).alias("snap"))
    value = F.element_at(F.array(*[F.lit(float(v)) for v in levels]), F.col("level_ix") + 1)
    return probe.level_summaries(audit.gated, frame, TEST).withColumn("level", value)


def report_details(audit: Audit, levels: Sequence[float], profile: str, source: str = "base-samples", key: bytes = keyed.RESEARCH_KEY) -> DataFrame:
    """What a report states beside its findings, per reference: ids, schedule, controls and levels.

    Lists hold one entry per level or control of a run. ``source`` says where the
    controls come from; a run without controls has none.
    """
    summaries = level_rows(audit, levels)
    told = [c for c in ("level", "released_fraction", "mean_collapse", "max_collapse", "mean_prompt_collapse", "snap") if c in summaries.columns]
    by_level = summaries.groupBy(*TEST).agg(F.transform(F.array_sort(F.collect_list(F.struct("level_ix", *told))), lambda e: F.struct(*[e[c].alias(c) for c in told])).alias("levels"))
    nulls = audit.summary.where("role = 'control'").groupBy(*RUN).agg(F.struct(
        F.lit(source).alias("source"), F.count(F.lit(1)).alias("count"), F.sort_array(F.collect_list("max_mass")).alias("max_masses"),
        F.sort_array(F.collect_list("membership_snap")).alias("membership_snaps")).alias("controls"))
    heads = audit.summary.where("role = 'reference'").select(*TEST, "negative_area")
    schedule = keyed.schedule_id(key)
    name = F.sha2(F.concat_ws("|", F.lit(profile), "pair", "ref_id", "win_lo", "win_hi", schedule), 256)
    return (heads.join(by_level, TEST, "left").join(nulls, RUN, "left")
            .select(*TEST, F.substring(name, 1, 32).alias("report_id"), F.concat(F.lit("target-"), "pair").alias("target"), F.concat(F.lit("base-"), "pair").alias("base"),
                    F.lit(profile).alias("profile"), schedule.alias("schedule_id"), "negative_area", "controls",
                    F.coalesce("levels", F.array().cast(summaries_type(by_level))).alias("levels")))


def summaries_type(by_level: DataFrame) -> str:
    return by_level.schema["levels"].dataType.simpleString()


def planted_overlap(audit: Audit, planted: Sequence[int]) -> DataFrame:
    """IoU of each reference's counted cells with the planted cells."""
    size = len(planted)
    counted = audit.cells.join(audit.regions.where("counts").select(*TEST, "root"), [*TEST, "root"], "left_semi")
    hit = F.count(F.when(F.col("cell").isin(*planted), 1))
    got = counted.groupBy(*TEST).agg((hit / (F.count(F.lit(1)) + size - hit)).alias("iou"))
    return audit.verdicts.select(*TEST).join(got, TEST, "left").select(*TEST, F.coalesce("iou", F.lit(0.0)).alias("iou"))


def trial_rows(audit: Audit, planted: Sequence[int], labels: DataFrame) -> DataFrame:
    """One experiment trial per reference: its strongest counted region, snap, IoU, verdict."""
    return (audit.verdicts.join(planted_overlap(audit, planted), TEST).join(labels, IMAGE)
            .select("pair", "ref_id", "label", F.coalesce("lead.mean_collapse", F.lit(0.0)).alias("collapse"),
                    F.col("membership_snap").alias("snap"), "iou", "verdict"))
