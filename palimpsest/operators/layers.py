"""Adapter modules placed on the layers of a diffusion transformer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name prefixes stripped in this order, each at most once, and the
# marks of text-encoder modules.
PREFIXES = ("base_model.model.", "model.diffusion_model.", "diffusion_model.", "transformer.", "unet.",
            "lora_unet_", "lora_transformer_", "lycoris_", "lora_")
TEXT_ENCODER_MARKS = ("lora_te", "text_encoder", "te1_", "te2_", "qwen", "text_model")

# Renames between checkpoint dialects.
RENAMES = ((".attn.to_out.0", ".attn.to_out"), ("time_guidance_embed.timestep_embedder.", "time_guidance_embed."))
KEY_RENAMES = ((".attn.to_out.0.", ".attn.to_out."), ("time_guidance_embed.timestep_embedder.", "time_guidance_embed."))

# Native names with a block index, their layers ({} is the index).
# A fused projection lists one layer per equal row part.
INDEXED = (
    (r"double_blocks\.(\d+)\.img_attn\.qkv", ("transformer_blocks.{}.attn.to_q", "transformer_blocks.{}.attn.to_k", "transformer_blocks.{}.attn.to_v")),
    (r"double_blocks\.(\d+)\.txt_attn\.qkv", ("transformer_blocks.{}.attn.add_q_proj", "transformer_blocks.{}.attn.add_k_proj", "transformer_blocks.{}.attn.add_v_proj")),
    (r"double_blocks\.(\d+)\.img_attn\.proj", ("transformer_blocks.{}.attn.to_out",)),
    (r"double_blocks\.(\d+)\.txt_attn\.proj", ("transformer_blocks.{}.attn.to_add_out",)),
    (r"double_blocks\.(\d+)\.img_mlp\.0", ("transformer_blocks.{}.ff.linear_in",)),
    (r"double_blocks\.(\d+)\.img_mlp\.2", ("transformer_blocks.{}.ff.linear_out",)),
    (r"double_blocks\.(\d+)\.txt_mlp\.0", ("transformer_blocks.{}.ff_context.linear_in",)),
    (r"double_blocks\.(\d+)\.txt_mlp\.2", ("transformer_blocks.{}.ff_context.linear_out",)),
    (r"single_blocks\.(\d+)\.linear1", ("single_transformer_blocks.{}.attn.to_qkv_mlp_proj",)),
    (r"single_blocks\.(\d+)\.linear2", ("single_transformer_blocks.{}.attn.to_out",)),
)
NAMED = {
    "img_in": "x_embedder", "txt_in": "context_embedder",
    "time_in.in_layer": "time_guidance_embed.linear_1", "time_in.out_layer": "time_guidance_embed.linear_2",
    "double_stream_modulation_img.lin": "double_stream_modulation_img.linear",
    "double_stream_modulation_txt.lin": "double_stream_modulation_txt.linear",
    "single_stream_modulation.lin": "single_stream_modulation.linear",
    "final_layer.linear": "proj_out",
}
HALF_SWAPPED = {"final_layer.adaLN_modulation.1": "norm_out.linear"}


def rename_key(key: Column) -> Column:
    """Layer key in the executor's dialect."""
    for old, new in KEY_RENAMES:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def _stripped(name: Column) -> Column:
    for prefix in PREFIXES:
        name = F.regexp_replace(name, "^" + prefix.replace(".", r"\."), "")
    for old, new in RENAMES:
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def _native_targets(key: Column) -> Column:
    """Layers a native name stands for, NULL when it is none."""
    out = F.lit(None).cast("array<string>")
    for name, layer in {**NAMED, **HALF_SWAPPED}.items():
        out = F.when(key == name, F.array(F.lit(layer))).otherwise(out)
    for regex, targets in INDEXED:
        index = F.regexp_extract(key, f"^{regex}$", 1)
        out = F.when(index != "", F.array(*[F.concat(*_around(t, index)) for t in targets])).otherwise(out)
    return out


def _around(target: str, index: Column) -> list[Column]:
    before, after = target.split("{}")
    return [F.lit(before), index, F.lit(after)]


def place_modules(modules: DataFrame, layers: DataFrame) -> DataFrame:
    """(unit, module, status, layer, part, parts, swapped).

    ``modules(unit, module)``, ``layers(layer)``. Exact names first, then
    names equal up to dots and underscores, then native names whose layers
    all exist; text-encoder modules are unsupported.
    """
    lower = F.lower("module")
    encoder = F.lit(False)
    for mark in TEXT_ENCODER_MARKS:
        encoder = encoder | lower.startswith(mark) | F.contains(lower, F.lit("." + mark))
    rows = modules.select("unit", "module", encoder.alias("_enc"), _stripped(F.col("module")).alias("_key"))
    rows = rows.withColumn("_flat", F.replace("_key", F.lit("."), F.lit("_")))
    flat = layers.groupBy(F.replace("layer", F.lit("."), F.lit("_")).alias("_flat")).agg(F.min("layer").alias("_dotted"))
    exact = layers.select(F.col("layer").alias("_key"), F.col("layer").alias("_exact")).distinct()
    named = rows.join(exact, "_key", "left").join(flat, "_flat", "left").withColumn("_direct", F.coalesce("_exact", "_dotted"))
    tried = named.where("NOT _enc AND _direct IS NULL").select(
        "unit", "module", F.col("_key").isin(*HALF_SWAPPED).alias("swapped"), F.posexplode_outer(_native_targets(F.col("_key"))).alias("part", "_target"))
    known = tried.join(layers.select(F.col("layer").alias("_target"), F.lit(True).alias("_there")).distinct(), "_target", "left")
    whole = known.groupBy("unit", "module").agg(F.every(F.coalesce("_there", F.lit(False))).alias("_all"), F.count(F.lit(1)).alias("parts"))
    native = known.join(whole, ["unit", "module"])
    good = native.where("_all").select("unit", "module", F.lit("translated").alias("status"), F.col("_target").alias("layer"), "part", F.col("parts").cast("int").alias("parts"), "swapped")
    lost = whole.where("NOT _all").select("unit", "module", F.lit("unmapped").alias("status"), F.lit(None).cast("string").alias("layer"),
                                          F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("parts"), F.lit(False).alias("swapped"))
    direct = named.where("_enc OR _direct IS NOT NULL").select(
        "unit", "module", F.when(F.col("_enc"), "unsupported").otherwise("placed").alias("status"), F.when(~F.col("_enc"), F.col("_direct")).alias("layer"),
        F.when(~F.col("_enc"), 0).alias("part"), F.when(~F.col("_enc"), 1).alias("parts"), F.lit(False).alias("swapped"))
    return direct.unionByName(good).unionByName(lost)


def split_fused(elements: DataFrame, parts: Column, rows: Column) -> DataFrame:
    """Row-wise split of a fused projection: part and row inside the part.

    Rows beyond ``parts`` equal pieces belong to none, as in an exact split.
    """
    size = F.floor(rows / parts)
    return (elements.withColumn("part", F.floor(F.col("i") / size).cast("int")).where(F.col("part") < parts)
            .withColumn("i", F.pmod(F.col("i"), size)))


def swap_halves(elements: DataFrame, rows: Column) -> DataFrame:
    """(shift, scale) rows to (scale, shift)."""
    half = F.floor(rows / 2)
    return elements.where(F.col("i") < 2 * half).withColumn("i", F.pmod(F.col("i") + half, 2 * half))


def coverage(mapped: DataFrame, layers: DataFrame) -> DataFrame:
    """(unit, layer, outcome): applied, wrong shape, or missing from the executor.

    ``mapped(unit, layer, out_dim, in_dim)``, ``layers(layer, out_dim, in_dim)``.
    """
    known = layers.select("layer", F.col("out_dim").alias("_o"), F.col("in_dim").alias("_i"))
    outcome = (F.when(F.col("_o").isNull(), "missed").when((F.col("_o") != F.col("out_dim")) | (F.col("_i") != F.col("in_dim")), "mismatched").otherwise("applied"))
    return mapped.join(known, "layer", "left").select("unit", "layer", outcome.alias("outcome"), F.concat(
        F.lit("("), F.col("out_dim").cast("string"), F.lit(", "), F.col("in_dim").cast("string"), F.lit(") vs ("), F.col("_o").cast("string"), F.lit(", "), F.col("_i").cast("string"), F.lit(")")).alias("detail"))


def coverage_issues(placed: DataFrame, covered: DataFrame) -> DataFrame:
    """(unit, applied, issues): an issue is struct(code, n, names) with every name, sorted.

    Codes: ``unplaced`` and ``text-encoder`` modules, ``shape`` conflicts, and
    layers that the transformer does ``not-linear`` build.
    """
    names = placed.where(F.col("status").isin("unmapped", "unsupported")).select(
        "unit", F.when(F.col("status") == "unmapped", "1unplaced").otherwise("2text-encoder").alias("code"), F.col("module").alias("name"))
    wrong = covered.where(F.col("outcome").isin("mismatched", "missed")).select(
        "unit", F.when(F.col("outcome") == "mismatched", "3shape").otherwise("4not-linear").alias("code"),
        F.when(F.col("outcome") == "mismatched", F.concat("layer", F.lit(" "), "detail")).otherwise(F.col("layer")).alias("name"))
    each = names.unionByName(wrong).groupBy("unit", "code").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    issues = each.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("code", "n", "names"))).alias("_i"))
    applied = covered.groupBy("unit").agg(F.count(F.when(F.col("outcome") == "applied", 1)).alias("applied"))
    plain = F.transform(F.coalesce("_i", F.array().cast("array<struct<code:string,n:bigint,names:array<string>>>")),
                        lambda i: F.struct(F.substring(i["code"], 2, 99).alias("code"), i["n"].alias("n"), i["names"].alias("names")))
    units = placed.select("unit").unionByName(covered.select("unit")).distinct()
    return units.join(applied, "unit", "left").join(issues, "unit", "left").select("unit", F.coalesce("applied", F.lit(0)).alias("applied"), plain.alias("issues"))


def compatibility_issues(base_model: Column, variant: Column, family: str) -> Column:
    """Why an adapter and the transformer under test may not fit: struct(code, detail) entries."""
    b, stated = F.lower(base_model), base_model.isNotNull()
    foreign = stated & ~F.contains(b, F.lit(family.lower()))
    sibling = stated & ~foreign & (F.contains(b, F.lit("base")) != (variant == "base"))

    def issue(when: Column, code: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(code).alias("code"), detail.alias("detail")))

    return F.array_compact(F.array(
        issue(variant != "base", "few-noise-levels", variant), issue(foreign, "other-family", base_model), issue(sibling, "other-variant", base_model)))


def card_variant(text: Column, base_marks: tuple[str, ...], distilled_marks: tuple[str, ...]) -> Column:
    """``base`` or ``distilled`` from a card's text; NULL when it does not say."""
    t = F.lower(text)

    def any_of(marks: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(t, F.lit(mark))
        return hit

    return F.when(any_of(base_marks), "base").when(any_of(distilled_marks), "distilled")
