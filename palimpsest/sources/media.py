"""Images, manifests, reports and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image extensions of a control folder and the manifest's defaults.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "heic", "heif", "tif", "tiff", "webp", "bmp", "gif")
MANIFEST = ("name string, toy struct<identities:int,lookAlikesPerIdentity:int,lookAlikeDistance:double,variance:double,side:int,generic:int,"
            "memorization:struct<kappas:array<double>,members:int,duplicates:int,identityWeight:double,references:int,probes:int>>")
TOY_DEFAULTS = {"identities": 3, "lookAlikesPerIdentity": 2, "lookAlikeDistance": 1.0, "variance": 0.05, "side": 12, "generic": 12}
MEMORIZATION_DEFAULTS = {"members": 8, "duplicates": 1, "identityWeight": 0.05, "references": 4, "probes": 4}
KAPPA_DEFAULTS = (0.0, 0.5, 1.0)
REPORT_SCHEMA = "palimpsest.memorization.v1"


def control_files(spark: SparkSession, folder: str) -> DataFrame:
    """Image files of a folder, any case of extension, sorted by name. Reads no content."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return files.withColumn("name", name).where(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*IMAGE_EXTENSIONS)).orderBy("name")


def image_latents(spark: SparkSession, folder: str, side: int) -> DataFrame:
    """(path, ref_id, cell, value, error): standardised luminance on a side x side grid.

    Cells take the area mean of their pixels. ``ref_id`` is the content's
    SHA-256. An image file that cannot be read has one row with the error
    ``unreadable`` and neither cell nor value.
    """
    images = spark.read.format("image").option("dropInvalid", "true").load(folder).select("image.*")
    ids = spark.read.format("binaryFile").load(folder).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("ref_id"))
    rows = images.withColumn("_y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring(F.col("data"), F.col("_y") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels"))
    pixels = (rows.select("origin", "width", "height", "nChannels", "_y", F.hex(line).alias("_hex"))
              .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("width") - 1))))

    def channel(i: Column) -> Column:
        at = (F.col("_x") * F.col("nChannels") + i) * 2 + 1
        return F.conv(F.substring(F.col("_hex"), at, F.lit(2)), 16, 10).cast("double")

    grey = F.col("nChannels") == 1
    # the image source stores blue, green, red
    blue, green, red = channel(F.lit(0)), channel(F.when(grey, 0).otherwise(1)), channel(F.when(grey, 0).otherwise(2))
    luma = (0.2126 * red + 0.7152 * green + 0.0722 * blue) / 255
    cell = F.floor(F.col("_y") * side / F.col("height")) * side + F.floor(F.col("_x") * side / F.col("width"))
    grid = pixels.groupBy("origin", cell.cast("int").alias("cell")).agg(((F.avg(luma) - 0.5) / 0.25).alias("value"))
    listed = ids.join(grid.withColumn("path", F.regexp_replace("origin", "^file:/*", "/")), "path", "left")
    named = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*IMAGE_EXTENSIONS)
    return listed.where(F.col("cell").isNotNull() | named).select("path", "ref_id", "cell", "value", F.when(F.col("cell").isNull(), "unreadable").alias("error"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Experiment configuration with a default for every missing field."""
    raw = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    toy, mem = F.col("toy"), F.col("toy.memorization")
    return raw.select(
        "name", toy.isNotNull().alias("has_toy"), *[F.coalesce(toy[k], F.lit(v)).alias(k) for k, v in TOY_DEFAULTS.items()],
        F.coalesce(mem["kappas"], F.array(*[F.lit(k) for k in KAPPA_DEFAULTS])).alias("kappas"),
        *[F.coalesce(mem[k], F.lit(v)).alias(k) for k, v in MEMORIZATION_DEFAULTS.items()])


def plain(value: Column) -> Column:
    """A number for JSON: non-finite values become ``inf``, ``-inf`` or ``nan`` text."""
    return (F.when(F.isnan(value), "nan").when(value == float("inf"), "inf").when(value == float("-inf"), "-inf").otherwise(value.cast("string")))


#: What every report says about itself.
DISCLAIMER = ("This report tests for memorization: where a model's weights fix parts of an image that its baseline leaves open. It does not measure ability. "
              "The rules are not calibrated on labelled members. A report without findings does not show that the image was left out of training.")


def assemble_reports(verdicts: DataFrame, regions: DataFrame, layers: DataFrame, keys: list[str], created: Column, details: DataFrame | None = None) -> DataFrame:
    """One nested row per image: verdict, reasons, regions, layers, provenance.

    Region and layer lists are bounded by the grid. ``calibrated`` stays
    false: the rules are not validated on labelled data. ``details`` (keys, ...)
    adds its columns, for example ids, the schedule, controls and levels.
    """
    kinds = dict(regions.dtypes)
    told = [c for c in ("region", "cells", "area_fraction", "mass", "mean_collapse", "peak_collapse", "peak_level", "p_value", "significance", "snap") if c in kinds]
    entry = F.struct(*[plain(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in told])
    listed = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("regions"))
    maps = (layers.groupBy(*keys, "layer").agg(F.array_sort(F.collect_list(F.struct("cell", "value"))).alias("_g"))
            .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layer", F.transform(F.col("_g.value"), lambda v: plain(v.cast("double"))).alias("values")))).alias("layers")))
    head = verdicts.select(*keys, "verdict", "reasons", plain(F.col("membership_snap")).alias("membership_snap"), plain(F.col("frame_snap")).alias("frame_snap"))
    if details is not None:
        head = head.join(details, keys, "left")
    return (head.join(listed, keys, "left").join(maps, keys, "left")
            .withColumn("disclaimer", F.lit(DISCLAIMER)).withColumn("schema", F.lit(REPORT_SCHEMA)).withColumn("calibrated", F.lit(False)).withColumn("created", F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .withColumn("run_date", F.to_date(created)))


def report_json(reports: DataFrame, keys: list[str]) -> DataFrame:
    """Reports as JSON text with keys in alphabetical order."""
    names = sorted(c for c in reports.columns if c != "run_date")
    return reports.select(*keys, F.to_json(F.struct(*names)).alias("report"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").partitionBy("run_date").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_overlay(pixels: DataFrame, path: str, by: str = "ref_id") -> None:
    """Overlay pixels, a folder per image."""
    pixels.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)
