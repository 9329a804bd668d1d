"""Heatmaps as data: cells, pixels, colours and outlines as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.mixture import spread

# The colour ramp's stops (t, red, green, blue) and its opacity range.
RAMP = ((0.0, 0xFD, 0xE3, 0xD0), (0.25, 0xF6, 0xAE, 0x86), (0.5, 0xEB, 0x68, 0x34), (0.75, 0xB9, 0x46, 0x1A), (1.0, 0x6B, 0x24, 0x0A))
ALPHA_LOW, ALPHA_HIGH = 0.55, 0.92


def cell_rect(row: Column, col: Column, frame: tuple, rows: int, cols: int) -> list[Column]:
    """Pixel rectangle of a cell; ``frame`` is (x, y, width, height)."""
    fx, fy, fw, fh = (F.lit(v) if isinstance(v, (int, float)) else v for v in frame)
    w, h = fw / cols, fh / rows
    return [(fx + col * w).alias("x"), (fy + row * h).alias("y"), w.alias("width"), h.alias("height")]


def _inside(x: Column, y: Column, frame: tuple) -> Column:
    fx, fy, fw, fh = frame
    return (x >= fx) & (x < fx + fw) & (y >= fy) & (y < fy + fh)


def pixel_cell(x: Column, y: Column, frame: tuple, rows: int, cols: int) -> Column:
    """Cell under a pixel, NULL outside the frame."""
    fx, fy, fw, fh = frame
    col = F.least(F.floor((x - fx) / fw * cols), F.lit(cols - 1))
    row = F.least(F.floor((y - fy) / fh * rows), F.lit(rows - 1))
    return F.when(_inside(x, y, frame), (row * cols + col).cast("int"))


def sample(pixels: DataFrame, maps: DataFrame, keys: list[str], frame: tuple, rows: int, cols: int) -> DataFrame:
    """Bilinear value at each pixel, cell centres as knots, edges clamped.

    Each map is folded to one array, and pixels meet it by a shuffled hash
    join on the keys alone: Catalyst takes a map's cells, exploded from a short array, for
    few enough to broadcast. Pixels outside the frame drop.
    """
    fx, fy, fw, fh = frame
    inside = pixels.where(_inside(F.col("px"), F.col("py"), frame))
    gx, gy = (F.col("px") - fx) / fw * cols - 0.5, (F.col("py") - fy) / fh * rows - 0.5
    clipped = {f"_{n}{d}": F.least(F.greatest(F.floor(g) + d, F.lit(0)), F.lit(size - 1)).cast("int") for n, g, size in (("y", gy, rows), ("x", gx, cols)) for d in (0, 1)}
    placed = inside.withColumns({**clipped, "_fx": gx - F.floor(gx), "_fy": gy - F.floor(gy)})

    def corner(dy: int, dx: int) -> tuple[Column, Column]:
        w = (F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))
        return F.col("_grid")[F.col(f"_y{dy}") * cols + F.col(f"_x{dx}")], w

    cells = spread(maps.select(*keys, "cell", "value").where("cell IS NOT NULL"), *keys).groupBy(*keys, "cell").agg(F.struct(F.sum("value").alias("v")).alias("_s"))
    grids = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("int").alias("cell"), "_s"))).alias("_m"))
    every = F.sequence(F.lit(0), F.lit(rows * cols - 1))
    grids = grids.select(*keys, F.transform(every, lambda i: F.col("_m")[i]).alias("_grid"))
    corners = [corner(dy, dx) for dy in (0, 1) for dx in (0, 1)]
    terms = [w * s["v"] for s, w in corners]
    total = F.when(F.coalesce(*terms).isNotNull(), sum((F.coalesce(t, F.lit(0.0)) for t in terms[1:]), F.coalesce(terms[0], F.lit(0.0))))
    known = F.coalesce(*[s for s, _ in corners]).isNotNull()
    # generated, so that colours and filters read the value instead of repeating its formula
    return placed.join(grids.hint("shuffle_hash"), keys).where(known).select(*pixels.columns, F.explode(F.array(total)).alias("value"))


def ramp(t: Column) -> Column:
    """struct(r, g, b) in [0, 1] at t, piecewise linear between the stops."""
    x = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    out = F.struct(*[F.lit(v / 255).alias(n) for n, v in zip("rgb", RAMP[0][1:])])
    for low, high in reversed(list(zip(RAMP, RAMP[1:]))):
        f = (x - low[0]) / (high[0] - low[0])
        color = F.struct(*[(F.lit(a / 255) + (b - a) / 255 * f).alias(n) for n, a, b in zip("rgb", low[1:], high[1:])])
        out = F.when((x > low[0]) & (x <= high[0]), color).otherwise(out)
    return out


def rgba(value: Column, threshold: float, scale_max: float = 1.0) -> Column:
    """Colour on the absolute scale; NULL (clear) below the threshold or when not finite."""
    t = (value - threshold) / max(scale_max - threshold, 1e-6)
    c = ramp(t)
    a = ALPHA_LOW + (ALPHA_HIGH - ALPHA_LOW) * F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when((value >= threshold) & finite, F.struct(c["r"].alias("r"), c["g"].alias("g"), c["b"].alias("b"), a.alias("a")))


def pixel_grid(images: DataFrame, width: int, height: int, scale: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(…, ox, oy, px, py): output pixels and where they look in the image."""
    return (images.withColumn("oy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
            .withColumn("ox", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
            .withColumn("px", F.lit(x0) + (F.col("ox") + 0.5) / scale).withColumn("py", F.lit(y0) + (F.col("oy") + 0.5) / scale))


def overlay(pixels: DataFrame, maps: DataFrame, counted: DataFrame | None, keys: list[str], frame: tuple, rows: int, cols: int,
            threshold: float, scale_max: float = 1.0) -> DataFrame:
    """Premultiplied overlay bytes; a thresholded layer only inside counted cells."""
    if counted is not None:
        asked = spread(counted.select(*keys, "cell"), *keys).groupBy(*keys).agg(F.collect_set(F.col("cell").cast("int")).alias("_counted"))
        here = pixel_cell(F.col("px"), F.col("py"), frame, rows, cols)
        pixels = pixels.join(asked.hint("shuffle_hash"), keys).where(F.array_contains("_counted", here)).select(*pixels.columns)
        threshold = max(threshold, 1e-6)
    colored = sample(pixels, maps, keys, frame, rows, cols).withColumn("c", rgba(F.col("value"), threshold, scale_max)).where("c IS NOT NULL")
    return colored.select(*pixels.columns, "value", "c", *[F.floor(255 * F.col(f"c.{n}") * F.col("c.a")).cast("int").alias(n) for n in "rgb"],
                          F.floor(255 * F.col("c.a")).cast("int").alias("a"))


def composite(image: DataFrame, heat: DataFrame, keys: list[str]) -> DataFrame:
    """Heat over a washed grey of the image; bytes. ``image(keys, ox, oy, red, green, blue)``."""
    grey = 0.5 + 0.5 * (0.2126 * F.col("red") + 0.7152 * F.col("green") + 0.0722 * F.col("blue")) / 255
    joined = image.join(heat.select(*keys, "ox", "oy", "c").hint("merge"), [*keys, "ox", "oy"], "left").withColumn("_g", grey)

    def mix(name: str) -> Column:
        v = F.when(F.col("c").isNull(), F.col("_g")).otherwise((1 - F.col("c.a")) * F.col("_g") + F.col("c.a") * F.col(f"c.{name}"))
        return F.floor(255 * F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).cast("int").alias(name)

    return joined.select(*keys, "ox", "oy", mix("r"), mix("g"), mix("b"))


def outline(cells: DataFrame, keys: list[str], cols: int) -> DataFrame:
    """Cell sides without a neighbour of the same region: (keys, cell, side)."""
    col = F.col("cell") % cols
    sides = F.array(*[F.struct(F.lit(n).alias("side"), near.cast("bigint").alias("near")) for n, near in (
        ("top", F.col("cell") - cols), ("bottom", F.col("cell") + cols),
        ("left", F.when(col > 0, F.col("cell") - 1).otherwise(-1)), ("right", F.when(col < cols - 1, F.col("cell") + 1).otherwise(-1)))])
    asked = cells.select(*keys, "cell", F.explode(sides).alias("s")).select(*keys, "cell", "s.side", "s.near")
    have = cells.select(*keys, F.col("cell").cast("bigint").alias("near"))
    return asked.join(have, [*keys, "near"], "left_anti").select(*keys, "cell", "side")


def label_anchor(cells: DataFrame, keys: list[str], cols: int) -> DataFrame:
    first = cells.groupBy(*keys).agg(F.min("cell").alias("cell"))
    return first.select(*keys, F.floor(F.col("cell") / cols).cast("int").alias("row"), (F.col("cell") % cols).cast("int").alias("col"))


def working_size(width: Column, height: Column, long_side: int) -> list[Column]:
    """Size with the given long side, both multiples of 16 and at least 16."""
    s = F.lit(float(long_side)) / F.greatest(width, height)

    def snap(v: Column) -> Column:
        return F.greatest(F.lit(16), (F.round(v * s / 16) * 16).cast("int"))

    return [snap(width).alias("work_width"), snap(height).alias("work_height")]


def centre_square(width: Column, height: Column) -> list[Column]:
    s = F.least(width, height)
    return [((width - s) / 2).alias("crop_x"), ((height - s) / 2).alias("crop_y"), s.alias("crop_side")]
