"""Maps over row-major grids held as long tables (keys..., cell, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.mixture import spread

# One-sided 95 % Student-t quantiles for 0..15 degrees of freedom,
# then for fewer than 20, fewer than 30, and beyond.
T95 = (float("inf"), 6.314, 2.920, 2.353, 2.132, 2.015, 1.943, 1.895, 1.860, 1.833, 1.812,
       1.796, 1.782, 1.771, 1.761, 1.753)
T95_BELOW_20, T95_BELOW_30, T95_BEYOND = 1.725, 1.697, 1.645


def row_of(cell: Column, cols: int) -> Column:
    return F.floor(cell / cols).cast("int")


def col_of(cell: Column, cols: int) -> Column:
    return (cell % cols).cast("int")


def t95(df_col: Column) -> Column:
    """t quantile of a degrees-of-freedom column."""
    table = F.array(*[F.lit(v) for v in T95])
    return (F.when(df_col < len(T95), F.element_at(table, F.greatest(df_col, F.lit(0)).cast("int") + 1))
            .when(df_col < 20, T95_BELOW_20).when(df_col < 30, T95_BELOW_30).otherwise(T95_BEYOND))


def channel_mean(latents: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean over channels per cell."""
    return latents.groupBy(*keys, "cell").agg(F.avg(value).alias(value))


def standard_error(value: str) -> Column:
    """Aggregate: standard error of the mean; infinite below two draws."""
    n = F.count(value)
    return F.when(n >= 2, F.stddev_samp(value) / F.sqrt(n)).otherwise(F.lit(float("inf")))


def draw_statistics(maps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """mean, standard error, number of draws and t lower bound per (keys, cell)."""
    stats = maps.groupBy(*keys, "cell").agg(
        F.avg(value).alias("mean"), standard_error(value).alias("se"), F.count(value).alias("draws"))
    return stats.withColumn("lower", F.when(F.col("draws") >= 2, F.col("mean") - t95(F.col("draws") - 1) * F.col("se"))
                            .otherwise(F.lit(float("-inf"))))


def box_mean(cells: DataFrame, keys: list[str], values: dict[str, str], rows: int, cols: int, radius: int,
             dense: bool = False) -> DataFrame:
    """Mean over the (2r+1)^2 box around each cell, clipped at the edges.

    ``values`` maps input columns to output columns. ``dense`` promises that
    every cell is present, which allows two running windows. Otherwise a cell is
    spread over its row and the row sums over their columns, also to places
    without a cell; grids are dealt over a fixed number of tasks once, and both
    sums are made there.
    """
    if radius <= 0:
        return cells.select("*", *[F.col(v).alias(out) for v, out in values.items()])
    if dense:
        across = Window.partitionBy(*keys, "_r").orderBy("_c").rangeBetween(-radius, radius)
        down = Window.partitionBy(*keys, "_c").orderBy("_r").rangeBetween(-radius, radius)
        wide = cells.withColumn("_r", row_of(F.col("cell"), cols)).withColumn("_c", col_of(F.col("cell"), cols))
        wide = wide.select("*", *[F.sum(v).over(across).alias(f"_s_{out}") for v, out in values.items()],
                           F.count(F.lit(1)).over(across).alias("_n"))
        out = wide.select("*", *[(F.sum(f"_s_{out}").over(down) / F.sum("_n").over(down)).alias(out) for out in values.values()])
        return out.drop("_r", "_c", "_n", *[f"_s_{out}" for out in values.values()])
    span = F.sequence(F.lit(-radius), F.lit(radius))
    dealt = spread(cells.select(*keys, "cell", *values), *keys)
    wide = (dealt.select("*", row_of(F.col("cell"), cols).alias("_r"), F.explode(span).alias("_d"))
            .withColumn("_c", col_of(F.col("cell"), cols) + F.col("_d")).where(F.col("_c").between(0, cols - 1)))
    own = F.col("_d") == 0
    across = wide.groupBy(*keys, "_r", "_c").agg(
        F.max(F.when(own, F.col("cell"))).alias("cell"), *[F.max(F.when(own, F.col(v))).alias(v) for v in values],
        *[F.sum(v).alias(f"_s_{out}") for v, out in values.items()], *[F.count(v).alias(f"_n_{out}") for v, out in values.items()])
    tall = across.withColumn("_d", F.explode(span)).withColumn("_r", F.col("_r") + F.col("_d")).where(F.col("_r").between(0, rows - 1))
    smoothed = (tall.groupBy(*keys, "_r", "_c").agg(
        F.max(F.when(own, F.col("cell"))).alias("cell"), *[F.max(F.when(own, F.col(v))).alias(v) for v in values],
        *[(F.sum(f"_s_{out}") / F.sum(f"_n_{out}")).alias(out) for out in values.values()])
                .where(F.col("cell").isNotNull()).drop("_r", "_c"))
    kept = [c for c in cells.columns if c not in {*keys, "cell", *values}]
    if not kept:
        return smoothed
    return cells.drop(*values).join(smoothed, [*keys, "cell"])


def iou(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union of two cell sets per key; 0 for an empty union."""
    both = (left.select(*keys, "cell").distinct().withColumn("_l", F.lit(1))
            .join(right.select(*keys, "cell").distinct().withColumn("_r", F.lit(1)), [*keys, "cell"], "full_outer"))
    return both.groupBy(*keys).agg(
        (F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)) / F.count(F.lit(1))).alias("iou"))


def pack_tokens(latents: DataFrame, rows: int, cols: int) -> DataFrame:
    """2x2 patches to (token, channel*4 + dy*2 + dx)."""
    r, c = row_of(F.col("cell"), cols), col_of(F.col("cell"), cols)
    token = F.floor(r / 2) * (cols // 2) + F.floor(c / 2)
    return (latents.withColumn("token", token.cast("int"))
            .withColumn("packed_channel", (F.col("channel") * 4 + (r % 2) * 2 + c % 2).cast("int"))
            .drop("cell", "channel"))


def unpack_tokens(tokens: DataFrame, rows: int, cols: int) -> DataFrame:
    """Inverse of :func:`pack_tokens`."""
    half = cols // 2
    part = F.col("packed_channel") % 4
    r = F.floor(F.col("token") / half) * 2 + F.floor(part / 2)
    c = (F.col("token") % half) * 2 + part % 2
    return (tokens.withColumn("cell", (r * cols + c).cast("int"))
            .withColumn("channel", F.floor(F.col("packed_channel") / 4).cast("int")).drop("token", "packed_channel"))


def mask_channels(latents: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """A cell mask applied to every channel: value inside, 0 outside."""
    inside = mask.select(*keys, "cell").distinct().withColumn("_in", F.lit(1.0))
    return (latents.join(inside, [*keys, "cell"], "left")
            .withColumn("value", F.col("value") * F.coalesce("_in", F.lit(0.0))).drop("_in"))
