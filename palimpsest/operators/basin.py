"""Seed-basin analysis over tables of trials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import keyed
from palimpsest.operators.mixture import spread
from palimpsest.session import materialized

PHOTO_SCALE = 0.25
BLOCK = 1024
#: Rows of a block whose distances to another block are made at a time.
STRIP = 64


def perturbed_seeds(seeds: DataFrame, footprint: DataFrame, betas: list[float], trials: int, key: bytes = keyed.RESEARCH_KEY) -> DataFrame:
    """√(1−β²)z* + βξ inside the footprint m, a fresh surround outside.

    ``seeds(ref_id, cell, z)``, ``footprint(cell, m)``. β and trial are
    configuration and are exploded from literals.
    """
    grid = (seeds.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(i).alias("beta_ix"), F.lit(float(v)).alias("beta")) for i, v in enumerate(betas)])))
            .select(*seeds.columns, "_b.beta_ix", "_b.beta").withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1)))))
    index = F.concat_ws(":", "beta_ix", "trial", "cell")
    xi = keyed.normal(keyed.prf_hex("basin", index, key))
    fresh = keyed.normal(keyed.prf_hex("background", index, key))
    moved = F.sqrt(1.0 - F.col("beta") * F.col("beta")) * F.col("z") + F.col("beta") * xi
    joined = grid.join(footprint, "cell", "left")
    return joined.withColumn("seed", blend(moved, fresh, F.coalesce("m", F.lit(1.0)))).drop("z", "m")


def blend(segment: Column, surround: Column, footprint: Column) -> Column:
    """m·segment + √(1−m²)·surround keeps unit variance."""
    return footprint * segment + F.sqrt(1.0 - footprint * footprint) * surround


def photo_scores(samples: DataFrame, reference: DataFrame, mask: DataFrame, keys: list[str], threshold: Column) -> DataFrame:
    """score = −Σ m (x − x₀)² / Σ m and whether it reaches the threshold."""
    joined = samples.join(reference, "cell").join(mask, "cell")
    gap = (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0"))
    out = joined.groupBy(*keys).agg((-F.sum(F.col("m") * gap) / F.sum("m")).alias("score"))
    return out.withColumn("hit", F.col("score") >= threshold)


def photo_scale(samples: DataFrame, keys: list[str], mask_sum: float = 1.0, bins: int = 4096) -> DataFrame:
    """Upper median of the masked squared distance over pairs i < j of a key's samples.

    ``samples(keys, id, vec)`` with the mask already applied. Vectors are cut
    into blocks; a task meets two blocks and returns only a histogram of its
    distances, so no pair is ever a row. Each round makes all distances again and
    narrows the bracket around the middle one to a bin of the last, until one
    value is left. The first bracket comes from the longest vector. NULL below
    two samples.
    """
    fields = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys)
    blocked = samples.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(1 << 20)))
    per = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    parts = per.withColumn("_parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = blocked.join(parts, keys).withColumn("_b", F.pmod("_b", F.col("_parts")))
    both = placed.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    meet = both.select(*keys, "n", "id", "vec", F.col("_b").alias("_mine"), F.least("_b", "_o").alias("_p"), F.greatest("_b", "_o").alias("_q"))

    def distances(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values("id")
        m = np.stack(pdf["vec"].to_numpy())
        same = pdf["_p"].iloc[0] == pdf["_q"].iloc[0]
        mine = pdf["_mine"].to_numpy()
        if same:
            a, c = m, m
        else:
            a, c = m[mine == pdf["_p"].iloc[0]], m[mine == pdf["_q"].iloc[0]]
        d = np.zeros((len(a), len(c)))
        ours, theirs = np.ascontiguousarray(a.T), np.ascontiguousarray(c.T)
        for lo in range(0, len(a), STRIP):
            strip = d[lo: lo + STRIP]
            for x, y in zip(ours[:, lo: lo + STRIP], theirs):
                gap = x[:, None] - y
                strip += gap * gap
        d /= mask_sum
        return d[np.triu_indices(len(m), 1)] if same else d.ravel()

    def histogram(pdf: pd.DataFrame) -> pd.DataFrame:
        d = distances(pdf)
        lo, hi = float(pdf["lo"].iloc[0]), float(pdf["hi"].iloc[0])
        inside = np.sort(d[(d >= lo) & (d <= hi)])
        at = np.minimum(((inside - lo) / max(hi - lo, 1e-300) * bins).astype("int64"), bins - 1)
        ids, first, counts = np.unique(at, return_index=True, return_counts=True)
        low, high = inside[first], inside[first + counts - 1]
        head = {k: [pdf[k].iloc[0]] * (len(ids) + 1) for k in keys}
        return pd.DataFrame({**head, "bin": [-1, *ids], "pairs": [int((d < lo).sum()), *counts], "low": [np.nan, *low], "high": [np.nan, *high]})

    # |a - c|² is at most 4 times the longest |a|²; a little more, for rounding
    reach = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x) * (4.001 / mask_sum)
    ends = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(reach).alias("hi")).where("n >= 2")
    bracket = materialized(ends.select(*keys, F.floor(F.col("n") * (F.col("n") - 1) / 4).alias("want"), F.lit(0.0).alias("lo"), "hi"), "bracket")
    # after a round the ends of a bracket are data values, in different bins of the next: every round narrows it
    while not bracket.where("lo < hi").isEmpty():
        hist = (spread(meet.join(bracket.where("lo < hi"), keys), *keys, "_p", "_q").groupBy(*keys, "_p", "_q")
                .applyInPandas(histogram, f"{fields}, bin bigint, pairs bigint, low double, high double")
                .groupBy(*keys, "bin").agg(F.sum("pairs").alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high")))
        upto = Window.partitionBy(*keys).orderBy("bin")
        summed = hist.withColumn("_c", F.sum("pairs").over(upto)).join(bracket.select(*keys, "want"), keys)
        picked = (summed.where((F.col("bin") >= 0) & (F.col("_c") > F.col("want"))).groupBy(*keys)
                  .agg(F.min_by(F.struct("low", "high"), "bin").alias("_s")).select(*keys, F.col("_s.low").alias("_lo"), F.col("_s.high").alias("_hi")))
        bracket = materialized(bracket.join(picked, keys, "left").select(*keys, "want", F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi")), "bracket")
    return per.select(*keys).join(bracket.select(*keys, F.col("lo").alias("scale")), keys, "left")


def return_rates(trials: DataFrame, keys: list[str]) -> DataFrame:
    """r(β) = hits / trials."""
    return trials.groupBy(*keys, "beta").agg(F.avg(F.col("hit").cast("double")).alias("rate"), F.count(F.lit(1)).alias("trials"))


def half_radius(rates: DataFrame, keys: list[str]) -> DataFrame:
    """First β where r falls below ½, interpolated; 0 if r(first) < ½, 1 if never."""
    along = Window.partitionBy(*keys).orderBy("beta")
    rows = rates.select(*keys, "beta", "rate", F.lag("beta").over(along).alias("_b"), F.lag("rate").over(along).alias("_r"))
    t = (F.col("_r") - 0.5) / F.greatest(F.col("_r") - F.col("rate"), F.lit(1e-12))
    at = F.when(F.col("_b").isNull(), 0.0).otherwise(F.col("_b") + t * (F.col("beta") - F.col("_b")))
    return rows.groupBy(*keys).agg(F.coalesce(F.min_by(at, F.when(F.col("rate") < 0.5, F.col("beta"))), F.lit(1.0)).alias("half_radius"))


def typicality(seeds: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """χ² z-score (Σz² − n)/√(2n) over mask > 0.5; 0 without cells."""
    rows = seeds.join(mask, "cell", "left")
    on = F.col("m") > 0.5
    n = F.count(F.when(on, 1))
    return rows.groupBy(*keys).agg(F.when(n > 0, (F.coalesce(F.sum(F.when(on, F.col("z") * F.col("z"))), F.lit(0.0)) - n) / F.sqrt(2.0 * F.greatest(n, F.lit(1)))).otherwise(0.0).alias("chi2_z"))


def evidence(radii: DataFrame, keys: list[str]) -> DataFrame:
    """Target against base half radius; a wider target basin supports memorization."""
    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("half_radius")))

    out = radii.groupBy(*keys).agg(of("target").alias("half_radius_target"), of("base").alias("half_radius_base"))
    return out.withColumn("supports", F.col("half_radius_target") > F.col("half_radius_base"))
