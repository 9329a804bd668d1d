"""Noise scales and score algebra as Column expressions (λ is the log-SNR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alpha(level: Column) -> Column:
    """Variance-preserving signal scale √sigmoid(λ)."""
    return F.sqrt(1.0 / (1.0 + F.exp(-level)))


def sigma(level: Column) -> Column:
    """Variance-preserving noise scale √sigmoid(−λ)."""
    return F.sqrt(1.0 / (1.0 + F.exp(level)))


def flow_sigma(level: Column) -> Column:
    """Rectified-flow noise scale sigmoid(−λ/2)."""
    return 1.0 / (1.0 + F.exp(level / 2.0))


def flow_alpha(level: Column) -> Column:
    return 1.0 - flow_sigma(level)


def level_grid(df: DataFrame, count: str, low: float, high: float) -> DataFrame:
    """``count`` (at least 2) evenly spaced levels from ``low`` to ``high`` per row."""
    n = F.greatest(F.col(count), F.lit(2))
    rows = df.withColumn("_n", n).withColumn("level_ix", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    return rows.withColumn("level", F.lit(low) + F.lit(high - low) * F.col("level_ix") / (F.col("_n") - 1)).drop("_n")


def retained(sigma_col: Column, jacobian: Column) -> Column:
    """ρ = 1 − σJ."""
    return 1.0 - sigma_col * jacobian


def clean_estimate(x: Column, eps: Column, alpha_col: Column, sigma_col: Column) -> Column:
    """x̂₀ = (x − σε̂)/α."""
    return (x - sigma_col * eps) / alpha_col


def epsilon_from_velocity(x: Column, velocity: Column, sigma_col: Column) -> Column:
    """ε̂ = x + (1 − σ)v̂ for a rectified flow."""
    return x + (1.0 - sigma_col) * velocity


def guided(conditional: Column, unconditional: Column, weight: Column | float) -> Column:
    """u + w(c − u); the conditional alone when w = 1 or there is no u."""
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return F.when((w == 1) | unconditional.isNull(), conditional).otherwise(unconditional + w * (conditional - unconditional))
