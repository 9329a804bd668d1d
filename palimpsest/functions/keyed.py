"""Keyed deterministic randomness as Column expressions.

A draw depends on its key, stream and index only, so repartitioning, retries
and the number of draws asked for never change a value.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "palimpsest.draws.v1"
RESEARCH_KEY = b"palimpsest.research.v1"
STREAMS = ("noise", "scenario", "rademacher", "scout", "confirmation", "control")
_BLOCK = 64
_SCALE = float(1 << 52)


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads of ``key``."""
    block = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def schedule_id(key: Column | bytes = RESEARCH_KEY) -> Column:
    """Names a key without revealing it."""
    value = key if isinstance(key, Column) else F.lit(bytearray(key))
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def level_key(level: Column) -> Column:
    """Index of a noise level by its value, not by its place in a list."""
    return (F.lit(1_000_000) + F.round(level * 64)).cast("bigint")


def prf_hex(stream: Column | str, index: Column, key: bytes = RESEARCH_KEY) -> Column:
    """HMAC-SHA256(key, ``version|stream|index``) as 64 hex digits."""
    inner, outer = pads(key)
    name = F.lit(stream) if isinstance(stream, str) else stream
    message = F.concat(F.lit(VERSION + "|"), name, F.lit("|"), index.cast("string"))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def uniform(digest: Column, part: int = 0) -> Column:
    """52 bits of a digest as a double in [0, 1)."""
    return F.conv(F.substring(digest, 1 + 13 * part, 13), 16, 10).cast("bigint") / F.lit(_SCALE)


def normal(digest: Column) -> Column:
    """A standard normal from two slices of one digest."""
    radius = F.sqrt(-2.0 * F.log(F.greatest(uniform(digest, 0), F.lit(1e-12))))
    return radius * F.cos(F.lit(2.0 * 3.141592653589793) * uniform(digest, 1))


def sign(value: Column) -> Column:
    return F.when(value >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def draw_index(level: Column, draw: Column, cell: Column) -> Column:
    return F.concat_ws(":", level_key(level), draw, cell)


def level_table(spark: SparkSession, levels: Iterable[float]) -> DataFrame:
    """Levels with their place on the scout grid (a few dozen rows)."""
    rows = [(i, float(v)) for i, v in enumerate(levels)]
    return spark.createDataFrame(rows, "level_ix int, level double")


def draws(levels: DataFrame, count: int, cells: int, stream: str, key: bytes = RESEARCH_KEY) -> DataFrame:
    """eps(level, draw, cell): the draws every model and reference shares."""
    grid = (levels.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))))
    digest = prf_hex(stream, draw_index(F.col("level"), F.col("draw"), F.col("cell")), key)
    return grid.withColumn("_d", digest).withColumn("eps", normal(F.col("_d"))).drop("_d")


def probe_signs(levels: DataFrame, probes: int, cells: int, key: bytes = RESEARCH_KEY) -> DataFrame:
    """Rademacher vectors, one per (level, probe): the sign of a keyed normal."""
    grid = (levels.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))))
            .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))))
    index = F.concat_ws(":", level_key(F.col("level")) * 1000 + F.col("probe"), F.col("cell"))
    return grid.withColumn("v", sign(normal(prf_hex("rademacher", index, key))))
