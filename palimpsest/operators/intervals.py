"""Byte-range algebra over many files.

A file may hold a third of all ranges, so no window runs over a whole file:
the byte axis is cut into buckets, each bucket is scanned on its own, and one
row per bucket carries what later buckets need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = 64 << 10
BUCKET = 16 << 20


def _carried_max(df: DataFrame, file: str, value: str, out: str, include_self: bool) -> DataFrame:
    """Running maximum of ``value`` in (file, bucket, lo) order across buckets."""
    end = 0 if include_self else -1
    local = Window.partitionBy(file, "_bucket").orderBy("lo").rowsBetween(Window.unboundedPreceding, end)
    across = Window.partitionBy(file).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (df.groupBy(file, "_bucket").agg(F.max(value).alias("_m"))
             .select(file, "_bucket", F.max("_m").over(across).alias("_carry")))
    return (df.withColumn("_local", F.max(value).over(local)).join(carry, [file, "_bucket"])
            .withColumn(out, F.greatest("_local", "_carry")).drop("_local", "_carry"))


def coalesce_ranges(ranges: DataFrame, file: str = "file", gap: int = GAP, bucket: int = BUCKET) -> DataFrame:
    """Merged half-open blocks: a range joins when it starts within ``gap`` of the running end.

    Empty ranges are dropped. Output (file, lo, hi).
    """
    starts = (ranges.where("hi > lo").groupBy(file, "lo").agg(F.max("hi").alias("hi"))
              .withColumn("_bucket", F.floor(F.col("lo") / bucket)))
    placed = _carried_max(starts, file, "hi", "_end", include_self=False)
    opened = placed.withColumn("_start", F.when(F.col("_end").isNull() | (F.col("lo") > F.col("_end") + gap), F.col("lo"))).drop("_end")
    owned = _carried_max(opened, file, "_start", "start", include_self=True)
    return owned.groupBy(file, F.col("start").alias("lo")).agg(F.max("hi").alias("hi"))


def contain_ranges(ranges: DataFrame, blocks: DataFrame, file: str = "file", bucket: int = BUCKET) -> DataFrame:
    """Each requested range with the merged block that holds it and its offset there.

    Equi-join on (file, bucket): a block is listed under every bucket it
    spans, and blocks never overlap, so a range meets few candidates.
    """
    spans = blocks.select(file, F.col("lo").alias("block_lo"), F.col("hi").alias("block_hi"),
                          F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))).alias("_bucket"))
    asked = ranges.where("hi > lo").withColumn("_bucket", F.floor(F.col("lo") / bucket))
    inside = (F.col("block_lo") <= F.col("lo")) & (F.col("block_hi") >= F.col("hi"))
    return (asked.join(spans, [file, "_bucket"]).where(inside)
            .withColumn("offset", F.col("lo") - F.col("block_lo")).drop("_bucket"))


def parse_content_range(header: Column) -> Column:
    """``bytes s-e/total`` as struct(start, end, total); total NULL for ``*``."""
    text = F.regexp_replace(header, "bytes ", "")
    pattern = r"^(\d+)-(\d+)/(.+)$"
    ok = text.rlike(pattern)
    return F.when(ok, F.struct(F.regexp_extract(text, pattern, 1).try_cast("bigint").alias("start"),
                               F.regexp_extract(text, pattern, 2).try_cast("bigint").alias("end"),
                               F.regexp_extract(text, pattern, 3).try_cast("bigint").alias("total")))
