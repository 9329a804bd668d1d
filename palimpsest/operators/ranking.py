"""Ranks, running totals and order statistics that survive a hot value.

A plain window over a whole table runs in one task. Here rows are first folded
to distinct values (map-side combine absorbs a value shared by a third of the
rows), the distinct values are cut into range buckets, each bucket is ranked on
its own, and the few bucket totals supply the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64


def range_bucket(df: DataFrame, value: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with ``_bucket``: the approximate-quantile bucket of ``value``.

    The edges are one scalar subquery, so Spark evaluates them once; any edges
    give the same result, they only balance the tasks.
    """
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.select(F.percentile_approx(F.col(value).cast("double"), steps, F.lit(1000)).alias("edges")).scalar()
    placed = df.withColumn("_edges", F.coalesce(edges, F.array().cast("array<double>")))
    return placed.withColumn("_bucket", F.size(F.filter("_edges", lambda e: e < F.col(value)))).drop("_edges")


def even_bucket(df: DataFrame, value: str, buckets: int = 256) -> Column:
    """Bucket number of a numeric id by even cuts between its extremes."""
    low = df.select(F.min(value).cast("double").alias("low")).scalar()
    high = df.select(F.max(value).cast("double").alias("high")).scalar()
    return F.floor((F.col(value) - low) / (high - low + 1.0) * buckets).cast("int")


def running_counts(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column],
                   buckets: int = BUCKETS) -> DataFrame:
    """Distinct (keys, order) rows with each total and ``<name>_before``.

    ``<name>_before`` sums the totals of strictly smaller ``order`` tuples of
    the same keys. The first order column must be numeric.
    """
    folded = df.groupBy(*keys, *order).agg(*[c.alias(n) for n, c in totals.items()])
    cut = range_bucket(folded, order[0], buckets)
    earlier = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_in_{n}") for n in totals])
    per_bucket = cut.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_sum_{n}") for n in totals])
    if keys:
        before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    else:
        # at most ``buckets`` rows, so one task is a bounded amount of work
        before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in totals])
    return (local.join(offsets, [*keys, "_bucket"])
            .select(*keys, *order, *totals,
                    *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"{n}_before") for n in totals]))


def order_statistics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact ``n``, ``median`` (mean of the middle two) and ``upper_median``."""
    known = df.where(F.col(value).isNotNull())
    counted = running_counts(known, keys, [value], {"n": F.count(F.lit(1))})
    size = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    if keys:
        placed = counted.join(size, keys)
    else:
        placed = counted.withColumn("total", size.scalar())

    def covers(index: Column) -> Column:
        return (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))

    lower = F.floor((F.col("total") - 1) / 2)
    upper = F.floor(F.col("total") / 2)
    return (placed.groupBy(*keys)
            .agg(F.max("total").alias("n"),
                 F.max(F.when(covers(lower), F.col(value))).alias("_lo"),
                 F.max(F.when(covers(upper), F.col(value))).alias("upper_median"))
            .select(*keys, "n", ((F.col("_lo") + F.col("upper_median")) / 2).alias("median"), "upper_median"))


def ordinal_ranks(df: DataFrame, value: str, tie: str, out: str) -> DataFrame:
    """0-based rank of ``value``; equal values rank by the unique id ``tie``."""
    cut = df.withColumn("_tie", even_bucket(df, tie))
    counted = running_counts(cut, [], [value, "_tie"], {"n": F.count(F.lit(1))})
    inside = Window.partitionBy(value, "_tie").orderBy(tie)
    return (cut.withColumn("_row", F.row_number().over(inside))
            .join(counted.select(value, "_tie", "n_before"), [value, "_tie"])
            .withColumn(out, F.col("_row") - 1 + F.col("n_before"))
            .drop("_row", "n_before", "_tie"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: list[str], salts: int = 32) -> DataFrame:
    """First ``k`` rows per key: salted heads first, then the final pick.

    Exact: a row among the first k of its key is among the first k of its salt.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    head = (salted.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
            .where(F.col("_row") <= k))
    return (head.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("rank") <= k).drop("_row", "_salt"))
