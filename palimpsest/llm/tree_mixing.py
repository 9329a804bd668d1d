"""Hierarchical budgeting of a source mixture (operator 10), DataFrame functions only.

The tree's leaves are the distinct paths of ``levels`` columns. A node can take
what its leaves can: tokens x ``max_epochs``. Top-down, each parent's budget is
split among its children by weight; a child that cannot take its share frees the
rest for its siblings, and only what a whole family cannot take goes to the
parent's siblings, because the family's capacity bounds its budget first. All of
it is exact integer arithmetic over one row per node: siblings are ordered by
capacity per weight, the full ones form a prefix, the others share what is left,
and single tokens of rounding go to the first names.

A leaf with budget b takes b div tokens whole epochs, then a prefix of the next
epoch's seeded order. That order is md5 of seed, epoch and id; its first three
hex digits cut it into 4096 even buckets, so whole buckets are taken or left by
their totals and only the bucket on the border is sorted. Hot leaves are thereby
spread over all tasks.

Defined cases: a null path part is a node of its own; null and empty texts have
no tokens and are kept in a leaf's whole epochs (in a leaf without tokens: in one);
repeated rows are taken once each; weights of 0 take nothing; an empty table
gives no rows; other columns are carried through, internal names start with
``__mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.session import materialized


def _name(levels: list[str], k: int) -> Column:
    """A node's path as one string; parts are marked so that null and text never meet."""
    return F.concat_ws("\x1f", *[F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in levels[:k]])


def shares(nodes: DataFrame) -> DataFrame:
    """``nodes`` (parent, node, weight, capacity, parent_budget) with each node's budget."""
    order = Window.partitionBy("parent").orderBy(F.col("capacity") / F.col("weight"), "node")
    sofar, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    family = Window.partitionBy("parent")
    left = F.col("parent_budget") - F.coalesce(F.sum("capacity").over(sofar), F.lit(0))
    ranked = nodes.where(F.col("weight") > 0).select("*", F.row_number().over(order).alias("place"), left.alias("left"), F.sum("weight").over(rest).alias("rest_weight"))
    full = F.col("capacity").cast("decimal(38,0)") * F.col("rest_weight") <= F.col("left").cast("decimal(38,0)") * F.col("weight")
    first_open = F.min(F.when(~full, F.col("place"))).over(family)
    opened = ranked.withColumn("first_open", first_open)
    pool = F.max(F.when(F.col("place") == F.col("first_open"), F.col("left"))).over(family)
    pool_weight = F.max(F.when(F.col("place") == F.col("first_open"), F.col("rest_weight"))).over(family)
    opened = opened.select("*", pool.alias("pool"), pool_weight.alias("pool_weight"))
    is_open = F.col("first_open").isNotNull() & (F.col("place") >= F.col("first_open"))
    share = F.when(is_open, F.expr("cast(cast(pool as decimal(38,0)) * weight div pool_weight as long)")).otherwise(F.col("capacity"))
    shared = opened.select("*", is_open.alias("is_open"), share.alias("share"))
    spare = F.col("pool") - F.sum(F.when(F.col("is_open"), F.col("share"))).over(family)
    turn = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("is_open"), "node"))
    return shared.select("*", spare.alias("spare"), turn.alias("turn")).select("node", (F.col("share") + F.when(F.col("is_open") & (F.col("turn") <= F.col("spare")), 1).otherwise(0)).alias("budget"))


def leaf_budgets(docs: DataFrame, levels: list[str], tokens: str, budget: int | None = None, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """(leaf, tokens, n_docs, budget) of every leaf of ``docs``; ``budget`` None: as many tokens as there are.

    ``weights`` maps a level's column to weights by value; what it does not name weighs 1.
    """
    leaves = docs.groupBy(*levels).agg(F.sum(F.col(tokens).cast("long")).alias("leaf_tokens"), F.count("*").alias("n_docs"))
    leaves = materialized(leaves.withColumn("leaf", _name(levels, len(levels))), "leaves")
    asked = F.lit(budget).cast("long") if budget is not None else F.col("held")
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)).alias("held"))
    budgets = total.select(F.lit("").alias("node"), F.least(asked, F.col("held") * max_epochs).alias("budget"))
    for k, level in enumerate(levels, 1):
        weight = F.lit(1).cast("long")
        for value, w in (weights or {}).get(level, {}).items():
            weight = F.when(F.col(level) == value, F.lit(w).cast("long")).otherwise(weight)
        nodes = leaves.groupBy(_name(levels, k - 1).alias("parent"), _name(levels, k).alias("node"), weight.alias("weight")).agg((F.sum("leaf_tokens") * max_epochs).alias("capacity"))
        if k == 1:  # the root's budget is one number
            owned = nodes.withColumn("parent_budget", budgets.select("budget").scalar())
        else:
            owned = nodes.join(budgets.select(F.col("node").alias("parent"), F.col("budget").alias("parent_budget")), "parent")
        budgets = shares(owned)
    return leaves.join(budgets, leaves.leaf == budgets.node, "left").select("leaf", "leaf_tokens", "n_docs", F.coalesce("budget", F.lit(0)).alias("budget"))


def mix(docs: DataFrame, levels: list[str], tokens: str, doc_id: str = "doc_id", seed: int = 7, budget: int | None = None, max_epochs: int = 2, weights: dict[str, dict[str, int]] | None = None) -> DataFrame:
    """The selected rows of ``docs``, once for each epoch that takes them, with ``__mix_epoch``."""
    size = F.coalesce(F.col(tokens).cast("long"), F.lit(0))
    budgets = materialized(leaf_budgets(docs.withColumn("__mix_tokens", size), levels, "__mix_tokens", budget, max_epochs, weights), "budgets")
    plan = budgets.select(
        F.col("leaf").alias("__mix_leaf"),
        F.expr("case when leaf_tokens > 0 then budget div leaf_tokens else 1 end").alias("__mix_whole"),
        F.expr("case when leaf_tokens > 0 then budget % leaf_tokens else 0 end").alias("__mix_rest"),
    )
    tagged = docs.select("*", size.alias("__mix_tokens"), _name(levels, len(levels)).alias("__mix_leaf"))
    turns = tagged.join(plan, "__mix_leaf").withColumn("__mix_epoch", F.explode(F.expr("sequence(0L, __mix_whole)")))
    turns = turns.where((F.col("__mix_epoch") < F.col("__mix_whole")) | (F.col("__mix_rest") > 0))
    whole = F.col("__mix_epoch") < F.col("__mix_whole")
    key = F.when(~whole, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__mix_epoch").cast("string"), F.col(doc_id).cast("string")).cast("binary")))
    turns = turns.withColumn("__mix_key", key)
    bucket = F.substring("__mix_key", 1, 3)
    totals = turns.where(F.col("__mix_key").isNotNull()).groupBy(F.col("__mix_leaf"), bucket.alias("__mix_bucket"), "__mix_rest").agg(F.sum("__mix_tokens").alias("held"))
    before = Window.partitionBy("__mix_leaf").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    border = (
        totals.withColumn("__mix_before", F.coalesce(F.sum("held").over(before), F.lit(0)))
        .where(F.col("__mix_before") + F.col("held") > F.col("__mix_rest"))
        .groupBy("__mix_leaf").agg(F.min_by(F.struct("__mix_bucket", "__mix_before"), "__mix_bucket").alias("__mix_border"))
    )
    judged = turns.join(materialized(border, "borders"), "__mix_leaf", "left").withColumn("__mix_bucket", bucket)
    edge = F.col("__mix_border.__mix_bucket")
    sure = judged.where(F.col("__mix_key").isNull() | (F.col("__mix_bucket") < edge) | edge.isNull())
    row = Window.partitionBy("__mix_leaf", "__mix_bucket").orderBy("__mix_key", F.xxhash64(*[c for c in docs.columns])).rowsBetween(Window.unboundedPreceding, 0)
    close = judged.where(F.col("__mix_key").isNotNull() & (F.col("__mix_bucket") == edge)).withColumn("__mix_upto", F.sum("__mix_tokens").over(row) + F.col("__mix_border.__mix_before"))
    columns = [*docs.columns, "__mix_epoch"]
    return sure.select(*columns).unionByName(close.where(F.col("__mix_upto") <= F.col("__mix_rest")).select(*columns))
