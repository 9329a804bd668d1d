"""Evaluation statistics and the go/no-go experiment summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import ranking

FLAGGED = ("memorized", "memorized-other-content")


def auc(rows: DataFrame, score: str, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """Mann-Whitney AUC, ties count half; NULL when a class is missing.

    Folds to distinct scores first, so n log n work and no pairs.
    """
    keys = keys or []
    counted = ranking.running_counts(
        rows.withColumn("_pos", positive).where(F.col(score).isNotNull()), keys, [score],
        {"pos": F.count(F.when(F.col("_pos"), 1)), "neg": F.count(F.when(~F.col("_pos"), 1))})
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return counted.groupBy(*keys).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
                                      (wins / F.when(pairs > 0, pairs)).alias("auc"))


def spearman(rows: DataFrame, x: str, y: str, tie: str) -> DataFrame:
    """Spearman's rho over ordinal ranks (ties in ``tie`` order); 0 when undefined."""
    ranked = ranking.ordinal_ranks(rows.select(tie, x, y), x, tie, "_rx")
    other = ranking.ordinal_ranks(rows.select(tie, y), y, tie, "_ry").select(tie, "_ry")
    # ranks are 0..n-1, so both variances are known and only Σ(rx - ry)² is needed
    gap = (F.col("_rx") - F.col("_ry")).cast("double")
    n = F.count(F.lit(1)).cast("double")
    return ranked.join(other, tie).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(n >= 2, 1.0 - 6.0 * F.sum(gap * gap) / (n * (n * n - 1.0))).otherwise(0.0).alias("spearman"))


def exceedance(rows: DataFrame, value: str, keys: list[str], is_control: Column) -> DataFrame:
    """p = (1 + controls at or above the value) / (1 + controls) per reference row.

    Without controls p is NULL. Controls are folded to distinct values, so a
    run with very many of them is ranked by many tasks.
    """
    flagged = rows.withColumn("_control", is_control)
    counted = ranking.running_counts(flagged, keys, [value], {"c": F.count(F.when(F.col("_control"), 1))})
    total = flagged.groupBy(*keys).agg(F.count(F.when(F.col("_control"), 1)).alias("controls"))
    above = (counted.join(total, keys)
             .withColumn("p_value", F.when(F.col("controls") > 0, (1 + F.col("controls") - F.col("c_before")) / (1 + F.col("controls"))))
             .select(*keys, value, "controls", "p_value"))
    return flagged.where(~F.col("_control")).drop("_control").join(above, [*keys, value])


def significance(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p.isNull(), "uncalibrated").when(p <= alpha, "significant").otherwise("not-significant")


def counts(significance_col: Column) -> Column:
    """Whether a region counts toward the verdict."""
    return significance_col != "not-significant"


def test_matrix(subjects: DataFrame, references: DataFrame, kappas: list[float], per_label: int) -> DataFrame:
    """subject x kappa x label x its first ``per_label`` references."""
    first = ranking.top_k(references, ["subject", "label"], [F.col("ord")], per_label, ["ord"])
    grid = subjects.select("subject", F.posexplode(F.array(*[F.lit(float(k)) for k in kappas])).alias("kappa_ix", "kappa"))
    return grid.join(first.drop("rank"), "subject")


def flagged_share(verdict: str = "verdict") -> Column:
    return F.avg(F.col(verdict).isin(*FLAGGED).cast("double"))


def group_summary(trials: DataFrame, group: list[str], medians: list[str]) -> DataFrame:
    """n, exact medians and flagged share per group."""
    out = trials.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), flagged_share().alias("flagged"))
    for name in medians:
        stat = ranking.order_statistics(trials, group, name).select(*group, F.col("median").alias(f"median_{name}"))
        out = out.join(stat, group, "left")
    return out


def flag_rates(audit: DataFrame) -> DataFrame:
    """Share of each audit kind flagged as memorized or other content."""
    return audit.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), flagged_share().alias("flag_rate"))


def criteria(trials: DataFrame) -> DataFrame:
    """The four go/no-go criteria as rows (name, value, pass).

    ``trials`` needs kappa, label, collapse, snap, iou, verdict. Everything is
    a scalar aggregate; only the number of kappas reaches one task.
    """
    extremes = trials.agg(F.max("kappa").alias("top"), F.min("kappa").alias("low"))
    top, low = extremes.select("top").scalar(), extremes.select("low").scalar()
    strongest = trials.where(F.col("kappa") == top)
    membership = auc(strongest, "snap", F.col("label") == "member").select(
        F.lit("membership").alias("name"), F.coalesce("auc", F.lit(0.0)).alias("value"))
    pooled = trials.where((F.col("label") == "member") & (F.col("collapse") > 0))
    localization = ranking.order_statistics(pooled, [], "iou").select(
        F.lit("localization").alias("name"), F.coalesce("median", F.lit(0.0)).alias("value"))
    medians = ranking.order_statistics(trials.where("label = 'member'"), ["kappa"], "collapse").select("kappa", "median")
    every = trials.select("kappa").distinct().join(medians, "kappa", "left").select("kappa", F.coalesce("median", F.lit(0.0)).alias("median"))
    dose = spearman(every.withColumn("_id", F.col("kappa")), "kappa", "median", "_id").select(
        F.lit("dose-response").alias("name"), F.col("spearman").alias("value"))
    least = trials.where(F.col("kappa") == low).agg(F.coalesce(flagged_share(), F.lit(1.0)).alias("value"))
    specificity = least.select(F.lit("specificity").alias("name"), "value")
    rows = membership.unionByName(localization).unionByName(dose).unionByName(specificity)
    passed = (F.when(F.col("name") == "membership", F.col("value") >= 0.9)
              .when(F.col("name") == "localization", F.col("value") >= 0.5)
              .when(F.col("name") == "dose-response", F.col("value") >= 0.8)
              .otherwise(F.col("value") <= 0.1))
    return rows.withColumn("pass", passed)


def go(criteria_rows: DataFrame) -> DataFrame:
    return criteria_rows.agg(F.every("pass").alias("go"))


def top_iou(maps: DataFrame, truth: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """IoU of each map's top |truth| cells with the truth; 0 when trivial."""
    marked = (maps.join(truth.select(*keys, "cell").distinct().withColumn("_t", F.lit(1)), [*keys, "cell"], "left")
              .withColumn("_t", F.coalesce("_t", F.lit(0))))
    sizes = marked.groupBy(*keys).agg(F.sum("_t").alias("k"), F.count(F.lit(1)).alias("cells"))
    # one grid per window: bounded by the number of cells of a grid
    ranked = marked.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), "cell")))
    hits = (ranked.join(sizes, keys).groupBy(*keys)
            .agg(F.max("k").alias("k"), F.max("cells").alias("cells"),
                 F.sum(F.when(F.col("_rank") <= F.col("k"), F.col("_t")).otherwise(0)).alias("inter")))
    return hits.select(*keys, F.when((F.col("k") > 0) & (F.col("k") < F.col("cells")),
                                     F.col("inter") / (2 * F.col("k") - F.col("inter"))).otherwise(0.0).alias("top_iou"))
