"""Weight updates and spectra from element tables (keys..., i, j, v).

Factors are dense. Products join packed rows with packed columns block by
block, so one large module spreads over many tasks and no key holds more than
``block`` x ``block`` pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.mixture import spread
from palimpsest.operators.ranking import top_k
from palimpsest.session import materialized

BLOCK = 128


def _packed(elements: DataFrame, keys: list[str], keep: str, fold: str, out: str) -> DataFrame:
    return (elements.groupBy(*keys, keep).agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("k"), "v"))).alias("_g"))
            .select(*keys, keep, F.col("_g.v").alias(out)))


def matmul(a: DataFrame, b: DataFrame, keys: list[str], scale: Column | float = 1.0, block: int = BLOCK) -> DataFrame:
    """a(i, k) · b(k, j) per key as elements (keys, i, j, v).

    ``a`` has columns i, j (its j is the inner index), ``b`` likewise (its i is
    the inner index).
    """
    rows = _packed(a, keys, "i", "j", "_row").withColumn("_ib", F.floor(F.col("i") / block))
    cols = _packed(b, keys, "j", "i", "_col").withColumn("_jb", F.floor(F.col("j") / block))
    row_blocks, col_blocks = rows.select(*keys, "_ib").distinct(), cols.select(*keys, "_jb").distinct()
    left, right = rows.join(col_blocks, keys), cols.join(row_blocks, keys)
    dot = F.aggregate(F.zip_with("_row", "_col", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    s = F.lit(float(scale)) if isinstance(scale, (int, float)) else scale
    return left.join(right, [*keys, "_ib", "_jb"]).select(*keys, "i", "j", (dot * s).alias("v"))


def _sizes(elements: DataFrame, keys: list[str], name: str) -> DataFrame:
    return elements.groupBy(*keys).agg((F.max("i") + 1).alias(f"_{name}r"), (F.max("j") + 1).alias(f"_{name}c"), F.count(F.lit(1)).alias(f"_{name}n"))


def product_issues(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, detail) of every module whose product a·b is not defined.

    ``no-factor``: one side is absent. ``gaps``: a side lacks elements.
    ``inner-sizes``: columns of a and rows of b differ.
    """
    both = _sizes(a, keys, "a").join(_sizes(b, keys, "b"), keys, "full_outer")
    gaps = (F.col("_an") != F.col("_ar") * F.col("_ac")) | (F.col("_bn") != F.col("_br") * F.col("_bc"))
    code = (F.when(F.col("_an").isNull() | F.col("_bn").isNull(), "no-factor").when(gaps, "gaps").when(F.col("_ac") != F.col("_br"), "inner-sizes"))
    shape = lambda n: F.concat(F.coalesce(F.col(f"_{n}r").cast("string"), F.lit("-")), F.lit("x"), F.coalesce(F.col(f"_{n}c").cast("string"), F.lit("-")))
    return both.select(*keys, code.alias("code"), F.concat_ws(" ", shape("a"), shape("b")).alias("detail")).where("code IS NOT NULL")


def _sound(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``matmul`` of the modules without product issues."""
    issues = product_issues(a, b, keys).select(*keys)
    return matmul(a.join(issues, keys, "left_anti"), b.join(issues, keys, "left_anti"), keys)


def low_rank_update(up: DataFrame, down: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """ΔW = scale·up·down; modules with ``product_issues`` have none."""
    return _sound(up, down, keys).join(scales.select(*keys, "scale"), keys).select(*keys, "i", "j", (F.col("v") * F.col("scale")).alias("v"))


def hadamard_update(w1a: DataFrame, w1b: DataFrame, w2a: DataFrame, w2b: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """ΔW = (w1a·w1b) ⊙ (w2a·w2b)·scale; modules with issues or unlike products have none."""
    left = _sound(w1a, w1b, keys)
    right = _sound(w2a, w2b, keys).withColumnRenamed("v", "_w")
    unlike = hadamard_issues(w1a, w1b, w2a, w2b, keys).select(*keys)
    return (left.join(unlike, keys, "left_anti").join(right, [*keys, "i", "j"]).join(scales.select(*keys, "scale"), keys)
            .select(*keys, "i", "j", (F.col("v") * F.col("_w") * F.col("scale")).alias("v")))


def hadamard_issues(w1a: DataFrame, w1b: DataFrame, w2a: DataFrame, w2b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, detail): issues of either product, or ``outer-sizes`` where the two products differ in shape."""
    outer = (w1a.groupBy(*keys).agg((F.max("i") + 1).alias("_r1")).join(w1b.groupBy(*keys).agg((F.max("j") + 1).alias("_c1")), keys)
             .join(w2a.groupBy(*keys).agg((F.max("i") + 1).alias("_r2")), keys).join(w2b.groupBy(*keys).agg((F.max("j") + 1).alias("_c2")), keys))
    unlike = outer.where("_r1 <> _r2 OR _c1 <> _c2").select(*keys, F.lit("outer-sizes").alias("code"), F.format_string("%dx%d %dx%d", "_r1", "_c1", "_r2", "_c2").alias("detail"))
    return product_issues(w1a, w1b, keys).unionByName(product_issues(w2a, w2b, keys)).unionByName(unlike)


def kronecker_update(w1: DataFrame, w2: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """ΔW = w1 ⊗ w2·scale; row i₁·R₂+i₂, column j₁·C₂+j₂.

    w2 travels as one array per row; each w1 element meets those rows.
    """
    inner = _packed(w2, keys, "i", "j", "_row").withColumnRenamed("i", "_i2")
    size = w2.groupBy(*keys).agg((F.max("i") + 1).alias("_r2"))
    met = w1.withColumnRenamed("v", "_v1").join(size, keys).join(inner, keys).join(scales.select(*keys, "scale"), keys)
    return (met.select(*keys, (F.col("i") * F.col("_r2") + F.col("_i2")).alias("i"), F.col("j").alias("_j1"), F.size("_row").alias("_c2"),
                       (F.col("_v1") * F.col("scale")).alias("_v1"), F.posexplode("_row").alias("_j2", "_v2"))
            .select(*keys, "i", (F.col("_j1") * F.col("_c2") + F.col("_j2")).alias("j"), (F.col("_v1") * F.col("_v2")).alias("v")))


def flatten_dense(tensor: DataFrame, dims: list[tuple[str, int]]) -> DataFrame:
    """Trailing indices folded into one column index, row-major."""
    j = F.lit(0).cast("bigint")
    for name, size in dims:
        j = j * size + F.col(name)
    return tensor.withColumn("j", j).drop(*[n for n, _ in dims])


def base_difference(weights: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """W − W_base elementwise."""
    return (weights.join(base.withColumnRenamed("v", "_b"), [*keys, "i", "j"])
            .select(*keys, "i", "j", (F.col("v") - F.col("_b")).alias("v"), F.col("_b").alias("base")))


def relative_update(difference: DataFrame, keys: list[str]) -> DataFrame:
    """‖ΔW‖, ‖W_base‖ and their ratio (NULL for a zero base)."""
    norms = difference.groupBy(*keys).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("update_norm"), F.sqrt(F.sum(F.col("base") * F.col("base"))).alias("base_norm"))
    return norms.withColumn("relative_update", F.col("update_norm") / F.when(F.col("base_norm") > 0, F.col("base_norm")))


def apply_update(x: DataFrame, down: DataFrame, up: DataFrame, base: DataFrame, scales: DataFrame, keys: list[str]) -> DataFrame:
    """y = base + ((x·downᵀ)·upᵀ)·scale: the rank first, so ΔW never exists.

    x(n, in) as (i, j); result (i, j) over (n, out).
    """
    def flip(m: DataFrame) -> DataFrame:
        return m.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "v")

    narrow = matmul(x, flip(down), keys)
    wide = matmul(narrow, flip(up), keys).withColumnRenamed("v", "_d")
    return (base.join(wide, [*keys, "i", "j"]).join(scales.select(*keys, "scale"), keys)
            .select(*keys, "i", "j", (F.col("v") + F.col("_d") * F.col("scale")).alias("v")))


# --- spectra ----------------------------------------------------------------

#: Elements of one column block of the Jacobi solver, and rows of one block of a factor.
BLOCK_ELEMENTS, FACTOR_ROWS = 1 << 22, 4096
#: Triangles that one task stacks.
FAN_IN = 64
#: Elements of a module small enough to be solved with many others in one batch.
SMALL_ELEMENTS = 1024


def _fields(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def triangles(factor: DataFrame, keys: list[str], fold: str) -> DataFrame:
    """The R of a tall factor's QR as (keys, r array<array<double>>), by a tree of small QRs.

    ``fold`` is the short (rank) index. Blocks of rows are reduced to triangles
    of at most rank x rank, then ``FAN_IN`` triangles at a time, so no task sees
    a whole factor, and no product of a factor with itself loses digits.
    """
    long = "i" if fold == "j" else "j"
    packed = _packed(factor, keys, long, fold, "vec").select(*keys, F.floor(F.col(long) / FACTOR_ROWS).alias("_b"), F.col(long).alias("_o"), F.array("vec").alias("r"))
    schema = f"{_fields(factor, keys)}, _b bigint, _o bigint, r array<array<double>>"

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_o")
        r = np.linalg.qr(np.concatenate([np.stack(list(x)) for x in pdf["r"]]), mode="r")
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "_b": [pdf["_b"].iloc[0] // FAN_IN], "_o": [pdf["_b"].iloc[0]], "r": [[row.tolist() for row in r]]})

    blocks = materialized(packed.groupBy(*keys, "_b").applyInPandas(reduce, schema), "triangles")
    while blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        blocks = materialized(blocks.groupBy(*keys, "_b").applyInPandas(reduce, schema), "triangles")
    return blocks.select(*keys, "r")


def _column_blocks(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, wide, rows, blocks, block, columns, x): the short side's columns in blocks of bounded size, missing elements 0."""
    dims = elements.groupBy(*keys).agg((F.max("i") + 1).alias("_out"), (F.max("j") + 1).alias("_in"))
    wide = F.col("_out") < F.col("_in")
    rows, cols = F.greatest("_out", "_in"), F.least("_out", "_in")
    width = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_ELEMENTS) / rows))
    placed = elements.join(dims, keys).select(*keys, wide.alias("wide"), rows.alias("rows"), F.ceil(cols / width).cast("int").alias("blocks"), cols.alias("_n"), width.alias("_w"),
                                              F.when(wide, F.col("i")).otherwise(F.col("j")).alias("_c"), F.when(wide, F.col("j")).otherwise(F.col("i")).alias("_r"), "v")
    cut = placed.withColumn("block", F.floor(F.col("_c") / F.col("_w")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        lo = int(head["block"]) * int(head["_w"])
        x = np.zeros((min(int(head["_w"]), int(head["_n"]) - lo), int(head["rows"])))
        x[pdf["_c"].to_numpy() - lo, pdf["_r"].to_numpy()] = pdf["v"].to_numpy()
        return pd.DataFrame({**{k: [head[k]] for k in keys}, "wide": [head["wide"]], "rows": [head["rows"]], "blocks": [head["blocks"]], "block": [head["block"]], "off": [0.0], "x": [x.ravel()]})

    return cut.groupBy(*keys, "block").applyInPandas(build, f"{_fields(elements, keys)}, {_JACOBI}")


_JACOBI = "wide boolean, rows bigint, blocks int, block int, off double, x array<double>"


def _rotated(blocks: DataFrame, keys: list[str], turn: int) -> DataFrame:
    """One round of the tournament: every block meets another, and the columns of both are made orthogonal to each other.

    ``off`` is the largest cosine between columns of different blocks before the round.
    """
    even = F.col("blocks") + F.col("blocks") % 2
    # the circle method: the last place stays, the others move on by one each round
    place = F.when(F.col("block") == even - 1, even - 1).otherwise(F.pmod(F.col("block") + turn, even - 1))
    pair = F.when(F.col("blocks") == 1, 0).otherwise(F.least(place, F.when(place == even - 1, 0).when(place == 0, even - 1).otherwise(even - 1 - place)))

    def rotate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block").reset_index(drop=True)
        rows = int(pdf["rows"].iloc[0])
        parts = [np.asarray(x).reshape(-1, rows) for x in pdf["x"]]
        whole = np.concatenate(parts)
        off = 0.0
        if len(parts) > 1:
            norms = [np.maximum(np.linalg.norm(p, axis=1), 1e-300) for p in parts]
            off = float(np.abs((parts[0] @ parts[1].T) / np.outer(*norms)).max())
        _, s, right = np.linalg.svd(whole, full_matrices=False)  # rows are the matrix's columns
        turned = np.zeros_like(whole)
        turned[: len(s)] = s[:, None] * right
        cuts = np.split(turned, np.cumsum([len(p) for p in parts])[:-1])
        return pdf.assign(off=off, x=[c.ravel() for c in cuts]).drop(columns="_p")

    return blocks.withColumn("_p", pair).groupBy(*keys, "_p").applyInPandas(rotate, f"{_fields(blocks, keys)}, {_JACOBI}")


def orthogonal_columns(elements: DataFrame, keys: list[str], tolerance: float = 1e-13, sweeps: int = 40) -> DataFrame:
    """Column blocks of A·V (or Aᵀ·V) with orthogonal columns: their norms are all singular values of A.

    One-sided block Jacobi. A task holds two column blocks, never a whole large
    module; modules of one block are done in one step. A sweep lets every two
    blocks of a module meet; it ends when no two columns of different blocks
    have a cosine above ``tolerance``.
    """
    blocks = materialized(_column_blocks(elements, keys), "jacobi")
    most = blocks.agg(F.max("blocks").alias("m")).first()["m"] or 1
    if most == 1:
        return _rotated(blocks, keys, 0)
    for _ in range(sweeps):
        worst = 0.0
        for turn in range(most + most % 2 - 1):
            blocks = materialized(_rotated(blocks, keys, turn), "jacobi")
            worst = max(worst, blocks.agg(F.max("off").alias("o")).first()["o"])
        if worst <= tolerance:
            return blocks
    raise ArithmeticError(f"columns still have a cosine of {worst} after {sweeps} sweeps")


def _small_svd(packed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, u) of small modules, one row each: a batch of rows is stacked by shape and solved at once.

    ``packed(keys, out, in, p, v)``: places ``i * in + j`` and values of the elements that are there.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, out, inner = len(pdf), pdf["out"].to_numpy(), pdf["in"].to_numpy()
        s, u = np.empty(n, dtype=object), np.empty(n, dtype=object)
        for rows, cols in set(zip(out.tolist(), inner.tolist())):
            at = np.flatnonzero((out == rows) & (inner == cols))
            places, values = [pdf["p"].iloc[a] for a in at], [pdf["v"].iloc[a] for a in at]
            whole = np.zeros((len(at), rows * cols))
            whole[np.repeat(np.arange(len(at)), [len(p) for p in places]), np.concatenate(places)] = np.concatenate(values)
            left, sigma, _ = np.linalg.svd(whole.reshape(-1, rows, cols), full_matrices=False)
            first = np.where(sigma[:, :1] > 0, left[:, :, 0], 0.0)
            for place, a in enumerate(at):
                s[a], u[a] = sigma[place], first[place]
        return pdf[keys].assign(s=s, u=u)

    return packed.mapInPandas(lambda batches: map(solve, batches), f"{_fields(packed, keys)}, s array<double>, u array<double>")


def dense_svd(elements: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, k, sigma) of dense modules, largest first, and the top left vector (keys, i, v).

    ``min(out, in)`` values each, 0 included; a module without a nonzero element has a zero vector.
    Modules of at most ``SMALL_ELEMENTS`` are solved in batches, larger ones by column blocks.
    """
    sizes = materialized(elements.groupBy(*keys).agg((F.max("i") + 1).alias("out"), (F.max("j") + 1).alias("in")), "sizes")
    fits = F.col("out") * F.col("in") <= min(SMALL_ELEMENTS, BLOCK_ELEMENTS)
    small, large = sizes.where(fits), sizes.where(~fits).select(*keys)
    element = F.struct((F.col("i") * F.col("in") + F.col("j")).alias("p"), "v")
    packed = spread(elements, *keys).join(small, keys).groupBy(*keys, "out", "in").agg(F.collect_list(element).alias("_e")).select(*keys, "out", "in", F.col("_e.p").alias("p"), F.col("_e.v").alias("v"))
    solved = materialized(_small_svd(packed, keys), "solved")
    sigmas = solved.select(*keys, F.posexplode("s").alias("k", "sigma")).withColumn("k", F.col("k").cast("bigint"))
    vectors = canonical_sign(solved.select(*keys, F.posexplode("u").alias("i", "v")).withColumn("i", F.col("i").cast("bigint")), keys)
    if large.isEmpty():
        return sigmas, vectors
    values, lead = _block_svd(elements.join(large, keys), keys)
    return sigmas.unionByName(values), vectors.unionByName(lead)


def _block_svd(elements: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """:func:`dense_svd` by orthogonal column blocks."""
    done = materialized(orthogonal_columns(elements, keys), "orthogonal")

    def norms(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.itertuples(index=False):
            size = np.linalg.norm(np.asarray(row.x).reshape(-1, int(row.rows)), axis=1)
            out.append(pd.DataFrame({**{k: [getattr(row, k)] * len(size) for k in keys}, "block": [row.block] * len(size), "c": np.arange(len(size)), "sigma": size}))
        return pd.concat(out) if out else pd.DataFrame({**{k: [] for k in keys}, "block": [], "c": [], "sigma": []})

    columns = materialized(done.mapInPandas(lambda batches: map(norms, batches), f"{_fields(elements, keys)}, block int, c bigint, sigma double"), "norms")
    # a module's singular values: as many as its short side has columns
    by_size = Window.partitionBy(*keys).orderBy(F.desc("sigma"), "block", "c")
    ranked = columns.withColumn("k", (F.row_number().over(by_size) - 1).cast("bigint"))
    lead = done.join(ranked.where("k = 0"), [*keys, "block"]).select(
        *keys, "wide", "sigma", F.posexplode(F.slice(F.col("x"), F.col("c").cast("int") * F.col("rows").cast("int") + 1, F.col("rows").cast("int"))).alias("r", "y"))
    unit = lead.withColumn("y", F.when(F.col("sigma") > 0, F.col("y") / F.col("sigma")).otherwise(0.0))
    tall = unit.where("not wide").select(*keys, F.col("r").cast("bigint").alias("i"), F.col("y").alias("v"))
    right = unit.where("wide").select(*keys, F.col("r").cast("bigint").alias("j"), "y", "sigma")
    turned = elements.join(right, [*keys, "j"]).groupBy(*keys, "i").agg((F.sum(F.col("v") * F.col("y")) / F.when(F.max("sigma") > 0, F.max("sigma")).otherwise(1.0)).alias("v"))
    return ranked.select(*keys, "k", "sigma"), canonical_sign(tall.unionByName(turned), keys)


def dense_spectrum(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, sigma) of dense modules."""
    return dense_svd(elements, keys)[0]


def low_rank_spectrum(up: DataFrame, down: DataFrame, scales: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Singular values of scale·up·down and its top left vector, never forming ΔW.

    With triangles R of both factors, the values are those of R_up·R_downᵀ, as
    many as the smallest of rank and both sides; so a rank beyond a side needs no
    other plan. u₁ = scale·up·(R_downᵀ·z)/σ₁, z the top right vector there.
    """
    both = (triangles(up, keys, "j").withColumnRenamed("r", "ru").join(triangles(down, keys, "i").withColumnRenamed("r", "rd"), keys)
            .join(scales.select(*keys, "scale"), keys))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ru, rd = (np.stack(list(pdf[c].iloc[0])) for c in ("ru", "rd"))
        scale = float(pdf["scale"].iloc[0])
        _, s, right = np.linalg.svd(scale * ru @ rd.T, full_matrices=False)
        coefficient = scale * rd.T @ right[0] / s[0] if s[0] > 0 else np.zeros(rd.shape[1])
        n = len(coefficient)
        sigma = np.full(n, np.nan)
        sigma[: min(n, len(s))] = s[:n]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * n for k in keys}, "k": np.arange(n), "sigma": sigma, "coefficient": coefficient})

    solved = materialized(both.groupBy(*keys).applyInPandas(solve, f"{_fields(up, keys)}, k bigint, sigma double, coefficient double"), "solved")
    u1 = (up.join(solved.select(*keys, F.col("k").alias("j"), "coefficient"), [*keys, "j"])
          .groupBy(*keys, "i").agg(F.sum(F.col("v") * F.col("coefficient")).alias("v")))
    # ranks beyond a side have a coefficient but no singular value
    return solved.where("sigma IS NOT NULL AND NOT isnan(sigma)").select(*keys, "k", "sigma"), canonical_sign(u1, keys)


def spectral_summary(sigmas: DataFrame, keys: list[str]) -> DataFrame:
    """Energy, entropy, effective rank, concentration and numeric rank per module."""
    per = sigmas.groupBy(*keys).agg(F.sum(F.col("sigma") * F.col("sigma")).alias("energy"), F.max("sigma").alias("_top"), F.count(F.lit(1)).alias("size"))
    ok = per.where((F.col("energy") > 0) & (F.col("energy") < float("inf")))
    p = F.col("sigma") * F.col("sigma") / F.col("energy")
    rows = sigmas.join(ok, keys)
    out = rows.groupBy(*keys).agg(
        F.max("energy").alias("energy"), F.max("size").alias("size"), F.max("_top").alias("_top"),
        (-F.sum(F.when(F.col("sigma") > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"),
        F.count(F.when(F.col("sigma") > F.col("_top") * 1e-4, 1)).alias("numeric_rank"))
    unit = F.when(F.col("size") >= 2, F.col("entropy") / F.log(F.col("size").cast("double"))).otherwise(0.0)
    return out.select(*keys, "size", "numeric_rank", "energy", F.sqrt("energy").alias("frobenius"), "entropy",
                      F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)).alias("normalized_entropy"), F.exp("entropy").alias("effective_rank"),
                      (F.col("_top") * F.col("_top") / F.col("energy")).alias("concentration"))


def top_sigmas(sigmas: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k largest singular values per module, largest first."""
    return top_k(sigmas, keys, [F.desc("sigma"), F.col("k")], k, ["k"])


def canonical_sign(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Flip a vector so that its largest-magnitude entry is positive."""
    lead = vectors.groupBy(*keys).agg(F.max_by("v", F.struct(F.abs("v"), -F.col("i"))).alias("_lead"))
    return vectors.join(lead, keys).select(*keys, "i", F.when(F.col("_lead") < 0, -F.col("v")).otherwise(F.col("v")).alias("v"))


def aggregate_spectra(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Energy-weighted narrowness and plain means over modules of size 2 or more."""
    usable = summaries.where("size >= 2")
    out = usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("modules"), (F.sum(F.col("energy") * (1 - F.col("normalized_entropy"))) / F.sum("energy")).alias("narrowness"),
        F.avg("effective_rank").alias("mean_effective_rank"), F.avg("concentration").alias("mean_concentration"), F.sum("energy").alias("total_energy"))
    return out.where("total_energy > 0")


def top_modules(summaries: DataFrame, keys: list[str], name: str, k: int) -> DataFrame:
    """The k modules of largest Frobenius norm."""
    return top_k(summaries, keys, [F.desc("frobenius"), F.col(name)], k, [name])
