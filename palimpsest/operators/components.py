"""4-connected components of cell masks.

Two plans with the same result. Grids small enough that one grid is a bounded
piece of work are labelled grid by grid, many grids per task. Anything larger
is labelled by a distributed loop over row runs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.grid import col_of, row_of
from palimpsest.session import checkpointed

SMALL_GRID = 65_536
#: Grids of at most so many cells are labelled many at a time, an Arrow batch of grids at once.
TINY_GRID = 1_024


def components(mask: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """(keys, cell, root): root is the smallest cell of the component."""
    if rows * cols <= TINY_GRID:
        return tiny_components(mask, keys, rows, cols)
    if rows * cols <= SMALL_GRID:
        return small_components(mask, keys, cols)
    return large_components(mask, keys, cols)


def _label(cells: np.ndarray, cols: int) -> np.ndarray:
    """Smallest cell reachable from each of the sorted, distinct cells."""
    order = np.sort(cells)
    root = np.arange(len(order))
    here = order % cols
    right = np.searchsorted(order, order + 1)
    down = np.searchsorted(order, order + cols)
    last = len(order) - 1
    has_right = (order[np.minimum(right, last)] == order + 1) & (here < cols - 1)
    has_down = order[np.minimum(down, last)] == order + cols
    a = np.concatenate([np.nonzero(has_right)[0], np.nonzero(has_down)[0]])
    b = np.concatenate([right[has_right], down[has_down]])
    while True:
        low = np.minimum(root[a], root[b])
        updated = root.copy()
        np.minimum.at(updated, a, low)
        np.minimum.at(updated, b, low)
        updated = updated[updated]
        if np.array_equal(updated, root):
            break
        root = updated
    labels = order[root]
    return labels[np.searchsorted(order, cells)]


def tiny_components(mask: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """A batch of grids is labelled as one tall grid, an empty row between each two."""
    grids = mask.groupBy(*keys).agg(F.collect_set(F.col("cell").cast("bigint")).alias("_cells"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in grids.schema.fields[:-1]) + ", cell bigint, root bigint"

    def label(batches):
        for batch in batches:
            lists = batch.column(len(keys))
            grid = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            below = grid * ((rows + 1) * cols)
            cells = lists.flatten().to_numpy()
            root = _label(below + cells, cols) - below if len(cells) else cells
            place = pa.array(grid)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(place) for i in range(len(keys))], pa.array(cells), pa.array(root)], names=[*keys, "cell", "root"])

    return grids.mapInArrow(label, schema)


def small_components(mask: DataFrame, keys: list[str], cols: int) -> DataFrame:
    """One task labels whole grids; a grid is at most ``SMALL_GRID`` cells."""
    cells = mask.select(*keys, F.col("cell").cast("bigint").alias("cell")).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields) + ", root bigint"

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(root=_label(pdf["cell"].to_numpy(), cols))

    return cells.groupBy(*keys).applyInPandas(label, schema)


def large_components(mask: DataFrame, keys: list[str], cols: int) -> DataFrame:
    """Min-label rounds with pointer jumping over row runs, until none changes."""
    cells = (mask.select(*keys, F.col("cell").cast("bigint").alias("cell")).distinct()
             .withColumn("_r", row_of(F.col("cell"), cols)).withColumn("_c", col_of(F.col("cell"), cols)))
    along = Window.partitionBy(*keys, "_r").orderBy("_c")
    runs = cells.withColumn("_g", F.col("_c") - F.row_number().over(along))
    runs = runs.withColumn("run", F.min("cell").over(Window.partitionBy(*keys, "_r", "_g"))).drop("_g")
    runs = checkpointed(runs.select(*keys, "cell", "run"))
    below = runs.select(*keys, (F.col("cell") - cols).alias("cell"), F.col("run").alias("b"))
    touching = runs.withColumnRenamed("run", "a").join(below, [*keys, "cell"]).select(*keys, "a", "b").distinct()
    edges = checkpointed(touching.select(*keys, "a", "b").union(touching.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = runs.select(*keys, F.col("run").alias("node"), F.col("run").alias("label")).distinct()
    while True:
        seen = (edges.join(labels.withColumnRenamed("node", "a"), [*keys, "a"])
                .groupBy(*keys, F.col("b").alias("node")).agg(F.min("label").alias("_near")))
        lowered = (labels.join(seen, [*keys, "node"], "left")
                   .select(*keys, "node", F.least("label", F.coalesce("_near", "label")).alias("_low"), "label"))
        hop = labels.select(*keys, F.col("node").alias("_low"), F.col("label").alias("_jump"))
        jumped = (lowered.join(hop, [*keys, "_low"], "left")
                  .select(*keys, "node", F.least("_low", F.coalesce("_jump", "_low")).alias("new"), "label"))
        stepped = checkpointed(jumped)
        changed = not stepped.where("new <> label").isEmpty()
        labels = stepped.select(*keys, "node", F.col("new").alias("label"))
        if not changed:
            break
    return (runs.join(labels.select(*keys, F.col("node").alias("run"), F.col("label").alias("root")), [*keys, "run"])
            .select(*keys, "cell", "root"))


def ordered_components(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Component size and 1-based place, largest first, then smallest root."""
    sizes = labelled.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("size"))
    place = Window.partitionBy(*keys).orderBy(F.desc("size"), "root")
    return sizes.withColumn("component", F.row_number().over(place))
