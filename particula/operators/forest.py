"""Random forest regression (M1): the method of `pyspark.ml`, grown from sums per cell.

Each feature is cut into at most `BINS` bins at quantiles of all rows; a tree
sees every row with a Poisson(1) weight, tries a third of the features at a
node and takes the cut that lowers the squared error most. `pyspark.ml` walks
all rows down all trees at every level, and keeps a weight per row and tree.
But rows equal in all bins (a cell) take the same way in every tree, so a tree
needs no more of them than the sums of w, w y and w y^2:

1. one pass over the rows draws all weights and adds them up per tree and cell;
2. a task grows a tree from its cells, level by level on arrays;
3. a cell's prediction is the mean over the trees; rows look up their cell.

Work grows with rows times trees, once, not with levels. Cells are at most the
product of the bins (32^3 for three features, however many rows), so what a
task holds, a tree's group and the looked-up table are bounded by that.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

BINS = 32
QUANTILES = 10_000  # of a feature, between which its cuts are chosen


def cuts_of(values, bins: int = BINS) -> list[float]:
    """Cuts between sorted values: all gaps where they are few, else those nearest to equal shares."""
    distinct, counts = np.unique(np.asarray(values, float), return_counts=True)
    # halved first, as a sum may overflow; a value at a cut lies above it
    middle = np.maximum(distinct[:-1] / 2 + distinct[1:] / 2, np.nextafter(distinct[:-1], np.inf))
    if len(middle) < bins:
        return middle[np.isfinite(middle)].tolist()
    stride, target, found = counts.sum() / bins, counts.sum() / bins, []
    until = np.cumsum(counts)
    for i in range(len(middle)):
        if abs(until[i] - target) < abs(until[i + 1] - target):
            found.append(float(middle[i]))
            target += stride
    return [x for x in found if math.isfinite(x)]


def _placed(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """With ``_cell``, the number of a row's cell: its bins as digits (a value at a cut lies above it)."""
    cut = [(c, f"_bin_{c}", of) for c, of in zip(columns, cuts, strict=True) if of]
    out = df
    if cut:
        splits = [[-math.inf, *of, math.inf] for *_, of in cut]
        out = Bucketizer(splitsArray=splits, inputCols=[c for c, *_ in cut], outputCols=[b for _, b, _ in cut]).transform(df)
    cell = F.lit(0)
    for _, b, of in cut:
        cell = cell * (len(of) + 1) + F.col(b).cast("int")
    return out.select(*df.columns, cell.alias("_cell"))


def _weighted_sums(cells: int, trees: int, seed: int):
    """(cell, y) -> per tree and cell the sums of w, w y and w y^2 over a task's rows."""

    def add(batches):
        rng = np.random.default_rng([seed, 0, TaskContext.get().partitionId()])
        sums, met = np.zeros((3, cells, trees)), np.zeros(cells, bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, y = batch.column("cell").to_numpy(), batch.column("y").to_numpy()
            order = np.argsort(cell, kind="stable")
            cell, y = cell[order], y[order, None]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            w = rng.poisson(1.0, (len(cell), trees)).astype(float)
            for i in range(3):
                sums[i, cell[starts]] += np.add.reduceat(w, starts)
                w *= y
            met[cell] = True
        of = np.flatnonzero(met)
        for tree in range(trees) if len(of) else ():
            w, wy, wyy = (s[of, tree] for s in sums)
            yield pa.RecordBatch.from_pydict({"tree": np.full(len(of), tree, np.int32), "cell": of.astype(np.int32), "w": w, "wy": wy, "wyy": wyy})

    return add


def grown(bins: list[np.ndarray], sizes: list[int], sums: np.ndarray, tried: int, depth: int, rng) -> np.ndarray:
    """The predictions of one tree for its cells: ``bins`` per feature, ``sums`` of w, w y, w y^2."""
    out = np.zeros(sums.shape[1])
    at = np.arange(len(out))  # the cells whose node may be split, and that node
    node = np.zeros(len(out), int)
    for level in range(depth + 1):
        k = int(node.max()) + 1 if len(node) else 0
        if k == 0:
            break
        w, wy, wyy = (np.bincount(node, s[at], k) for s in sums)
        out[at] = np.divide(wy, w, out=np.zeros(k), where=w > 0)[node]
        if level == depth:
            break
        ranks = rng.permuted(np.tile(np.arange(len(sizes)), (k, 1)), axis=1)
        # what rounding leaves of an error that is none is no gain
        gain, feature, cut = 1e-13 * wyy, np.full(k, -1), np.zeros(k, int)
        for f, size in enumerate(sizes):
            asked = ranks[:, f] < tried
            if size < 2 or not asked.any():
                continue
            place = np.cumsum(asked) - 1
            rows = asked[node]
            slot = place[node[rows]] * size + bins[f][at[rows]]
            left, left_y = (np.bincount(slot, s[at[rows]], int(asked.sum()) * size).reshape(-1, size).cumsum(axis=1)[:, :-1] for s in sums[:2])
            right, right_y = w[asked, None] - left, wy[asked, None] - left_y
            both = (left >= 1) & (right >= 1)
            score = np.full(left.shape, -np.inf)
            all_y, all_w = (np.broadcast_to(x[asked, None], left.shape)[both] for x in (wy, w))
            score[both] = left_y[both] ** 2 / left[both] + right_y[both] ** 2 / right[both] - all_y**2 / all_w
            best = score.argmax(axis=1)
            score = score[np.arange(len(best)), best]
            here = np.flatnonzero(asked)
            better = score > gain[here]
            gain[here[better]], feature[here[better]], cut[here[better]] = score[better], f, best[better]
        go = feature[node] >= 0
        at, node = at[go], node[go]
        child = np.cumsum(feature >= 0) - 1
        bin_of = np.array(bins)[feature[node], at] if len(at) else np.zeros(0, int)
        node = 2 * child[node] + (bin_of > cut[node])
    return out


def _tree(sizes: list[int], tried: int, depth: int, seed: int):
    def grow(table: pa.Table) -> pa.Table:
        table = table.sort_by("cell")
        bins = list(np.unravel_index(table["cell"].to_numpy(), sizes))
        sums = np.array([table[c].to_numpy() for c in ("w", "wy", "wyy")])
        rng = np.random.default_rng([seed, 1, table["tree"][0].as_py()])
        return pa.table({"tree": table["tree"], "cell": table["cell"], "p": grown(bins, sizes, sums, tried, depth, rng)})

    return grow


def forest_predictions(df: DataFrame, rows: int, label: str, columns: list[str], trees: int, depth: int, seed: int, out: str) -> DataFrame:
    """``df`` (of ``rows`` rows, no missing values in ``label`` and ``columns``) with the forest's prediction of ``label``."""
    points = min(rows, QUANTILES)
    quantiles = df.approxQuantile(columns, [(i + 0.5) / points for i in range(points)], 1.0 / QUANTILES)
    cuts = [cuts_of(q, min(BINS, rows)) for q in quantiles]
    sizes = [len(c) + 1 for c in cuts]
    tried = len(columns) if trees == 1 else math.ceil(len(columns) / 3)
    placed = _placed(df, columns, cuts)
    sums = placed.select(F.col("_cell").alias("cell"), F.col(label).cast("double").alias("y")).mapInArrow(
        _weighted_sums(math.prod(sizes), trees, seed), "tree int, cell int, w double, wy double, wyy double"
    )
    sums = sums.repartition(trees, "tree").groupBy("tree", "cell").agg(*[F.sum(c).alias(c) for c in ("w", "wy", "wyy")])
    grown_trees = sums.groupBy("tree").applyInArrow(_tree(sizes, tried, depth, seed), "tree int, cell int, p double")
    # a row per cell; kept, so that the forest is grown once
    forest = cut_lineage(grown_trees.groupBy("cell").agg(F.avg("p").alias(out)).withColumnRenamed("cell", "_cell"))
    return placed.join(F.broadcast(forest), "_cell", "left").select(*df.columns, out)
