"""Many decision trees in one pass per level.

Features are binned once into bytes.  Every level of all trees is one job: tasks
send their rows down the trees grown so far, add up moments per (node, feature,
bin), and the sums of all tasks give the best split of each node.  The number of
jobs is the depth, whatever the number of trees, folds or grid points.  Trees that
see the same rows with the same weights, such as those of grid points that differ
in depth or leaf size alone, share a node's moments as long as all splits above it
are the same.

A tree predicts the ratio of two sums, numerator over denominator: with w y over
w it is a regression tree (for 0/1 labels the splits of the Gini impurity), with
one numerator per class a classification tree, and with the products of
residuals w (Y - m)(T - e) over w (T - e)^2 a treatment-effect tree, whose gain
compares effects and needs no ratio per unit.  A split's gain is the rise of
numerator^2 / denominator, summed over numerators.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taufold.operators.quantiles import exact_quantiles

MAX_BINS = 32
#: Cells (node, feature, bin) of a task's histogram; more nodes of a level are dealt over several passes.
HISTOGRAM_CELLS = 1 << 21
#: Pairs of row and tree that are sent down together.
PAIRS = 1 << 20
#: A gain below this share of the node's own score is rounding.
LEAST_GAIN = 1e-12


@dataclass(frozen=True)
class TreeSpec:
    """One tree: which draw weighs its rows, which moments it fits, the folds it must not see and those it sees alone (-1: any)."""

    draw: int = 0
    target: int = 0
    max_depth: int = 5
    min_leaf: int = 1
    skip: tuple[int, ...] = ()
    only: tuple[int, ...] = ()


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees in flat arrays; tree t begins at node t, a right child follows its left one."""

    feature: np.ndarray  # -1: a leaf
    cut: np.ndarray  # bins up to it go left
    left: np.ndarray
    value: np.ndarray  # (nodes, numerators)
    cuts: tuple[tuple[float, ...], ...]
    n_trees: int

    def leaves(self, bins: np.ndarray, trees: np.ndarray | None = None) -> np.ndarray:
        """(rows, trees): the node that each row of ``bins`` (rows, features) ends in."""
        roots = np.arange(self.n_trees) if trees is None else trees
        node = np.broadcast_to(roots, (len(bins), len(roots))).copy()
        rows = np.arange(len(bins))[:, None]
        while True:
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.any():
                return node
            right = bins[rows, np.maximum(feature, 0)] > self.cut[node]
            node = np.where(inner, self.left[node] + right, node)

    def alike(self) -> np.ndarray:
        """For each tree the first one with the same splits and values."""

        def shape(node: int) -> tuple:
            if self.feature[node] < 0:
                return (self.value[node].tobytes(),)
            left = int(self.left[node])
            return int(self.feature[node]), int(self.cut[node]), shape(left), shape(left + 1)

        first: dict[tuple, int] = {}
        return np.array([first.setdefault(shape(t), t) for t in range(self.n_trees)], np.int64)

    def binned(self, features: np.ndarray) -> np.ndarray:
        """Bins of feature values (rows, features)."""
        return np.stack([np.searchsorted(c, features[:, k], "left") for k, c in enumerate(self.cuts)], axis=1)


def feature_cuts(df: DataFrame, features: str, max_bins: int = MAX_BINS) -> tuple[tuple[float, ...], ...]:
    """Cut values of each entry of the array column ``features``: all values where there are few, else exact quantiles.

    The largest value is no cut.  At most ``max_bins`` values per feature reach the driver.
    """
    long = df.select(F.posexplode(features).alias("k", "v"))
    found = {r["k"]: r["n"] for r in long.groupBy("k").agg(F.approx_count_distinct("v", 0.02).alias("n")).collect()}
    few = [k for k, n in found.items() if n <= max_bins]
    many = [k for k in found if k not in few]
    cuts: dict[int, list[float]] = {}
    if few:
        for r in long.filter(F.col("k").isin(few) & ~F.isnan("v")).distinct().collect():
            cuts.setdefault(r["k"], []).append(r["v"])
    if many:
        shares = [b / max_bins for b in range(1, max_bins + 1)]
        for (k,), values in exact_quantiles(long.filter(F.col("k").isin(many)), "v", shares, by=["k"]).items():
            cuts[k] = values
    return tuple(tuple(sorted(set(cuts.get(k, [])))[:-1]) for k in range(max(found, default=-1) + 1))


def entries(column: pa.Array, dtype: type) -> np.ndarray:
    """An array column whose rows are equally long, as (rows, entries)."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False).astype(dtype)[:, None]


def binned(df: DataFrame, features: str, cuts: tuple[tuple[float, ...], ...], keep: Sequence[str]) -> DataFrame:
    """(bins, ...): bytes of each row's bins, and the columns ``keep``; features are binned once for all trees."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = entries(batch.column(0), np.float64)
            bins = np.stack([np.searchsorted(c, values[:, k], "left") for k, c in enumerate(cuts)], axis=1).astype(np.uint8)
            ends = pa.array(np.arange(len(bins) + 1, dtype=np.int32) * len(cuts))
            rows = pa.Array.from_buffers(pa.binary(), len(bins), [None, ends.buffers()[1], pa.py_buffer(bins.tobytes())])
            yield pa.record_batch([rows, *batch.columns[1:]], ["bins", *keep])

    source = df.select(F.col(features), *keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(scan, f"bins binary{kinds}")


def row_slices(batches: Iterator[pa.RecordBatch], n_features: int, n_trees: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    step = max(16, PAIRS // max(1, n_trees))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            part = batch.slice(low, step)
            rows = part.column(0)
            ends = np.frombuffer(rows.buffers()[1], np.int32, len(rows) + 1, 4 * rows.offset)
            bins = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            yield bins.reshape(len(rows), n_features), part


def _weights(draws: np.ndarray, folds: np.ndarray, specs: Sequence[TreeSpec]) -> np.ndarray:
    """(rows, trees): how often each row counts in each tree."""
    weight = draws[:, [s.draw for s in specs]]
    for j in range(folds.shape[1]):
        skip = np.array([s.skip[j] if j < len(s.skip) else -1 for s in specs])
        only = np.array([s.only[j] if j < len(s.only) else -1 for s in specs])
        own = folds[:, j : j + 1]
        weight = np.where((own == skip) | ((only >= 0) & (own != only)), 0, weight)
    return weight


def _level(
    table: DataFrame, trees: Trees, nodes: np.ndarray, owner: np.ndarray, limits: Sequence[tuple[int, int]], specs: Sequence[TreeSpec], numerators: int
) -> DataFrame:
    """(slot, least, n, den, num0.., feature, bin, and the left side's sums) of the best split of each of ``nodes``.

    ``limits`` are the (slot, least rows of a side) that are asked for, one or more per node.
    """
    spark = table.sparkSession
    n_features, n_bins = len(trees.cuts), max((len(c) for c in trees.cuts), default=0) + 1
    growing = np.unique(owner)
    slot_of = np.full(len(trees.feature), -1, np.int64)
    slot_of[nodes] = np.arange(len(nodes))
    shared = spark.sparkContext.broadcast((trees, slot_of, growing, [specs[t] for t in growing]))
    stats = 2 + numerators

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, slots, which, chosen = shared.value
        target = np.array([s.target for s in chosen])
        total = np.zeros((n_features, stats, len(nodes) * n_bins))
        for bins, part in row_slices(batches, n_features, len(which)):
            weight = _weights(entries(part.column(1), np.int64), entries(part.column(2), np.int64), chosen)
            slot = slots[own.leaves(bins, which)]
            row, tree = np.nonzero((weight > 0) & (slot >= 0))
            if not len(row):
                continue
            count = weight[row, tree].astype(np.float64)
            den = entries(part.column(3), np.float64)[row, target[tree]] * count
            num = entries(part.column(4), np.float64).reshape(part.num_rows, -1, numerators)[row, target[tree]] * count[:, None]
            at = slot[row, tree] * n_bins
            for k in range(n_features):
                place = at + bins[row, k]
                for s, values in enumerate((count, den, *num.T)):
                    total[k, s] += np.bincount(place, values, len(nodes) * n_bins)
        feature, place = np.nonzero(total[:, 0])
        columns = [place // n_bins, feature, place % n_bins, *(total[feature, s, place] for s in range(stats))]
        yield pa.record_batch([pa.array(c) for c in columns], names)

    sums = ["n", "den", *(f"num{j}" for j in range(numerators))]
    names = ["slot", "feature", "bin", *sums]
    cells = table.select("bins", "draws", "folds", "den", "num").mapInArrow(add, "slot long, feature long, bin long, " + ", ".join(f"{c} double" for c in sums))
    # One shuffle: a node's cells meet in one task, a node has at most features x bins of them.
    cells = cells.repartition("slot").groupBy("slot", "feature", "bin").agg(*[F.sum(c).alias(c) for c in sums])
    one = Window.partitionBy("slot", "feature")
    so_far = one.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("slot", "feature", "bin", *[F.sum(c).over(so_far).alias(f"l_{c}") for c in sums], *[F.sum(c).over(one).alias(c) for c in sums])

    def score(side: str) -> F.Column:
        squares = [F.pow(F.col(f"{side}num{j}"), F.lit(2)) for j in range(numerators)]
        return F.try_divide(sum(squares[1:], squares[0]), F.col(f"{side}den"))

    right = {f"r_{c}": F.col(c) - F.col(f"l_{c}") for c in sums}
    leaf_sizes = {least for _, least in limits}
    if len(leaf_sizes) == 1:
        cells = cells.withColumn("least", F.lit(leaf_sizes.pop()))
    else:  # a few rows per node of this level
        cells = cells.join(F.broadcast(spark.createDataFrame(limits, "slot long, least long")), "slot")
    gain = score("l_") + score("r_") - score("")
    fits = (F.col("l_n") >= F.col("least")) & (F.col("r_n") >= F.col("least")) & (gain > LEAST_GAIN * score(""))
    ranked = cells.withColumns(right).withColumn("gain", F.when(fits, gain))
    best = Window.partitionBy("slot", "least").orderBy(F.desc_nulls_last("gain"), "feature", "bin")
    first = ranked.withColumn("_nth", F.row_number().over(best)).filter("_nth = 1")
    return first.select("slot", "least", "feature", "bin", "gain", *sums, *[f"l_{c}" for c in sums])


def grow(table: DataFrame, specs: Sequence[TreeSpec], cuts: tuple[tuple[float, ...], ...], numerators: int = 1) -> Trees:
    """All trees of ``specs``, level by level.

    ``table`` has ``bins`` (see ``binned``), ``draws`` (how often a unit counts,
    one entry per draw), ``folds`` (fold numbers that specs may skip), ``den``
    (one entry per target) and ``num`` (``numerators`` entries per target).  It is
    read once a level, so it should be a written table.  A tree without rows has
    a NaN value.  Equal gains go to the first feature and the smallest cut.
    """
    n_trees = len(specs)
    feature, cut, left = [-1] * n_trees, [0] * n_trees, [0] * n_trees
    value = [[float("nan")] * numerators for _ in range(n_trees)]
    # Nodes of one number see the same rows: the same draw, target and folds, and the same splits above.
    same: dict[tuple, int] = {}
    number = lambda *key: same.setdefault(key, len(same))
    frontier = [(number(s.draw, s.target, s.skip, s.only), t, t, 0) for t, s in enumerate(specs)]  # number, node, tree, depth
    n_features, n_bins = len(cuts), max((len(c) for c in cuts), default=0) + 1
    room = max(1, HISTOGRAM_CELLS // max(1, n_features * n_bins))

    def so_far() -> Trees:
        narrow = lambda x: np.array(x, np.int32)
        return Trees(narrow(feature), narrow(cut), narrow(left), np.array(value, np.float64).reshape(-1, numerators), cuts, n_trees)

    while frontier:
        trees, following = so_far(), []
        members: dict[int, list[tuple[int, int, int]]] = {}
        for shared, *member in frontier:
            members.setdefault(shared, []).append(tuple(member))
        groups = list(members.items())
        for low in range(0, len(groups), room):
            part = groups[low : low + room]
            # The first tree of each number stands for all.
            nodes, owner = (np.array([own[0][k] for _, own in part]) for k in range(2))
            limits = sorted({(slot, specs[tree].min_leaf) for slot, (_, own) in enumerate(part) for _, tree, _ in own})
            found = _level(table, trees, nodes, owner, limits, specs, numerators)
            # One row per node of the level and leaf size.
            best = {(r["slot"], r["least"]): r for r in found.collect()}
            for slot, shared, (node, tree, depth) in ((slot, shared, m) for slot, (shared, own) in enumerate(part) for m in own):
                r = best.get((slot, specs[tree].min_leaf))
                if r is None:
                    continue
                ratio = lambda den, nums: [x / den if den else float("nan") for x in nums]
                nums = [r[f"num{j}"] for j in range(numerators)]
                if depth == 0:
                    value[node] = ratio(r["den"], nums)
                if r["gain"] is None or depth >= specs[tree].max_depth:
                    continue
                feature[node], cut[node], left[node] = r["feature"], r["bin"], len(feature)
                own = [r[f"l_num{j}"] for j in range(numerators)]
                sides = [(r["l_n"], r["l_den"], own), (r["n"] - r["l_n"], r["den"] - r["l_den"], [a - b for a, b in zip(nums, own)])]
                for side, (n, den, sums) in enumerate(sides):
                    if depth + 1 < specs[tree].max_depth and n >= 2 * specs[tree].min_leaf:
                        below = number(shared, r["feature"], r["bin"], side)
                        following.append((below, len(feature), tree, depth + 1))
                    feature.append(-1)
                    cut.append(0)
                    left.append(0)
                    value.append(ratio(den, sums))
        frontier = following
    return so_far()
