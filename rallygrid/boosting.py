"""Spark's boosted trees, fitted in one task where the rows fit.

A boosted tree in Spark is some five jobs in a row, each a pass of small tasks, so hundreds of trees on
some hundred thousand rows are mostly waiting. Here one task reads the frame, and grows all trees over arrays:
the same loss, impurity, number of bins, samples of rows and of features a node, and a model of Spark's own class.
Rows that fall into the same bins are one row with counts (few features have few such cells,
however many rows there are), and a sample of them is drawn from the binomial distribution.
Where many of all cells occur, the sums of a level's nodes are products of matrices over the whole grid.
Frames of more than ``TASK_CELLS`` values are fitted by Spark's jobs.

Sets of features over the same rows share medians and borders, found once per feature. A set is grown and scored in one task
over codes of three features each, two bytes a row (``grow_wide``), so up to ``WIDE_CELLS`` values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Values of a frame that one task holds, 8 bytes each as they arrive and 1 as bins.
TASK_CELLS = 40_000_000
#: Values of a set of features that one task holds as codes, 2 bytes for three of them.
WIDE_CELLS = 400_000_000
#: Bits of a feature's code, and features that share one.
CODE_BITS, CODED = 5, 3
#: Rows of a cell up to which their count and the sum of their gradients, each under 4, are summed as one number:
#: the counts are multiples of ``COUNT_UNIT``, and what rounding takes from a sum of gradients is under 1/256 at worst.
UNIT_ROWS, COUNT_UNIT = 1 << 14, float(1 << 17)
#: Rows worked on at once while they go down a tree.
BLOCK = 1 << 16
#: Features whose borders are found in one task.
BORDER_FEATURES = 5
#: Combinations of bins up to which equal rows are counted together.
MOST_COMBINATIONS = 1 << 22
#: The whole grid is worked on if at least one in so many of its cells occurs.
GRID_SHARE = 4
NODES = "tree int, node int, feature int, threshold double, prediction double, gain double, count double, sum double, squares double"


def thresholds(x: np.ndarray, bins: int) -> np.ndarray:
    """Up to ``bins - 1`` borders between the values, at their quantiles; all between few distinct values."""
    ordered = np.sort(x[~np.isnan(x)])
    distinct = ordered[np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]])]
    if len(distinct) <= bins:
        return (distinct[1:] + distinct[:-1]) / 2
    low = ordered[np.arange(1, bins) * len(ordered) // bins - 1]
    above = np.searchsorted(distinct, low, "right")
    keep = above < len(distinct)
    return np.unique((low[keep] + distinct[above[keep]]) / 2)


def combined(codes: list[np.ndarray], sizes: list[int], y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bins of the distinct rows, and how many rows of either class each stands for."""
    if np.prod([float(s) for s in sizes]) > min(MOST_COMBINATIONS, 8 * len(y)):
        return codes, y.astype(np.float64), 1.0 - y
    key = np.ravel_multi_index(codes, sizes)
    ones, rows = np.bincount(key, y), np.bincount(key)
    at = np.flatnonzero(rows)
    return [c.astype(np.uint8) for c in np.unravel_index(at, sizes)], ones[at].astype(np.float64), (rows[at] - ones[at]).astype(np.float64)


def sampler(counts: np.ndarray, sample: float, rng: np.random.Generator) -> Callable[[], np.ndarray]:
    """Draws how many of each cell's rows are in a sample. Equal counts are drawn in a row, as each change
    of the count is a new set-up of the distribution."""
    if sample >= 1:
        return lambda: counts
    order = np.argsort(counts, kind="stable")
    ordered, out = counts[order].astype(np.int64), np.empty(len(counts))

    def draw() -> np.ndarray:
        out[order] = rng.binomial(ordered, sample)
        return out

    return draw


def best_split(left_n: np.ndarray, left_g: np.ndarray, count: np.ndarray, total: np.ndarray, square: np.ndarray, allowed: np.ndarray, j: int, gains: np.ndarray, feature: np.ndarray, border: np.ndarray) -> None:
    """Puts the feature ``j`` in where it splits a node better than those before; sums by node and border."""
    right_n, right_g = count[:, None] - left_n, total[:, None] - left_g
    valid = (left_n >= 1) & (right_n >= 1) & allowed[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(valid, left_g**2 / left_n + right_g**2 / right_n - (total**2 / count)[:, None], 0.0)
    best = gain.argmax(1)
    top = gain[np.arange(len(count)), best]
    better = top > np.maximum(gains, 1e-9 * np.maximum(square, 1e-9))
    gains[better], feature[better], border[better] = top[better], j, best[better]


def grow(codes: list[np.ndarray], sizes: list[int], ones: np.ndarray, zeros: np.ndarray, trees: int, depth: int, step: float, sample: float, per_node: int, seed: int) -> list[tuple]:
    """``(tree, node, feature, bin, prediction, gain, count, sum, squares)``; nodes are numbered as in a
    heap from 1, a leaf has the feature -1."""
    rng, wide = np.random.default_rng(seed), max(sizes)
    n, out = len(ones), []
    f, buffer = np.zeros(n), np.empty(n, np.int64)
    draw_1, draw_0 = sampler(ones, sample, rng), sampler(zeros, sample, rng)
    for tree in range(trees):
        m1, m0 = draw_1(), draw_0()
        m = m1 + m0
        if tree:
            p = 1 / (1 + np.exp(-2 * f))
            g, squares = 4 * (m1 - m * p), 16 * (m1 * (1 - p) ** 2 + m0 * p * p)
        else:
            g, squares = m1 - m0, m
        node, done = np.zeros(n, np.int64), np.zeros(1 << (depth + 1), bool)
        value = np.zeros(1 << (depth + 1))
        for level in range(depth + 1):
            first = 1 << level
            count, total, square = (np.bincount(node, v, first) for v in (m, g, squares))
            mean = np.divide(total, count, out=np.zeros(first), where=count > 0)
            live = [k for k in range(first) if not done[first + k]]
            gains, feature, border = np.zeros(first), np.full(first, -1), np.zeros(first, np.int64)
            if level < depth and live:
                allowed = np.zeros((first, len(codes)), bool)
                for k in live:
                    allowed[k, rng.permutation(len(codes))[:per_node]] = True
                base = node * wide
                for j, code in enumerate(codes):
                    if sizes[j] < 2 or not allowed[:, j].any():
                        continue
                    np.add(base, code, out=buffer)
                    left_n = np.bincount(buffer, m, first * wide).reshape(first, wide).cumsum(1)[:, : sizes[j] - 1]
                    left_g = np.bincount(buffer, g, first * wide).reshape(first, wide).cumsum(1)[:, : sizes[j] - 1]
                    best_split(left_n, left_g, count, total, square, allowed[:, j], j, gains, feature, border)
            for k in live:
                at = first + k
                out.append((tree, at, int(feature[k]), int(border[k]), float(mean[k]), float(gains[k] / count[k]) if count[k] else 0.0, float(count[k]), float(total[k]), float(square[k])))
                value[at] = mean[k]
                if feature[k] < 0:
                    done[at] = True
            if level == depth:
                break
            right = np.zeros(n, np.int64)
            for k in live:
                if feature[k] >= 0:
                    rows = np.flatnonzero(node == k) if first > 1 else slice(None)
                    right[rows] = codes[feature[k]][rows] > border[k]
            for k in range(first):  # below a leaf all rows go on to the left and keep its value
                if done[first + k]:
                    done[2 * (first + k)] = done[2 * (first + k) + 1] = True
                    value[2 * (first + k)] = value[first + k]
            node = 2 * node + right
        f += (step if tree else 1.0) * value[(1 << depth) + node]
    return out


def grow_grid(codes: list[np.ndarray], sizes: list[int], ones: np.ndarray, zeros: np.ndarray, trees: int, depth: int, step: float, sample: float, per_node: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """What ``grow`` gives, and the margin of every cell of the grid, from distinct cells.

    A node is a box of the grid. The grid is a matrix, its rows the combinations of the first half of the
    features and its columns those of the others, so the sums of all nodes of a level by the bins
    of one half are that matrix times the nodes' sides in the other half."""
    rng, out, half = np.random.default_rng(seed), [], (len(sizes) + 1) // 2
    parts = ((0, half), (half, len(sizes)))
    shape = tuple(int(np.prod(sizes[a:b])) for a, b in parts)
    at = np.ravel_multi_index(codes, sizes)
    f, sums = np.zeros(shape), np.zeros((3, *shape))
    margins, flat = f.reshape(-1), sums.reshape(3, -1)
    draw_1, draw_0 = sampler(ones, sample, rng), sampler(zeros, sample, rng)

    def sides(boxes: list[np.ndarray]) -> list[np.ndarray]:
        """For either half a matrix, 1 where a combination is in a node's box."""
        both = []
        for a, b in parts:
            inside = np.ones((1, len(boxes)))
            for j in range(a, b):
                bins = np.arange(sizes[j])[:, None]
                own = (bins >= [box[j, 0] for box in boxes]) & (bins <= [box[j, 1] for box in boxes])
                inside = (inside[:, None] * own[None]).reshape(-1, len(boxes))
            both.append(inside)
        return both

    for tree in range(trees):
        m1, m0 = draw_1(), draw_0()
        flat[0, at] = m1 + m0
        if tree:
            p = 1 / (1 + np.exp(-2 * margins[at]))
            flat[1, at] = 4 * (m1 - (m1 + m0) * p)
            flat[2, at] = 16 * (m1 * (1 - p) ** 2 + m0 * p * p)
        else:
            flat[1, at], flat[2, at] = m1 - m0, m1 + m0
        nodes, boxes = [1], [np.array([[0, s - 1] for s in sizes])]
        leaves, values = [], []
        for level in range(depth + 1):
            k = len(nodes)
            left, right = sides(boxes)
            by_left = (sums.reshape(-1, shape[1]) @ right).reshape(3, shape[0], k) * left
            count, total, square = by_left.sum(1)
            mean = np.divide(total, count, out=np.zeros(k), where=count > 0)
            gains, feature, border = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
            if level < depth:
                allowed = np.zeros((k, len(sizes)), bool)
                for i in range(k):
                    allowed[i, rng.permutation(len(sizes))[:per_node]] = True
                by_right = np.stack([sums[i].T @ left for i in (0, 1)]) * right
                for (a, b), cells in zip(parts, (by_left[:2], by_right)):
                    cells = cells.reshape(2, *sizes[a:b], k)
                    for j in range(a, b):
                        if sizes[j] < 2 or not allowed[:, j].any():
                            continue
                        bins = cells.sum(tuple(1 + i - a for i in range(a, b) if i != j))
                        left_n, left_g = bins.cumsum(1)[:, :-1].transpose(0, 2, 1)
                        best_split(left_n, left_g, count, total, square, allowed[:, j], j, gains, feature, border)
            for i, node in enumerate(nodes):
                out.append((tree, node, int(feature[i]), int(border[i]), float(mean[i]), float(gains[i] / count[i]) if count[i] else 0.0, float(count[i]), float(total[i]), float(square[i])))
            below = []
            for i, (node, box) in enumerate(zip(nodes, boxes)):
                if feature[i] < 0:
                    leaves.append(box)
                    values.append(mean[i])
                    continue
                low, high = box.copy(), box.copy()
                low[feature[i], 1], high[feature[i], 0] = border[i], border[i] + 1
                below += [(2 * node, low), (2 * node + 1, high)]
            if not below:
                break
            nodes, boxes = [x for x, _ in below], [x for _, x in below]
        left, right = sides(leaves)
        f += (left * (np.array(values) * (step if tree else 1.0))) @ right.T
    return out, margins


def grow_wide(codes: np.ndarray, width: int, y: np.ndarray, trees: int, depth: int, step: float, sample: float, per_node: int, seed: int) -> np.ndarray:
    """Margins of all rows by trees grown on the first ``len(y)`` of them, each row by itself.

    ``codes``: bins of ``CODED`` features each, by row. Sums run over the cells of a code, so once for its features, and over the
    smaller child of a node; the other child's are its parent's less those."""
    rng, (many, every), n = np.random.default_rng(seed), codes.shape, len(y)
    bins, cells = 1 << CODE_BITS, 1 << CODE_BITS * CODED
    packed = [np.bincount(c[:n]).max() < UNIT_ROWS for c in codes]
    short, long = np.empty(n, np.uint16), np.empty(n, np.int64)
    f = np.zeros(every)

    def sums(rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Count and sum of gradients of the rows, by feature and bin."""
        out, own = np.empty((2, many * CODED, bins)), g[rows]
        both = own + COUNT_UNIT
        for k in range(many):
            np.take(codes[k], rows, out=short[: len(rows)], mode="clip")
            at = long[: len(rows)]
            at[:] = short[: len(rows)]
            if packed[k]:
                total = np.bincount(at, both, cells)
                count = np.rint(total / COUNT_UNIT)
                total -= count * COUNT_UNIT
            else:
                count, total = np.bincount(at, minlength=cells), np.bincount(at, own, cells)
            for i, x in enumerate((count, total)):
                first = x.reshape(-1, bins).sum(1).reshape(bins, bins)
                out[i, CODED * k], out[i, CODED * k + 1], out[i, CODED * k + 2] = first.sum(1), first.sum(0), x.reshape(-1, bins).sum(0)
        return out[:, :width]

    def move(splits: list[tuple[int, int, int]]) -> None:
        """Rows of the nodes that are split go to their children; all else stays."""
        for a in range(0, every, BLOCK):
            own = node[a : a + BLOCK]
            new = own.copy()
            for at, j, border in splits:
                shift = CODE_BITS * (CODED - 1 - j % CODED)
                right = (codes[j // CODED, a : a + BLOCK] & np.uint16(bins - 1 << shift)) > np.uint16(border << shift)
                here = own == at
                right &= here
                new += here.view(np.uint8) * node.dtype.type(at)
                new += right.view(np.uint8)
            own[:] = new

    for tree in range(trees):
        g = 4 * (y - 1 / (1 + np.exp(-2 * f[:n]))) if tree else 2.0 * y - 1
        kept = rng.random(n, dtype=np.float32) < sample if sample < 1 else np.ones(n, bool)
        node, value = np.ones(every, np.uint8 if depth < 7 else np.uint16), np.zeros(2 << depth)
        hist = sums(np.flatnonzero(kept), g)
        level = [(1, hist[0, 0].sum(), hist[1, 0].sum(), hist)]
        for deep in range(depth + 1):
            splits, below = [], []
            for at, count, total, hist in level:
                value[at] = total / count * (step if tree else 1.0) if count else 0.0
                if hist is None:
                    continue
                allowed = np.zeros(width, bool)
                allowed[rng.permutation(width)[:per_node]] = True
                left_n, left_g = hist.cumsum(2)
                right_n, right_g = count - left_n, total - left_g
                valid = (left_n >= 1) & (right_n >= 1) & allowed[:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(valid, left_g**2 / left_n + right_g**2 / right_n - total**2 / count, 0.0)
                j, border = divmod(int(gains.argmax()), bins)
                if gains[j, border] <= 1e-9 * max(count, 1e-9):
                    continue
                splits.append((at, j, border))
                below += [[2 * at, left_n[j, border], left_g[j, border], None], [2 * at + 1, right_n[j, border], right_g[j, border], hist]]
            if splits:
                move(splits)
            for low, high in zip(below[::2], below[1::2]) if deep < depth - 1 else ():
                small, large = (low, high) if low[1] <= high[1] else (high, low)
                whole, small[3] = high[3], sums(np.flatnonzero((node[:n] == small[0]) & kept), g)
                large[3] = whole - small[3]
            level = below if deep < depth - 1 else [[*x[:3], None] for x in below]
        for a in range(0, every, BLOCK):
            f[a : a + BLOCK] += value[node[a : a + BLOCK]]
    return f


def margins_of(nodes: list[tuple], codes: list[np.ndarray], trees: int, depth: int, step: float) -> np.ndarray:
    """Sum of the trees' predictions for rows given by their bins."""
    feature, border, value = (np.zeros((trees, 2 << depth), t) for t in (np.int64, np.int64, np.float64))
    feature[:] = -1
    for t, at, j, k, mean, *_ in nodes:
        feature[t, at], border[t, at], value[t, at] = j, k, mean
    n = len(codes[0])
    table, rows, out = np.stack(codes), np.arange(n), np.zeros(n)
    for t in range(trees):
        node = np.ones(n, np.int64)
        for _ in range(depth):
            j = feature[t, node]
            node = np.where(j < 0, node, 2 * node + (table[j, rows] > border[t, node]))
        out += (step if t else 1.0) * value[t, node]
    return out


class Grown:
    """Trees over columns of values, each given whole; ``nodes`` as of ``grow``."""

    def __init__(self, columns: Iterator[np.ndarray], y: np.ndarray, bins: int, trees: int, depth: int, step: float, sample: float, per_node: int, seed: int) -> None:
        self.borders, codes, self.depth, self.trees, self.step, self.grid = [], [], depth, trees, step, None
        for column in columns:
            self.borders.append(thresholds(column, bins))
            codes.append(np.searchsorted(self.borders[-1], column).astype(np.uint8))
        self.sizes = [len(b) + 1 for b in self.borders]
        codes, ones, zeros = combined(codes, self.sizes, y)
        args = (codes, self.sizes, ones, zeros, trees, depth, step, sample, per_node, seed)
        whole = np.prod([float(s) for s in self.sizes])
        if len(y) != len(ones) and whole <= GRID_SHARE * len(ones):
            self.nodes, self.grid = grow_grid(*args)
        else:
            self.nodes = grow(*args)

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        codes = [np.searchsorted(b, c) for b, c in zip(self.borders, columns)]
        margins = margins_of(self.nodes, codes, self.trees, self.depth, self.step) if self.grid is None else self.grid[np.ravel_multi_index(codes, self.sizes)]
        return 1 / (1 + np.exp(-2 * margins))


def _fit_task(width: int, *how) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, labels = [], []
        for b in batches:
            parts.append(b["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            labels.append(b["y"].to_numpy(zero_copy_only=False))
        if not parts:
            return
        grown = Grown((np.concatenate([p[:, j] for p in parts]) for j in range(width)), np.concatenate(labels), *how)
        columns = list(zip(*grown.nodes))
        cut = [float(grown.borders[j][k]) if j >= 0 else 0.0 for j, k in zip(columns[2], columns[3])]
        ints = [pa.array(c, pa.int32()) for c in columns[:3]]
        yield pa.RecordBatch.from_arrays([*ints, pa.array(cut), *[pa.array(c, pa.float64()) for c in columns[4:]]], names=[c.split()[0] for c in NODES.split(", ")])

    return run


def _forward_task(year: int, features: list[str], kept: list[str], how: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, test, labels = [[] for _ in features], [], []
        for b in batches:
            before = b["_year"].to_numpy(zero_copy_only=False) < year
            for part, f in zip(train, features):
                part.append(b[f].to_numpy(zero_copy_only=False)[before])
            labels.append(b["_y"].to_numpy(zero_copy_only=False)[before])
            if not before.all():
                test.append(b.select([*kept, *features]).filter(pa.array(~before)))
        if not test:
            return
        medians = []

        def filled() -> Iterator[np.ndarray]:
            for j, f in enumerate(features):
                column, train[j] = np.concatenate(train[j]), None
                known = column[~np.isnan(column)]
                if not len(known):
                    raise ValueError(f"no value of {f} is known before {year}")
                medians.append(np.partition(known, (len(known) - 1) // 2)[(len(known) - 1) // 2])
                yield np.where(np.isnan(column), medians[j], column)

        grown = Grown(filled(), np.concatenate(labels), *how)
        for b in test:
            columns = [b[f].to_numpy(zero_copy_only=False) for f in features]
            p = grown.probabilities([np.where(np.isnan(c), m, c) for c, m in zip(columns, medians)])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in kept], pa.array(p), pa.array(np.full(len(p), year), pa.int32())], names=[*kept, "p", "test_year"])

    return run


def forward_scores(df: DataFrame, year: str, years: Sequence[int], features: Sequence[str], trees: Sequence[BoostedTrees], kept: Sequence[str]) -> list[DataFrame] | None:
    """``*kept, p, test_year`` of each of the years: its rows with their probability by trees grown on the years before,
    in one task a year; gaps are filled with the training rows' medians.

    None where a year's trees can't be grown in a task: rows beyond ``TASK_CELLS``, none before, or other labels than 0 and 1."""
    label = trees[0].getLabelCol()
    y = F.col(label).cast("double")
    counts = df.groupBy(F.col(year).alias("year")).agg(F.count("*").alias("n"), F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("odd")).filter("year is not null").collect()  # a row per year
    out, missing = [], F.lit(float("nan"))
    for at, model in zip(years, trees):
        before = [r for r in counts if r["year"] < at]
        rows = sum(r["n"] for r in before)
        if not rows or any(r["odd"] for r in before) or rows * len(features) > TASK_CELLS:
            return None
        values = [F.coalesce(F.col(f).cast("double"), missing).alias(f"_f{i}") for i, f in enumerate(features)]
        part = df.filter(F.col(year) <= at).select(F.col(year).cast("int").alias("_year"), y.alias("_y"), *kept, *values)
        schema = f"{', '.join(f'`{c}` {df.schema[c].dataType.simpleString()}' for c in kept)}, p double, test_year int"
        run = _forward_task(at, [f"_f{i}" for i in range(len(features))], list(kept), model.how(len(features)))
        out.append(part.coalesce(1).mapInArrow(run, schema))
    return out


def _borders_task(features: list[str], bins: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[] for _ in features]
        for b in batches:
            for part, f in zip(parts, features):
                part.append(b[f].to_numpy(zero_copy_only=False))
        for j, f in enumerate(features):
            column, parts[j] = np.concatenate([np.zeros(0), *parts[j]]), None
            known = column[~np.isnan(column)]
            if not len(known):
                raise ValueError(f"no value of {f} is known in training")
            middle = np.partition(known, (len(known) - 1) // 2)[(len(known) - 1) // 2]
            borders = thresholds(np.where(np.isnan(column), middle, column), bins)
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([float(middle)]), pa.array([borders.tolist()], pa.list_(pa.float64()))], names=["feature", "middle", "borders"])

    return run


def _set_task(features: list[str], known: dict, train: int, test: int, how: tuple) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y = np.zeros((-(-len(features) // CODED), train + test), np.uint16), np.empty(train)
        done, tests, labels = 0, train, []
        for b in batches:
            own = b["_train"].to_numpy(zero_copy_only=False)
            a, z = int(own.sum()), int((~own).sum())
            for j, f in enumerate(features):
                column, (middle, borders) = b[f].to_numpy(zero_copy_only=False), known[f]
                code = np.searchsorted(borders, np.where(np.isnan(column), middle, column)).astype(np.uint16) << CODE_BITS * (CODED - 1 - j % CODED)
                codes[j // CODED, done : done + a] |= code[own]
                codes[j // CODED, tests : tests + z] |= code[~own]
            y[done : done + a] = b["_y"].to_numpy(zero_copy_only=False)[own]
            labels.append(b["_y"].filter(pa.array(~own)))
            done, tests = done + a, tests + z
        if done != train or tests != train + test:
            raise ValueError(f"{done} and {tests - train} rows were read, {train} and {test} counted")
        p = 1 / (1 + np.exp(-2 * grow_wide(codes, len(features), y, *how)[train:]))
        at = 0
        for label in labels:
            yield pa.RecordBatch.from_arrays([label, pa.array(p[at : at + len(label)])], names=["target", "p"])
            at += len(label)

    return run


def set_scores(train: DataFrame, test: DataFrame, sets: dict[str, Sequence[str]], trees: dict[str, BoostedTrees]) -> dict[str, DataFrame] | None:
    """``target, p`` of the test rows for each set of features, by its trees grown on the training rows in one task;
    gaps are filled with the training rows' medians.

    None where that isn't possible: values beyond ``WIDE_CELLS``, more bins than a code has, no training rows, or other labels than 0 and 1."""
    models = list(trees.values())
    y, bins = F.col(models[0].getLabelCol()).cast("double"), models[0].getMaxBins()
    sizes = train.agg(F.count("*").alias("n"), F.count_if(y.isNull() | ~y.isin(0.0, 1.0)).alias("odd")).first()
    rows, tests = sizes["n"], test.count()
    if not rows or sizes["odd"] or (rows + tests) * max(map(len, sets.values())) > WIDE_CELLS or bins > 1 << CODE_BITS or any(m.getMaxBins() != bins for m in models):
        return None
    features = list(dict.fromkeys(f for s in sets.values() for f in s))
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f)
    parts = []
    for k in range(0, len(features), BORDER_FEATURES):
        some = features[k : k + BORDER_FEATURES]
        parts.append(train.select(*map(value, some)).coalesce(1).mapInArrow(_borders_task(some, bins), "feature string, middle double, borders array<double>"))
    with ThreadPool(len(parts)) as pool:  # a job each, since a union of frames of one partition is one task
        found = pool.map(inheritable_thread_target(train.sparkSession)(lambda part: part.collect()), parts)  # a row per feature
    known = {r["feature"]: (r["middle"], np.array(r["borders"])) for part in found for r in part}
    out = {}
    for name, own in sets.items():
        of = lambda df, first: df.select(F.lit(first).alias("_train"), y.alias("_y"), *map(value, own))
        run = _set_task(list(own), {f: known[f] for f in own}, rows, tests, trees[name].how(len(own))[1:])
        out[name] = of(train, True).unionByName(of(test, False)).coalesce(1).mapInArrow(run, "target double, p double")
    return out


def spark_model(spark: SparkSession, uid: str, nodes: list, width: int, step: float) -> GBTClassificationModel:
    """A model of Spark's own from the rows of ``NODES``, in order of tree and node."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    tree = jvm.org.apache.spark.ml.tree
    # Each name that is looked up in the JVM is a call, so all are looked up once.
    leaf, internal, split_at, part = tree.LeafNode, tree.InternalNode, tree.ContinuousSplit, jvm.java.util.Arrays.copyOfRange
    variance = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    flat = jvm.org.apache.spark.mllib.linalg.Vectors.parse("[" + ",".join(repr(v) for r in nodes for v in (r["count"], r["sum"], r["squares"])) + "]").toArray()
    by: dict[tuple[int, int], tuple] = {(r["tree"], r["node"]): (i, r) for i, r in enumerate(nodes)}

    def build(t: int, at: int):
        i, r = by[t, at]
        stats = variance(part(flat, 3 * i, 3 * i + 3), int(r["count"]))
        impurity = max(0.0, r["squares"] / r["count"] - (r["sum"] / r["count"]) ** 2) if r["count"] else 0.0
        if r["feature"] < 0:
            return leaf(r["prediction"], impurity, stats)
        split = split_at(r["feature"], r["threshold"])
        return internal(r["prediction"], impurity, r["gain"], build(t, 2 * at), build(t, 2 * at + 1), split, stats)

    count = max(t for t, _ in by) + 1
    regression = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    trees, weights = gateway.new_array(regression, count), gateway.new_array(jvm.double, count)
    for t in range(count):
        trees[t], weights[t] = regression(f"{uid}_tree_{t}", build(t, 1), width), step if t else 1.0
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid, trees, weights, width, 2))


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` for whole features, in one task up to ``TASK_CELLS`` values."""

    def how(self, width: int) -> tuple:
        """The settings as ``Grown`` takes them, for rows of so many features."""
        per_node = max(1, int(np.ceil(float(self.getFeatureSubsetStrategy()) * width)))
        return self.getMaxBins(), self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.getSubsamplingRate(), per_node, self.getSeed()

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.count_if(F.expr("y is null or y not in (0, 1)")).alias("odd")).first()
        if not size["n"] or size["odd"] or size["n"] * size["width"] > TASK_CELLS:
            return super()._fit(dataset)
        width = size["width"]
        nodes = rows.coalesce(1).mapInArrow(_fit_task(width, *self.how(width)), NODES).collect()  # a row per node of a tree
        model = spark_model(dataset.sparkSession, self.uid, nodes, width, self.getStepSize())
        return self._copyValues(model)
