"""Gradient boosting for a yes-or-no label over binned features, with missing values of their own.

Each feature is cut at exact quantiles into at most 255 bins; missing values have
one more, and each split learns to which side they go. A tree grows level by
level. For a level, a task sums gradient, hessian and rows by (node, feature, bin)
over its rows, the tasks' sums are added up, and the driver, which gets at most
16 × features × 256 cells a task, chooses the splits. Only the smaller child of a split is
summed; the other one is the parent less that. Rows are blocks of arrays, a line for each feature, in an RDD, and
their scores are another one beside it: a level is one short job without a plan or a shuffle, and the scores after a
tree, which are all that is written for it, are kept by the job that sums the next tree's root, so no tree is applied
twice. A tree is walked by comparing whole lines of bins, a byte for each row, and never row by row.

Gradients are whole multiples of 2⁻²⁴, so sums are exact: the trees do not depend
on how the rows are dealt to tasks or on the order in which sums arrive.
Growth ends when the loss of held-out rows, which comes with the next tree's
first level, has not fallen for ``PATIENCE`` trees.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplypanel.model.preparation import FEATURES, feature_histogram
from supplypanel.operators.order_statistics import running_totals
from supplypanel.sources.tables import settled

BINS = 255
MISSING = BINS  # the bin of missing values
FRACTION_BITS = 24
LEAST_HESSIAN = 1e-3
PATIENCE, TOLERANCE = 10, 1e-7
#: Trees after which the rows' scores are written to the shared folder, so that lineage stays short.
WRITTEN_TREES = 25
#: Rows that are worth a task of their own, and tasks of which the driver adds the sums up itself.
PART_ROWS, SENDING_TASKS = 20_000, 16
#: Rows of a block, and of one sum of doubles, at most: a hessian is no more than 2²² of its units, so a sum of them
#: stays below ``COUNT_BITS`` bits, and a double holds it and the count above it without rounding.
BLOCK_ROWS, COUNT_BITS = (1 << 15) - 1, 37


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order (children of i at 2i + 1, 2i + 2): feature (-1 for a leaf), last bin to the left, side of missing values, value."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray


@dataclass(frozen=True)
class Boosted:
    """Cut points of each feature, the first raw score, and the trees; losses of held-out rows before each tree."""

    features: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    losses: list[float]

    def log_odds(self) -> Column:
        """The raw score of a row that has the features as columns."""
        locate, _, gained = _walkers()
        features, cuts, base = self.features, self.cuts, self.base

        @F.pandas_udf("double")
        def raw(*columns: pd.Series) -> pd.Series:
            bins = locate([c.to_numpy(float, na_value=np.nan) for c in columns], cuts)
            total = np.full(bins.shape[1], base)
            for tree in trees:
                total += gained(bins, *tree)
            return pd.Series(total)

        trees = [_plain(t) for t in self.trees]
        return raw(*[F.col(c).cast("double") for c in features])


def _plain(tree: Tree) -> tuple[list[tuple], np.ndarray]:
    """Splits in heap order (node, feature, last bin to the left, side of missing values), and the nodes' values."""
    splits = [
        (int(n), int(tree.feature[n]), int(tree.cut[n]), bool(tree.missing_left[n]))
        for n in np.flatnonzero(tree.feature >= 0)
    ]
    return splits, tree.value


def _walkers():
    """What tasks run, as closures over plain arrays, so that workers need no copy of this package."""
    missing = MISSING

    def locate(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
        """The bin of each value, a line for each feature: how many cut points lie below it."""
        out = np.empty((len(columns), len(columns[0])), np.uint8)
        for f, (values, edges) in enumerate(zip(columns, cuts)):
            out[f] = np.where(np.isnan(values), missing, np.searchsorted(edges, values))
        return out

    def reach(bins: np.ndarray, splits: list[tuple]) -> dict[int, np.ndarray]:
        """For each leaf a mark on the rows that come to it."""
        inside = {0: np.ones(bins.shape[1], bool)}
        for node, feature, cut, missing_left in splits:
            here, at = inside.pop(node), bins[feature]
            left = at <= cut
            if missing_left:
                left |= at == missing
            left &= here
            inside[2 * node + 1], inside[2 * node + 2] = left, here ^ left
        return inside

    def gained(bins: np.ndarray, splits: list[tuple], value: np.ndarray) -> np.ndarray:
        """What a tree adds to the score of each row."""
        leaves = reach(bins, splits)
        kind = np.uint8 if len(leaves) <= 256 else np.uint16
        place = np.zeros(bins.shape[1], kind)
        for i, marked in enumerate(leaves.values()):
            place |= marked.view(np.uint8) * kind(i)
        return value[list(leaves)].take(place)

    return locate, reach, gained


def cut_points(rows: DataFrame, features: list[str], histogram: DataFrame | None = None) -> list[np.ndarray]:
    """For each feature the upper ends of all bins but the last: the values themselves if there are few, else exact quantiles.

    ``histogram`` is that of the rows, by whatever keys, where it is known.
    """
    if histogram is None:
        histogram = feature_histogram(rows, features=features)
    else:
        histogram = histogram.where(F.col("feature").isin(*features)).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    histogram = settled(histogram.where("value is not null and not isnan(value)"))
    counts = {r.feature: r.distinct for r in histogram.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct")).collect()}
    few = [f for f in features if 0 < counts.get(f, 0) <= BINS]
    many = [f for f in features if counts.get(f, 0) > BINS]
    found: dict[str, list[float]] = {f: [] for f in features}
    # At most BINS rows for each feature in both cases.
    if few:
        for r in histogram.where(F.col("feature").isin(*few)).select("feature", "value").collect():
            found[r.feature].append(r.value)
    if many:
        ranked = running_totals(histogram.where(F.col("feature").isin(*many)), ["feature"], "value", ["n"], few_groups=True)
        place = F.expr(f"(before_n * {BINS}) div total_n")
        for r in ranked.groupBy("feature", place.alias("place")).agg(F.max("value").alias("value")).collect():
            found[r.feature].append(r.value)
    return [np.array(sorted(found[f])[:-1], float) for f in features]


def _binned(rows: DataFrame, features: list[str], cuts: list[np.ndarray], label: Column, held_out: Column) -> DataFrame:
    """A row for each block of rows, those to learn from first: how many these are, bins (a byte for each feature, feature by feature) and label of all."""
    locate, _, _ = _walkers()
    block_rows = BLOCK_ROWS

    def block(parts: list[tuple]) -> pa.RecordBatch:
        bins, label, held = (np.concatenate(x, axis=-1) for x in zip(*parts))
        order = np.argsort(held, kind="stable")
        return pa.RecordBatch.from_arrays(
            [pa.array([int((~held).sum())]), pa.array([bins[:, order].tobytes()], pa.binary()),
             pa.array([label[order].astype(float).tobytes()], pa.binary())], names=["own", "bins", "label"])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, room = [], block_rows
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))]
            label, held = (batch.column(len(features) + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bins, held, start = locate(columns, cuts), np.array(held, bool), 0
            while start < len(held):
                part = slice(start, start + room)
                parts.append((bins[:, part], label[part], held[part]))
                room -= len(held[part])
                start = part.stop
                if not room:
                    yield block(parts)
                    parts, room = [], block_rows
        if parts:
            yield block(parts)

    values = [F.col(c).cast("double").alias(c) for c in features]
    return rows.select(*values, label.cast("double").alias("_label"), held_out.alias("_held_out")).mapInArrow(
        binned, "own long, bins binary, label binary")


def _one_by_one(blocks: RDD) -> RDD:
    """The blocks sent singly, so that two such RDDs can be put side by side block by block."""
    return blocks._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _first_blocks(table: DataFrame, parts: int, n_features: int) -> RDD:
    """The blocks as arrays, dealt evenly: rows to learn from, bins and label."""

    def opened(row) -> tuple:
        label = np.frombuffer(row.label).astype(np.uint8)
        return int(row.own), np.frombuffer(row.bins, np.uint8).reshape(n_features, -1), label

    return _one_by_one(table.repartition(parts).rdd.map(opened))


def _state(blocks: RDD, scores: RDD) -> RDD:
    """The blocks with their scores so far."""
    return blocks.zip(scores).map(lambda pair: (*pair[0], pair[1]))


def _sparer():
    """What keeps a worker from searching all that it has imported for garbage after each short task, as a closure."""

    def spare() -> None:
        if not gc.get_freeze_count():
            gc.freeze()

    return spare


def _scored(state: RDD, tree: Tree) -> RDD:
    """The blocks' scores with one more tree in them."""
    _, _, gained = _walkers()
    grown, spare = _plain(tree), _sparer()

    def scored(block: tuple) -> np.ndarray:
        spare()
        _, bins, _, score = block
        return score + gained(bins, *grown)

    return _one_by_one(state.map(scored))


def _narrow():
    """What makes a task's sums small to send, as a closure: whole numbers in the fewest bytes that hold them all."""

    def narrow(numbers: np.ndarray) -> np.ndarray:
        most = int(np.abs(numbers).max(initial=0))
        return numbers.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)

    return narrow


def _level_sums(state: RDD, n_features: int, tree: Tree | None, nodes: list[int]) -> tuple[np.ndarray, float, int]:
    """Gradient, hessian and rows of each (node, feature, bin), and the loss and number of the held-out rows."""
    _, reach, _ = _walkers()
    splits = _plain(tree)[0] if tree else None
    one, width, count_bits, most = float(1 << FRACTION_BITS), BINS + 1, COUNT_BITS, BLOCK_ROWS
    cells, narrow, spare = len(nodes) * width, _narrow(), _sparer()

    def summed(blocks: Iterator[tuple]) -> Iterator[tuple]:
        spare()
        totals, loss_sum, held_rows = np.zeros((3, n_features, cells), np.int64), 0, 0
        kind = np.uint8 if len(nodes) < 256 else np.uint16
        waiting, rows = [], 0

        def add_up() -> None:
            if not waiting:
                return
            first, bins, label, score = (
                x[0] if len(waiting) == 1 else np.concatenate(x, axis=-1) for x in zip(*waiting))
            p = 1.0 / (1.0 + np.exp(-score))
            both = np.empty(len(p), complex)  # one look-up of a cell adds to two sums
            both.real = np.rint((p - label) * one)
            both.imag = np.rint(p * (1 - p) * one) + float(1 << count_bits)  # the hessian, and a one above it
            found = np.zeros((n_features, cells), complex)
            for f in range(n_features):
                np.add.at(found[f], first + bins[f], both)
            totals[0] += found.real.astype(np.int64)
            counted = found.imag.astype(np.int64)
            totals[1] += counted & ((1 << count_bits) - 1)
            totals[2] += counted >> count_bits
            waiting.clear()

        for own, bins, label, score in blocks:
            if splits is None and own < len(label):
                loss = np.logaddexp(0.0, score[own:]) - label[own:] * score[own:]
                loss_sum += int(np.rint(loss * one).sum())
                held_rows += len(loss)
            bins, label, score = bins[:, :own], label[:own], score[:own]
            first = np.zeros(own, np.intp)
            if splits is not None:
                leaves, slot = reach(bins, splits), np.zeros(own, kind)
                for i, n in enumerate(nodes, 1):
                    slot |= leaves[n].view(np.uint8) * kind(i)
                inside = np.flatnonzero(slot)
                bins, label, score = bins.take(inside, axis=1), label.take(inside), score.take(inside)
                first = (slot.take(inside).astype(np.intp) - 1) * width
            # Rows of several blocks are summed at once, as long as a double holds their hessians and count.
            if rows + len(label) > most:
                add_up()
                rows = 0
            if len(label):
                waiting.append((first, bins, label, score))
                rows += len(label)
        add_up()
        yield [narrow(t) for t in totals], loss_sum, held_rows

    def added(a: tuple, b: tuple) -> tuple:
        return [np.add(x, y, dtype=np.int64) for x, y in zip(a[0], b[0])], a[1] + b[1], a[2] + b[2]

    parts = state.mapPartitions(summed)
    # A few tasks send their sums to the driver, many add them up among themselves first.
    few = state.getNumPartitions() <= SENDING_TASKS
    totals, loss, held = parts.reduce(added) if few else parts.treeReduce(added)
    totals = np.stack(totals).astype(np.int64).reshape(3, n_features, len(nodes), width)
    return totals.transpose(0, 2, 1, 3), loss / one, held


def best_splits(sums: np.ndarray, least_rows: int) -> list[tuple | None]:
    """For each node the split of largest gain: gain, feature, last bin to the left, missing to the left, left (g, h, n).

    ``sums`` is (3, nodes, features, bins + 1) in whole numbers. Ties go to the
    earlier feature, then to missing values on the right, then to the lower cut.
    """
    one = float(1 << FRACTION_BITS)
    known, gone = np.cumsum(sums[..., :BINS], axis=-1)[..., :-1], sums[..., BINS:]
    whole = sums.sum(axis=-1)[..., None]

    def value(part: np.ndarray) -> np.ndarray:
        return (part[0] / one) ** 2 / (part[1] / one)

    def gains(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = value(left) + value(right) - value(whole)
        allowed = (left[2] >= least_rows) & (right[2] >= least_rows)
        allowed &= (left[1] >= LEAST_HESSIAN * one) & (right[1] >= LEAST_HESSIAN * one)
        return np.where(allowed & (gain > 1e-9), gain, -np.inf)

    # (nodes, features, missing side, cut); without missing values the two sides are one split.
    gain = np.full((*known.shape[1:3], 2, known.shape[3]), -np.inf)
    gain[:, :, 0] = gains(known, whole)
    node, feature = np.nonzero(gone[2, ..., 0])
    gain[node, feature, 1] = gains(known[:, node, feature] + gone[:, node, feature], whole[:, node, feature])
    out: list[tuple | None] = []
    for node in range(gain.shape[0]):
        flat = int(np.argmax(gain[node]))
        feature, side, cut = np.unravel_index(flat, gain[node].shape)
        if gain[node, feature, side, cut] == -np.inf:
            out.append(None)
            continue
        part = known[:, node, feature, cut] + side * gone[:, node, feature, 0]
        if gone[2, node, feature, 0] == 0:  # rows with a missing value that come later go to the larger side
            side = int(part[2] > whole[2, node, feature, 0] - part[2])
        out.append((float(gain[node].max()), int(feature), int(cut), bool(side), part))
    return out


def _grow(state, n_features, first, depth, most_leaves, least_rows, rate) -> Tree | None:
    """One tree from the sums of its root; None if the root cannot be split."""
    size, one = 2 ** (depth + 1) - 1, float(1 << FRACTION_BITS)
    tree = Tree(np.full(size, -1), np.zeros(size, int), np.zeros(size, bool), np.zeros(size))
    sums = {0: first}
    totals = {0: first[:, 0].sum(axis=-1)}
    for level in range(depth):
        nodes = sorted(sums)
        splits = dict(zip(nodes, best_splits(np.stack([sums[n] for n in nodes], axis=1), least_rows)))
        chosen = sorted((n for n in nodes if splits[n]), key=lambda n: (-splits[n][0], n))
        leaves = len(totals) - int((tree.feature >= 0).sum())
        chosen = sorted(chosen[: max(0, most_leaves - leaves)])
        for n in chosen:
            _, tree.feature[n], tree.cut[n], tree.missing_left[n], part = splits[n]
            totals[2 * n + 1], totals[2 * n + 2] = part, totals[n] - part
        if not chosen or level == depth - 1:
            break
        smaller = [min((2 * n + 1, 2 * n + 2), key=lambda c: (totals[c][2], c)) for n in chosen]
        found, _, _ = _level_sums(state, n_features, tree, smaller)
        below = {}
        for i, (n, child) in enumerate(zip(chosen, smaller)):
            other = 4 * n + 3 - child  # the children's numbers add up to this
            below[child] = found[:, i]
            below[other] = sums[n] - found[:, i]
        sums = below
    if tree.feature[0] < 0:
        return None
    for n, (g, h, _) in totals.items():
        tree.value[n] = -rate * (g / one) / (h / one) if h else 0.0
    return tree


def fit_boosted(
    rows: DataFrame, label: Column, held_out: Column, features: list[str] = FEATURES, max_iter: int = 300,
    rate: float = 0.05, depth: int = 5, most_leaves: int = 31, least_rows: int = 20, patience: int = PATIENCE,
    histogram: DataFrame | None = None,
) -> Boosted:
    """Boosted trees of ``rows``; those marked by ``held_out`` only tell when to stop."""
    cuts = cut_points(rows, features, histogram)
    table = settled(_binned(rows, features, cuts, label, held_out))
    # One row for each block.
    found = table.mapInArrow(_block_counts(), "n long, own long, events double").agg(
        *[F.sum(c).alias(c) for c in ("n", "own", "events")]).first()
    if not found.own:
        raise ValueError("no rows to learn from")
    context = rows.sparkSession.sparkContext
    parts = max(1, min(context.defaultParallelism, -(-found.n // PART_ROWS)))
    share = min(max(found.events / found.own, 1e-9), 1 - 1e-9)
    base, trees, losses = float(np.log(share / (1 - share))), [], []
    blocks = _first_blocks(table, parts, len(features)).persist(StorageLevel.MEMORY_AND_DISK_DESER)
    scores, before = _one_by_one(blocks.map(lambda block: np.full(len(block[2]), base))).persist(StorageLevel.MEMORY_AND_DISK_DESER), None
    while True:
        state = _state(blocks, scores)
        # The scores of the last tree are kept by the same job that sums the next one's root.
        first, loss, held = _level_sums(state, len(features), None, [0])
        if before is not None:
            before.unpersist()
        if held:
            losses.append(loss / held)
        stale = len(losses) > patience and min(losses[-patience:]) > losses[-patience - 1] - TOLERANCE
        if stale or len(trees) == max_iter:
            break
        tree = _grow(state, len(features), first[:, 0], depth, most_leaves, least_rows, rate)
        if tree is None:
            break
        trees.append(tree)
        before, scores = scores, _scored(state, tree).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        if len(trees) % WRITTEN_TREES == 0:
            scores.checkpoint()
    scores.unpersist()
    blocks.unpersist()
    return Boosted(list(features), cuts, base, trees, losses)


def _block_counts():
    """Rows, rows to learn from and events among these, of each block."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            labels = [np.frombuffer(v) for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(v) for v in labels], pa.int64()), pa.array(own, pa.int64()),
                 pa.array([float(v[:k].sum()) for v, k in zip(labels, own)], pa.float64())], names=["n", "own", "events"])

    return counted
