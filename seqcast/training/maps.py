"""Linear models trained from sums over their windows.

A step of plain gradient descent on a linear model is an affine map of its
weights, which sums of products over the windows of its mini-batch give. So a
whole round of parameter averaging is the average of its workers' maps, and an
epoch is one map after another: one pass over the blocks adds up the maps of
every round, and all epochs, their losses and early stopping are then small
products of matrices, one model at a time. The weights are those that
:func:`seqcast.training.averaging.fit_averaged` reaches round by round, in one
job instead of epochs times rounds.

The same sums give the least-squares model of a symbol by one solve.

A task adds up the blocks of one model before it hands on its sums, and Spark
adds those with map-side combine; a model's sums are of one size whatever its
windows (its inputs squared, for each round of an epoch).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from seqcast.session import new_table_folder, ship_package
from seqcast.training.averaging import AveragedModel, _arrow_rows, _matrix, _vector, _windows, check_settings, stored_work
from seqcast.training.kernels import LinearKernel

# What a row of sums holds: products of the windows of a round, or of the held-out windows, or a round's map.
PRODUCTS, HELD, MAP = 0, 1, 2
SUMS = "symbol string, kind int, round int, n bigint, v array<double>"
FOUND = "symbol string, epoch int, round int, loss double, train_loss double, test_loss double, state array<double>"


class Sums:
    """Sums over windows: of the products of inputs with inputs and with targets, and of the squares of targets."""

    def __init__(self, inputs: int, outputs: int, values: np.ndarray | None = None, n: int = 0):
        self.inputs, self.outputs, self.n = inputs + 1, outputs, n
        size = self.inputs * (self.inputs + outputs) + outputs
        self.values = np.zeros(size) if values is None else values
        own, cross = self.inputs**2, self.inputs * (self.inputs + outputs)
        self.own = self.values[:own].reshape(self.inputs, self.inputs)
        self.cross = self.values[own:cross].reshape(self.inputs, outputs)
        self.squares = self.values[cross:]

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.own += x.T @ x
        self.cross += x.T @ y
        self.squares += (y**2).sum(axis=0)
        self.n += len(x)

    def loss(self, weights: np.ndarray) -> float:
        """Mean squared error of these weights over the windows."""
        total = np.einsum("io,ij,jo->", weights, self.own, weights, optimize=True) - 2 * (weights * self.cross).sum() + self.squares.sum()
        return float(max(total, 0.0) / (self.n * self.outputs))

    def step(self, kernel: LinearKernel) -> tuple[np.ndarray, np.ndarray]:
        """The map (factor, shift) of one step on all these windows."""
        rate = 2.0 * kernel.learning_rate / (self.n * self.outputs)
        decay = np.full(self.inputs, kernel.learning_rate * kernel.l2)
        decay[-1] = 0.0
        return np.eye(self.inputs) - rate * self.own - np.diag(decay), rate * self.cross


def _scaled_target(unit: pa.Array, k: int, held: bool) -> np.ndarray:
    y = _matrix(unit.field("y")[k])
    if not held:
        return y
    low, high = _vector(unit.field("low")[k]), _vector(unit.field("high")[k])
    return np.where(high > low, (y - low) / np.where(high > low, high - low, 1.0), 0.5)


def _summing(kernel: LinearKernel, length: int, frequency: int | None):
    """The function that gives the sums of a task's units; without a frequency, all windows are one round."""

    def rows(symbol: str, total: dict) -> Iterator[tuple]:
        for (kind, r), sums in sorted(total.items()):
            yield (symbol, kind, r, sums[0], sums[1]) if kind == MAP else (symbol, kind, r, sums.n, sums.values)

    def table(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["symbol", "kind", "round", "n", "v"])

    def block(total: dict, x: np.ndarray, y: np.ndarray, held: bool, size: int) -> None:
        def sums(kind: int, r: int) -> Sums:
            return total.setdefault((kind, r), Sums(kernel.inputs, kernel.outputs))

        if held or frequency is None:
            sums(HELD if held else PRODUCTS, 0).add(x, y)
            return
        stride = frequency * size
        for r, first in enumerate(range(0, len(x), stride)):
            last = min(first + stride, len(x))
            sums(PRODUCTS, r).add(x[first:last], y[first:last])
            if frequency == 1:
                continue  # the average of one-step maps follows from the sums
            factor, shift = np.eye(kernel.inputs + 1), np.zeros((kernel.inputs + 1, kernel.outputs))
            for at in range(first, last, size):
                one = Sums(kernel.inputs, kernel.outputs)
                one.add(x[at : min(at + size, last)], y[at : min(at + size, last)])
                a, c = one.step(kernel)
                factor, shift = a @ factor, a @ shift + c
            n, before = total.get((MAP, r), (0, 0.0))
            total[MAP, r] = n + last - first, before + (last - first) * np.concatenate([factor.ravel(), shift.ravel()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                symbol, held, size = (batch[c][row].as_py() for c in ("symbol", "held", "size"))
                if symbol != now:
                    if total:
                        yield table(list(rows(now, total)))
                    now, total = symbol, {}
                unit = batch["unit"][row].values
                for k in range(len(unit)):
                    m = unit.field("m")[k].as_py()
                    x = _windows(_matrix(unit.field("x")[k]), length, m).reshape(m, -1)
                    y = _scaled_target(unit, k, held)[length : length + m]
                    block(total, np.hstack([x, np.ones((m, 1))]), y, held, size)
        if total:
            yield table(list(rows(now, total)))

    return work


def _sums_of(work, kernel: LinearKernel, frequency: int | None) -> DataFrame:
    """``symbol, kind, round, n, v`` of every model, added up over all its units."""
    parts = work.units.select("symbol", "unit", "held", "size").mapInArrow(_summing(kernel, work.length, frequency), SUMS)
    added = parts.groupBy("symbol", "kind", "round").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    path = new_table_folder(added.sparkSession, "sums")
    with _arrow_rows(added.sparkSession, work.row_bytes):
        added.write.parquet(path)
    return added.sparkSession.read.schema(SUMS).parquet(path)


def _read(group: pa.Table, kernel: LinearKernel) -> dict:
    """The sums and maps of one model by kind and round."""
    found = {}
    for kind, r, n, v in zip(*(group.column(c) for c in ("kind", "round", "n", "v")), strict=True):
        values = v.values.to_numpy(zero_copy_only=False)
        key = kind.as_py(), r.as_py()
        found[key] = (n.as_py(), values) if key[0] == MAP else Sums(kernel.inputs, kernel.outputs, values.copy(), n.as_py())
    return found


def _total(found: dict, kernel: LinearKernel, kind: int) -> Sums | None:
    """The sums of all rounds."""
    parts = [sums for (k, _), sums in sorted(found.items()) if k == kind]
    return Sums(kernel.inputs, kernel.outputs, sum(p.values for p in parts), sum(p.n for p in parts)) if parts else None


def _epochs(kernel: LinearKernel, frequency: int, max_epochs: int, patience: int | None, max_score: float | None):
    """The function that trains one model from its sums."""

    def train(group: pa.Table) -> pa.Table:
        symbol = group.column("symbol")[0].as_py()
        found = _read(group, kernel)
        shape = (kernel.inputs + 1, kernel.outputs)
        given = [s.values.to_numpy(zero_copy_only=False) for s in group.column("start") if s.is_valid]
        weights = given[0].reshape(shape) if given else kernel.initial_state(0).reshape(shape)
        steps = []
        for r in range(1 + max(r for kind, r in found if kind == PRODUCTS)):
            if frequency == 1:
                steps.append(found[PRODUCTS, r].step(kernel))
            else:
                n, values = found[MAP, r]
                steps.append((values[: shape[0] ** 2].reshape(shape[0], -1) / n, values[shape[0] ** 2 :].reshape(shape) / n))
        everything, held = _total(found, kernel, PRODUCTS), found.get((HELD, 0))
        out, best, best_epoch = [], None, 0
        for epoch in range(1, max_epochs + 1):
            for r, (factor, shift) in enumerate(steps):
                out.append((symbol, epoch, r, found[PRODUCTS, r].loss(weights), None, None, None))
                weights = factor @ weights + shift
            losses = everything.loss(weights), None if held is None else held.loss(weights)
            out.append((symbol, epoch, None, None, *losses, None))
            judged = losses[0] if losses[1] is None else losses[1]
            if best is None or judged < best[0] or np.isnan(best[0]):
                best, best_epoch = (judged, weights), epoch
            if np.isnan(judged) or max_score is not None and judged > max_score or patience is not None and epoch - best_epoch >= patience:
                break
        out.append((symbol, best_epoch, None, best[0], None, None, best[1].ravel()))
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        names = [part.split(" ")[0] for part in FOUND.split(", ")]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return train


def fit_linear_averaged(
    blocks: DataFrame,
    kernel: LinearKernel,
    averaging_frequency: int = 1,
    batch_size: int | DataFrame = 64,
    max_epochs: int = 25,
    patience: int | None = None,
    max_score: float | None = None,
    per_symbol: bool = True,
    holdout: DataFrame | None = None,
    start: AveragedModel | None = None,
) -> tuple[AveragedModel, DataFrame]:
    """What :func:`fit_averaged` gives for a linear kernel, its rounds included, from one pass over the blocks.

    The kernel must step by plain gradient descent, as others are no affine maps.
    """
    check_settings(kernel, averaging_frequency, batch_size, max_epochs, per_symbol, start)
    if not isinstance(kernel, LinearKernel) or kernel.updater != "sgd":
        raise ValueError("only plain gradient descent on a linear kernel is an affine map")
    ship_package()
    work = stored_work(blocks, kernel, averaging_frequency, batch_size, per_symbol, holdout)
    sums = _sums_of(work, kernel, averaging_frequency)
    if start is None:
        sums = sums.withColumn("start", F.lit(None).cast("array<double>"))
    else:  # beside one of the sums of a model
        begun = start.states.select("symbol", F.lit(PRODUCTS).alias("kind"), F.lit(0).alias("round"), F.col("state").alias("start"))
        sums = sums.join(begun, ["symbol", "kind", "round"], "left")
    path = new_table_folder(blocks.sparkSession, "epochs")
    trained = sums.groupBy("symbol").applyInArrow(_epochs(kernel, averaging_frequency, max_epochs, patience, max_score), FOUND)
    trained.write.parquet(path)
    stored = blocks.sparkSession.read.schema(FOUND).parquet(path)
    history = stored.where("round is null and state is null").select("symbol", "epoch", "train_loss", "test_loss")
    best = stored.where("state is not null").select("symbol", "epoch", "loss", "state")
    rounds = stored.where("round is not null").select("symbol", "epoch", "round", "loss")
    return AveragedModel(kernel, work.length, per_symbol, work.models, best, rounds), history


def _solved(kernel: LinearKernel):
    """The function that solves for the ridge model of one symbol."""

    def solve(group: pa.Table) -> pa.Table:
        sums = _total(_read(group, kernel), kernel, PRODUCTS)
        penalty = np.full(sums.inputs, kernel.l2)
        penalty[-1] = 0.0
        own, cross = sums.own / sums.n + np.diag(penalty), sums.cross / sums.n
        try:
            weights = np.linalg.solve(own, cross)
        except np.linalg.LinAlgError:  # without a penalty, inputs that follow from others leave a choice
            weights = np.linalg.lstsq(own, cross, rcond=None)[0]
        symbol = group.column("symbol")[0].as_py()
        row = {"symbol": [symbol], "epoch": pa.array([0], pa.int32()), "loss": [sums.loss(weights)], "state": pa.array([weights.ravel()], pa.list_(pa.float64()))}
        return pa.table(row)

    return solve


def fit_least_squares(blocks: DataFrame, category: str = "close", l2: float = 1e-4, per_symbol: bool = True) -> AveragedModel:
    """The linear model of every symbol, or of all together, with the least mean squared error plus ``l2`` times the
    squares of its weights but the intercept: one aggregate over the blocks, and a solve for each model."""
    ship_package()
    length = blocks.select((F.size("x") - F.col("m")).alias("length")).where("m > 0").agg(F.min("length")).first()[0]
    if length is None:
        raise ValueError("there is no training window")
    kernel = LinearKernel(category, length, l2=l2)
    work = stored_work(blocks, kernel, 1, 64, per_symbol, None)
    path = new_table_folder(blocks.sparkSession, "solved")
    solved = _sums_of(work, kernel, None).groupBy("symbol").applyInArrow(_solved(kernel), "symbol string, epoch int, loss double, state array<double>")
    solved.write.parquet(path)
    states = blocks.sparkSession.read.schema(solved.schema).parquet(path)
    return AveragedModel(kernel, work.length, per_symbol, work.models, states)
