"""Data-parallel training with parameter averaging and early stopping.

A worker is a block of windows (see :mod:`seqcast.operators.windows`), so the
number of workers grows with the data and the work of one task does not. In a
round every block starts from the weights of its model, takes
``averaging_frequency`` mini-batches of ``batch_size`` windows, and hands its
weights back; the weights of a model are averaged over its blocks, weighted by
windows seen. One Spark job per round serves all models. An epoch is as many
rounds as the largest block needs, a number fixed by the settings.

Up to ``BLOCKS_PER_UNIT`` neighbouring blocks of a symbol are one *unit*, a row
of a table written once, in buckets by model and share of its units; in a round
every unit gets the weights of its model once, whatever their size, and a task
adds up its units of one symbol before it hands on chunks of weights, which
Spark averages with map-side combine. Weights that are too large to broadcast
are repeated for each share and moved to the buckets; the units stay where they
are.

The first round of an epoch also scores the weights it was given, over all
windows of the block and of the held-out blocks if there are any, so the losses
of an epoch cost no pass of their own. The weights of every round are written
to the shared folder and read back, which cuts the lineage and survives lost
executors. Only counts come to the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from seqcast.operators.skew import join_on_symbol
from seqcast.operators.stats import best_epoch
from seqcast.session import bucketed_table, new_table_folder, ship_package
from seqcast.training.kernels import LinearKernel, LstmKernel

Kernel = LinearKernel | LstmKernel

# Weights of all models together are broadcast up to this many bytes; beyond
# that they are joined, on the model and a share of its units.
BROADCAST_BYTES = 64 << 20
# Aim for the bytes of one Arrow batch handed to Python.
ARROW_BYTES = 64 << 20
# Neighbouring blocks of one symbol that share a row, neighbouring units that
# share a copy of weights too large to broadcast, and the bytes of a task.
BLOCKS_PER_UNIT = 8
UNITS_PER_SHARE = 8
TASK_BYTES = 16 << 20
# Weights per output row.
CHUNK = 1 << 16
# Places of the losses in the rows of a round, before those of the weights.
ROUND_LOSS, TRAIN_LOSS, TEST_LOSS = -3, -2, -1
LOSSES = {ROUND_LOSS: "round_loss", TRAIN_LOSS: "train_loss", TEST_LOSS: "test_loss"}

POOLED = "*"


@dataclass(frozen=True)
class AveragedModel:
    """Trained weights: one row ``(symbol, epoch, loss, state)`` per model.

    A pooled model has the single symbol ``*`` and serves every symbol.
    ``rounds`` is the table ``symbol, epoch, round, loss``, if it was asked for:
    the loss of the weights a round began with over the windows of the round.
    """

    kernel: Kernel
    length: int
    per_symbol: bool
    models: int
    states: DataFrame
    rounds: DataFrame | None = None

    def transform(self, blocks: DataFrame) -> DataFrame:
        """Test blocks to ``symbol, window, date, prediction, actual``, in the units of the target.

        Every window is scored on its own, from a cleared recurrent state.
        """
        ship_package()
        wide = self.kernel.outputs > 1
        number = "array<double>" if wide else "double"
        kernel, length = self.kernel, self.length

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    owner, state, unit = batch["owner"][row].as_py(), _vector(batch["state"][row]), batch["unit"][row].values
                    for k in range(len(unit)):
                        m, start = unit.field("m")[k].as_py(), unit.field("start")[k].as_py()
                        x = _windows(_matrix(unit.field("x")[k]), length, m)
                        low, high = _vector(unit.field("low")[k]), _vector(unit.field("high")[k])
                        predicted = kernel.predict(state, x) * (high - low) + low
                        actual = _matrix(unit.field("y")[k])[length : length + m]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([owner] * m, pa.string()),
                                pa.array(np.arange(start, start + m)),
                                unit.field("date")[k].values.slice(length, m),
                                _numbers(predicted, wide),
                                _numbers(actual, wide),
                            ],
                            names=["symbol", "window", "date", "prediction", "actual"],
                        )

        date = blocks.schema["date"].dataType.elementType.simpleString()
        out = f"symbol string, window bigint, date {date}, prediction {number}, actual {number}"
        units = _units(blocks, self.per_symbol, ("block", "start", "m", "x", "y", "date", "low", "high"))
        states = self.states.select("symbol", "state")
        if _fits_broadcast(self.models, kernel):
            attached = units.join(F.broadcast(states), "symbol")
        else:
            attached = join_on_symbol(units, states, spread_by="place", counts=units.groupBy("symbol").agg(F.count("*").alias("n")))
        return attached.select("owner", "unit", "state").mapInArrow(score, out)


def _model_key(symbol: str, per_symbol: bool):
    return F.col(symbol) if per_symbol else F.lit(POOLED)


def _units(blocks: DataFrame, per_symbol: bool, fields: tuple[str, ...]) -> DataFrame:
    """``symbol, owner, salt, place, unit``: rows of neighbouring blocks, and a number to spread them by."""
    salt = F.expr(f"block div {BLOCKS_PER_UNIT}").alias("salt")
    return (
        blocks.groupBy(F.col("symbol").alias("owner"), salt)
        .agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("unit"))
        .select(_model_key("owner", per_symbol).alias("symbol"), "owner", "salt", F.xxhash64("owner", "salt").alias("place"), "unit")
    )


def _fits_broadcast(models: int, kernel: Kernel, limit: int | None = None) -> bool:
    return models * kernel.state_size * 8 <= (BROADCAST_BYTES if limit is None else limit)


def _vector(value: pa.ListScalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False)


def _matrix(value: pa.ListScalar) -> np.ndarray:
    """A list of numbers, or of equally long lists, as a table with one row per element."""
    items = value.values
    if pa.types.is_list(items.type):
        return items.flatten().to_numpy(zero_copy_only=False).reshape(len(items), -1)
    return items.to_numpy(zero_copy_only=False).reshape(-1, 1)


def _windows(rows: np.ndarray, length: int, m: int) -> np.ndarray:
    """The first ``m`` windows of ``length`` rows, as a view."""
    return np.lib.stride_tricks.sliding_window_view(rows, length, axis=0)[:m].transpose(0, 2, 1)


def _numbers(table: np.ndarray, wide: bool) -> pa.Array:
    if not wide:
        return pa.array(np.ascontiguousarray(table[:, 0]), pa.float64())
    offsets = np.arange(0, table.size + 1, table.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(table).ravel(), pa.float64()))


@contextmanager
def _arrow_rows(spark: SparkSession, row_bytes: int):
    """Bounds the rows per Arrow batch, for rows as large as a unit with its weights."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(1, min(int(before) if int(before) > 0 else 10000, ARROW_BYTES // row_bytes))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Work:
    """The units of a training run as a table ``symbol, share, owner, unit, held, size``, and what is known of them."""

    units: DataFrame
    models: int
    length: int
    rounds: int
    row_bytes: int
    small: bool


def stored_work(
    blocks: DataFrame,
    kernel: Kernel,
    averaging_frequency: int,
    batch_size: int | DataFrame,
    per_symbol: bool,
    holdout: DataFrame | None,
    broadcast_bytes: int | None = None,
) -> Work:
    """Writes the units in buckets by model and share, so that a round moves weights only.

    There are as many buckets as the bytes of the units ask for, and at least
    two for every core if there are units enough.
    """
    spark = blocks.sparkSession
    fields = ("block", "m", "x", "y", "low", "high")
    none = F.lit(None).cast("array<double>")
    units = _units(blocks.withColumns({"low": none, "high": none}), per_symbol, fields).withColumn("held", F.lit(False))
    if holdout is not None:  # of symbols that have a model
        held = _units(holdout, per_symbol, fields).join(units.select("symbol").distinct(), "symbol", "left_semi")
        units = units.unionByName(held.withColumn("held", F.lit(True)))
    if isinstance(batch_size, DataFrame):
        sizes = batch_size.select(F.col("symbol").alias("owner"), F.greatest(F.col("batch_size"), F.lit(1)).cast("int").alias("size"))
        units = units.join(sizes, "owner", "left").withColumn("size", F.coalesce("size", F.lit(64)))
    else:
        units = units.withColumn("size", F.lit(batch_size))
    path = new_table_folder(spark, "gathered")
    units.write.parquet(path)
    units = spark.read.schema(units.schema).parquet(path)
    windows = F.array_max(F.col("unit.m"))
    bars = F.aggregate("unit", F.lit(0), lambda n, b: n + F.size(b["x"]))
    facts = units.agg(
        F.count("*").alias("all"),
        F.count(F.when(~F.col("held"), 1)).alias("units"),
        F.count_distinct("symbol").alias("models"),
        F.max(F.when(~F.col("held"), F.ceil(windows / (F.lit(averaging_frequency) * F.col("size"))))).alias("rounds"),
        F.max(F.size(F.get("unit.x", F.lit(0)))).alias("bars"),
        F.sum(bars).alias("all_bars"),
        F.min(F.size(F.get("unit.x", F.lit(0))) - F.get("unit.m", F.lit(0))).alias("length"),
    ).first()
    if not facts["units"]:
        raise ValueError("there is no training window")
    small = _fits_broadcast(facts["models"], kernel, broadcast_bytes)
    bar_bytes = 8 * (kernel.outputs + 5)
    wanted = max(2 * spark.sparkContext.defaultParallelism, -(-facts["all_bars"] * bar_bytes // TASK_BYTES))
    tasks = min(facts["all"], wanted)
    if not per_symbol:
        share = F.pmod("place", F.lit(tasks))
    else:  # broadcast weights have no copies that units could share
        share = F.col("salt") if small else F.expr(f"salt div {UNITS_PER_SHARE}")
    shared = units.withColumn("share", share.cast("bigint"))
    # Units of a model lie together in a bucket, so that a task adds them up before it hands them on.
    work = bucketed_table(shared, "units", "symbol", "share", sorted_by=("symbol", "share", "owner", "salt"), buckets=tasks)
    row_bytes = BLOCKS_PER_UNIT * facts["bars"] * bar_bytes + 8 * kernel.state_size
    return Work(work, facts["models"], facts["length"], facts["rounds"], row_bytes, small)


def _trainer(kernel: Kernel, length: int, frequency: int, r: int, train: bool, seed: list[int], track: bool):
    """The function one round applies to the units of a task.

    It gives rows ``(symbol, first, n, v)``: weights ``v`` from index ``first``
    on, averaged over the ``n`` windows seen; the losses stand at the places
    of ``LOSSES``. Units of one symbol lie together, so one running sum is held
    at a time.
    """

    def rows(symbol: str, total: dict) -> Iterator[tuple[str, int, int, np.ndarray]]:
        for place in LOSSES:
            n, loss = total[place]
            if n:
                yield symbol, place, n, np.array([loss / n])
        if total["seen"]:
            average = total["sum"] / total["seen"]
            for at in range(0, len(average), CHUNK):
                yield symbol, at, total["seen"], average[at : at + CHUNK]

    def table(found: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["symbol", "first", "n", "v"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                symbol, owner = batch["symbol"][row].as_py(), batch["owner"][row].as_py()
                if symbol != now:
                    if now is not None and (found := list(rows(now, total))):
                        yield table(found)
                    now, total = symbol, {**dict.fromkeys(LOSSES, (0, 0.0)), "seen": 0, "sum": None}
                given, held, size = batch["state"][row], batch["held"][row].as_py(), batch["size"][row].as_py()
                start = _vector(given) if given.is_valid else kernel.initial_state(seed[0])
                unit = batch["unit"][row].values
                for k in range(len(unit)):
                    m = unit.field("m")[k].as_py()
                    x = _windows(_matrix(unit.field("x")[k]), length, m)
                    y = _matrix(unit.field("y")[k])
                    if held:  # targets of held-out blocks are in their units
                        low, high = _vector(unit.field("low")[k]), _vector(unit.field("high")[k])
                        y = np.where(high > low, (y - low) / np.where(high > low, high - low, 1.0), 0.5)
                    y = _windows(y[1:], length, m)
                    if r == 0:
                        place = TEST_LOSS if held else TRAIN_LOSS
                        total[place] = (total[place][0] + m, total[place][1] + m * kernel.loss(start, x, y))
                    first, last = r * frequency * size, min((r + 1) * frequency * size, m)
                    if train and not held and first < last:
                        state = start
                        if track:
                            seen, loss = total[ROUND_LOSS]
                            total[ROUND_LOSS] = (seen + last - first, loss + (last - first) * kernel.loss(start, x[first:last], y[first:last]))
                        rng = np.random.default_rng([*seed, zlib.crc32(owner.encode()), unit.field("block")[k].as_py()])
                        for at in range(first, last, size):
                            end = min(at + size, last)
                            state = kernel.step(state, x[at:end], y[at:end], rng)
                        total["seen"] += last - first
                        weighted = state * (last - first)
                        total["sum"] = weighted if total["sum"] is None else total["sum"] + weighted
        if now is not None and (found := list(rows(now, total))):
            yield table(found)

    return work


def _average(updates: DataFrame) -> DataFrame:
    """``symbol, state`` and the losses from the rows of all workers, a chunk of weights at a time."""
    mean = Summarizer.mean(array_to_vector("v"), F.col("n").cast("double"))
    chunks = updates.groupBy("symbol", "first").agg(vector_to_array(mean).alias("v"))
    weights = F.sort_array(F.collect_list(F.when(F.col("first") >= 0, F.struct("first", "v"))))

    losses = [F.max(F.when(F.col("first") == place, F.get("v", F.lit(0)))).alias(name) for place, name in LOSSES.items()]
    found = chunks.groupBy("symbol").agg(weights.alias("weights"), *losses)
    state = F.when(F.size("weights") > 0, F.flatten("weights.v"))
    return found.select("symbol", state.alias("state"), *LOSSES.values())


def _judged(history: DataFrame) -> DataFrame:
    """``symbol, epoch, loss``: the held-out loss where there is one, else the training loss."""
    return history.select("symbol", "epoch", F.coalesce("test_loss", "train_loss").alias("loss"))


def _stopped(history: DataFrame, patience: int | None, max_score: float | None) -> DataFrame:
    """Models whose loss has not improved for ``patience`` epochs, or exceeds ``max_score`` or is no number."""
    latest = history.groupBy("symbol").agg(F.max(F.struct("epoch", "loss")).alias("latest"))
    known = latest.join(best_epoch(history).withColumnRenamed("epoch", "best"), "symbol")
    tests = F.isnan("latest.loss")
    if patience is not None:
        tests = tests | (F.col("latest.epoch") - F.col("best") >= patience)
    if max_score is not None:
        tests = tests | (F.col("latest.loss") > max_score)
    return known.where(tests).select("symbol")


def check_settings(
    kernel: Kernel, averaging_frequency: int, batch_size: int | DataFrame, max_epochs: int, per_symbol: bool, start: AveragedModel | None
) -> None:
    if min(averaging_frequency, 1 if isinstance(batch_size, DataFrame) else batch_size, max_epochs) < 1:
        raise ValueError("averaging_frequency, batch_size and max_epochs must be at least 1")
    if start is not None and (start.kernel != kernel or start.per_symbol != per_symbol):
        raise ValueError("training goes on with the same kernel and kind of model")


def fit_averaged(
    blocks: DataFrame,
    kernel: Kernel,
    averaging_frequency: int = 1,
    batch_size: int | DataFrame = 64,
    max_epochs: int = 25,
    patience: int | None = None,
    max_score: float | None = None,
    per_symbol: bool = True,
    seed: int = 12345,
    holdout: DataFrame | None = None,
    start: AveragedModel | None = None,
    track_rounds: bool = False,
    progress: Callable[[dict], None] | None = None,
    broadcast_bytes: int | None = None,
) -> tuple[AveragedModel, DataFrame]:
    """Trains one model per symbol, or one for all, on train blocks.

    ``batch_size`` is one number, or a table ``symbol, batch_size`` as
    :func:`minibatch_size` gives it. ``holdout`` are test blocks, whose loss
    then decides the best epoch and early stopping. ``start`` is a model whose
    weights, running state included, training goes on from. ``track_rounds``
    keeps the loss of every round, which the model has as ``rounds``;
    ``progress`` is called after each round with its ``epoch`` and ``round``,
    the number of ``models`` and their mean ``loss`` (tracked rounds only),
    which the job of the round observes on its way. Weights of all models
    beyond ``broadcast_bytes`` (else ``BROADCAST_BYTES``) are joined.

    Returns the model with the weights of the best epoch, and the history
    ``symbol, epoch, train_loss, test_loss``. Without ``patience`` and
    ``max_score`` training runs for ``max_epochs``.
    """
    check_settings(kernel, averaging_frequency, batch_size, max_epochs, per_symbol, start)
    spark = blocks.sparkSession
    ship_package()
    folder = new_table_folder(spark, "averaging")
    state_row = "symbol string, state array<double>, " + ", ".join(f"{name} double" for name in LOSSES.values())
    work = stored_work(blocks, kernel, averaging_frequency, batch_size, per_symbol, holdout, broadcast_bytes)
    shares = None
    if not work.small:
        shares_path = f"{folder}/shares"
        work.units.select("symbol", "share").distinct().write.parquet(shares_path)
        shares = spark.read.schema("symbol string, share bigint").parquet(shares_path)

    def with_weights(states: DataFrame | None) -> DataFrame:
        if states is None:
            return work.units.withColumn("state", F.lit(None).cast("array<double>"))
        states = states.select("symbol", "state")
        if work.small:
            return work.units.join(F.broadcast(states), "symbol")
        return work.units.join(shares.join(states, "symbol").hint("merge"), ["symbol", "share"])

    def run(states: DataFrame | None, epoch: int, r: int, train: bool = True) -> DataFrame:
        task = _trainer(kernel, work.length, averaging_frequency, r, train, [seed, epoch, r], track_rounds)
        inputs = with_weights(states).select("symbol", "owner", "unit", "held", "size", "state")
        result = _average(inputs.mapInArrow(task, "symbol string, first int, n bigint, v array<double>"))
        if r > 0:  # a model without a window left for this round keeps its weights
            kept = states.select("symbol", F.col("state").alias("kept"))
            result = kept.join(result, "symbol", "left").select("symbol", F.coalesce("state", "kept").alias("state"), *LOSSES.values())
        path = f"{folder}/rounds/epoch={epoch}/round={r}"
        seen = Observation(f"epoch {epoch} round {r}") if progress is not None and train else None
        if seen is not None:
            result = result.observe(seen, F.count("*").alias("models"), F.avg("round_loss").alias("loss"))
        with _arrow_rows(spark, work.row_bytes):
            result.write.parquet(path)
        if seen is not None:
            progress({"epoch": epoch, "round": r, **seen.get})
        return spark.read.schema(state_row).parquet(path)

    def written() -> DataFrame:
        path = f"{folder}/rounds"
        return spark.read.schema(f"{state_row}, epoch int, round int").option("basePath", path).parquet(path)

    def losses() -> DataFrame:
        # Round 0 of an epoch scores the weights the epoch before ended with.
        scored = written().where((F.col("round") == 0) & (F.col("epoch") > 1))
        return scored.select("symbol", (F.col("epoch") - 1).cast("int").alias("epoch"), "train_loss", "test_loss")

    stops_early = patience is not None or max_score is not None
    states, active = (None if start is None else start.states), True
    for epoch in range(1, max_epochs + 1):
        for r in range(work.rounds):
            states = run(states, epoch, r)
            if r == 0 and epoch > 1 and stops_early:
                states = states.join(_stopped(_judged(losses()), patience, max_score), "symbol", "left_anti")
                active = not states.isEmpty()
                if not active:
                    break
        if not active:
            break
    if active:
        run(states, max_epochs + 1, 0, train=False)

    history = losses()
    ended = written().where(F.col("round") == work.rounds - 1).select("symbol", "epoch", "state")
    best = ended.join(best_epoch(_judged(history)), ["symbol", "epoch"]).select("symbol", "epoch", "loss", "state")
    rounds = None
    if track_rounds:  # of epochs that a model went through to their end
        gone = written().where("round_loss is not null").select("symbol", "epoch", "round", F.col("round_loss").alias("loss"))
        rounds = gone.join(history.select("symbol", "epoch"), ["symbol", "epoch"], "left_semi")
    return AveragedModel(kernel, work.length, per_symbol, work.models, best, rounds), history
