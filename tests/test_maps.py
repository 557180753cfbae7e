"""Linear models from sums over their windows, against the rounds they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of
from seqcast.operators.windows import both_blocks, window_blocks
from seqcast.sources.writers import load_model, save_model
from seqcast.training.averaging import fit_averaged
from seqcast.training.kernels import LinearKernel
from seqcast.training.maps import fit_least_squares, fit_linear_averaged
from seqcast.training.predict import predict_all, predict_one_ahead
from test_training import _arrays, wave_rows

ROWS = wave_rows("A", 150) + wave_rows("B", 90, 0.5) + bar_rows("C", 100)


@pytest.fixture(scope="module")
def blocks(spark):
    return both_blocks(bars_of(spark, ROWS), length=6, block_size=20)


def table(frame, *names):
    return {tuple(r[n] for n in names): r for r in frame.collect()}


SETTINGS = [
    dict(batch_size=10, max_epochs=3),
    dict(batch_size=6, averaging_frequency=3, max_epochs=3),
    dict(batch_size=7, averaging_frequency=2, max_epochs=2, per_symbol=False),
    dict(batch_size=20, max_epochs=6, patience=1),
    dict(batch_size=20, max_epochs=4, max_score=0.05),
]


@pytest.mark.parametrize("settings", SETTINGS)
def test_maps_train_as_rounds(spark, blocks, settings):
    train, test = blocks
    kernel = LinearKernel(length=6, learning_rate=0.09 if "patience" in settings else 0.03, l2=0.01)
    slow, told = fit_averaged(train, kernel, holdout=test, track_rounds=True, **settings)
    fast, known = fit_linear_averaged(train, kernel, holdout=test, **settings)
    a, b = table(told, "symbol", "epoch"), table(known, "symbol", "epoch")
    assert a.keys() == b.keys()
    for key in a:
        assert b[key]["train_loss"] == pytest.approx(a[key]["train_loss"], rel=1e-8)
        assert b[key]["test_loss"] == pytest.approx(a[key]["test_loss"], rel=1e-8)
    a, b = table(slow.rounds, "symbol", "epoch", "round"), table(fast.rounds, "symbol", "epoch", "round")
    assert a.keys() == b.keys() and all(b[k]["loss"] == pytest.approx(a[k]["loss"], rel=1e-8) for k in a)
    a, b = table(slow.states, "symbol"), table(fast.states, "symbol")
    assert a.keys() == b.keys()
    for key in a:
        assert (a[key]["epoch"], a[key]["loss"]) == (b[key]["epoch"], pytest.approx(b[key]["loss"], rel=1e-8))
        assert b[key]["state"] == pytest.approx(a[key]["state"], rel=1e-7, abs=1e-10)


def test_sizes_of_each_symbol_all_features_and_a_start(spark):
    train, test = both_blocks(bars_of(spark, ROWS), length=6, block_size=20, category="all")
    kernel = LinearKernel("all", 6, 0.05)
    sizes = spark.createDataFrame([("A", 5), ("B", 10)], "symbol string, batch_size int")
    first, _ = fit_linear_averaged(train, kernel, batch_size=sizes, max_epochs=1)
    slow, _ = fit_averaged(train, kernel, batch_size=sizes, max_epochs=2)
    fast, _ = fit_linear_averaged(train, kernel, batch_size=sizes, max_epochs=1, start=first)
    a, b = table(slow.states, "symbol"), table(fast.states, "symbol")
    assert a.keys() == b.keys() == {("A",), ("B",), ("C",)}
    assert all(b[k]["state"] == pytest.approx(a[k]["state"]) for k in a if a[k]["epoch"] == 2)
    assert predict_all(fast, test).count() == predict_all(slow, test).count() > 0


def test_only_plain_descent_is_a_map(blocks):
    with pytest.raises(ValueError, match="affine"):
        fit_linear_averaged(blocks[0], LinearKernel(length=6, updater="rmsprop"))
    with pytest.raises(ValueError, match="updater"):
        LinearKernel(updater="adam")


def test_least_squares_of_each_symbol(spark, blocks):
    model = fit_least_squares(blocks[0], l2=1e-3)
    found = table(model.states, "symbol")
    assert found.keys() == {("A",), ("B",), ("C",)}
    for symbol in "ABC":
        x, y = _arrays(ROWS, 6, 0.9, "close", symbol)
        design = np.hstack([x.reshape(len(x), -1), np.ones((len(x), 1))])
        penalty = np.diag([1e-3] * 30 + [0.0])
        want = np.linalg.solve(design.T @ design / len(x) + penalty, design.T @ y[:, -1, 0] / len(x))
        assert found[symbol,]["state"] == pytest.approx(want)
        assert found[symbol,]["loss"] == pytest.approx(np.mean((design @ want - y[:, -1, 0]) ** 2))
    pooled = fit_least_squares(blocks[0], per_symbol=False)
    assert [r["symbol"] for r in pooled.states.collect()] == ["*"]
    out = predict_one_ahead(model, blocks[1])
    assert out.count() == predict_one_ahead(pooled, blocks[1]).count() > 0
    with pytest.raises(ValueError, match="no training window"):
        fit_least_squares(blocks[0].where("m < 0"))


def test_exact_least_squares_without_a_penalty(spark):
    """A flat series, whose inputs all follow from one another."""
    flat = bars_of(spark, bar_rows("F", 60, open=1.0, close=1.0, low=1.0, high=1.0, volume=1.0))
    model = fit_least_squares(window_blocks(flat, "train", length=6), l2=0.0)
    assert model.states.first()["loss"] == pytest.approx(0.0, abs=1e-12)


def test_running_squares_survive_a_reload(spark, blocks, tmp_path):
    kernel = LinearKernel(length=6, learning_rate=1e-3, updater="rmsprop")
    settings = dict(kernel=kernel, batch_size=20)
    whole, _ = fit_averaged(blocks[0], **settings, max_epochs=3)
    first, _ = fit_averaged(blocks[0], **settings, max_epochs=2)
    save_model(first, str(tmp_path / "model"))
    more, _ = fit_averaged(blocks[0], **settings, max_epochs=1, start=load_model(spark, str(tmp_path / "model")))
    a, b = table(whole.states, "symbol"), table(more.states, "symbol")
    for key in a:
        if a[key]["epoch"] == 3 and table(first.states, "symbol")[key]["epoch"] == 2:
            assert b[key]["state"] == pytest.approx(a[key]["state"])
            assert len(a[key]["state"]) == 2 * 31
    assert predict_one_ahead(more, blocks[1]).count() > 0


def test_running_squares_by_hand():
    kernel, rng = LinearKernel(length=2, learning_rate=0.1, updater="rmsprop", decay=0.9), np.random.default_rng(0)
    x, y = rng.random((8, 2, 5)), rng.random((8, 2, 1))
    state = kernel.initial_state(0)
    slope = kernel.gradient(state, x, y)
    after = kernel.step(state, x, y, rng)
    assert after[11:] == pytest.approx(0.1 * slope**2)
    assert after[:11] == pytest.approx(-0.1 * slope / (np.sqrt(0.1) * np.abs(slope) + 1e-8))


def test_progress_of_every_round(spark, blocks):
    seen = []
    model, _ = fit_averaged(blocks[0], LinearKernel(length=6), batch_size=10, max_epochs=2, track_rounds=True, progress=seen.append)
    assert [(s["epoch"], s["round"], s["models"]) for s in seen] == [(1, 0, 3), (1, 1, 3), (2, 0, 3), (2, 1, 3)]
    means = {(r["epoch"], r["round"]): r["loss"] for r in model.rounds.groupBy("epoch", "round").agg(F.avg("loss").alias("loss")).collect()}
    assert all(means[s["epoch"], s["round"]] == pytest.approx(s["loss"]) for s in seen)
