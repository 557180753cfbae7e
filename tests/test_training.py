import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixtures import bar_rows, bars_of, expected_windows
from seqcast.operators import stats
from seqcast.operators.windows import both_blocks, window_blocks
from seqcast.schema import FEATURES, SequenceConfig
from seqcast.sources.writers import load_model, predictions_as_documents, save_model, with_run_label, write_predictions
from seqcast.training import averaging
from seqcast.training.averaging import fit_averaged
from seqcast.training.forecaster import fit_forecaster
from seqcast.training.kernels import LinearKernel, LstmKernel
from seqcast.training.predict import persistence_forecast, predict_all, predict_one_ahead, prediction_series

TINY = SequenceConfig(layer1=4, layer2=3, dense=5, dropout=0.0, learning_rate=0.01)


def wave_rows(symbol, n, step=0.3):
    """A series whose next bar can be told from the last ones."""
    wave = lambda phase: lambda i: 50 + 10 * math.sin(step * i + phase)
    return bar_rows(symbol, n, open=wave(0.0), close=wave(0.5), low=wave(1.0), high=wave(1.5), volume=wave(2.0))


@pytest.fixture(scope="module")
def bars(spark):
    table = bars_of(spark, wave_rows("A", 150) + wave_rows("B", 90, 0.5)).persist()
    yield table
    table.unpersist()


def _arrays(rows, length, ratio, category, symbol):
    train, _ = expected_windows(rows, length, 1, ratio, category)
    picked = [train[key] for key in sorted(train) if key[0] == symbol]
    x, y = np.array([p[0] for p in picked]), np.array([p[1] for p in picked])
    return x, y if y.ndim == 3 else y[:, :, None]


# --- kernels


@pytest.mark.parametrize("category", ["close", "all"])
def test_recurrent_gradient_by_finite_differences(category):
    kernel, rng = LstmKernel(category, TINY), np.random.default_rng(0)
    x, y = rng.random((6, 5, 5)), rng.random((6, 5, kernel.outputs))
    weights = kernel.initial_state(1)[: kernel.weight_count] + rng.normal(0, 0.05, kernel.weight_count)
    slope, _ = kernel.gradient(weights, x, y, kernel._start(6))

    def objective(w):
        decay = sum((p**2).sum() for p in kernel._split(w) if p.ndim > 1)
        return kernel.loss(np.concatenate([w, w]), x, y) + 0.5 * TINY.l2 * decay

    for k in rng.choice(kernel.weight_count, 60, replace=False):
        unit = np.eye(1, kernel.weight_count, k)[0] * 1e-6
        assert slope[k] == pytest.approx((objective(weights + unit) - objective(weights - unit)) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("category", ["close", "all"])
def test_linear_gradient_by_finite_differences(category):
    kernel, rng = LinearKernel(category, length=3, learning_rate=1.0), np.random.default_rng(0)
    x, y = rng.random((6, 3, 5)), rng.random((6, 3, kernel.outputs))
    state = rng.normal(size=kernel.state_size)
    slope = state - kernel.step(state, x, y, rng)
    for k in range(kernel.state_size):
        unit = np.eye(1, kernel.state_size, k)[0] * 1e-6
        numeric = (kernel.loss(state + unit, x, y) - kernel.loss(state - unit, x, y)) / 2e-6
        assert slope[k] == pytest.approx(numeric, abs=1e-6)


def test_default_settings():
    c = SequenceConfig()
    assert (c.layer1, c.layer2, c.dense, c.learning_rate, c.l2, c.dropout, c.tbptt, c.seed) == (
        256, 256, 32, 0.1, 1e-4, 0.2, 22, 12345,
    )
    assert LstmKernel().outputs == 1 and LstmKernel("all").outputs == 5


def test_truncation_carries_the_state_over():
    whole, cut = LstmKernel("close", TINY), LstmKernel("close", SequenceConfig(4, 3, 5, 0.0, dropout=0.0, tbptt=2))
    x = np.random.default_rng(0).random((3, 6, 5))
    weights = whole.initial_state(1)[: whole.weight_count]
    carried = cut._start(3)
    outs = []
    for at in range(0, 6, 2):
        out, carried, _ = cut._forward(cut._split(weights), x[:, at : at + 2], carried, (1.0, 1.0))
        outs.append(out)
    assert np.allclose(np.concatenate(outs, axis=1), whole.steps_predicted(np.concatenate([weights, weights]), x))


# --- parameter averaging


def test_one_worker_is_plain_gradient_descent(spark, bars):
    """A block that holds a whole series, and all its mini-batches in one round."""
    rows = wave_rows("A", 150) + wave_rows("B", 90, 0.5)
    kernel = LinearKernel(length=6, learning_rate=0.05)
    blocks = window_blocks(bars, "train", length=6)
    model, history = fit_averaged(blocks, kernel, averaging_frequency=100, batch_size=16, max_epochs=3)
    got = {r["symbol"]: np.array(r["state"]) for r in model.states.collect()}
    losses = {(r["symbol"], r["epoch"]): r["train_loss"] for r in history.collect()}
    assert len(losses) == 6
    for symbol in "AB":
        x, y = _arrays(rows, 6, 0.9, "close", symbol)
        state = kernel.initial_state(0)
        for epoch in (1, 2, 3):
            for at in range(0, len(x), 16):
                state = kernel.step(state, x[at : at + 16], y[at : at + 16], None)
            assert losses[symbol, epoch] == pytest.approx(kernel.loss(state, x, y))
        assert got[symbol] == pytest.approx(state)


def test_rounds_average_the_workers(spark, bars):
    """Blocks of 20 windows, two rounds of one mini-batch of 10 per epoch, averaged by hand."""
    rows = wave_rows("A", 150) + wave_rows("B", 90, 0.5)
    kernel = LinearKernel(length=6, learning_rate=0.05)
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    model, history = fit_averaged(blocks, kernel, batch_size=10, max_epochs=2)
    got = {r["symbol"]: np.array(r["state"]) for r in model.states.collect()}
    for symbol in "AB":
        x, y = _arrays(rows, 6, 0.9, "close", symbol)
        state = kernel.initial_state(0)
        for _ in range(2):
            for r in range(2):
                parts = []
                for at in range(0, len(x), 20):
                    chosen = slice(at + 10 * r, min(at + 10 * (r + 1), len(x), at + 20))
                    if chosen.start < chosen.stop:
                        parts.append((chosen.stop - chosen.start, kernel.step(state, x[chosen], y[chosen], None)))
                state = sum(n * s for n, s in parts) / sum(n for n, _ in parts)
        assert got[symbol] == pytest.approx(state)


def test_joined_weights_train_as_broadcast_ones(spark, bars, monkeypatch):
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    settings = dict(kernel=LinearKernel(length=6), batch_size=10, max_epochs=2)
    small, _ = fit_averaged(blocks, **settings)
    monkeypatch.setattr(averaging, "BROADCAST_BYTES", 0)
    large, _ = fit_averaged(blocks, **settings)
    a = {r["symbol"]: r["state"] for r in small.states.collect()}
    b = {r["symbol"]: r["state"] for r in large.states.collect()}
    assert a.keys() == b.keys() and all(a[s] == pytest.approx(b[s]) for s in a)
    test = window_blocks(bars, "test", length=6)
    key = lambda r: (r["symbol"], r["window"])
    one, two = (sorted(m.transform(test).collect(), key=key) for m in (small, large))
    assert len(one) == len(two) > 0
    assert [r["prediction"] for r in one] == pytest.approx([r["prediction"] for r in two])


def test_pooled_weights_beyond_the_broadcast_limit(spark, bars, monkeypatch):
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    settings = dict(kernel=LinearKernel(length=6), batch_size=10, max_epochs=2, per_symbol=False)
    small, _ = fit_averaged(blocks, **settings)
    monkeypatch.setattr(averaging, "BROADCAST_BYTES", 0)
    large, _ = fit_averaged(blocks, **settings)
    assert small.states.first()["state"] == pytest.approx(large.states.first()["state"])
    test = window_blocks(bars, "test", length=6)
    assert large.transform(test).count() == small.transform(test).count() > 0


def test_batch_size_of_each_symbol(spark, bars):
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    sizes = spark.createDataFrame([("A", 5), ("B", 10)], "symbol string, batch_size int")
    model, _ = fit_averaged(blocks, LinearKernel(length=6), batch_size=sizes, max_epochs=2)
    got = {r["symbol"]: r["state"] for r in model.states.collect()}
    for symbol, size in (("A", 5), ("B", 10)):
        alone, _ = fit_averaged(blocks.where(F.col("symbol") == symbol), LinearKernel(length=6), batch_size=size, max_epochs=2)
        assert got[symbol] == pytest.approx(alone.states.first()["state"])


def test_training_goes_on_from_a_saved_model(spark, bars, tmp_path):
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    settings = dict(kernel=LinearKernel(length=6, learning_rate=1e-3), batch_size=20)
    four, _ = fit_averaged(blocks, **settings, max_epochs=4)
    first, _ = fit_averaged(blocks, **settings, max_epochs=3)
    save_model(first, str(tmp_path / "model"))
    more, _ = fit_averaged(blocks, **settings, max_epochs=1, start=load_model(spark, str(tmp_path / "model")))
    a, b = ({r["symbol"]: r["state"] for r in m.states.collect()} for m in (four, more))
    assert all(a[s] == pytest.approx(b[s]) for s in a)
    with pytest.raises(ValueError, match="same kernel"):
        fit_averaged(blocks, LinearKernel(length=6), start=first)


def test_held_out_loss_decides(spark, bars):
    train, test = both_blocks(bars, length=6, block_size=20)
    kernel = LinearKernel(length=6)
    model, history = fit_averaged(train, kernel, batch_size=10, max_epochs=3, holdout=test)
    rows = history.collect()
    for r in model.states.collect():
        mine = {h["epoch"]: h["test_loss"] for h in rows if h["symbol"] == r["symbol"]}
        assert r["epoch"] == min(mine, key=mine.get) and r["loss"] == min(mine.values())
    last = {h["symbol"]: h["test_loss"] for h in rows if h["epoch"] == 3}
    ranges = {r["symbol"]: (r["min_close"], r["max_close"]) for r in stats.feature_ranges(bars).collect()}
    final, _ = fit_averaged(train, kernel, batch_size=10, max_epochs=3)
    if all(r["epoch"] == 3 for r in final.states.collect()):
        errors = {}
        for p in final.transform(test).collect():
            low, high = ranges[p["symbol"]]
            errors.setdefault(p["symbol"], []).append(((p["prediction"] - p["actual"]) / (high - low)) ** 2)
        for symbol, found in errors.items():
            assert last[symbol] == pytest.approx(sum(found) / len(found))


def test_pooled_model_serves_every_symbol(spark, bars):
    blocks = window_blocks(bars, "train", length=6, block_size=20)
    model, history = fit_averaged(blocks, LinearKernel(length=6), batch_size=10, max_epochs=2, per_symbol=False)
    assert [r["symbol"] for r in model.states.collect()] == ["*"] and history.count() == 2
    out = model.transform(window_blocks(bars, "test", length=6))
    assert {r["symbol"] for r in out.select("symbol").distinct().collect()} == {"A", "B"}


def test_loss_falls_and_the_best_epoch_is_kept(spark, bars):
    blocks = window_blocks(bars, "train", length=6, block_size=32, category="close")
    model, history = fit_averaged(blocks, LstmKernel("close", TINY), batch_size=16, max_epochs=6)
    losses = {}
    for r in history.collect():
        losses.setdefault(r["symbol"], {})[r["epoch"]] = r["train_loss"]
    for r in model.states.collect():
        mine = losses[r["symbol"]]
        assert sorted(mine) == [1, 2, 3, 4, 5, 6]
        assert mine[6] < mine[1]
        assert r["epoch"] == min(mine, key=mine.get) and r["loss"] == min(mine.values())


def test_same_seed_same_weights_with_dropout(spark, bars):
    config = SequenceConfig(layer1=4, layer2=3, dense=5, learning_rate=0.01)
    blocks = window_blocks(bars, "train", length=6, block_size=32)
    runs = [fit_averaged(blocks, LstmKernel("close", config), batch_size=16, max_epochs=1)[0] for _ in range(2)]
    a, b = ({r["symbol"]: r["state"] for r in model.states.collect()} for model in runs)
    assert all(a[s] == pytest.approx(b[s]) for s in a)


def test_patience_stops_a_model_and_keeps_the_others(spark, bars):
    """The model of a series whose loss no longer improves stops; the other trains on."""
    rows = wave_rows("A", 120) + bar_rows("FLAT", 120, open=1.0, close=1.0, low=1.0, high=1.0, volume=1.0)
    blocks = window_blocks(bars_of(spark, rows), "train", length=6, ratio=0.9)
    # a flat series scales to 0.5 throughout, so that its loss falls to zero and stays there
    _, history = fit_averaged(
        blocks, LinearKernel(length=6, learning_rate=0.06), averaging_frequency=50, batch_size=8, max_epochs=12, patience=1
    )
    epochs = {}
    for r in history.collect():
        epochs.setdefault(r["symbol"], []).append(r["epoch"])
    assert max(epochs["A"]) == 12
    assert max(epochs["FLAT"]) < 12


def test_score_limit(spark, bars):
    blocks = window_blocks(bars, "train", length=6)
    _, history = fit_averaged(blocks, LinearKernel(length=6, learning_rate=1e-6), max_epochs=5, max_score=1e-9)
    assert {r["epoch"] for r in history.collect()} == {1}


def test_no_training_window(spark):
    blocks = window_blocks(bars_of(spark, bar_rows("A", 10)), "train")
    with pytest.raises(ValueError, match="no training window"):
        fit_averaged(blocks, LinearKernel())


# --- forecasts


def test_linear_fit_equals_least_squares(spark, bars):
    rows = wave_rows("A", 150) + wave_rows("B", 90, 0.5)
    model = fit_forecaster(window_blocks(bars, "train", length=3), "linear", length=3, regParam=0.0).stages[-1]
    parts = [_arrays(rows, 3, 0.9, "close", s) for s in "AB"]
    x = np.vstack([p[0].reshape(len(p[0]), -1) for p in parts])
    y = np.concatenate([p[1][:, -1, 0] for p in parts])
    fitted = x @ model.coefficients.toArray() + model.intercept
    design = np.hstack([x, np.ones((len(x), 1))])
    best = design @ np.linalg.lstsq(design, y, rcond=None)[0]
    assert np.mean((fitted - y) ** 2) == pytest.approx(np.mean((best - y) ** 2), abs=1e-6)


def test_forecast_comes_back_in_units_and_beats_persistence(spark, bars):
    test = window_blocks(bars, "test", length=6)
    out = predict_one_ahead(fit_forecaster(window_blocks(bars, "train", length=6), length=6), test, length=6)
    assert out.columns == ["symbol", "window", "date", "category", "prediction", "actual"]
    mine = stats.mean_loss(out, by=None).first()["loss"]
    assert mine < stats.mean_loss(persistence_forecast(test, length=6), by=None).first()["loss"]
    _, want = expected_windows(wave_rows("A", 150) + wave_rows("B", 90, 0.5), 6, 1, 0.9, "close")
    assert {(r["symbol"], r["window"]): (r["date"], r["actual"]) for r in out.collect()} == {
        key: (date, y) for key, (date, _, y) in want.items()
    }


def test_all_features_by_five_fits_and_by_one_kernel(spark, bars):
    test = window_blocks(bars, "test", length=6, category="all")
    models = {f: fit_forecaster(window_blocks(bars, "train", length=6, category=f), length=6) for f in FEATURES}
    five = predict_all(models, test, length=6).orderBy("symbol", "window").collect()
    blocks = window_blocks(bars, "train", length=6, category="all")
    model, _ = fit_averaged(blocks, LinearKernel("all", 6, 0.05), averaging_frequency=9, batch_size=16, max_epochs=2)
    one = predict_all(model, test).orderBy("symbol", "window").collect()
    single = predict_one_ahead(models["high"], window_blocks(bars, "test", length=6, category="high"), "high", 6)
    singles = [r["prediction"] for r in single.orderBy("symbol", "window").collect()]
    assert [r["prediction"][3] for r in five] == pytest.approx(singles)
    assert [r["actual"] for r in five] == [r["actual"] for r in one]
    assert all(len(r["prediction"]) == 5 and 0 < r["prediction"][0] < 100 for r in one)
    with pytest.raises(ValueError):
        predict_one_ahead(model, test, "all")


# --- what is written


@pytest.fixture(scope="module")
def forecast(bars):
    return persistence_forecast(window_blocks(bars, "test", length=6), length=6)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_predictions_as_files(spark, forecast, tmp_path, fmt):
    path = str(tmp_path / "out")
    write_predictions(forecast, path, fmt, windows_per_file=3)
    read = spark.read.format(fmt).option("header", True).load(path)
    assert read.count() == forecast.count()
    assert {r["symbol"] for r in read.select("symbol").distinct().collect()} == {"A", "B"}
    files = [p for p in (tmp_path / "out" / "symbol=A").iterdir() if p.name.startswith("part-")]
    assert len(files) >= 3  # eight windows, three to a file
    with pytest.raises(ValueError):
        write_predictions(forecast, path, "xlsx")


def test_documents_hold_every_window_in_order(spark, forecast):
    import json

    pages = predictions_as_documents(forecast, page_size=5).orderBy("symbol", "page").collect()
    points = {}
    for row in pages:
        document = json.loads(row["document"])
        assert document["symbol"] == row["symbol"] and len(document["window"]) <= 5
        points.setdefault(row["symbol"], []).extend(
            zip(document["window"], document["result"]["predict"], document["result"]["actual"])
        )
    for symbol, got in points.items():
        mine = forecast.where(F.col("symbol") == symbol).orderBy("window").collect()
        assert got == [(r["window"], r["prediction"], r["actual"]) for r in mine]


def test_chart_data(spark, forecast):
    long = prediction_series(forecast)
    assert long.columns == ["symbol", "window", "series", "value"] and long.count() == 2 * forecast.count()
    table = spark.createDataFrame(
        [("A", -10.0, 3.9), ("A", 1.0, 104.0), ("B", 1e12, -1e12)], "symbol string, prediction double, actual double"
    )
    got = {r["symbol"]: (r["min_value"], r["max_value"]) for r in stats.value_bounds(table).collect()}
    assert got == {"A": (-9, 106), "B": (-2147483648, 2147483647)}


def test_run_label_may_stand_in_a_path(forecast):
    label = with_run_label(forecast).select("run").distinct().collect()
    assert len(label) == 1 and not set("/: ") & set(label[0]["run"])


@pytest.mark.parametrize("kind", ["linear", "gbt", "averaged", "lstm"])
def test_reloaded_model_predicts_alike(spark, bars, tmp_path, kind):
    blocks = window_blocks(bars, "train", length=6)
    if kind in ("linear", "gbt"):
        model = fit_forecaster(blocks, kind, length=6, **({"maxIter": 2, "seed": 1} if kind == "gbt" else {}))
    else:
        kernel = LinearKernel(length=6) if kind == "averaged" else LstmKernel("close", TINY)
        model, _ = fit_averaged(blocks, kernel, max_epochs=1)
    path = str(tmp_path / "model")
    save_model(model, path)
    again = load_model(spark, path)
    test = window_blocks(bars, "test", length=6)
    one, two = (
        [r["prediction"] for r in predict_one_ahead(m, test, length=6).orderBy("symbol", "window").collect()]
        for m in (model, again)
    )
    assert one == two and len(one) > 0


def test_best_epoch_and_weighted_average(spark):
    history = spark.createDataFrame(
        [("A", 1, 0.5), ("A", 2, 0.25), ("A", 3, 0.25), ("B", 1, 1.0), ("B", 2, float("nan"))],
        "symbol string, epoch int, loss double",
    )
    assert {tuple(r) for r in stats.best_epoch(history).collect()} == {("A", 2, 0.25), ("B", 1, 1.0)}
    params = spark.createDataFrame(
        [("A", 0, 1.0, 1), ("A", 0, 4.0, 2), ("A", 1, 7.0, 5)], "symbol string, k int, v double, n long"
    )
    assert {tuple(r) for r in stats.weighted_param_average(params).collect()} == {("A", 0, 3.0), ("A", 1, 7.0)}
