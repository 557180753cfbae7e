"""Small hand-made series, and the plain-Python account of what must come out."""

import datetime as dt
import math
import random

from seqcast.schema import BAR_SCHEMA, FEATURES

START = dt.date(2015, 1, 1)


def bar_rows(symbol, n, seed=1, start=START, **fixed):
    """``n`` daily bars with all values different; ``fixed`` sets features to a constant or a function of i."""
    rng = random.Random(f"{symbol}/{seed}")
    rows = []
    for i in range(n):
        values = {f: round(100 * (k + 1) + rng.random() * 90, 4) for k, f in enumerate(FEATURES)}
        for name, value in fixed.items():
            values[name] = value(i) if callable(value) else value
        rows.append((symbol, start + dt.timedelta(days=i), *[float(values[f]) for f in FEATURES]))
    return rows


def bars_of(spark, rows, seed=0):
    """The bars as a table, in no particular order."""
    shuffled = list(rows)
    random.Random(seed).shuffle(shuffled)
    return spark.createDataFrame(shuffled, BAR_SCHEMA)


def scale_value(value, low, high):
    return (value - low) / (high - low) if high > low else 0.5


def expected_windows(rows, length, horizon, ratio, category):
    """Train and test windows by plain loops over each series."""
    train, test = {}, {}
    for symbol in {row[0] for row in rows}:
        mine = sorted(row for row in rows if row[0] == symbol)
        values = [row[2:] for row in mine]
        low = [min(v[k] for v in values) for k in range(5)]
        high = [max(v[k] for v in values) for k in range(5)]
        scaled = [[scale_value(v[k], low[k], high[k]) for k in range(5)] for v in values]
        split = math.floor(len(mine) * ratio + 0.5)

        def pick(v):
            return list(v) if category == "all" else v[FEATURES.index(category)]

        for i in range(max(split - length - horizon, 0)):
            x = scaled[i : i + length]
            y = [pick(scaled[i + t + 1]) for t in range(length)]
            train[symbol, i] = (x, y)
        for j in range(max(len(mine) - split - length - horizon, 0)):
            at = split + j
            test[symbol, j] = (mine[at + length][1], scaled[at : at + length], pick(values[at + length]))
    return train, test
