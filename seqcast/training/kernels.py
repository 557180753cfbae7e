"""Small NumPy kernels that run inside Spark tasks.

A kernel turns one flat weight vector and a batch of windows into a loss, a
gradient and predictions. It knows nothing of Spark: which windows it sees, and
how the vectors of many tasks become one, is decided by the jobs in
:mod:`seqcast.training.averaging`.

``x`` is ``(windows, steps, features)`` and ``y`` is ``(windows, steps,
outputs)``: the target of the next bar for every step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from seqcast.schema import FEATURES, WINDOW_LENGTH, Category, SequenceConfig


UPDATERS = ("sgd", "rmsprop")
EPSILON = 1e-8


@dataclass(frozen=True)
class LinearKernel:
    """Least squares on the flattened window, for the bar after it.

    Steps are plain gradient descent (``sgd``), or divide each slope by the root
    of its running mean square (``rmsprop``). The state vector then holds the
    weights and, behind them, the running squares, so that both are averaged
    over the workers and saved with the model.
    """

    category: str = "close"
    length: int = WINDOW_LENGTH
    learning_rate: float = 0.01
    l2: float = 0.0
    updater: str = "sgd"
    decay: float = 0.95

    def __post_init__(self):
        if self.updater not in UPDATERS:
            raise ValueError(f"updater must be one of {UPDATERS}")

    @property
    def inputs(self) -> int:
        return self.length * len(FEATURES)

    @property
    def outputs(self) -> int:
        return len(Category.of(self.category).features)

    @property
    def weight_count(self) -> int:
        return (self.inputs + 1) * self.outputs

    @property
    def state_size(self) -> int:
        return self.weight_count * (1 + (self.updater != "sgd"))

    def initial_state(self, seed: int) -> np.ndarray:
        return np.zeros(self.state_size)

    def _weights(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = state[: self.weight_count].reshape(self.inputs + 1, self.outputs)
        return table[:-1], table[-1]

    def predict(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        w, b = self._weights(state)
        return x.reshape(len(x), -1) @ w + b

    def loss(self, state: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean((self.predict(state, x) - y[:, -1, :]) ** 2))

    def gradient(self, state: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1)
        w, _ = self._weights(state)
        slope = 2.0 * (self.predict(state, x) - y[:, -1, :]) / (len(x) * self.outputs)
        return np.vstack([flat.T @ slope + self.l2 * w, slope.sum(axis=0)]).ravel()

    def step(self, state: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        slope = self.gradient(state, x, y)
        if self.updater == "sgd":
            return state - self.learning_rate * slope
        weights, squares = state[: self.weight_count], state[self.weight_count :]
        squares = self.decay * squares + (1.0 - self.decay) * slope**2
        return np.concatenate([weights - self.learning_rate * slope / (np.sqrt(squares) + EPSILON), squares])


def _hard_sigmoid(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value and slope of ``clip(0.2 a + 0.5, 0, 1)``."""
    raw = 0.2 * a + 0.5
    return np.clip(raw, 0.0, 1.0), np.where((raw > 0.0) & (raw < 1.0), 0.2, 0.0)


class _Recurrent:
    """One recurrent layer with input, forget and output gates that also see the cell (peepholes).

    Columns of the weight tables are the blocks cell input, input, forget and output gate.
    """

    def __init__(self, w, u, peep, b):
        self.w, self.u, self.peep, self.b = w, u, peep, b

    def forward(self, x, h, c):
        """Outputs ``(windows, steps, units)`` from carried state ``h, c``, and what backward needs."""
        units = self.u.shape[0]
        p_in, p_forget, p_out = self.peep
        projected = x @ self.w + self.b
        outs, tape = [], []
        for t in range(x.shape[1]):
            a = projected[:, t] + h @ self.u
            cell_in = np.tanh(a[:, :units])
            gate_in, s_in = _hard_sigmoid(a[:, units : 2 * units] + c * p_in)
            gate_forget, s_forget = _hard_sigmoid(a[:, 2 * units : 3 * units] + c * p_forget)
            new_c = gate_forget * c + gate_in * cell_in
            gate_out, s_out = _hard_sigmoid(a[:, 3 * units :] + new_c * p_out)
            squashed = np.tanh(new_c)
            tape.append((h, c, new_c, cell_in, gate_in, gate_forget, gate_out, s_in, s_forget, s_out, squashed))
            h, c = gate_out * squashed, new_c
            outs.append(h)
        return np.stack(outs, axis=1), (h, c), tape

    def backward(self, x, tape, d_out):
        """Slopes of the inputs and of ``w, u, peep, b`` for the slopes ``d_out`` of the outputs."""
        units = self.u.shape[0]
        p_in, p_forget, p_out = self.peep
        d_a_all = np.empty((x.shape[0], x.shape[1], 4 * units))
        d_u, d_peep = np.zeros_like(self.u), np.zeros_like(self.peep)
        d_h = np.zeros((x.shape[0], units))
        d_c = np.zeros_like(d_h)
        for t in reversed(range(x.shape[1])):
            h, c, new_c, cell_in, gate_in, gate_forget, gate_out, s_in, s_forget, s_out, squashed = tape[t]
            d_h = d_h + d_out[:, t]
            a_out = d_h * squashed * s_out
            d_c = d_c + d_h * gate_out * (1.0 - squashed**2) + a_out * p_out
            a_cell = d_c * gate_in * (1.0 - cell_in**2)
            a_in = d_c * cell_in * s_in
            a_forget = d_c * c * s_forget
            d_peep += np.stack([(a_in * c).sum(0), (a_forget * c).sum(0), (a_out * new_c).sum(0)])
            d_a = np.hstack([a_cell, a_in, a_forget, a_out])
            d_a_all[:, t] = d_a
            d_u += h.T @ d_a
            d_h = d_a @ self.u.T
            d_c = d_c * gate_forget + a_in * p_in + a_forget * p_forget
        flat = d_a_all.reshape(-1, 4 * units)
        d_w = x.reshape(-1, x.shape[2]).T @ flat
        return d_a_all @ self.w.T, (d_w, d_u, d_peep, flat.sum(axis=0))


@dataclass(frozen=True)
class LstmKernel:
    """Two recurrent layers, a dense rectified layer and a linear output, trained with RMSProp.

    The loss is the mean squared error over all steps. The state vector holds the
    weights and, behind them, the running squares of RMSProp, so that both are
    averaged over the workers and saved with the model.
    """

    category: str = "close"
    config: SequenceConfig = field(default_factory=SequenceConfig)

    @property
    def outputs(self) -> int:
        return len(Category.of(self.category).features)

    def _shapes(self) -> list[tuple[int, ...]]:
        c = self.config
        shapes: list[tuple[int, ...]] = []
        for inputs, units in ((len(FEATURES), c.layer1), (c.layer1, c.layer2)):
            shapes += [(inputs, 4 * units), (units, 4 * units), (3, units), (4 * units,)]
        return shapes + [(c.layer2, c.dense), (c.dense,), (c.dense, self.outputs), (self.outputs,)]

    @property
    def weight_count(self) -> int:
        return sum(int(np.prod(shape)) for shape in self._shapes())

    @property
    def state_size(self) -> int:
        return 2 * self.weight_count

    def _split(self, weights: np.ndarray) -> list[np.ndarray]:
        parts, at = [], 0
        for shape in self._shapes():
            size = int(np.prod(shape))
            parts.append(weights[at : at + size].reshape(shape))
            at += size
        return parts

    def initial_state(self, seed: int) -> np.ndarray:
        """Gaussian weights with variance 2 / (inputs + outputs); biases 0, forget gates 1."""
        rng = np.random.default_rng(seed)
        parts = []
        for shape in self._shapes():
            if len(shape) == 1:
                bias = np.zeros(shape)
                if len(parts) in (3, 7):  # the two recurrent layers
                    units = shape[0] // 4
                    bias[2 * units : 3 * units] = 1.0
                parts.append(bias)
            else:
                parts.append(rng.normal(0.0, np.sqrt(2.0 / (shape[0] + shape[1])), shape))
        weights = np.concatenate([part.ravel() for part in parts])
        return np.concatenate([weights, np.zeros(self.weight_count)])

    def _layers(self, parts):
        return _Recurrent(*parts[0:4]), _Recurrent(*parts[4:8])

    def _start(self, windows: int):
        c = self.config
        return [(np.zeros((windows, units)), np.zeros((windows, units))) for units in (c.layer1, c.layer2)]

    def _forward(self, parts, x, carried, masks):
        first, second = self._layers(parts)
        x0 = x * masks[0]
        h1, carry1, tape1 = first.forward(x0, *carried[0])
        x1 = h1 * masks[1]
        h2, carry2, tape2 = second.forward(x1, *carried[1])
        hidden = h2 @ parts[8] + parts[9]
        active = np.maximum(hidden, 0.0)
        return active @ parts[10] + parts[11], [carry1, carry2], (x0, tape1, x1, tape2, h2, hidden, active)

    def steps_predicted(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        parts = self._split(state[: self.weight_count])
        return self._forward(parts, x, self._start(len(x)), (1.0, 1.0))[0]

    def predict(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.steps_predicted(state, x)[:, -1, :]

    def loss(self, state: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean((self.steps_predicted(state, x) - y) ** 2))

    def gradient(self, weights, x, y, carried, masks=(1.0, 1.0)):
        """Slope of the loss plus half the L2 term, for one stretch of steps, and the state it ends in."""
        parts = self._split(weights)
        out, carry, (x0, tape1, x1, tape2, h2, hidden, active) = self._forward(parts, x, carried, masks)
        first, second = self._layers(parts)
        d_out = 2.0 * (out - y) / out.size
        flat_out = d_out.reshape(-1, self.outputs)
        d_active = (d_out @ parts[10].T) * (hidden > 0.0)
        flat_active = d_active.reshape(-1, self.config.dense)
        d_x1, grads2 = second.backward(x1, tape2, d_active @ parts[8].T)
        _, grads1 = first.backward(x0, tape1, d_x1 * masks[1])
        slopes = [
            *grads1,
            *grads2,
            h2.reshape(-1, self.config.layer2).T @ flat_active,
            flat_active.sum(axis=0),
            active.reshape(-1, self.config.dense).T @ flat_out,
            flat_out.sum(axis=0),
        ]
        decayed = [d + self.config.l2 * p if p.ndim > 1 else d for d, p in zip(slopes, parts)]
        return np.concatenate([d.ravel() for d in decayed]), carry

    def _masks(self, shapes, rng):
        keep = 1.0 - self.config.dropout
        if keep >= 1.0:
            return (1.0, 1.0)
        return tuple((rng.random(shape) < keep) / keep for shape in shapes)

    def step(self, state: np.ndarray, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        c = self.config
        weights, squares = state[: self.weight_count].copy(), state[self.weight_count :].copy()
        carried = self._start(len(x))
        for at in range(0, x.shape[1], c.tbptt):
            xs, ys = x[:, at : at + c.tbptt], y[:, at : at + c.tbptt]
            masks = self._masks([xs.shape, (*xs.shape[:2], c.layer1)], rng)
            slope, carried = self.gradient(weights, xs, ys, carried, masks)
            squares = c.rms_decay * squares + (1.0 - c.rms_decay) * slope**2
            weights = weights - c.learning_rate * slope / np.sqrt(squares + 1e-8)
        return np.concatenate([weights, squares])
