"""Language-model scoring: a unigram base over all words, and a gated recurrent network over the frequent ones.

Counts of all words of the training texts are gathered by a shuffle; they are a table and never come to the driver whole.
The most frequent words, at most ``KNOWN`` of them, go to every task as an array, so that only rarer words of a text meet
the table in a join.

The network reads the last word and predicts the next among the ``VOCABULARY`` most frequent words, the end, and one
class for all others; the softmax is factored into classes of words of like frequency. It is trained by backpropagation
through ``STEPS`` words at a time, state carried on from one such window to the next. Training texts are dealt by hash into
``ROUNDS`` rounds, and those of a round into shards of about ``SHARD_WORDS`` words, whatever the partitions of the input. A text goes there once, as numbers of 16 bits.
Every shard of a round trains on its texts once, in the order of their hashes, beginning from the same weights (at first
output biases from the counts), with steps that get smaller from round to round; the weights of its shards are averaged
by words seen, in a tree. Scoring carries the state through a whole text of any length. Another word costs what the
class of others costs times its share by smoothed counts, so that scores are logarithms of probabilities of the text.

Texts run side by side in lanes; a lane takes the next text when one ends, so work is even whatever the lengths.

Defined cases. Null and empty texts: the end alone. Rows without an id are scored but not learnt from. Repeated rows are
scored (and learnt from) each; rows that are equal in all columns are learnt from in one shard. Without training texts every count is zero and the network gives its first guess. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import pieces, prepare, written
from seqcast.llm.words import Words
from seqcast.session import new_table_folder

#: Words whose counts every task holds; words of the network, in classes of this many; its units.
KNOWN = 1 << 18
VOCABULARY, CLASS_WORDS, UNITS = 2048, 64, 16
#: Words of a window of training, texts side by side, and the step of the optimizer.
STEPS, LANES, RATE = 32, 512, 1.0
#: Rounds of training, after each of which weights are averaged, and words of one shard of a round, about.
ROUNDS, SHARD_WORDS = 4, 1 << 20
#: Words that a task folds into counts before it sends them on.
MOMENTUM, CLIP = 0.9, 0.25
RATES = {"inputs": 4.0, "recurrent": 0.5, "class_weights": 0.5, "class_bias": 0.5, "word_weights": 2.0, "word_bias": 2.0}
FOLD_WORDS = 1 << 21
#: Weights that one task averages, and rows that the driver averages at the end, at most.
FAN_IN = 64
END, OTHER = 0, 1
_LN10 = float(np.log(10.0))


@dataclass
class Lexicon:
    """Counts that every task holds: the most frequent words by hash, and totals of all."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray
    number: np.ndarray  # in the network's vocabulary; OTHER if not there
    texts: int  # training texts, so the count of ends
    tokens: int  # N
    distinct: int  # V
    size: int = field(default=0)  # words of the vocabulary, with END and OTHER
    inside: int = field(default=0)  # N of the words in the vocabulary, with ends
    starts: np.ndarray | None = field(default=None, init=False, repr=False)  # made by the task that asks first
    shift: np.uint64 = field(default=np.uint64(0), init=False, repr=False)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each word, and whether it is known."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        last = len(self.hashes) - 1
        if self.starts is None:  # where each of some ranges of hashes begins: one look instead of a search
            self.shift = np.uint64(64 - (4 * last + 4).bit_length())
            self.starts = np.searchsorted(self.hashes, np.arange(1 << 64 - int(self.shift), dtype=np.uint64) << self.shift)
        at = np.minimum(self.starts[hashes >> self.shift], last)
        behind = np.flatnonzero(self.hashes[at] < hashes)
        while len(behind):  # a few others in the range, since hashes are spread evenly
            behind = behind[at[behind] < last]
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < hashes[behind]]
        return at, self.hashes[at] == hashes

    def other_mass(self) -> float:
        """Smoothed count of all words that aren't in the vocabulary, unseen ones included."""
        words_inside = max(0, self.size - 2) + (1 if self.texts else 0)
        return float(self.tokens - self.inside + self.distinct - words_inside + 1)


class Network:
    """Gated recurrent units with a class-factored softmax; arrays are single precision."""

    names = ("inputs", "recurrent", "class_weights", "class_bias", "word_weights", "word_bias")

    def __init__(self, size: int, counts: np.ndarray | None = None, units: int = UNITS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.units, self.classes = units, -(-size // CLASS_WORDS)
        full = self.classes * CLASS_WORDS
        share = np.full(full, 1e-30)
        share[:size] = 1.0 if counts is None else np.maximum(counts, 0.5)
        by_class = share.reshape(self.classes, CLASS_WORDS)
        self.arrays = {
            "inputs": rng.normal(0, 0.3, (full, 3 * units)),
            "recurrent": rng.normal(0, 1 / np.sqrt(units), (units, 3 * units)),
            "class_weights": rng.normal(0, 0.05, (units, self.classes)),
            "class_bias": np.log(by_class.sum(axis=1) / share.sum()),
            "word_weights": rng.normal(0, 0.05, (self.classes, units, CLASS_WORDS)),
            "word_bias": np.log(by_class / by_class.sum(axis=1, keepdims=True)),
        }
        self.arrays = {k: v.astype(np.float32) for k, v in self.arrays.items()}
        self.held: dict[str, np.ndarray] = {}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.arrays[n].ravel() for n in self.names])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for n in self.names:
            shape = self.arrays[n].shape
            k = int(np.prod(shape))
            self.arrays[n] = values[at : at + k].reshape(shape).astype(np.float32)
            at += k
        return self

    def forward(self, state: np.ndarray, given: np.ndarray, fresh: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``fresh`` marks steps before which the state is cleared."""
        a, u = self.arrays, self.units
        out = np.empty((len(given), len(state), u), np.float32)
        # Gates are planes of their own, so that each step works on contiguous arrays.
        inputs = np.ascontiguousarray(a["inputs"].reshape(-1, 3, u).transpose(1, 0, 2))
        recurrent = np.ascontiguousarray(a["recurrent"].reshape(u, 3, u).transpose(1, 0, 2))
        half, clear = np.float32(0.5), fresh.any(axis=1).tolist()
        for t in range(len(given)):
            if clear[t]:
                state = np.where(fresh[t][:, None], np.float32(0), state)
            r = state @ recurrent
            x = inputs.take(given[t], axis=1)
            x[:2] += r[:2]
            gates = x[:2]  # the logistic function
            gates *= half
            np.tanh(gates, out=gates)
            gates *= half
            gates += half
            new = np.tanh(x[2] + gates[1] * r[2])
            if keep is not None:
                keep.append((state, gates, r[2], new))
            state = new + gates[0] * (state - new)
            out[t] = state
        return out

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array for passing results, held from call to call: fresh memory costs more than the work done in it."""
        size = prod(shape)
        if len(self.held.get(name, ())) < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)

    @staticmethod
    def _softmax(states: np.ndarray, weights: np.ndarray, high: bool, room: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials and their sums; logits of this network are seldom near what single precision can't hold."""
        np.matmul(states, weights, out=room)
        if high:
            np.minimum(room, np.float32(60), out=room)
        np.exp(room, out=room)
        return room, room @ ones + np.float32(1e-30)

    def output(self, states: np.ndarray, wanted: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of the probabilities of the wanted words, and with ``grads`` the gradient of their negative
        sum by the states."""
        a, n, u = self.arrays, len(wanted), self.units
        wanted = wanted.astype(np.uint16)
        group, inside = wanted // CLASS_WORDS, (wanted % CLASS_WORDS).astype(np.int64)
        # A unit that is always one has the biases as its weights.
        by_class = np.concatenate([a["class_weights"], a["class_bias"][None]])
        by_word = np.concatenate([a["word_weights"], a["word_bias"][:, None]], axis=1)
        reach = max(1.0, float(states.max(initial=0)), -float(states.min(initial=0)))
        high = reach * max(float(np.abs(w).sum(axis=-2).max()) for w in (by_class, by_word)) > 60  # most that a logit can be
        given = self._room("states", n, u + 1)
        given[:, :u], given[:, u] = states, 1
        odds, total = self._softmax(given, by_class, high, self._room("classes", n, self.classes), np.ones((self.classes, 1), np.float32))
        rows = np.arange(n)
        place = rows * self.classes + group
        share = odds.ravel().take(place) / total[:, 0]
        log = np.log(share)
        back = None
        if grads is not None:
            odds /= total
            odds.ravel()[place] = share - 1
            back = odds @ a["class_weights"].T
            grads["class_weights"] += states.T @ odds
            grads["class_bias"] += odds.sum(axis=0)
        # Words in the order of their classes, so that those of a class are a slice.
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group.take(order), np.arange(self.classes + 1)).tolist()
        given, inside = given.take(order, axis=0, out=self._room("sorted", n, u + 1), mode="clip"), inside.take(order)
        beside = None if grads is None else self._room("beside", n, u)
        ones = np.ones((CLASS_WORDS, 1), np.float32)
        rows *= CLASS_WORDS
        for c in range(self.classes):
            here = slice(cuts[c], cuts[c + 1])
            if here.start == here.stop:
                continue
            s, k = given[here], here.stop - here.start
            odds, total = self._softmax(s, by_word[c], high, self._room("words", k, CLASS_WORDS), ones)
            place = rows[:k] + inside[here]
            some = np.divide(odds.ravel().take(place), total[:, 0], out=share[here])
            if grads is not None:
                odds /= total
                odds.ravel()[place] = some - 1
                np.matmul(odds, a["word_weights"][c].T, out=beside[here])
                grads["word_weights"][c] += s[:, :u].T @ odds
                grads["word_bias"][c] += odds.sum(axis=0)
        places = np.empty(n, np.int64)
        places[order] = np.arange(n)
        log += np.log(share, out=share).take(places)
        if grads is not None:
            back += beside.take(places, axis=0, out=self._room("sorted", n, u), mode="clip")
        return log, back

    def backward(self, given: np.ndarray, fresh: np.ndarray, kept: list, back: np.ndarray, grads: dict) -> None:
        """Gradients of the inputs and the recurrent weights; ``back``: gradient by the state after each step."""
        a, u = self.arrays, self.units
        after = np.zeros_like(back[0])
        by_input, clear = self._room("inputs", *given.shape, 3 * u), fresh.any(axis=1).tolist()
        for t in range(len(given) - 1, -1, -1):
            state, gates, rn, new = kept[t]
            z, g = gates
            d = back[t] + after
            rest = 1 - z
            dn = d * rest * (1 - new * new)
            x = by_input[t]
            dz = state - new
            dz *= d
            dz *= z
            np.multiply(dz, rest, out=x[:, :u])
            dg = dn * rn
            dg *= g
            np.multiply(dg, 1 - g, out=x[:, u : 2 * u])
            x[:, 2 * u :] = dn
            r = x.copy()
            np.multiply(dn, g, out=r[:, 2 * u :])
            grads["recurrent"] += state.T @ r
            after = r @ a["recurrent"].T + d * z
            if clear[t]:
                after[fresh[t]] = 0
        words = given.astype(np.uint16).ravel()
        order = np.argsort(words, kind="stable")  # of 16 bits, which are sorted by digits
        words = words.take(order)
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        flat = by_input.reshape(-1, 3 * u).take(order, axis=0, out=self._room("sorted", len(words), 3 * u), mode="clip")
        grads["inputs"][words[first]] += np.add.reduceat(flat, first, axis=0)


class Lanes:
    """Texts side by side: each lane takes the next text of the stream when its own has ended. Texts are numbers of words
    with the end as the last."""

    def __init__(self, texts: Iterator[tuple[object, np.ndarray]], lanes: int = LANES, steps: int = STEPS):
        self.texts, self.lanes, self.steps = texts, lanes, steps

    def windows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """Lane numbers, words before, words wanted, fresh starts, live places, and owners (numbers into ``owners``)."""
        now: list[tuple[int, np.ndarray, int] | None] = [None] * self.lanes
        self.owners: dict[int, object] = {}
        serial, more, steps, some = 0, True, self.steps, list(range(self.lanes))
        nothing = np.full(steps, END, np.int64)
        while True:
            # A lane that is empty at the end of the texts stays so.
            tried, some = some if more else [lane for lane in some if now[lane] is not None], []
            parts, numbers, lengths, starts, before = [], [], [], [], []
            for lane in tried:
                at, text = 0, now[lane]
                last = END if text is None else text[1][text[2] - 1]
                while at < steps:
                    if text is None:
                        taken = next(self.texts, None) if more else None
                        if taken is None:
                            more = False
                            break
                        self.owners[serial] = taken[0]
                        text = (serial, taken[1], 0)
                        starts.append(len(some) * steps + at)
                        serial += 1
                    number, words, done = text
                    left = len(words) - done
                    n = min(steps - at, left)
                    parts.append(words[done : done + n])
                    numbers.append(number)
                    lengths.append(n)
                    at += n
                    text = (number, words, done + n) if n < left else None
                now[lane] = text
                if at:
                    some.append(lane)
                    before.append(last)
                    parts.append(nothing[at:])
                    numbers.append(-1)
                    lengths.append(steps - at)
            if not some:
                return
            wanted, owner = np.concatenate(parts).reshape(-1, steps), np.repeat(numbers, lengths).reshape(-1, steps)
            # A text ends with the end and begins after one, so that the word before is the one wanted before.
            given = np.concatenate([np.array(before, np.int64)[:, None], wanted[:, :-1]], axis=1)
            fresh = owner < 0
            fresh.ravel()[starts] = True
            yield np.array(some), *(np.ascontiguousarray(x.T) for x in (given, wanted, fresh, owner))


def train(network: Network, texts: Iterator[tuple[object, np.ndarray]], rate: float = RATE) -> int:
    """One pass over the texts by truncated backpropagation; returns how many words it saw."""
    lanes = Lanes(texts)
    state = np.zeros((lanes.lanes, network.units), np.float32)
    speed = {n: np.zeros_like(v) for n, v in network.arrays.items()}
    seen, step = 0, 0
    for live, given, wanted, fresh, owner in lanes.windows():
        kept: list = []
        states = network.forward(state[live], given, fresh, kept)
        state[live] = states[-1]
        grads = {n: np.zeros_like(v) for n, v in network.arrays.items()}
        real = owner >= 0
        at = np.flatnonzero(real.ravel())
        if len(at) == real.size:  # no lane has ended
            _, by_state = network.output(states.reshape(-1, network.units), wanted.ravel(), grads)
        else:
            _, back = network.output(states.reshape(-1, network.units)[at], wanted.ravel()[at], grads)
            by_state = np.zeros((real.size, network.units), np.float32)
            by_state[at] = back
        network.backward(given, fresh, kept, by_state.reshape(states.shape), grads)
        seen, step = seen + len(at), step + 1
        for n, g in grads.items():
            g /= lanes.lanes * lanes.steps  # the few long texts at the end weigh no more than any other words
            norm = float(np.sqrt((g * g).sum()))
            speed[n] *= np.float32(MOMENTUM)
            g *= np.float32(rate * RATES[n] * min(1.0, CLIP / (norm + 1e-12)))
            speed[n] -= g
            network.arrays[n] += speed[n]
        lanes.owners.clear()  # nobody asks for them here
    return seen


def score(network: Network, texts: Iterator[tuple[object, np.ndarray]]) -> Iterator[tuple[object, float]]:
    """What came with each text, and the natural logarithm of its probability, as texts end."""
    lanes = Lanes(texts)
    state = np.zeros((lanes.lanes, network.units), np.float32)
    sums: dict[int, float] = {}
    for live, given, wanted, fresh, owner in lanes.windows():
        states = network.forward(state[live], given, fresh)
        state[live] = states[-1]
        at = np.flatnonzero(owner.ravel() >= 0)
        if len(at) == owner.size:  # no lane has ended
            log, _ = network.output(states.reshape(-1, network.units), wanted.ravel())
            mine = owner.ravel().copy()
        else:
            log, _ = network.output(states.reshape(-1, network.units)[at], wanted.ravel()[at])
            mine = owner.ravel()[at]
        least = int(mine.min())
        mine -= least
        total, numbers = np.bincount(mine, log.astype(np.float64)), np.flatnonzero(np.bincount(mine))
        open_now = set(owner[-1].tolist())
        for number, value in zip((numbers + least).tolist(), total[numbers].tolist(), strict=True):
            value += sums.pop(number, 0.0)
            if number in open_now:  # it may go on in the next window
                sums[number] = value
            else:
                yield lanes.owners.pop(number), value
    for number, value in sums.items():
        yield lanes.owners.pop(number), value


def _tally(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, sorted, and how often each occurs."""
    words = np.sort(words)
    first = np.flatnonzero(np.append(True, words[1:] != words[:-1])) if len(words) else np.zeros(0, np.int64)
    return words[first], np.diff(np.append(first, len(words)))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def folded() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for part in pieces(batch.column(0)):
            held.append(Words(part, lower=True).hash)
            n += len(held[-1])
            if n >= FOLD_WORDS:
                yield folded()
                held, n = [], 0
    if n:
        yield folded()


def _numbered(words: Words, lexicon: Lexicon, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, each text's followed by the end, and where each text begins, with the end of all."""
    rows = len(words.counts)
    begin = words.first + np.arange(rows + 1)
    numbers = np.full(len(words) + rows, END, np.int64)
    numbers[np.arange(len(words)) + words.doc] = np.where(known, lexicon.number[at], OTHER) if len(lexicon.number) else OTHER
    return numbers, begin


def _coded(lexicon: Lexicon):
    """Rows (mark, numbers) of rows (mark, text): the numbers of a text's words and the end, of 16 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in pieces(batch.column(1)):
                words = Words(part, lower=True)
                at, known = lexicon.find(words.hash)
                numbers, begin = _numbered(words, lexicon, at, known)
                numbers, begin = numbers.astype("<u2"), begin.tolist()
                numbers = [numbers[a:b].tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(part)), pa.array(numbers, pa.binary())], names=["mark", "numbers"])
                start += len(part)

    return run


def _trained(size: int, weights: np.ndarray, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(size).load(weights)
        seen = train(network, ((None, np.frombuffer(n.as_buffer(), "<u2").astype(np.int64)) for batch in batches for n in batch.column(0)), rate)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]), pa.array([network.flat().tobytes()], pa.binary())], names=["part", "seen", "weights"])

    return run


def _averaged(group: pa.Table) -> pa.Table:
    seen = np.array(group.column("seen").to_pylist())
    total = sum(s * np.frombuffer(w, np.float32).astype(np.float64) for s, w in zip(seen, group.column("weights").to_pylist(), strict=True))
    part = group.column("part").to_pylist()[0] // FAN_IN
    return pa.table({"part": pa.array([part], pa.int64()), "seen": pa.array([float(seen.sum())]), "weights": pa.array([(total / seen.sum()).astype(np.float32).tobytes()], pa.binary())})


def _scored(lexicon: Lexicon, weights: np.ndarray):
    names = ["doc", "held_out", "n_tokens", "n_known", "log_known", "n_other", "log_other", "log_network", "words", "times"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.log10(lexicon.counts + 1.0)
        ends, end = lexicon.texts > 0, np.log10(lexicon.texts + 1.0)
        nothing = _tally(np.zeros(0, np.int64))

        def texts() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                start = 0
                for part in pieces(batch.column(2)):
                    words = Words(part, lower=True)
                    at, known = lexicon.find(words.hash)
                    every, begin = _numbered(words, lexicon, at, known)
                    log = np.where(known, logs[at], 0.0) if len(logs) else np.zeros(len(words))
                    n_known, n_other = words.per_text(known).tolist(), words.per_text(every[np.arange(len(words)) + words.doc] == OTHER).tolist()
                    strange = ~known
                    rare = words.hash[strange].view(np.int64)
                    cut = np.append(0, np.cumsum(words.per_text(strange))).tolist()
                    begin, first = begin.tolist(), words.first.tolist()
                    for row in range(len(part)):
                        a, b = first[row], first[row + 1]
                        numbers = every[begin[row] : begin[row + 1]]
                        k = known[a:b]
                        mine = log[a:b][k]
                        mine_rare, times = _tally(rare[cut[row] : cut[row + 1]]) if cut[row] < cut[row + 1] else nothing
                        others = mine[numbers[:-1][k] == OTHER]
                        meta = (ids[start + row], held[start + row], b - a + 1, n_known[row] + ends, float(mine.sum()) + end, n_other[row], float(others.sum()))
                        yield (meta, mine_rare, times), numbers
                    start += len(part)

        def rows(out: list) -> pa.RecordBatch:
            columns = list(zip(*[(*meta, value, rare, times) for (meta, rare, times), value in out], strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        out = []
        for done in score(Network(lexicon.size).load(weights), texts()):
            out.append(done)
            if len(out) >= 512:
                yield rows(out)
                out = []
        if out:
            yield rows(out)

    return run


def fit(docs: DataFrame, learn: Column, text: str = "text") -> tuple[DataFrame, Lexicon, np.ndarray]:
    """Counts of all words of the training texts (word, n), what tasks hold of them, and the network's weights."""
    prepare(docs.sparkSession)
    training = docs.where(learn).select(F.col(f"`{text}`").cast("string").alias("text"))
    counts = written(training.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    texts = training.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    # The most frequent words, down to a count above which there are no more than KNOWN of them: no sort of all words.
    level = F.when(F.col("n") < 256, F.col("n")).otherwise(256 + F.floor((F.log2("n") - 8) * 32))
    lowest, held = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):  # some 2,000 rows
        held += r["n"]
        if held > KNOWN:
            break
        lowest = r["level"]
    top = counts.where(level >= lowest if lowest is not None else F.lit(False)).toArrow()  # at most KNOWN rows
    hashes, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.lexsort((hashes, -n))
    hashes, n = hashes[order], n[order]
    inside = min(len(n), VOCABULARY - 2)
    number = np.full(len(n), OTHER, np.int64)
    number[:inside] = np.arange(2, 2 + inside)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], n[order], number[order], texts, int(total["tokens"]) + texts, int(total["distinct"]) + (texts > 0), 2 + inside, int(n[:inside].sum()) + texts)
    shares = np.concatenate([[texts, max(0, lexicon.tokens - lexicon.inside)], n[:inside]]).astype(np.float64)
    weights = Network(lexicon.size, shares).flat()
    small = lexicon.number != OTHER
    near = Lexicon(lexicon.hashes[small], lexicon.counts[small], lexicon.number[small], 0, 0, 0)
    dealt = docs.where(learn).select(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("mark"), F.col(f"`{text}`").cast("string").alias("text"))
    coded = dealt.mapInArrow(_coded(near), "mark long, numbers binary").withColumn("round", F.pmod(F.xxhash64(F.lit("round"), "mark"), F.lit(ROUNDS)).cast("int"))
    path = new_table_folder(docs.sparkSession, "coded")
    coded.write.option("compression", "zstd").partitionBy("round").parquet(path)
    coded = docs.sparkSession.read.schema(coded.schema).parquet(path)
    shards = max(1, round(lexicon.tokens / (ROUNDS * SHARD_WORDS)))
    for r in range(ROUNDS):
        share = coded.where(F.col("round") == r).repartition(shards, "mark").sortWithinPartitions("mark", "numbers").select("numbers")
        weights = _round(share, lexicon.size, weights, RATE * (ROUNDS - r) / ROUNDS)
    return counts, lexicon, weights


def _round(shards: DataFrame, size: int, weights: np.ndarray, rate: float) -> np.ndarray:
    """The weights after every partition has trained on its texts, averaged by words seen."""
    rows = written(shards.mapInArrow(_trained(size, weights, rate), "part long, seen double, weights binary"), "weights")
    while rows.count() > FAN_IN:
        rows = written(rows.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(lambda g: _averaged(g), "part long, seen double, weights binary"), "weights")
    found = sorted(rows.collect(), key=lambda r: r["part"])  # at most FAN_IN rows
    if not found:
        return weights
    seen = sum(r["seen"] for r in found)
    return (sum(r["seen"] * np.frombuffer(r["weights"], np.float32).astype(np.float64) for r in found) / seen).astype(np.float32)


def score_texts(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, weights: np.ndarray, key: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per document: key, held_out, n_tokens, n_known, train_tokens, base_score and score, all logarithms to
    base 10 over whole texts. The key must be integral."""
    prepare(docs.sparkSession)
    held = F.lit(False) if held_out is None else held_out
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("doc"), held.alias("held_out"), F.col(f"`{text}`").cast("string").alias("text"))
    columns = "doc long, held_out boolean, n_tokens long, n_known long, log_known double, n_other long, log_other double, log_network double, words array<long>, times array<long>"
    # A number for each row, fixed by the written table, so that repeated rows stay apart.
    rows = written(slim.mapInArrow(_scored(lexicon, weights), columns), "scores")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_log"))
    found = rows.drop("words", "times").join(met, "row", "left")
    rare_log, rare_known = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    base = F.col("log_known") + rare_log - F.col("n_tokens") * float(np.log10(lexicon.tokens + lexicon.distinct + 1))
    others = F.col("log_other") + rare_log - F.col("n_other") * float(np.log10(lexicon.other_mass()))
    return found.select(
        F.col("doc").alias(key), "held_out", "n_tokens", (F.col("n_known") + rare_known).cast("long").alias("n_known"),
        F.lit(lexicon.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_network") / _LN10 + others).alias("score"),
    )
