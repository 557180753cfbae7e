"""Language identification by hierarchical discrimination: the family first, then one-versus-one linear support vector
machines between the languages of that family.

A text is its letters' byte n-grams: shares of single bytes and of hashed pairs and triples, over the whole text, under a
square root (so that a frequent n-gram does not drown the rest). Families are told apart by one support vector machine
each against the rest; inside a family every pair of languages has a machine of its own, and the language with the
most won pairs is taken, margins breaking ties.

The machines are fitted on a bounded sample of the different labelled texts, ``SAMPLE_ROWS`` in all: of each language the
same number, those with the least hash, however often a text is repeated. Only their feature vectors come to the driver.
Every row is then judged in full.

Defined cases. Null text, or text without a letter: ``und`` with score 0. Rows without a label, or without an id, are not
learnt from. With no labelled row at all every text is ``und``; with one language, texts with letters are that language
with score 1. Languages of no listed family make one family together, called other. Repeated rows are judged each. A sample of fewer rows than languages takes one text of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, pieces, prepare, written

#: Rows that the machines are fitted on at most, over all languages together.
SAMPLE_ROWS = 4000
#: Buckets of hashed pairs and triples; 256 single bytes come on top.
HASHED = 1 << 12
#: How fast a margin turns into certainty.
SHARPNESS = 3.0
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("am", "ar", "he", "mt"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "dravidian": ("kn", "ml", "ta", "te"),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
#: Bytes by class: ASCII letters lower-cased, everything else in ASCII a space, other bytes themselves.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def family(language: str) -> str:
    return _FAMILY_OF.get(language.lower().replace("_", "-").split("-")[0], "other")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(texts: pa.Array) -> np.ndarray:
    """One row of single-precision features for each text of a slice without nulls."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    data = texts.buffers()[2] if n else None
    raw = _FOLD[np.frombuffer(data, np.uint8)[places[0] : places[-1]]] if data else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(n), np.diff(places))
    out = np.zeros((n, 256 + HASHED), np.float32)
    width = out.shape[1]
    a = raw.astype(np.uint32)
    words = a != 32
    base = row * width
    flat = np.bincount(base[words] + a[words], minlength=n * width)
    for size in (2, 3):
        if len(a) < size:
            continue
        # Runs of separators say nothing; a separator on one side marks the edge of a word.
        code = a[: len(a) - size + 1] * np.uint32(0x9E3779B1)
        some = words[: len(code)].copy()
        for k in range(1, size):
            code = (code ^ a[k : len(a) - size + 1 + k]) * np.uint32(0x85EBCA6B)
            some |= words[k : k + len(code)]
        some &= row[: len(code)] == row[size - 1 :]
        bucket = (code[some] >> np.uint32(32 - HASHED.bit_length() + 1)).astype(np.int64) + 256
        flat += np.bincount(base[: len(code)][some] + bucket, minlength=n * width)
    counts = flat.reshape(n, width).astype(np.float32)
    out = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 100.0, steps: int = 300, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, its classes weighted alike; y is -1 or 1.

    With ``rows`` it is fitted on these rows of ``x``, of which it holds one copy in single precision."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32) * c
    chosen = np.arange(len(x)) if rows is None else np.flatnonzero(rows)
    own = np.empty((len(chosen), x.shape[1]), np.float32 if x.dtype == np.float16 else x.dtype)
    for k in range(0, len(own), 256):
        own[k : k + 256] = x[chosen[k : k + 256]]
    x = own
    mean = x.mean(axis=0)
    x -= mean
    longest = max((float((x[k : k + 256] ** 2).sum(axis=1).max()) for k in range(0, len(x), 256)), default=0.0)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    ahead_w, ahead_b, t = w, b, 1.0
    rate = 1.0 / (1.0 / c + 2 * c * (1 + longest))  # no steeper than the bound of the curvature
    for _ in range(steps):  # accelerated gradient descent
        slack = np.maximum(0, 1 - y * (x @ ahead_w + ahead_b)) * weight
        grad_w = ahead_w / c - 2 * ((slack * y) @ x)
        grad_b = -2 * float((slack * y).sum())
        new_w, new_b = ahead_w - rate * grad_w, ahead_b - rate * grad_b
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w = new_w + (t - 1) / later * (new_w - w)
        ahead_b = new_b + (t - 1) / later * (new_b - b)
        w, b, t = new_w.astype(np.float32), new_b, later
    return w, b - float(mean @ w)


class Model:
    """All machines: one for each family against the rest, one for each pair of languages inside a family."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        self.families = sorted({family(g) for g in self.languages})
        self.members = {f: [g for g in self.languages if family(g) == f] for f in self.families}
        y = np.array(languages, object)
        fam = np.array([family(g) for g in languages], object)
        weights, biases = [], []

        def add(rows: np.ndarray, positive: np.ndarray) -> int:
            w, b = fit_machine(x, np.where(positive[rows], 1, -1).astype(np.float32), rows=rows)
            weights.append(w)
            biases.append(b)
            return len(weights) - 1

        every = np.ones(len(y), bool)
        self.of_family = {f: add(every, fam == f) for f in self.families} if len(self.families) > 1 else {}
        self.of_pair = {p: add((y == p[0]) | (y == p[1]), y == p[0]) for f in self.families for p in combinations(self.members[f], 2)}
        width = 256 + HASHED
        self.weights = np.stack(weights, axis=1) if weights else np.zeros((width, 0), np.float32)
        self.biases = np.array(biases, np.float32)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and certainty of each row of features."""
        n = len(x)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        sure = 1 / (1 + np.exp(-SHARPNESS * (x @ self.weights + self.biases).astype(np.float64)))
        if self.of_family:
            by_family = sure[:, [self.of_family[f] for f in self.families]] + 1e-9
            best = by_family.argmax(axis=1)
            certainty = by_family[np.arange(n), best] / by_family.sum(axis=1)
        else:
            best, certainty = np.zeros(n, np.int64), np.ones(n)
        out: list[str] = [UNKNOWN] * n
        for i, f in enumerate(self.families):
            rows, members = np.flatnonzero(best == i), self.members[f]
            if not len(rows):
                continue
            won, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for (a, b), k in self.of_pair.items():
                if a in members:
                    p, i_a, i_b = sure[rows, k], members.index(a), members.index(b)
                    won[:, i_a] += p > 0.5
                    won[:, i_b] += p <= 0.5
                    total[:, i_a] += p
                    total[:, i_b] += 1 - p
            chosen = (won + total / (len(members) + 1)).argmax(axis=1)
            if len(members) > 1:
                certainty[rows] *= total[np.arange(len(rows)), chosen] / (len(members) - 1)
            for r, m in zip(rows.tolist(), chosen.tolist(), strict=True):
                out[r] = members[m]
        return out, np.clip(certainty, 0, 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for part in pieces(batch.column(1)) for r in features(part).astype(np.float16)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["lang", "features"])


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fits the machines on at most ``sample_rows`` of the rows for which ``learn`` holds and the label is not null."""
    prepare(docs.sparkSession)
    whole = F.col(f"`{text}`").cast("string")
    labelled = docs.where(learn & F.col(f"`{lang}`").isNotNull() & whole.rlike(r"\p{L}")).select(F.col(f"`{lang}`").cast("string").alias("lang"), whole.alias("text"), F.xxhash64(whole).alias("draw"))
    draws = labelled.select("lang", "draw").distinct()
    each = max(1, sample_rows // max(1, draws.select("lang").distinct().count()))
    for shares in (512, 8, 1):  # least of shares first, so that no task ranks all texts of a language
        nth = F.row_number().over(Window.partitionBy("lang", F.pmod("draw", F.lit(shares))).orderBy("draw"))
        draws = draws.withColumn("nth", nth).where(F.col("nth") <= each).drop("nth")
    chosen = written(draws, "draws")  # at most sample_rows
    drawn = labelled.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    used = drawn.select("lang", "text").mapInArrow(_sampled, "lang string, features binary").collect()
    used.sort(key=lambda r: (r["lang"], r["features"]))
    languages = [r["lang"] for r in used]
    x = np.stack([np.frombuffer(r["features"], np.float16) for r in used]) if used else np.zeros((0, 256 + HASHED), np.float16)
    del used  # the driver holds the sample once, in half precision, and the rows of one machine in single precision
    return Model(x, languages)


def _predicted(model: Model):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            languages, scores = [], []
            for part in pieces(column):
                letters = [has_letter(t) for t in part.to_pylist()]
                found, sure = model.predict(features(part))
                languages += [g if ok else UNKNOWN for g, ok in zip(found, letters, strict=True)]
                scores += [s if ok else 0.0 for s, ok in zip(sure.tolist(), letters, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return F.arrow_udf(run, "lang string, score double")


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with a struct column ``predicted`` (underscores follow if the name is taken) as their last: lang and
    score. Nothing but the text is looked at."""
    prepare(docs.sparkSession)
    return docs.select("*", _predicted(model)(F.col(f"`{text}`").cast("string")).alias(fresh(docs, "predicted")))


def held_out(key: str = "doc_id") -> Column:
    """Rows that are not learnt from: the id's checksum leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % 4 == 2, F.lit(False))


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.0) -> DataFrame:
    """The documents, with their columns, whose language is known: not ``und``, and with a score of ``least`` or more."""
    learn = ~held_out(key) & F.col(f"`{key}`").isNotNull()
    judged = predict(docs, fit(docs, learn, key, text, lang), text)
    verdict = F.col(f"`{judged.columns[-1]}`")
    return judged.where((verdict["lang"] != UNKNOWN) & (verdict["score"] >= least)).select(*(F.col(f"`{c}`") for c in docs.columns))
