"""Small tables with the awkward rows that every operator has to bear."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
#: Names that operators use for columns of their own.
CLASHING = ("quality", "lines", "contamination", "predicted", "doc", "mark", "node", "component", "words", "ids", "near_duplicate_of", "place", "_row", "Text2", "lines_doc_", "lines__doc", "lines__runs", "_salt")

VOCABULARY = [a + b + c for a in ("ba", "ki", "lo", "mu", "ne") for b in ("ra", "si", "to") for c in ("", "n", "st", "x")]


def prose(rng, n, end="."):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n)) + end


def texts(seed=1):
    """Plain, copied, edited, chained, short, blank and very long texts, with passages and runs of lines in common."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    run = [prose(rng, 6) for _ in range(5)]
    out = []
    for _ in range(25):
        out.append("\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 8))))
    out += [out[3], out[3], out[7].upper(), out[5] + " " + passage, passage, "Intro here.\n" + passage + "\nMore after it."]
    base = prose(rng, 120).split(" ")
    for k in range(12):  # a chain of small edits, so that its ends differ a lot
        base = [*base[:k * 9], f"edit{k}", *base[k * 9 + 1 :]]
        out.append(" ".join(base))
    out += ["\n".join([prose(rng, 5), *run, prose(rng, 4)]), "\n".join([*run, prose(rng, 9)]), "\n".join([prose(rng, 3), "", *run[1:4], " "]), "\n".join(run), "\n".join(["same line."] * 7)]
    out += [None, "", " ", "\n\n\t", "one", "one two three", "One two three", "one two three four", "a b c d e", "!!! ... 123 ---", "é ü ß 語 語 語", "a  b\t\tc \x0b d", "<|endoftext|> it's \r\n 'x'  "]
    long = prose(rng, 30_000)
    out += [long, long[: len(long) // 2], "x" * 200_000]
    return out


def rows(seed=1):
    found = [(k * 3 % 97 + 100 * (k // 97), t, rng_lang(t), None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts(seed))]
    return found + [found[4], found[4], (None, found[2][1], None, None, None), (None, None, None, None, None)]


def rng_lang(text):
    return None if not text or len(text) < 20 else ("en", "de")[len(text) % 2]


def documents(spark, found=None):
    """Documents with further columns under clashing names."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows() if found is None else found, SCHEMA)
    return frame.select("*", *(F.lit(f"extra {c}").alias(c) for c in CLASHING))


def plain(found=None):
    """(id, text) of the same rows."""
    return [(r[0], r[1]) for r in (rows() if found is None else found)]


def same(left, right):
    """Equal as bags, whatever the nulls."""
    key = repr
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)
