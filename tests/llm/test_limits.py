"""Cases at the limits of the operators' rules, against plain Python."""

import random

import pytest

import corpus_pipeline
from seqcast.llm import linededup, neardup, packing, tokenfiles
from tests.llm import brute, cases


def linked(rows, percent):
    """rows (id, text), ids ascending -> (id, shingles, component, kept) by the rule alone."""
    sets, top = {i: brute.shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i in sets:
        for j in sets:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return [(i, len(s), top[i], top[i] == i) for i, s in sets.items()]


def short_texts():
    """Texts of few shingles, each with copies that have a word or two more, and a repetitive one."""
    rng, rows = random.Random(21), ["a b c d e f g h i j", "a b c d e f g h i j k"]
    for n in range(3, 16):
        for _ in range(4):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            rows += [" ".join(words + [f"x{k}" for k in range(more)]) for more in range(3)]
    rows += ["p q r s t u " * 40, "p q r s t u " * 40 + "more"]
    return list(enumerate(rows))


def test_small_sets_link(spark):
    rows = short_texts()
    expected = linked(rows, 85)
    assert expected[1] == (1, 7, 0, False)
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cases.same([tuple(r) for r in found], expected)
    assert neardup.links_others(6) and not neardup.links_others(5)


def test_stage_drops_from_four_fifths_on(spark):
    rng, base = random.Random(4), cases.prose(random.Random(5), 150).split(" ")
    rows = short_texts()
    for k in range(150):
        copy = list(base) if k % 2 else cases.prose(rng, 60).split(" ")
        edited = list(copy)
        for _ in range(3 if k % 2 else 1):
            edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
        rows += [(len(rows) + j, " ".join(x)) for j, x in enumerate((copy, edited))]
    stay, by_op1 = ({r[0] for r in linked(rows, p) if r[3]} for p in (80, 85))
    assert len(stay) < len(by_op1) - 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], cases.SCHEMA)
    cases.same([(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()], [r for r in rows if r[0] in stay])
    cases.same([tuple(r) for r in neardup.near_duplicates(docs, percent=80).collect()], linked(rows, 80))


def test_bands_follow_the_threshold():
    assert neardup.banding(85) == (25, 5) and neardup.banding(80) == (32, 4)
    assert neardup.margin(85) == neardup.MARGIN and neardup.margin(80) > 0.176
    assert neardup.links_others(4, 80) and not neardup.links_others(3, 80)


def long_runs(rows, least, words):
    """rows (id, text) in order -> (id, text that stays): later copies of ``least`` lines, or fewer with enough words, go."""
    first, out = {}, []
    found = [(i, brute.lines(t)) for i, t in rows]
    for i, x in found:
        for h in range(1, least + 1):
            for k, run in enumerate(brute.windows(x, h)):
                first.setdefault(run, (i, k))
    for (i, x), (_, t) in zip(found, rows, strict=True):
        gone = set()
        for h in range(1, least + 1):
            for k, run in enumerate(brute.windows(x, h)):
                if first[run] < (i, k) and (h == least or len(brute.words("\n".join(run))) >= words):
                    gone.update(range(k, k + h))
        if len(gone) < len(x) or not x:
            out.append((i, t if not gone else "\n".join(y for k, y in enumerate(x) if k not in gone)))
    return out


def texts_with_long_lines():
    rng = random.Random(31)
    long, just, below = (cases.prose(rng, n) for n in (80, 50, 49))
    two, short = [cases.prose(rng, 25), cases.prose(rng, 30)], "Read more below."
    texts = [cases.prose(rng, 9) + "\n" + long, long, "Other start.\n" + long + "\n" + short, just, just, below, below, short, short]
    texts += ["\n".join([cases.prose(rng, 7), *two]), "\n".join([*two, cases.prose(rng, 8)]), two[0] + "\n" + short, f"{long}\n{cases.prose(rng, 4)}\n{long}", "", " "]
    run = [cases.prose(rng, 20) for _ in range(4)]
    return list(enumerate([*texts, "\n".join(run), "\n".join([cases.prose(rng, 3), *run[1:], cases.prose(rng, 3)])]))


@pytest.mark.parametrize("least", [3, 5])
def test_runs_of_few_long_lines(spark, least):
    rows = texts_with_long_lines()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], cases.SCHEMA)
    left = linededup.without_repeated_lines(docs, min_lines=least, min_words=50)
    expected = long_runs(rows, least, 50)
    cases.same([(r["doc_id"], r["text"]) for r in left.collect()], expected)
    assert {1, 4} & {i for i, _ in expected} == set() and {5, 6, 7, 8} <= {i for i, _ in expected}
    if least == 3:
        cases.same([(r["doc_id"], r["text"]) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()], expected)


def test_bins_hold_a_class():
    bins = packing.Bins(2048, 0)
    closed = [bins.put((k, 0, 500 + k % 2)) for k in range(8)]  # 2048 // 500 == 2048 // 501 == 4
    assert [len(c) for c in closed] == [0, 0, 0, 4] * 2 and not bins.open
    mixed = [bins.put((k, 0, 511 + k % 2)) for k in range(6)]  # one class, but 512 fills its bins without a gap
    assert mixed == [[]] * 6 and len(bins.open) == 2


def test_tails_share_one_open_bin():
    bins = packing.Bins(2048, 0)
    closed = [bins.put((k, 0, 50 + k % 2)) for k in range(41)]
    assert closed[:-1] == [[]] * 40 and len(closed[-1]) == 40  # 2,020 tokens, and the next did not fit
    assert [r[-1] for r in closed[-1]][:3] == [0, 50, 101] and len(bins.tails) == 1
    assert [len(rows) for rows in bins.rest()] == [1] and not bins.tails


def test_strings_of_special_tokens_are_tokens(spark):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", " a\n<|endoftext|>b", "<|endof text|>", "plain  text"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["ids"] for r in packing.pack(rows).collect()}
    for i, t in enumerate(texts):
        want = brute.ids(t, 1)
        assert found[i] == b"".join(x.to_bytes(4, "little") for x in want), t
    assert 50256 in brute.ids(texts[0], 1)


def test_ids_that_the_files_cannot_hold(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(Exception, match="16 bits"):
        tokenfiles.write_ids(rows, end_id=1 << 16)


def near_copies(n, length=200, edits=6, seed=11):
    """Different near copies of one text, and some that are further from it but near each other."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    rows = []
    for k in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 2) if k % 10 else edits):
            copy[rng.randrange(length)] = f"new{rng.randrange(10**7)}"
        rows.append((k, " ".join(copy)))
        if k % 10 == 0:
            copy[rng.randrange(length)] = f"twin{k}"
            rows.append((n + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("percent", [85, 30, 20])
def test_large_groups_by_pivots(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PIVOTS", 3)
    monkeypatch.setattr(neardup, "PIVOT_BLOCKS", 1)
    rows = sorted(near_copies(120))
    if percent < 50:
        rng = random.Random(5)
        for n in (4, 9, 20, 31, 60, 150):  # sets whose sizes lie folds apart
            words = [f"s{rng.randrange(10**6)}" for _ in range(n)]
            rows += [(1000 + 10 * n, " ".join(words)), (1001 + 10 * n, " ".join([*words, *(f"t{rng.randrange(10**6)}" for _ in range(int(n * 2.2)))]))]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()
    cases.same([tuple(r) for r in found], linked(rows, percent))


def test_near_copies_cost_a_few_comparisons_each(spark, monkeypatch):
    """Beyond the pivots, only members without a near one are compared with the group."""
    seen = []
    real = neardup.written

    def written(df, name):
        out = real(df, name)
        if name == "distances":
            seen.append(out.groupBy("alone").count().collect())
        return out

    monkeypatch.setattr(neardup, "written", written)
    monkeypatch.setattr(neardup, "BLOCK", 64)
    monkeypatch.setattr(neardup, "PIVOT_BLOCKS", 4)
    rows = [r for r in near_copies(1500, edits=2) if r[0] < 1500]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in found} == {0}
    alone = {r["alone"]: r["count"] for r in seen[0]}
    assert alone.get(True, 0) < 0.05 * alone[False]
