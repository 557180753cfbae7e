"""Operators that compare, cut or judge texts, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcast.llm import components, decontam, linededup, neardup, quality, substrings
from tests.llm import brute, cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


def bare(rows):
    return [tuple(r) for r in rows]


def test_near_duplicates(docs):
    found = neardup.near_duplicates(docs).collect()
    cases.same(bare(found), brute.near_duplicates(cases.plain()))


@pytest.mark.parametrize("pivots_from", [1, 100])
def test_near_duplicates_in_blocks(docs, monkeypatch, pivots_from):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "PIVOT_BLOCKS", pivots_from)
    cases.same(bare(neardup.near_duplicates(docs).collect()), brute.near_duplicates(cases.plain()))


def test_near_duplicates_of_many_edited_copies(spark):
    rng = random.Random(3)
    base = cases.prose(rng, 150).split(" ")
    rows = []
    for k in range(300):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cases.same(bare(found), brute.near_duplicates(rows))


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    for size in (60, 400, 3000):
        for share in (0.6, 0.85, 0.95):
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            common = int(size * 2 * share / (1 + share))
            a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:common], pool[size : 2 * size - common]]))
            times = neardup.fold(size)
            close = neardup.estimate(neardup.sketch(a, times), neardup.sketch(b, times)[None, :], len(a), np.array([len(b)]))[0]
            assert abs(close - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < neardup.MARGIN


def test_without_near_duplicates(docs):
    left = neardup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    stay = {r[0] for r in brute.near_duplicates(cases.plain()) if r[3]}
    cases.same([(r["doc_id"], r["text"]) for r in left.collect()], [r for r in cases.plain() if r[0] in stay])


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 960)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = sorted((top(u), top(v)))
        parent[b] = a
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    alone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    cases.same(bare(found), [(x, top(x)) for x in parent if x not in alone])
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_passages(docs):
    found = substrings.remove_repeats(docs)
    cases.same(bare(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), brute.repeats(cases.plain()))
    for r in found.where("n_removed > 0").collect():
        assert sum(r["lengths"]) == r["n_removed"] and min(r["lengths"]) >= substrings.WINDOW
        assert len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]


@pytest.mark.parametrize(("size", "anchor"), [(4, 4), (8, 1), (20, 5)])
def test_repeated_passages_of_other_sizes(docs, size, anchor):
    found = substrings.remove_repeats(docs, size=size, anchor=anchor)
    cases.same(bare(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), brute.repeats(cases.plain(), size))


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_line_dedup(docs, least):
    judged = linededup.line_dedup(docs, min_lines=least)
    own = judged.columns[-1]
    assert own == "lines_" and judged.columns[:-1] == docs.columns
    cases.same(bare(judged.select("doc_id", f"{own}.n_lines", f"{own}.n_removed", f"{own}.kept_text").collect()), brute.line_dedup(cases.plain(), least))


def test_line_dedup_runs_no_python(docs):
    plan = linededup.line_dedup(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_without_repeated_lines(docs):
    left = linededup.without_repeated_lines(docs)
    assert left.columns == docs.columns and left.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    expected = [(i, t) for i, n, gone, t in brute.line_dedup(cases.plain()) if not gone or gone < n]
    cases.same([(r["doc_id"], r["text"]) for r in left.collect()], expected)
    assert left.where("n_chars != length(text)").count() == 0


ITEMS = [(1, "one two three"), (2, cases.prose(random.Random(8), 30)), (2, "one two three"), (30, None), (4, ""), (None, "a b c d"), (5, "x" * 200_000)]


@pytest.mark.parametrize(("block_bytes", "group"), [(1 << 20, 16), (100_000, 16), (100_000, 1)])
def test_contamination(spark, docs, block_bytes, group, monkeypatch):
    monkeypatch.setattr(decontam, "GROUP_BLOCKS", group)
    passage = cases.texts()[30]
    items = [*ITEMS, (100, passage.upper()), (7, " ".join(passage.split()[3:17]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    found = decontam.contamination(docs, bench, block_bytes=block_bytes)
    own = found.columns[-1]
    assert own == "contamination_" and found.columns[:-1] == docs.columns
    digest = found.select("doc_id", f"{own}.n_words", decontam.contamination_digest(own).alias("d"))
    rows = digest.select("doc_id", "n_words", "d.n_hit", "d.n_items", "d.items_sha256", (F.col("d.n_hit") > 0)).collect()
    expected = brute.contamination(cases.plain(), items)
    assert sum(r[5] for r in expected) > 5
    cases.same(bare(rows), expected)
    left = decontam.decontaminated(docs, bench)
    assert left.columns == docs.columns
    cases.same([(r["doc_id"], r["text"]) for r in left.collect()], [p for p, e in zip(cases.plain(), expected, strict=True) if not e[5]])


def test_a_large_benchmark_takes_two_passes(spark, docs, monkeypatch):
    rng = random.Random(9)
    items = [(k, cases.prose(rng, 500)) for k in range(250)] + [(900, cases.texts()[30])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    held, counted = sum(len(t) for _, t in items), []
    by_rarest = decontam._by_rarest
    monkeypatch.setattr(decontam, "_by_rarest", lambda texts, group: counted.append(len(group)) or by_rarest(texts, group))
    found = decontam.contamination(docs, bench, block_bytes=held // 9)
    assert counted == [14]  # one pass that counts for all blocks
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan  # and one that matches
    digest = found.select("doc_id", f"{found.columns[-1]}.n_words", decontam.contamination_digest(found.columns[-1]).alias("d"))
    rows = digest.select("doc_id", "n_words", "d.n_hit", "d.n_items", "d.items_sha256", (F.col("d.n_hit") > 0)).collect()
    cases.same(bare(rows), brute.contamination(cases.plain(), items))


def test_contamination_by_nothing(spark, docs):
    bench = spark.createDataFrame([(1, None)], "item_id long, text string")
    found = decontam.contamination(docs, bench)
    assert found.where(F.size(f"{found.columns[-1]}.begins") > 0).count() == 0 and found.count() == len(cases.rows())


def test_quality_counts(docs):
    judged = quality.line_clean(docs)
    own = judged.columns[-1]
    assert own == "quality_" and judged.columns[:-1] == docs.columns
    found = judged.select("text", *(f"{own}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))).collect()
    assert len(found) == len(cases.rows())
    for r in found:
        assert tuple(r)[1:7] == brute.quality(r["text"])
        assert not (r["kept"] and r["base_failed"])


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        ("", "empty"),
        ("Home | News | Sport | About | Contact", "navigation"),
        ("This%%% is&&& not*** clean### text$$$ at### all***", "symbols"),
        ("BUY NOW!! THE BEST OFFERS OF THE YEAR!!", "shouting"),
        ("spam spam spam spam spam spam eggs spam spam spam", "stutter"),
        ("go go go go go now now now now now then then then then", "stutter"),
        ("Licensed under CC BY 4.0.", "boilerplate"),
        ("Main menu", "punctuation"),
        ("A plain line of text that says something, and ends.", None),
        ("A line of prose without its full stop at the end", None),
        ("He paid $5 & left.", None),
        ("NASA and ESA agreed.", None),
    ],
)
def test_line_rules(line, reason):
    assert quality.judge(line, quality.split_words(line), set(), quality.Rules()) == reason


def test_quality_verdict(spark):
    good = "\n".join(cases.prose(random.Random(k), 30) for k in range(4))
    menu = "\n".join(["Home | News | Sport | About | Contact us"] * 3 + [cases.prose(random.Random(9), 5)] * 6)
    found = quality.line_clean(spark.createDataFrame([(1, good), (2, good + "\nAll rights reserved."), (3, menu)], "doc_id long, text string")).select("doc_id", "quality.*").collect()
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["kept"] and by_id[1]["kept_text"] == good and by_id[1]["kept_share"] == 1
    assert by_id[2]["kept"] and by_id[2]["kept_text"] == good and by_id[2]["failed_lines"] == {"boilerplate": 1}
    assert not by_id[3]["kept"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.without_near_duplicates(none).count() == 0
    assert substrings.remove_repeats(none).count() == 0
    assert linededup.line_dedup(none).count() == 0
    assert linededup.without_repeated_lines(none).count() == 0
    assert decontam.contamination(none, bench).count() == 0
    assert quality.line_clean(none).count() == 0


def test_passages_that_documents_repeat_under_hot_anchors(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 1)
    rng = random.Random(6)
    passage = cases.prose(rng, 20)
    rows = [(k, " ".join([cases.prose(rng, 5), *[passage] * (k % 4 * 9), "same " * 60, cases.prose(rng, 5)])) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = substrings.remove_repeats(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    cases.same(bare(found), brute.repeats(rows))


def test_repeated_passages_of_hot_anchors(docs, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ROWS", 1)  # every anchor
    monkeypatch.setattr(substrings, "SHARES", 3)
    found = substrings.remove_repeats(docs, with_text=False)
    cases.same(bare(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), brute.repeats(cases.plain()))


def test_factors_copy_their_reference(docs):
    by_id = {}
    for i, t in cases.plain():
        by_id.setdefault(i, []).append(brute.words(t))
    found = [r for r in substrings.remove_repeats(docs).collect() if r["n_removed"]]
    for r in found:
        covered = set()
        for f in r["factors"]:
            assert f["reference"] < r["doc_id"] and f["length"] >= substrings.WINDOW
            own = {tuple(w[f["begin"] : f["begin"] + f["length"]]) for w in by_id[r["doc_id"]]}
            theirs = {tuple(w[f["position"] : f["position"] + f["length"]]) for w in by_id[f["reference"]]}
            assert own & theirs
            covered.update(range(f["begin"], f["begin"] + f["length"]))
        assert len(covered) == r["n_removed"]
    whole = max(found, key=lambda r: r["n_words"])  # half of the longest text is a copy of the other's begin
    assert max(f["length"] for f in whole["factors"]) > 1000
