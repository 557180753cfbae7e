"""The pipeline against plain Python, and every query that has a SQL form against DuckDB."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqcast.llm import langid, linededup, neardup
from seqcast.llm.oracle import ORACLE
from seqcast.llm.queries import REGISTRY
from tests.llm import brute, cases
from tests.llm.test_limits import linked, long_runs

SF_DIR = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{SF_DIR}/{table}.parquet')")
    got = REGISTRY[name](spark, SF_DIR)
    want = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    cases.same([tuple(r[c] for c in want.columns) for r in got.collect()], want.fetchall())


def test_language_query(spark):
    found = REGISTRY["op2_language_id"](spark, SF_DIR).join(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert len(rows) > 30 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.9 * len(rows)


def test_token_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    start = 0
    for r in REGISTRY["op4_token_files"](spark, SF_DIR).orderBy("doc_id").collect():
        ids = brute.ids(texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)
    pieces = {}
    for r in REGISTRY["op10_packing"](spark, SF_DIR).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(texts)
    for key, found in pieces.items():
        ids, end = brute.ids(texts[key], 1), 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == end and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == brute.crc(ids[end : end + r["length"]])
            end += r["length"]
        assert end == len(ids)


def test_quality_query_agrees_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = REGISTRY["op8_quality_rules"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("n_words >= 20").collect()
    assert sum(r["kept"] for r in rows if r["quality"] == 1) >= 0.99 * sum(r["quality"] == 1 for r in rows)
    assert sum(not r["kept"] for r in rows if r["quality"] == 0) >= 0.9 * sum(r["quality"] == 0 for r in rows)
    assert docs.count() == 1000


def brute_pipeline(rows, items):
    """Ids with the texts that get to packing, by the stages' own rules; ``rows`` (id, text), ids ascending, hold no text
    that a language is in doubt for."""
    rows = [(i, t) for i, t in rows if t and langid.has_letter(t)]
    rows = long_runs(rows, linededup.MIN_LINES, linededup.MIN_WORDS)
    kept = {r[0] for r in linked(rows, neardup.STAGE_PERCENT) if r[3]}
    rows = [(i, t) for i, t in rows if i in kept]
    return [(i, t) for (i, t), c in zip(rows, brute.contamination(rows, items), strict=True) if not c[5]]


def corpus(rng):
    clean = ["\n".join(cases.prose(rng, rng.randint(5, 25)) for _ in range(rng.randint(2, 7))) for _ in range(30)]
    run = "\n".join(cases.prose(rng, 6) for _ in range(4))
    near = clean[2].split(" ")
    near[3] = "changed"
    wide = cases.prose(rng, 100).split(" ")
    edited = [f"new{k}" if k in (30, 60) else x for k, x in enumerate(wide)]  # 86 of 106 shingles in common
    passage = cases.prose(rng, 70)  # a line long enough to count alone
    texts = [*clean, " ".join(wide), " ".join(edited), "Begin so.\n" + passage, "Or so.\n" + passage + "\nAnd end.", passage, clean[0], run + "\n" + clean[4] + "x", clean[5] + "\n" + run, " ".join(near), clean[8].upper(), "12 34 !!", "", None, "\n".join(clean[9:11])]
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], [(1, clean[20].split("\n")[0]), (2, "no such words here")]


def test_stages_and_run(spark, tmp_path):
    rows, items = corpus(random.Random(12))
    frame = spark.createDataFrame(rows, cases.SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    expected = brute_pipeline([r[:2] for r in rows], items)
    assert 20 < len(expected) < len(rows) - 6
    docs = frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.dtypes == frame.dtypes, name
    cases.same([(r["doc_id"], r["text"]) for r in docs.collect()], expected)
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    total = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {i: len(brute.ids(t, 1)) for i, t in expected}


def test_pipeline_bears_awkward_rows(spark, tmp_path):
    cases.documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "a b c d e f g h i j")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 30


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], cases.SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
