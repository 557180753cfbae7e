"""Hard negatives, conversation tries and URL rules, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqcast.llm import convtrie, negatives, queries, urlfilter
from tests.llm import cases
from tests.llm.brute import LOWER


def bare(rows):
    return [tuple(r) for r in rows]


# --- URLs


def parts(url):
    found = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def fits(pattern, host, path):
    """Whether a pattern without runs fits, by looking at the characters around it."""
    target, low = host + path, (host + path).translate(LOWER)
    at_label, text = pattern.startswith("||"), pattern.removeprefix("||").translate(LOWER)
    begins, ends = text.startswith("^"), text.endswith("^")
    text = text.strip("^")
    for k in range(len(target)):
        if low.startswith(text, k):
            before, after = low[k - 1 : k], low[k + len(text) : k + len(text) + 1]
            if at_label and not (k == 0 or before == "." and k <= len(host)):
                continue
            if begins and before and before.isascii() and before.isalnum() or ends and after and after.isascii() and after.isalnum():
                continue
            return True
    return False


def judged(url, rules):
    host, path = parts(url)
    sites = [(r, v) for r, v in rules if r and r[0] not in "^*|"]
    own = []
    for r, v in sites:
        name, slash, rest = r.partition("/")
        name = name.translate(LOWER)
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            own.append((len(r), r, v))
    other = [(v == "allow", r, v) for r, v in rules if r and r[0] in "^|" and fits(r, host, path)]
    return host, path, max(own)[1] if own else None, max(other)[1] if other else None, max(own)[2] if own else max(other)[2] if other else "allow"


URLS = [
    "http://example.com/en/1", "https://www.EXAMPLE.com/en/1?x=/fr/", "http://a.www.example.com/en/", "http://example.com/EN/1", "http://notexample.com/en/1",
    "http://example.net/fr/2#top", "http://x.example.net/es/", "http://example.net/de/", "http://net", "http://net/es/", "http://com?x", "http://com", "http://com/",
    "http://casino.example.org/", "http://a-casino-b.example.org", "http://casinos.example.org/", "http://ok.org/a/Casino", "http://ok.org/?casino", "http://ads.x.org/", "http://x.ads-1.org/",
    "http://loads.x.org/ads", "http://anti-spam.org/", "http://spam.org/", "http://user@h.org:80/spam_x", "no scheme", "", None, "x://y://z/adult/", "HTTP://é.org/PILLS/ü", "http://\n.com/\ncasino\n",
    "http://" + "a." * 20_000 + "com/" + "en/" * 20_000, "http://pornü.org/", "://", "http:///spam",
]


def url_rows(seed=2):
    rng = random.Random(seed)
    rows = [(k, u) for k, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[5]), (None, None)]
    words = ["www", "example", "casino", "ads", "en", "es", "fr", "net", "com", "spam", "x"]
    for k in range(200):
        host = ".".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        rows.append((100 + k, f"http://{host}/" + rng.choice("/-_.").join(rng.choice(words) for _ in range(rng.randint(0, 3)))))
    return rows + [(900 + k, URLS[13]) for k in range(80)]


RULES = [*urlfilter.SITE_RULES, *urlfilter.PATTERN_RULES, ("X.net", "block"), ("||www.ads", "block"), ("spam.x/en", "allow"), ("a*b/(c)^", "block"), ("^x", "block"), ("", "block"), (None, "block"), ("^en^", "other")]


def test_urls(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit(1).alias(c) for c in ("judged", "token", "rule", "target", "n", "_salt")))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    found = urlfilter.judge_urls(frame, rules)
    assert found.columns == [*frame.columns, "judged_"]
    known = [(r, v) for r, v in RULES if v in ("allow", "block")]
    cases.same(bare(found.select("page_id", "judged_.*").collect()), [(i, *judged(u, known)) for i, u in rows])


def test_urls_without_rows_or_rules(spark):
    rules = urlfilter.rules_of(spark, urlfilter.PATTERN_RULES)
    assert urlfilter.judge_urls(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    frame = spark.createDataFrame(url_rows(), "page_id long, url string")
    assert {r[0] for r in urlfilter.judge_urls(frame, urlfilter.rules_of(spark, [])).select("judged.verdict").collect()} == {"allow"}
    kept = urlfilter.kept_urls(frame, rules)
    assert kept.columns == frame.columns
    cases.same(bare(kept.collect()), [(i, u) for i, u in url_rows() if judged(u, urlfilter.PATTERN_RULES)[4] == "allow"])


def test_rules_run_only_where_their_rarest_token_is(spark):
    rules = spark.createDataFrame([("example.com/en/", "block"), ("^casino^", "block"), ("*anywhere*", "block"), ("com/e", "block")], "rule string, verdict string")
    tokens = {r["rule"]: set(r["tokens"]) for r in urlfilter.compiled(rules).collect()}
    assert tokens == {"example.com/en/": {"example", "com", "en"}, "^casino^": {"casino"}, "*anywhere*": set(), "com/e": {"com"}}


def test_urls_by_runs_of_any_characters(spark):
    rules = spark.createDataFrame([("^shop*sale^", "block"), ("*x.(y)", "block")], "rule string, verdict string")
    urls = ["http://shop.org/a/sale", "http://shop.org/sales", "http://shops.org/sale", "http://a.org/Shop/\nSALE?", "http://a.org/xx.(y)z", "http://a.org/xx.y"]
    found = urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").select("judged.verdict")
    assert [r[0] for r in found.collect()] == ["block", "allow", "block", "block", "block", "allow"]


# --- conversations


def trie(found):
    """{conversation: turns (role, text)} -> one row per node, by a dictionary of all prefixes."""
    members = defaultdict(list)
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            below[p[:-1]] += 1
    for p in members:
        own = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        for d in range(len(p) + 1):
            leaves[p[:d]] += not below[p]
            saved[p[:d]] += own
    rows = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(found[c]) == len(p)))
        rows.append((len(p), min(m), min(members[p[:-1]]) if p else None, len(m), below[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def ordered(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            out[c].append(((turn is not None, turn or 0), role or "", digest, (role or "", text or "")))
    return {c: [x[3] for x in sorted(v)] for c, v in out.items()}


def conversation_rows(seed=4):
    rng = random.Random(seed)
    says = ["hello", "hello there", "é ü", "", None, "x" * 5000, "same", "ok"]
    rows = []
    common = [(rng.choice(["user", "bot", None]), rng.choice(says)) for _ in range(40)]
    for c in range(0, 160):
        kind = rng.randrange(5)
        own = common[: rng.randint(1, 40)] if kind == 0 else [("user", "same")] if kind == 1 else []
        own = own + [(rng.choice(["user", "bot", None]), rng.choice(says)) for _ in range(rng.randint(0 if own else 1, 6))]
        rows += [(c, k if rng.random() < 0.95 else None, r, t) for k, (r, t) in enumerate(own)]
    for c in range(10_000, 10_060):  # copies
        rows += [(c, k, r, t) for k, (r, t) in enumerate(common[:12])]
    rows += [(7, 0, "user", "hello"), (7, 0, "user", "hello"), (-4, 1, "user", "same"), (None, 1, "user", "lost"), (2**40, 5, None, None)]
    rng.shuffle(rows)
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("most_rows", [None, 2])
def test_trie(spark, most_rows):
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, CONVERSATIONS).select("*", *(F.lit(1).alias(c) for c in ("turns", "conv", "one", "low")))
    found = convtrie.prefix_trie(convtrie.conversations_of(frame), most_rows)
    cases.same(bare(found.collect()), trie(ordered(rows)))


def test_trie_bursts_by_turns_too(spark):
    rows = conversation_rows(9)
    found = convtrie.prefix_trie(convtrie.conversations_of(spark.createDataFrame(rows, CONVERSATIONS)), most_turns=30)
    cases.same(bare(found.collect()), trie(ordered(rows)))


def test_trie_in_small_sweeps_and_stretches(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "SWEEP_ROWS", 5)
    monkeypatch.setattr(convtrie, "ENDS_STRETCH", 7)
    rows = conversation_rows(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = convtrie.prefix_trie(convtrie.conversations_of(spark.createDataFrame(rows, CONVERSATIONS)), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    cases.same(bare(found), trie(ordered(rows)))


def test_trie_of_nothing_and_of_conversations_without_turns(spark):
    assert convtrie.prefix_trie(convtrie.conversations_of(spark.createDataFrame([], CONVERSATIONS))).count() == 0
    silent = spark.range(3).select(F.col("id").alias("conv"), F.lit(b"").alias("turns"))
    cases.same(bare(convtrie.prefix_trie(silent).collect()), trie({0: [], 1: [], 2: []}))


def test_trie_of_one_long_conversation(spark):
    rows = [(1, k, "user", f"turn {k % 70}") for k in range(3000)] + [(2, k, "user", f"turn {k % 70}") for k in range(2500)]
    found = convtrie.prefix_trie(convtrie.conversations_of(spark.createDataFrame(rows, CONVERSATIONS)), 1)
    nodes = {r["depth"]: r for r in found.collect()}
    assert len(nodes) == 3001 and nodes[2500]["n_convs"] == 2 and nodes[2501]["n_convs"] == 1 and nodes[0]["n_leaves"] == 1
    assert nodes[0]["saved_tokens"] == sum(len(f"turn {k % 70}") for k in range(2500))


def test_trie_query(spark, tmp_path):
    rows = conversation_rows(6)
    spark.createDataFrame(rows, CONVERSATIONS).write.parquet(str(tmp_path / "conversations.parquet"))
    own, rebuilt = ordered(rows), {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    found = queries.REGISTRY["op12_prefix_trie"](spark, str(tmp_path))
    want = [(r[1], r[0], *r[2:]) for r in trie(rebuilt)]
    cases.same(bare(found.collect()), want)


# --- vectors


def mined(rows, positives=5, count=10, low=30, high=90):
    """rows (id, label, q) -> hard negatives, by sorting all rows for each anchor."""
    out, done = [], set()
    for a, label, q in rows:
        if a % 100 or (a, label, tuple(q)) in done:
            continue
        done.add((a, label, tuple(q)))
        scored = sorted((-sum(x * y for x, y in zip(q, v)), i, m) for i, m, v in rows)
        own = [(i, -s) for s, i, m in scored if m == label and i != a][:positives]
        for p, ps in own:
            near = [(i, -s) for s, i, m in scored if m != label and low * ps <= -100 * s <= high * ps][:count]
            out += [(a, p, k + 1, i, ps, s) for k, (i, s) in enumerate(near)]
    return out


def vector_rows(seed=3, n=700, dims=9):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, dims))
    rows = []
    for i in range(n):
        v = middles[rng.integers(5)] + 0.4 * rng.normal(size=dims)
        rows.append((i, None if i % 97 == 5 else int(rng.integers(4)), [float(x) for x in v]))
    rows += [(300, 1, rows[300][2]), (300, 1, rows[300][2]), (300, 2, [0.5] * dims), (None, 1, rows[1][2]), (701, 1, None), (702, 1, [float("nan")] * dims), (703, 1, [float("inf")] * dims), (704, 2, [None] * dims)]
    rows += [(800, 3, [0.25] * (dims - 2)), (801, 3, []), (900, 1, [1.0] * (dims + 1)), *((1000 + k, k % 3, rows[7][2]) for k in range(40))]
    return rows


def scaled(rows, relabel=False):
    out = []
    for i, label, v in rows:
        if None in (i, label, v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        out.append((i, (label + 1) % 10 if relabel and i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    return out


VECTORS = "vec_id long, label int, embedding array<float>"


def floats(rows):
    return [(i, m, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, m, v in rows]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "SHARD_BYTES", 60 * 10 * 8)
        monkeypatch.setattr(negatives, "ANCHORS", 3)
        monkeypatch.setattr(negatives, "STEP_ROWS", 4)
        monkeypatch.setattr(negatives, "SAMPLE_ROWS", 50)
    rows = floats(vector_rows())
    frame = spark.createDataFrame(rows, VECTORS).select("*", *(F.lit(1).alias(c) for c in ("q", "id", "shard", "block")))
    found = negatives.hard_negatives(negatives.usable(frame), F.col("id") % 100 == 0)
    # Rows of one id are anchors of their own, whose results are told apart by their scores alone.
    cases.same(bare(found.collect()), mined(scaled(rows)))


def test_hard_negatives_query(spark, tmp_path):
    rows = floats(vector_rows(8))
    spark.createDataFrame(rows, VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.REGISTRY["op11_hard_negatives"](spark, str(tmp_path))
    assert found.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    cases.same(bare(found.collect()), mined(scaled(rows, relabel=True)))


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.usable(empty), F.col("id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, 1, [1.0, 2.0]), (101, 2, [1.0, 2.0])], VECTORS)
    assert negatives.hard_negatives(negatives.usable(lone), F.col("id") % 100 == 0).count() == 0


def test_the_walk_goes_by_falling_bound_and_stops_early():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(30, 16)) * 300
    q = np.rint(middles[rng.integers(30, size=4000)] + rng.normal(size=(4000, 16)) * 8).astype(np.int64)
    books = (negatives.codebook(q[:, :8]), negatives.codebook(q[:, 8:]))
    labels = rng.integers(3, size=4000)
    shard = negatives.Shard(np.arange(4000), labels, q, books)
    high, _ = shard.bounds(q[0])
    walked = list(shard.walk(high))
    assert len(walked) == len({w[1:] for w in walked}) and all(a[0] >= b[0] for a, b in zip(walked, walked[1:]))
    real = {(int(c) // len(books[1]), int(c) % len(books[1])) for c in shard.cell}
    assert real <= {w[1:] for w in walked}
    seen = 0
    for scores, _, _ in shard.steps(q[0], lambda: float(q[0] @ q[0]) * 0.9):
        seen += len(scores)
    assert 0 < seen < 2000  # a tenth of them are near


def test_products_beyond_floating_point_are_exact():
    q = np.array([[2**30 + 1, 3], [2**30, 7], [-(2**30), 1]], np.int64)
    books = (q[:, :1].astype(float), q[:, 1:].astype(float))
    shard = negatives.Shard(np.arange(3), np.zeros(3, np.int64), q, books)
    got = sorted(zip(shard.scores(q[0], 0, 3).tolist(), shard.ids.tolist()))
    assert got == sorted((int(sum(int(a) * int(b) for a, b in zip(q[0], v))), i) for i, v in enumerate(q))
