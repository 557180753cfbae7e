"""Tokens, packing, token files, archives, language identification and the language model."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqcast.llm import langid, lm, packing, tokenfiles, tokens, warc
from seqcast.llm.words import Words
from tests.llm import brute, cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


# --- tokens and packing


def test_encoder_equals_the_library():
    odd = ["", " ", "a", " a", "a ", "\n", "\na", "a\n", "a\nb", "a\n\nb", "a\n b", "a \nb", "a  b", "a\tb", "\ta", "it's  '  s x's", "<|endoftext|> a", "é\xa0b c", "a　b", "1 2 3.a", "word.", "word...", "word!?", "w.x.", "Ünï, cödé", "ﬁne ǆ ª", "x\x1cy z", "x \x1c z", "a\r\nb", "\U0001f600 ok"]
    texts = [t for t in [*odd, *cases.texts()] if t is not None]
    for remember in (500_000, 3):
        encoder = tokens.PieceEncoder(tokens.vocabulary_path(), remember)
        for some in (texts, texts[::-1]):
            got = encoder.encode(some)
            for text, ids in zip(some, got, strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == brute.ids(text, 0)[:-1], text[:50]
    assert encoder.encode([None, "a"])[0] == b""


def test_encoder_on_random_text():
    rng = random.Random(11)
    signs = "ab É.,!?'sß \n\t-12|  \xa0語"
    encoder = tokens.PieceEncoder(tokens.vocabulary_path())
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == brute.ids(text, 0)[:-1], repr(text)


def test_cuts():
    for n in (1, 63, 64, 65, 2047, 2048, 2049, 5000, 123_456):
        pieces = packing.cuts(n)
        assert sum(pieces) == n and max(pieces) <= 2048
        assert all(x & (x - 1) == 0 for x in pieces if x >= packing.SMALLEST) and sum(x < packing.SMALLEST for x in pieces) <= 1


def test_packing(docs):
    rows = packing.pack(docs, end_id=1).collect()
    texts = cases.plain()
    expected = sorted((i is None, i or 0, tuple(brute.ids(t, 1))) for i, t in texts)
    whole, sequences = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        whole.setdefault((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]), []).append((r["start"], ids))
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    again = []
    for (null, key, n), pieces in whole.items():
        copies = len({1 for s, _ in pieces if s == 0}) and sum(s == 0 for s, _ in pieces)
        pieces.sort()
        text = [x for _, ids in pieces[::copies] for x in ids]
        assert len(text) == n
        again += [(null, key, tuple(text))] * copies
    assert sorted(again) == expected
    filled = [sum(n for _, n in found) for found in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in filled)
    assert padding <= 0.02 * sum(filled) + 8 * 2 * packing.CAPACITY


def test_full_bins_waste_less_than_a_tail():
    bins, closed = packing.Bins(2048, 0), []
    rng = random.Random(0)
    for k in range(30_000):
        start = 0
        for length in packing.cuts(rng.randint(1, 4000)):
            closed += bins.put((k, start, length))
            start += length
    fill = {}
    for *_, length, sequence, offset in closed:
        fill[sequence] = max(fill.get(sequence, 0), offset + length)
    assert min(fill.values()) > 2048 - packing.SMALLEST
    rest = list(bins.rest())
    assert sum(p[2] for s in rest for p in s) > 2048 * (len(rest) - 3) * 0.9


# --- token files


def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 40):
        counts = rng.integers(1, 1000, n)
        lengths = tokenfiles.code_lengths(counts)
        assert (2.0 ** -lengths.astype(float)).sum() <= 1
        heap, cost = sorted(counts.tolist()), 0  # Huffman's own cost, by merging the two least
        while len(heap) > 1:
            pair = heap[0] + heap[1]
            cost += pair
            heap = sorted([*heap[2:], pair])
        assert n == 1 or (lengths * counts).sum() == cost
    steep = np.array([2**k for k in range(40)])
    lengths = tokenfiles.code_lengths(steep)
    assert lengths.max() <= tokenfiles.LIMIT and abs((2.0 ** -lengths.astype(float)).sum() - 1) < 1e-12
    with pytest.raises(ValueError, match="don't fit"):
        tokenfiles.code_lengths(np.ones(9), limit=3)


def test_token_files(spark, docs, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT", 500)
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 3000)
    files = tokenfiles.write_ids(docs)
    assert files.count() > 5
    rows = tokenfiles.read_ids(spark, files).collect()
    expected = [(i, brute.ids(t, 2)) for i, t in cases.plain()]
    cases.same([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["ids_crc32"]) for r in rows], [(i, x, len(x), brute.crc(x)) for i, x in expected])
    end = 0
    order = sorted(rows, key=lambda r: r["start"])
    for r in order:
        assert r["start"] == end
        end += r["n_tokens"]
    assert [r["doc_id"] for r in order] == sorted((i for i, _ in expected), key=lambda i: (i is not None, i or 0))


def test_damaged_token_files(spark, docs, tmp_path):
    files = tokenfiles.write_ids(docs.limit(5), folder=str(tmp_path / "ids")).collect()
    path = files[0]["file"].removeprefix("file://")
    data = open(path, "rb").read()
    for bad in (data[:-30], b"IDHUFFxx" + data[8:], data + b"x"):
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match="ArchiveError"):
            tokenfiles.read_ids(spark, spark.createDataFrame([(path, 0, 0, 5)], "file string, part long, nth long, ids long")).collect()


# --- archives


def pages():
    rng = random.Random(4)
    large = ["<p>" + cases.prose(rng, rng.randint(20, 400)) + "</p>" for _ in range(60)]
    html = [*large, large[3], large[3], large[7], "", "", None, "short", "short", "é" * 50, "é" * 50, "x" * 300_000, "a\r\n\r\nb" * 30]
    rows = [(k * 7 % 101, f"http://x.example/{k}" if k % 9 else None, h) for k, h in enumerate(html)]
    return [*rows, rows[5], (None, "http://n\r\nx", large[9]), (None, None, None)]


def expected_pages(rows):
    import hashlib

    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        head = first.get(h or "") if len(raw) >= 100 else None
        refers = head if head is not None and sum((x or "") == (h or "") for _, _, x in rows) > 1 and i != head else None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return out


def test_archives(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("digest", "first", "page")})
    archives = warc.write_archives(frame, folder=str(tmp_path / "archives"), archive_bytes=20_000)
    assert archives.count() > 3
    rows = warc.read_archives(spark, archives).collect()
    cases.same([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows], expected_pages(pages()))
    by_digest = {r["payload_digest"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert all(len(by_digest[r["payload_digest"]]) == r["payload_bytes"] for r in rows)
    listed = archives.collect()
    data = open(listed[0]["archive"], "rb").read()
    assert data[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
    for k, bad in enumerate((data[:-20], b"\0" + data[1:], data[: len(data) // 2] + bytes([data[len(data) // 2] ^ 0xFF]) + data[len(data) // 2 + 1 :])):
        path = str(tmp_path / f"bad-{k}.warc.zst")
        open(path, "wb").write(bad)
        with pytest.raises(Exception, match="ArchiveError"):
            warc.read_archives(spark, spark.createDataFrame([(path, listed[0]["records"])], "archive string, records long")).collect()
    assert warc.write_archives(frame.limit(0)).count() == 0


def test_record_checks():
    good = warc.record(5, "http://x", b"payload", "239f59ed55e737c77147cf55ad0c1b030b6d7ee748a7426952f9b852d5a935e5", None, "2024-01-01T00:00:00Z")
    assert warc.parsed(good)["payload"] == b"payload"
    for old, new in ((b"WARC/1.1", b"WARC/1.0"), (b"payload\r\n\r\n", b"Payload\r\n\r\n"), (b"\r\n\r\npayload", b"\r\n\r\npayloads"), (b"Content-Length: 7", b"Content-Length: 8"), (b"Page-ID", b"WARC-Type"), (b"sha256:", b"sha1:"), (b"WARC-Type: response", b"WARC-Type: revisit")):
        with pytest.raises(warc.ArchiveError):
            warc.parsed(good.replace(old, new))


# --- languages


def test_held_out_accuracy(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(found, ~langid.held_out())
    judged = langid.predict(found.where(langid.held_out()), model).select("lang", F.col("predicted.lang").alias("guess"), F.col("predicted.score").alias("score")).collect()
    assert len(judged) > 200 and sum(r["lang"] == r["guess"] for r in judged) >= 0.97 * len(judged)
    assert all(0 < r["score"] <= 1 for r in judged)
    assert set(model.of_family) == {"germanic", "romance"} and set(model.of_pair) == {("de", "en"), ("es", "fr")}


def test_features_by_hand():
    texts = ["Aé b, c", "", "zz  ZZ", "ß"]
    got = langid.features(pa.array(texts))
    for text, row in zip(texts, got, strict=True):
        folded = [b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in text.encode()]
        counts = {}
        for b in folded:
            if b != 32:
                counts[b] = counts.get(b, 0) + 1
        for size in (2, 3):
            for k in range(len(folded) - size + 1):
                gram = folded[k : k + size]
                if set(gram) == {32}:
                    continue
                code = gram[0] * 0x9E3779B1 % 2**32
                for b in gram[1:]:
                    code = (code ^ b) * 0x85EBCA6B % 2**32
                place = 256 + code * langid.HASHED // 2**32
                counts[place] = counts.get(place, 0) + 1
        total = sum(counts.values())
        want = [(counts.get(k, 0) / total) ** 0.5 if total else 0.0 for k in range(256 + langid.HASHED)]
        assert row.tolist() == pytest.approx(want, abs=1e-6)


def test_verdicts_by_hand(spark):
    """Families by the surest machine, then the language that wins most pairs, from the machines' numbers alone."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null")
    model = langid.fit(docs, ~langid.held_out())
    rows = langid.predict(docs, model).limit(60).collect()
    for r in rows:
        x = langid.features(pa.array([r["text"]]))[0]

        def sure(k):
            margin = sum(float(a) * float(b) for a, b in zip(x, model.weights[:, k], strict=True) if a) + float(model.biases[k])
            return 1 / (1 + math.exp(-langid.SHARPNESS * margin))

        chances = {f: sure(k) + 1e-9 for f, k in model.of_family.items()}
        best = max(chances, key=chances.get)
        won, total = dict.fromkeys(model.members[best], 0), dict.fromkeys(model.members[best], 0.0)
        for (a, b), k in model.of_pair.items():
            if a in won:
                p = sure(k)
                won[a if p > 0.5 else b] += 1
                total[a] += p
                total[b] += 1 - p
        guess = max(won, key=lambda g: (won[g], total[g]))
        score = chances[best] / sum(chances.values()) * total[guess] / (len(won) - 1)
        assert (r["predicted"]["lang"], r["predicted"]["score"]) == (guess, pytest.approx(score, abs=1e-4))


def test_no_language_is_lost_among_repeated_rows(spark):
    rows = [(k, f"the quick brown fox number {chr(97 + k % 26)}{chr(97 + k // 26)} jumps over it", "en") for k in range(400)]
    rows += [(1000 + k, "der schnelle braune Fuchs springt weit", "de") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for sample in (2, 50):
        model = langid.fit(docs, F.lit(True), sample_rows=sample)
        assert model.languages == ["de", "en"]
    found = langid.predict(docs, model).groupBy("lang", "predicted.lang").count().collect()
    assert {(r[0], r[1]) for r in found} == {("en", "en"), ("de", "de")}


def test_languages_of_awkward_rows(docs):
    learn = F.col("doc_id").isNotNull()
    judged = langid.predict(docs, langid.fit(docs, learn))
    own = judged.columns[-1]
    assert own == "predicted_"
    for r in judged.collect():
        known = any(c.isalpha() for c in r["text"] or "")
        assert r[own]["lang"] in (("de", "en") if known else ("und",)) and (known or r[own]["score"] == 0)
    nobody = langid.predict(docs, langid.fit(docs, F.lit(False)))
    assert nobody.where(F.col(f"{own}.lang") != "und").count() == 0
    single = langid.predict(docs, langid.fit(docs.where("lang = 'en'"), learn))
    assert {r[0] for r in single.select(f"{own}.lang").distinct().collect()} == {"en", "und"}
    left = langid.identified(docs)
    assert left.columns == docs.columns
    cases.same([(r["doc_id"], r["text"]) for r in left.collect()], [(i, t) for i, t in cases.plain() if any(c.isalpha() for c in t or "")])


def test_the_machines_hold_one_copy_of_the_sample():
    rng = np.random.default_rng(3)
    x = rng.random((1200, 2000), np.float32)
    languages = [("en", "de", "fr")[k % 3] for k in range(len(x))]
    tracemalloc.start()
    model = langid.Model(x, languages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * x.nbytes
    half = langid.Model(x.astype(np.float16), languages)
    assert half.weights.dtype == np.float32 and model.of_pair == half.of_pair
    assert np.abs(half.weights - model.weights).max() < 0.05 * np.abs(model.weights).max()


def test_three_languages_of_a_family(spark):
    rng = random.Random(6)
    stems = {"es": "que los ción para", "fr": "est les tion pour", "it": "che gli zione per", "en": "the and with of", "xx": "zzq wxq qqz kkx"}
    rows = [(k, " ".join(rng.choice(stems[g].split()) + rng.choice(["a", "o", "e"]) for _ in range(30)), g) for k, g in enumerate(rng.choice(list(stems)) for _ in range(400))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(frame, F.col("doc_id") % 2 == 0, sample_rows=100)
    assert len(model.of_pair) == 3 and set(model.families) == {"germanic", "other", "romance"}
    found = langid.predict(frame, model).where("doc_id % 2 = 1").collect()
    assert sum(r["lang"] == r["predicted"]["lang"] for r in found) >= 0.95 * len(found)


# --- the language model


def test_unigram_base(docs):
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 3 != 0)
    counts, lexicon, weights = lm.fit(docs, learn)
    rows = lm.score_texts(docs, counts, lexicon, weights, held_out=F.col("doc_id") % 3 == 0).collect()
    assert len(rows) == len(cases.rows())
    seen = [brute.words(t, lower=True) + [None] for i, t in cases.plain() if i is not None and i % 3]
    c = Counter(x for w in seen for x in w)
    n, v = sum(c.values()), len(c)
    expected = []
    for i, t in cases.plain():
        w = brute.words(t, lower=True) + [None]
        expected.append((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)))
    cases.same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows], expected)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    twice = {}
    for r in rows:  # equal texts get equal scores, wherever they ran
        assert twice.setdefault((r["doc_id"], r["n_tokens"], r["base_score"]), r["score"]) == pytest.approx(r["score"], rel=1e-4)


def test_rare_words_join_the_counts(docs, monkeypatch):
    learn = F.col("doc_id").isNotNull()
    whole = {(r["doc_id"], r["n_tokens"]): (r["n_known"], r["base_score"]) for r in lm.score_texts(docs, *lm.fit(docs, learn)).collect()}
    monkeypatch.setattr(lm, "KNOWN", 5)
    few = lm.score_texts(docs, *lm.fit(docs, learn)).collect()
    for r in few:
        known, base = whole[r["doc_id"], r["n_tokens"]]
        assert r["n_known"] == known and r["base_score"] == pytest.approx(base)


def test_training_does_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 2000)  # several shards a round
    learn = F.col("doc_id").isNotNull()
    weights = [lm.fit(docs.repartition(n), learn)[2] for n in (1, 7)]
    assert np.abs(weights[0] - weights[1]).max() < 1e-4


def test_words_are_found_without_a_search():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 1000):
        hashes = np.unique(np.concatenate([rng.integers(0, 2**63, n, np.uint64) * np.uint64(2), np.arange(min(n, 20), dtype=np.uint64), np.array([2**64 - 1], np.uint64)]))
        lexicon = lm.Lexicon(hashes, np.ones(len(hashes)), np.zeros(len(hashes), np.int64), 0, 0, 0)
        asked = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 2**63, 500, np.uint64) * np.uint64(2)])
        at, known = lexicon.find(asked)
        want = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        assert (at == want).all() and (known == (hashes[want] == asked)).all()
        assert len(lexicon.starts) >= len(hashes)


def test_rare_words_are_tallied():
    for some in ([], [5], [3, -1, 3, 7, 7, 7]):
        words, times = lm._tally(np.array(some, np.int64))
        want = np.unique(np.array(some, np.int64), return_counts=True)
        assert words.tolist() == want[0].tolist() and times.tolist() == want[1].tolist()


def test_score_is_the_network_word_by_word(docs):
    """Gates, state and both softmaxes in plain Python, from the fitted weights."""
    learn = F.col("doc_id").isNotNull()
    counts, lexicon, weights = lm.fit(docs, learn)
    found = {(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score_texts(docs, counts, lexicon, weights).collect()}
    net = lm.Network(lexicon.size).load(weights)
    a, u = {n: v.astype(float) for n, v in net.arrays.items()}, net.units
    seen = Counter(w for i, t in cases.plain() if i is not None for w in brute.words(t, lower=True))
    ranked = sorted(seen.values(), reverse=True)
    assert len(seen) <= lm.VOCABULARY - 2 and sorted(lexicon.counts.tolist(), reverse=True) == ranked  # all have a number
    checked = 0
    for doc, text in cases.plain():
        words = brute.words(text, lower=True)
        if len(words) > 60:
            continue
        at, known = lexicon.find(Words(pa.array([" ".join(words)]), lower=True).hash)
        state, before, total = [0.0] * u, lm.END, 0.0
        for k in range(len(words) + 1):
            word = lm.END if k == len(words) else int(lexicon.number[at[k]]) if known[k] else lm.OTHER
            x = a["inputs"][before]
            r = [sum(state[i] * a["recurrent"][i][j] for i in range(u)) for j in range(3 * u)]
            z, g = ([1 / (1 + math.exp(-(x[j] + r[j]))) for j in range(b, b + u)] for b in (0, u))
            new = [math.tanh(x[2 * u + j] + g[j] * r[2 * u + j]) for j in range(u)]
            state = [z[j] * state[j] + (1 - z[j]) * new[j] for j in range(u)]
            group, inside = divmod(word, lm.CLASS_WORDS)
            for w, b, n in ((a["class_weights"], a["class_bias"], group), (a["word_weights"][group], a["word_bias"][group], inside)):
                logits = [sum(state[i] * w[i][j] for i in range(u)) + b[j] for j in range(len(b))]
                total += logits[n] - math.log(sum(map(math.exp, logits)))
            if word == lm.OTHER:
                total += math.log((seen[words[k]] + 1) / lexicon.other_mass())
            before = word
        assert found[doc, len(words) + 1] == pytest.approx(total / math.log(10), rel=1e-3, abs=1e-3)
        checked += 1
    assert checked > 20


def test_no_training_text(docs):
    rows = lm.score_texts(docs, *lm.fit(docs, F.lit(False))).collect()
    assert len(rows) == len(cases.rows()) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], cases.SCHEMA)
    assert lm.score_texts(none, *lm.fit(none, F.lit(True))).count() == 0
    assert packing.pack(none).count() == 0
    assert tokenfiles.read_ids(spark, tokenfiles.write_ids(none)).count() == 0
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0
    assert langid.identified(none).count() == 0


def small_network():
    rng = np.random.default_rng(0)
    net = lm.Network(70, rng.integers(1, 50, 70).astype(float), units=4)
    for k in net.arrays:
        net.arrays[k] = net.arrays[k] + rng.normal(0, 0.1, net.arrays[k].shape).astype(np.float32)
    return net


def test_probabilities_add_up():
    net = small_network()
    states = np.random.default_rng(1).normal(size=(3, 4)).astype(np.float32)
    total = sum(np.exp(net.output(states, np.full(3, w))[0]) for w in range(net.classes * lm.CLASS_WORDS))
    assert total == pytest.approx(np.ones(3), abs=1e-4)


def test_gradients_by_finite_differences():
    net, rng = small_network(), np.random.default_rng(3)
    net.arrays = {k: v.astype(np.float64) for k, v in net.arrays.items()}
    given, wanted = rng.integers(0, 70, (5, 3)), rng.integers(0, 70, (5, 3))
    fresh = np.zeros((5, 3), bool)
    fresh[0] = fresh[3, 1] = True

    def loss(grads=None):
        kept = []
        states = net.forward(np.zeros((3, 4)), given, fresh, kept)
        log, back = net.output(states.reshape(-1, 4).astype(np.float64), wanted.ravel(), grads)
        if grads is not None:
            net.backward(given, fresh, kept, back.reshape(5, 3, 4), grads)
        return -log.sum()

    grads = {n: np.zeros_like(v) for n, v in net.arrays.items()}
    loss(grads)
    for name, values in net.arrays.items():
        for at in zip(*(rng.integers(0, s, 5) for s in values.shape), strict=True):
            old = values[at]
            values[at] = old + 0.01
            up = loss()
            values[at] = old - 0.01
            down = loss()
            values[at] = old
            assert grads[name][at] == pytest.approx((up - down) / 0.02, abs=2e-3)


def test_state_is_carried_through_whole_texts():
    net, rng = small_network(), np.random.default_rng(4)
    texts = [np.append(rng.integers(1, 70, n), lm.END) for n in [0, 1, 5, 63, 64, 65, 300, 1000, *rng.integers(0, 90, 600)]]
    got = dict(lm.score(net, iter(list(enumerate(texts)))))
    assert len(got) == len(texts)
    for k, text in enumerate(texts[:60]):
        state, total, before = np.zeros((1, 4), np.float32), 0.0, lm.END
        for word in text:
            state = net.forward(state, np.array([[before]]), np.zeros((1, 1), bool))[-1]
            total += float(net.output(state, np.array([word]))[0][0])
            before = word
        assert got[k] == pytest.approx(total, rel=1e-3)


def test_training_learns_an_order_of_words():
    rng = np.random.default_rng(5)
    texts = [np.append((np.arange(rng.integers(20, 60)) + rng.integers(0, 20)) % 20 + 2, lm.END) for _ in range(6000)]
    counts = np.bincount(np.concatenate(texts), minlength=22).astype(float)
    net = lm.Network(22, counts)
    held = texts[:200]
    before = sum(x for _, x in lm.score(net, iter([(0, t) for t in held])))
    assert lm.train(net, iter([(None, t) for t in texts[200:]])) == sum(map(len, texts[200:]))
    after = sum(x for _, x in lm.score(net, iter([(0, t) for t in held])))
    assert after > 0.9 * before


def test_arrays_are_held_from_window_to_window():
    rng = np.random.default_rng(9)
    size, n = 2048, lm.LANES * lm.STEPS
    net = lm.Network(size, 1 / np.arange(1, size + 1))
    states, wanted = rng.uniform(-1, 1, (n, net.units)).astype(np.float32), (rng.zipf(1.3, n) - 1) % size
    grads = {k: np.zeros_like(v) for k, v in net.arrays.items()}
    fresh = {k: np.zeros_like(v) for k, v in net.arrays.items()}
    net.output(states, wanted, grads)
    for some in (grads, None):
        tracemalloc.start()
        net.output(states, wanted, some)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 4 * n * net.classes * 1.5  # less than logits of classes and of words take
    # What an earlier call left, of another size, is not seen.
    grads = {k: np.zeros_like(v) for k, v in net.arrays.items()}
    log, back = net.output(states[:700], wanted[:700], grads)
    new = lm.Network(size, 1 / np.arange(1, size + 1))
    expected, by_state = new.output(states[:700], wanted[:700], fresh)
    assert np.array_equal(log, expected) and np.array_equal(back, by_state) and all(np.array_equal(grads[k], fresh[k]) for k in grads)


def test_logits_beyond_single_precision():
    net = lm.Network(70, np.ones(70), units=4)
    net.arrays["class_weights"] *= 1e4
    net.arrays["word_weights"] *= 1e4
    states = np.ones((5, 4), np.float32)
    grads = {k: np.zeros_like(v) for k, v in net.arrays.items()}
    log, back = net.output(states, np.array([0, 1, 63, 64, 69]), grads)
    assert not np.isnan(log).any() and (log <= 1e-6).all() and np.isfinite(back).all() and all(np.isfinite(g).all() for g in grads.values())


def test_lanes_that_ended():
    rng = np.random.default_rng(4)
    texts = [np.append(rng.integers(2, 70, n), lm.END) for n in [3, 500, 0, 90, 7, 64, 31, 32, 33]]
    lanes = lm.Lanes(iter(list(enumerate(texts))), lanes=4, steps=32)
    found, before = {k: [] for k in range(len(texts))}, {k: [] for k in range(len(texts))}
    for live, given, wanted, fresh, owner in lanes.windows():
        assert given.shape == wanted.shape == fresh.shape == owner.shape == (32, len(live)) and (owner >= 0).any(axis=0).all()
        for lane in range(len(live)):
            for t in np.flatnonzero(owner[:, lane] >= 0).tolist():
                k = lanes.owners[int(owner[t, lane])]
                assert fresh[t, lane] == (not found[k])
                found[k].append(int(wanted[t, lane]))
                before[k].append(int(given[t, lane]))
    assert all(found[k] == x.tolist() and before[k] == [lm.END, *x.tolist()[:-1]] for k, x in enumerate(texts))


def test_numbers_of_a_piece():
    texts = ["b a  c\ta", "", " ", "zz A", "a"]
    words = Words(pa.array(texts), lower=True)
    hashes = np.sort(Words(pa.array(["a b c"])).hash)
    number = np.array([{h: k for k, h in zip([2, lm.OTHER, 3], Words(pa.array(["a b c"])).hash.tolist())}[h] for h in hashes.tolist()])
    for lexicon in (lm.Lexicon(hashes, np.array([5, 4, 3]), number, 1, 13, 4), lm.Lexicon(hashes[:0], number[:0], number[:0], 0, 0, 0)):
        numbers, begin = lm._numbered(words, lexicon, *lexicon.find(words.hash))
        known = {"a": 2, "c": 3} if len(lexicon.number) else {}
        expected = [[known.get(w, lm.OTHER) for w in brute.words(t, lower=True)] + [lm.END] for t in texts]
        assert [numbers[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == expected
