"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text, pattern=SPACE, lower=False):
    text = text or ""
    return re.findall(pattern, text.translate(LOWER) if lower else text)


def windows(w, n):
    return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w)} if 0 < len(w) < 5 else set(windows(w, 5))


def near_duplicates(rows):
    """rows (id, text) -> one (id, shingles, component, kept) per row."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and i is not None and j is not None and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((top(i), top(j)))
                parent[y] = x
    return [(i, len(s), None if i is None else top(i), i is None or top(i) == i) for i, s in sets]


def repeats(rows, size=13):
    """rows (id, text) -> (id, words, removed, sha256 of what stays)."""
    first = {}
    for i, t in rows:
        for x in windows(words(t), size) if i is not None else ():
            first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k, x in enumerate(windows(w, size)) if i is not None and first[x] < i for j in range(size)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def lines(text):
    return [x for x in (text or "").split("\n") if re.search(SPACE, x)]


def line_dedup(rows, least=3):
    """rows (id, text) -> (id, lines, removed, text that stays)."""
    first = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, x in enumerate(windows(lines(t), least)):
            if i is not None:
                first.setdefault(x, (i, k))
    out = []
    for i, t in rows:
        found = lines(t)
        gone = {k + j for k, x in enumerate(windows(found, least)) if i is not None and first[x] < (i, k) for j in range(least)}
        out.append((i, len(found), len(gone), t if not gone else "\n".join(x for k, x in enumerate(found) if k not in gone)))
    return out


def contamination(rows, items, size=10):
    """rows (id, text), items (item, text) -> (id, words, hit, items, digest, contaminated)."""
    by_window = defaultdict(set)
    for item, t in items:
        w = words(t, ALNUM, lower=True)
        for x in windows(w, size) if len(w) >= size else [tuple(w)] * (len(w) > 0):
            by_window[x].add(item)
    out = []
    for i, t in rows:
        w, hit, ids = words(t, ALNUM, lower=True), set(), set()
        for n in {len(x) for x in by_window}:
            for k, x in enumerate(windows(w, n)):
                if x in by_window:
                    hit.update(range(k, k + n))
                    ids |= by_window[x]
        ids = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


def quality(text):
    """words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed of one text."""
    text = text or ""
    w = words(text)
    found = Counter(windows(w, 8))
    again = {k + j for k, x in enumerate(windows(w, 8)) if found[x] > 1 for j in range(8)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(SPACE, x):
            dup += x in seen
            seen.add(x)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


def ids(text, end):
    """Ids of a whole text by the library alone."""
    from tokenizers import Tokenizer

    from seqcast.llm.tokens import vocabulary_path

    if not hasattr(ids, "library"):
        ids.library = Tokenizer.from_file(vocabulary_path())
    return [*ids.library.encode(text or "", add_special_tokens=False).ids, end]


def crc(numbers):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in numbers))
