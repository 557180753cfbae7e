"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much goes whole.

A line is what stands between line feeds. It fails by the first of these rules that holds (numbers are parameters of
``Rules``, phrases a fixed list):

* empty: it has no word;
* repeated: it equals an earlier line of the document;
* navigation: separators such as ``|`` or ``>`` stand for a large share of its words;
* symbols: markup and currency signs are many for its words;
* shouting: nearly all of its cased letters are capitals;
* stutter: in a line of some length, one word makes up most of it, or most words repeat the one before;
* boilerplate: it is short and holds a phrase of licence, cookie or copyright notices;
* punctuation: it is very short and does not end as a sentence does.

Defined cases. Null text has no lines; it counts as empty and is rejected. A document without words is rejected. Repeated
documents are each judged; text of any length is judged whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, pieces, prepare
from seqcast.llm.words import WHITE, Words

#: Phrases of notices that aren't content, in lower case.
NOTICES = (
    "all rights reserved",
    "cookie policy",
    "copyright ©",
    "enable javascript",
    "licensed under",
    "privacy policy",
    "released under the",
    "sign up for our newsletter",
    "terms of service",
    "terms of use",
)
#: Signs that separate navigation entries, signs counted as symbols, ends of sentences, and white space.
SEPARATORS = ("|", ">", "»", "›", "·", "•")
SYMBOLS = "#*$%&|<>"
ENDINGS = tuple(".!?…:;\"'”’»)]。！？")
_SPACE = " \t\n\v\f\r"
REASONS = ("empty", "repeated", "navigation", "symbols", "shouting", "stutter", "boilerplate", "punctuation")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of what a document may lose."""

    separator_share: float = 0.2  # separators per word
    symbol_share: float = 0.5  # symbols per word
    capital_share: float = 0.9  # of at least capital_letters letters
    capital_letters: int = 20
    stutter_share: float = 0.5  # of at least stutter_words words
    stutter_words: int = 10
    notice_words: int = 40
    heading_words: int = 2
    kept_share: float = 0.5  # of the characters in words
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8


def split_words(line: str) -> list[str]:
    """Words of a line: runs of characters other than space and the controls 09 to 0D."""
    for c in _SPACE[1:]:
        if c in line:
            line = line.replace(c, " ")
    return [w for w in line.split(" ") if w]


def judge(line: str, words: list[str], earlier: set[str], rules: Rules) -> str | None:
    """Why the line fails, or None."""
    n = len(words)
    if not n:
        return "empty"
    if line in earlier:
        return "repeated"
    if sum(words.count(s) for s in SEPARATORS if s in line) >= max(1, rules.separator_share * n):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) >= max(2, rules.symbol_share * n):
        return "symbols"
    if not line.islower():
        capitals = sum(map(str.isupper, line))
        if capitals >= rules.capital_letters * rules.capital_share and capitals >= rules.capital_share * max(rules.capital_letters, capitals + sum(map(str.islower, line))):
            return "shouting"
    if n >= rules.stutter_words:
        limit = rules.stutter_share * n
        if Counter(words).most_common(1)[0][1] >= limit or sum(map(str.__eq__, words, words[1:])) >= limit:
            return "stutter"
    if n <= rules.notice_words:
        low = line.lower()
        if any(p in low for p in NOTICES):
            return "boilerplate"
    if n <= rules.heading_words and not line.rstrip(_SPACE).endswith(ENDINGS):
        return "punctuation"
    return None


def clean(text: str, rules: Rules) -> tuple[list[str], Counter, int]:
    """The lines that stay, how many went by which rule, and how many are repeated."""
    kept, why, earlier, repeated = [], Counter(), set(), 0
    for line in text.split("\n"):
        words = split_words(line)
        reason = judge(line, words, earlier, rules)
        repeated += reason == "repeated"
        if words:
            earlier.add(line)
        if reason:
            why[reason] += 1
        else:
            kept.append(line)
    return kept, why, repeated


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def repeated_words(words: Words, size: int) -> np.ndarray:
    """How many words of each text lie in a window of ``size`` words that the text holds twice or more."""
    found, at = words.windows(size)
    key = found ^ (words.doc[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return words.per_text(words.covered(at[twice], size))


def _cleaned(rules: Rules):
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_share double, kept_text string, failed_lines map<string,int>"

    def judge_all(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out: list[list] = [[] for _ in range(10)]
            for part in pieces(column):
                words = Words(part, WHITE)
                inside = np.zeros(len(words.raw) + 1, np.int64)
                np.add.at(inside, words.begin, 1)
                np.add.at(inside, words.end, -1)
                points = np.concatenate([[0], np.cumsum((np.cumsum(inside[:-1]) > 0) & (words.raw & 0xC0 != 0x80))])
                symbols = np.concatenate([[0], np.cumsum(_SYMBOL[words.raw])])
                chars = (points[words.places[1:]] - points[words.places[:-1]]).tolist()
                marks = (symbols[words.places[1:]] - symbols[words.places[:-1]]).tolist()
                again = repeated_words(words, rules.window).tolist()
                for n, c, s, r, text in zip(words.counts.tolist(), chars, marks, again, part.to_pylist(), strict=True):
                    lines, why, repeated = clean(text, rules)
                    left = "\n".join(lines)
                    stays = len(left) - sum(map(left.count, _SPACE))
                    failed = n < rules.min_words or 100 * r > rules.repeat_percent * n
                    share = stays / c if c else 0.0
                    row = (n, c, s, repeated, r, failed, not failed and share >= rules.kept_share, share, left, list(why.items()))
                    for values, value in zip(out, row, strict=True):
                        values.append(value)
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.int32())]
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names)

    return F.arrow_udf(judge_all, fields)


def line_clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents with a struct column ``quality`` (underscores follow if the name is taken) as their last: counts of
    the whole text, the verdict, the share of characters that stays, the cleaned text, and failed lines by rule."""
    prepare(docs.sparkSession)
    return docs.select("*", _cleaned(rules)(F.col(f"`{text}`").cast("string")).alias(fresh(docs, "quality")))
