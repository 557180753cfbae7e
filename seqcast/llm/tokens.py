"""Exact token ids of whole texts, each distinct piece encoded once by the tokenizers library."""

from __future__ import annotations

import os
import re
import sys
from array import array
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from seqcast.llm.common import pieces
from seqcast.llm.words import mixed, span_hashes, text_bytes

#: Two white-space characters in a row. Between any others, a lone space opens a new piece of the byte-level
#: splitting rule and a lone line feed is a piece of its own, whatever stands around them.
_WHITE_RUN = re.compile(r"\s\s")
#: Bytes that are white space other than a space or a line feed, or begin such a character.
_MAY_BE_WHITE = np.zeros(256, bool)
_MAY_BE_WHITE[[9, 11, 12, 13, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: The first three bytes of the white space of more than one byte, as one number; those of two bytes end in 0.
_WIDE_WHITE = np.array(sorted(int.from_bytes(chr(c).encode().ljust(3, b"\0")[:3]) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A word of Latin letters and the marks behind it: the splitting rule takes each of the two as one piece.
_WORD = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([.,;:!?]*)")


def _byte_signs() -> list[str]:
    """The sign of each byte in a byte-level vocabulary: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    signs = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [signs[b] for b in range(256)]


_SIGNS = _byte_signs()
_SPACE_SIGN = _SIGNS[32]
_BYTE_SIGNS = {c: "".join(_SIGNS[b] for b in chr(c).encode()) for c in range(0x80, 0x250)}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceTable:
    """Ids of known pieces by the pieces' 64-bit keys: open addressing in flat arrays, looked up many at a time."""

    def __init__(self, bits: int, kind: type):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.entry = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        self.first, self.length = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.ids, self.used, self.filled = np.zeros(1 << 12, kind), 0, 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, or -1."""
        slot = (keys >> self.shift).astype(np.int64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        while len(left):
            found = self.keys[slot]
            same = found == keys[left]
            out[left[same]] = self.entry[slot[same]]
            on = ~same & (found != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """New keys, each once, with their ids."""
        values = np.frombuffer(b"".join(ids), "<u4").astype(self.ids.dtype)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        end = self.used + len(keys)
        self.first, self.length = (_grown(x, end) for x in (self.first, self.length))
        self.ids = _grown(self.ids, self.filled + len(values))
        self.first[self.used : end] = self.filled + np.cumsum(lengths) - lengths
        self.length[self.used : end] = lengths
        self.ids[self.filled : self.filled + len(values)] = values
        number = np.arange(self.used, end, dtype=np.int32)
        self.used, self.filled = end, self.filled + len(values)
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):  # of those that want one free slot the first gets it; the others try the next
            _, winner = np.unique(slot, return_index=True)
            winner = winner[self.keys[slot[winner]] == 0]
            self.keys[slot[winner]], self.entry[slot[winner]] = keys[winner], number[winner]
            rest = np.ones(len(keys), bool)
            rest[winner] = False
            keys, number, slot = keys[rest], number[rest], (slot[rest] + 1) & self.mask


def _grown(values: np.ndarray, least: int) -> np.ndarray:
    if len(values) >= least:
        return values
    out = np.zeros(max(least, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out


class PieceEncoder:
    """Encodes texts with the tokenizers library.

    A text is cut before each single space and at each single line feed, where the byte-level vocabulary never joins
    characters, and every distinct piece is encoded once by the library. Texts with runs of white space are encoded
    whole, and so are texts with the string of a special or added token, which the library takes for that token. At most
    ``remember`` pieces are remembered, which bounds memory; then all are forgotten and learnt anew, so results do not
    depend on it.
    """

    def __init__(self, path: str, remember: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.library.get_added_tokens_decoder().values()} - {""})
        self.added = "|".join(map(re.escape, added))
        self.library.model._resize_cache(0)  # words are remembered here
        self.merges = self.library.model.tokenize
        self.kind = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self.line_feed = self._encoded(["\n"])[0]
        self.of_marks: dict[str, bytes] = {}
        self.remember, self.bits = remember, max(8, (remember * 2).bit_length())
        self.table = PieceTable(self.bits, self.kind)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_lines(self, lines: list[str]) -> list[bytes]:
        """Ids of many short texts, each framed by characters that aren't white space or led by one space.

        They go to the library as lines of a larger text; a line feed between such lines is an id of its own.
        """
        out = []
        for at in range(0, len(lines), 20_000):
            some = lines[at : at + 20_000]
            texts = ["\n".join(some[i : i + 200]) + "\n" for i in range(0, len(some), 200)]
            ids = np.array([x for e in self.library.encode_batch_fast(texts, add_special_tokens=False) for x in e.ids], "<u4")
            cuts = 4 * np.flatnonzero(ids == int.from_bytes(self.line_feed, "little"))
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(cuts[:-1] + 4).tolist()], cuts.tolist(), strict=True)]
        return out

    def _word(self, word: str, spaced: bool) -> bytes:
        """Ids of Latin letters, after a space or not: one piece of the splitting rule, so the merges alone decide."""
        mapped = word if word.isascii() else word.translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self.merges(f"{_SPACE_SIGN}{mapped}" if spaced else mapped)]).tobytes()

    def _learnt(self, pieces: list[tuple[str, bool]]) -> list[bytes]:
        """Ids of pieces, each with whether a space stands before it.

        Most are a word with or without a mark behind it, which the splitting rule parts: the word is merged by itself.
        Others go to the library as they are.
        """
        out, rest, plain = [b""] * len(pieces), [], []
        words: dict[tuple[str, bool], bytes] = {}
        for i, (piece, spaced) in enumerate(pieces):
            found = _WORD.fullmatch(piece)
            if found:
                word, marks = found.groups()
                ids = words.get((word, spaced))
                if ids is None:
                    ids = words[word, spaced] = self._word(word, spaced)
                out[i] = ids + self._marks(marks) if marks else ids
            elif not piece or piece[-1].isspace() or piece[0].isspace() or "\n" in piece:
                rest.append(i)
            else:
                plain.append(i)
        for some, encoded in ((plain, self._encoded_lines), (rest, self._encoded)):
            if some:
                for i, ids in zip(some, encoded([f" {pieces[i][0]}" if pieces[i][1] else pieces[i][0] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _marks(self, marks: str) -> bytes:
        ids = self.of_marks.get(marks)
        if ids is None:
            ids = self._encoded([marks])[0] if marks else b""
            if len(marks) < 4:
                self.of_marks[marks] = ids
        return ids

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts (null: empty), one text after another, and where each begins, with the end."""
        ids, counts = zip(*map(self._encode_slice, pieces(column)), strict=True)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        ids, first = self.encode_column(pa.array(texts, pa.string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def _encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, and how many each has."""
        raw, places = text_bytes(texts)
        n = len(raw)
        space, feed = raw == 32, raw == 10
        head = space | feed
        odd = self._odd(texts, raw, head, places)
        if self.added:
            marked = pc.match_substring_regex(texts, self.added).to_numpy(zero_copy_only=False)
            odd = sorted({*odd, *np.flatnonzero(marked).tolist()})
        head[places[:-1][places[:-1] < places[1:]]] = True
        at = np.flatnonzero(head)
        spaced, opens = space[at], feed[at]
        begin, end = at + (spaced | opens), np.append(at[1:], n)
        end = np.maximum(end, begin)
        first = np.searchsorted(at, places)
        keys = mixed(span_hashes(raw, begin, end) * np.uint64(2) + spaced) | np.uint64(1)
        entry = self.table.find(keys)
        wanted = entry < 0
        for row in odd:
            wanted[first[row] : first[row + 1]] = False
            entry[first[row] : first[row + 1]] = -1
        if wanted.any():
            new, one = np.unique(keys[wanted], return_index=True)
            one = np.flatnonzero(wanted)[one]
            if self.table.used + len(new) > self.remember:
                self.table = PieceTable(self.bits, self.kind)
                return self._encode_slice(texts) if self.remember > len(keys) else self._whole(texts)
            data = raw.tobytes()
            learnt = self._learnt([(data[a:b].decode(), s) for a, b, s in zip(begin[one].tolist(), end[one].tolist(), spaced[one].tolist(), strict=True)])
            self.table.add(new, learnt)
            entry[wanted] = self.table.find(keys[wanted])
        known = entry >= 0
        length = np.where(known, self.table.length[entry], 0)
        total = length + (opens & known)
        start = np.cumsum(total) - total
        ids = np.empty(int(total.sum()), self.kind)
        feeds = start[opens & known]
        ids[feeds] = int.from_bytes(self.line_feed, "little")
        body = np.ones(len(ids), bool)
        body[feeds] = False
        ids[body] = self.table.ids[np.repeat(self.table.first[entry] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        sums = np.concatenate([[0], np.cumsum(total)])
        counts = sums[first[1:]] - sums[first[:-1]]
        if not len(odd):
            return ids, counts
        cuts = np.concatenate([[0], np.cumsum(counts)])
        rows = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for row, whole in zip(odd, self._encoded([texts[row].as_py() for row in odd]), strict=True):
            rows[row] = np.frombuffer(whole, "<u4").astype(self.kind)
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = [np.frombuffer(x, "<u4").astype(self.kind) for x in self._encoded(texts.to_pylist())]
        return np.concatenate([*rows, np.zeros(0, self.kind)]), np.array([len(r) for r in rows], np.int64)

    @staticmethod
    def _odd(texts: pa.Array, raw: np.ndarray, head: np.ndarray, places: np.ndarray) -> list[int]:
        """Rows that begin with white space or have two such characters in a row."""
        starts = places[:-1][places[:-1] < places[1:]]
        pairs = np.flatnonzero(head[:-1] & head[1:]) + 1
        rows = set((np.searchsorted(places, pairs[~np.isin(pairs, starts)], side="right") - 1).tolist())
        rows.update((np.searchsorted(places, starts[head[starts]], side="right") - 1).tolist())
        at = np.flatnonzero(_MAY_BE_WHITE[raw])
        if len(at):
            three = np.concatenate([raw, np.zeros(2, np.uint8)]).astype(np.int64)
            lead = three[at]
            code = lead << 16 | three[at + 1] << 8 | np.where(lead == 0xC2, 0, three[at + 2])
            at = at[(lead < 0x80) | np.isin(code, _WIDE_WHITE)]
            found = set((np.searchsorted(places, at, side="right") - 1).tolist())
            rows.update(row for row in found - rows if (text := texts[row].as_py())[0].isspace() or _WHITE_RUN.search(text))
        return sorted(rows)


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker: it serves many tasks, and what one has learnt is of use to the next."""
    memory = sys.modules.setdefault("seqcast_worker_memory", ModuleType("seqcast_worker_memory"))
    encoders = memory.__dict__.setdefault("encoders", {})
    if path not in encoders:
        encoders[path] = PieceEncoder(path)
    return encoders[path]
