"""Whole-text tokenization with the tokenizers library, unit by unit.

A text is cut where no token of the tokenizer spans: at single spaces and line ends
between two other characters, and between a letter and a run of punctuation at the
end of a word.  So the ids of the whole text are those of its units in turn.  Units
are told apart by 128 bits of hash; the library encodes each once, and its ids are
remembered.  The memory is bounded: when it is full, the half not used for longest goes.

Which cuts a tokenizer allows is tried out when it is loaded; a cut that changes
ids is not made.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from recollect.llm._text import _LOWER, BASES, chunks, mix, spans

REMEMBERED = 1_000_000  # units; about 80 MB
TOGETHER = 1000  # new units of one call to the library
TAIL = ".,!?;:*#$%&|)"
_MARKS = (" \x01 ", "\n")  # one of them is a token of its own between two units
_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), b"\xe2\x81\x9f", b"\xe3\x80\x80"]  # white space beyond ASCII
_TAIL = np.zeros(256, dtype=bool)
_TAIL[list(TAIL.encode())] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _blanks(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _BLANK[data]
    for lead in {w[0] for w in _WIDE}:
        at = np.flatnonzero(data == lead)
        for w in (w for w in _WIDE if w[0] == lead):
            some = at[at + len(w) <= len(data)]
            some = some[np.logical_and.reduce([data[some + i] == b for i, b in enumerate(w)])]
            for i in range(len(w)):
                out[some + i] = True
    return out


class UnitEncoder:
    def __init__(self, path: str, special_as_text: bool = False):
        """``special_as_text``: the strings of special tokens in a text are ordinary text; by default they are those tokens."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.mark, self.mark_id = next(((m, self._ids(f" a{m} b")[1]) for m in _MARKS if self._apart(" a", m, " b") and len(self._ids(f" a{m} b")) == 3), (None, -1))
        words = ["a", "Ab", "Zqé", "Äß", "é", "x1", "7", "?!", "日", "'s", "(a)"]
        self.at_space = all(self._apart(a, f" {b}") for a in words for b in words)
        self.at_line = all(self._apart(a, "\n", b) for a in words for b in words)
        runs = [*TAIL, *(a + b for a in TAIL for b in TAIL)]
        self.at_tail = all(self._apart(a, r) and self._apart(f" {a}", r) for a in words[:5] for r in runs)
        upper = " ABCDEFGHIJKLMNOPQRSTUVWXYZ AbÄ"
        self.fold = self._ids(upper) == self._ids(upper.lower())  # it lower-cases, so there are fewer units if A-Z are lower-cased before
        self.key = np.zeros((2, 0), np.uint64)  # hashes of the remembered units, in order of the first
        self.begin, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.turn = np.zeros(0, np.uint32), 0

    @classmethod
    def at(cls, path: str, special_as_text: bool = False) -> UnitEncoder:
        """The encoder of this Python worker for a file."""
        key = (path, special_as_text)
        if key not in _ENCODERS:
            _ENCODERS[key] = cls(*key)
        return _ENCODERS[key]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _apart(self, *parts: str) -> bool:
        return self._ids("".join(parts)) == [i for p in parts for i in self._ids(p)]

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit begins, and the number of units before each text; no unit spans texts."""
        n = len(data)
        begins = np.zeros(n + 1, dtype=bool)
        begins[offsets] = True
        if self.at_space or self.at_line:
            blank = _blanks(data)
            lone = np.zeros(n, dtype=bool)
            lone[1:-1] = blank[1:-1] & ~blank[:-2] & ~blank[2:]
            edges = np.concatenate([offsets[:-1], offsets[1:] - 1])
            lone[edges[(edges >= 0) & (edges < n)]] = False
            if self.at_space:
                begins[:-1] |= lone & (data == 32)
            if self.at_line:
                line = lone & (data == 10)
                begins[:-1] |= line
                begins[1:] |= line
        if self.at_tail:
            tail = _TAIL[data]
            last = np.zeros(n, dtype=bool)
            last[:] = begins[1:]
            first = np.flatnonzero(tail & ~np.append(False, tail[:-1]))
            # a run of marks counts if it reaches the end of its unit
            stops = np.flatnonzero(tail & ~np.append(tail[1:], False))
            letter = _LETTER[data]
            wide = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
            letter[wide + 1] = (data[wide + 1] != 0x97) & (data[wide + 1] != 0xB7)
            good = last[stops] & (first > 0) & letter[first - 1] & ~begins[first]
            inner = np.cumsum(begins[:-1])
            good &= inner[first] == inner[stops]
            begins[first[good]] = True
        starts = np.flatnonzero(begins[:-1])
        return starts, np.searchsorted(starts, offsets)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number for each unit); units without blanks inside go many to a call."""
        plain = [i for i, u in enumerate(units) if u[0] == " " and (rest := u[1:]) and rest.split() == [rest] and "\x01" not in rest] if self.mark else []
        texts = [self.mark.join([units[i] for i in plain[j : j + TOGETHER]]) for j in range(0, len(plain), TOGETHER)]
        ids = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([np.append(x, np.uint32(self.mark_id)) for x in ids]) if ids else np.zeros(0, np.uint32)
        stops = np.flatnonzero(ids == self.mark_id)
        if len(stops) != len(plain):
            plain, ids, stops = [], np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lengths = np.zeros(len(units), dtype=np.int64)
        lengths[plain] = np.diff(stops, prepend=-1) - 1
        alone = np.setdiff1d(np.arange(len(units)), plain)
        found = [e.ids for e in self.tokenizer.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)]
        lengths[alone] = list(map(len, found))
        single = np.zeros(len(units), dtype=bool)
        single[alone] = True
        of_single = np.repeat(single, lengths)
        out = np.zeros(len(of_single), dtype=np.uint32)
        out[~of_single] = ids[ids != self.mark_id]
        out[of_single] = [x for f in found for x in f]
        return out, lengths

    def _remember(self, key: np.ndarray, units: list[str]) -> None:
        ids, size = self._encode_units(units)
        begin = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.key[0], key[0])
        self.key = np.insert(self.key, at, key, axis=1)
        self.begin, self.size, self.used = (np.insert(a, at, b) for a, b in ((self.begin, begin), (self.size, size), (self.used, np.full(len(at), self.turn))))

    def _forget(self) -> None:
        """Keep the half of the units that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: REMEMBERED // 2])
        size = self.size[keep]
        begin = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(self.begin[keep] - begin, size) + np.arange(size.sum())]
        self.key, self.begin, self.size, self.used = self.key[:, keep], begin, size, self.used[keep]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids end) of the texts data[offsets[i]:offsets[i+1]], in UTF-8."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])
        starts, first = self._units(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        if self.fold:
            raw, data = data, _LOWER[data]
            for i in np.unique(np.searchsorted(starts, np.flatnonzero(raw == ord("<")), side="right") - 1):  # may be a special token, which is told by its case
                data[starts[i] : ends[i]] = raw[starts[i] : ends[i]]
        values, length = data.astype(np.uint64), mix((ends - starts).astype(np.uint64))
        one, two = (spans(values, starts, ends, base) ^ length for base in BASES)
        _, some, number = np.unique(one, return_index=True, return_inverse=True)
        one, two, differ = one[some], two[some], two != two[some][number]
        at, known = self._known(one, two)
        if not known.all():
            text, new = data.tobytes(), np.flatnonzero(~known)
            if len(self.key[0]) + len(new) > REMEMBERED:
                self._forget()
                at, known = self._known(one, two)
                new = np.flatnonzero(~known)
            self._remember(np.stack([one, two])[:, new], [text[b:e].decode() for b, e in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)])
            at, known = self._known(one, two)
        if differ.any() or not known.all():  # two units of equal first hash: no memory for this turn
            return self._afresh(data, offsets)
        self.used[at] = self.turn = self.turn + 1
        unit = at[number]
        size = self.size[unit]
        done = np.concatenate([[0], np.cumsum(size)])
        return self.pool[np.repeat(self.begin[unit] - done[:-1], size) + np.arange(done[-1])], done[first[1:]]

    def _known(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the memory of each unit, and whether it is there."""
        have = self.key.shape[1]
        at = np.minimum(np.searchsorted(self.key[0], one), max(have - 1, 0))
        return at, (self.key[0][at] == one) & (self.key[1][at] == two) if have else np.zeros(len(one), dtype=bool)

    def _afresh(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by whole texts."""
        text, bounds = data.tobytes(), offsets.tolist()
        found = [self._ids(text[b:e].decode()) for b, e in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.array([x for f in found for x in f], dtype=np.uint32), np.cumsum([len(f) for f in found])

    def encode_texts(self, texts: Sequence[str | None]) -> list[list[int]]:
        """The ids of each text; a null counts as empty."""
        out = []
        for _, _, data, offsets in chunks(pa.array(texts, pa.large_string())):
            ids, ends = self.encode(data, offsets)
            out += [x.tolist() for x in np.split(ids, ends[:-1])]
        return out
