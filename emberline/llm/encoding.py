"""Encoding many texts with a tokenizer of the `tokenizers` library, each distinct unit once.

A unit is a stretch of text that the tokenizer encodes by itself, whatever stands around it. The
units of a block of texts are found and hashed with numpy, the distinct ones are encoded by the
library, and their ids are put together. Units that were met before come from a table of bounded
size. A hash has 64 bits over the bytes of the unit.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from emberline.llm.words import SPACE, Runs, run_hashes

#: Units remembered by one worker.
KNOWN_UNITS = 600_000

#: White space that splits neither by the rule of spaces and line feeds nor is certain in all classes.
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII marks, but for the apostrophe, which begins a contraction together with letters.
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _letter_changes(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII letter and a mark; both kinds of tokenizers split there."""
    letter, mark = _LETTER[data], _MARK[data]
    return np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches flat[start:start + length], one after another."""
    if not len(length):
        return flat[:0]
    end = np.cumsum(length)
    at = np.arange(int(end[-1])) + np.repeat(start - (end - length), length)
    return flat[at]


class UnitEncoder:
    """Base: what is a unit is decided by `_units`."""

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = sorted(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values())
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at = self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, data: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encode the units that are not known yet; `hashes` are distinct."""
        if len(self.known) > KNOWN_UNITS:
            self._forget()
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != hashes
        if not new.any():
            return
        encode = self.tokenizer.encode
        found = [encode(data[a:b].decode("utf-8"), add_special_tokens=False).ids
                 for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(size.sum()))
        place, begin = at[new], len(self.flat) + np.cumsum(size) - size
        self.known, self.at, self.size = (np.insert(old, place, more) for old, more in (
            (self.known, hashes[new]), (self.at, begin), (self.size, size)))
        self.flat = np.concatenate((self.flat, flat))

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of the texts in them, start of each unit, bounds of each unit in the ids).

        Units start at places in the texts joined by one byte. No text may be odd.
        """
        data, start, end, first = self._units(texts)
        hashes = run_hashes(np.frombuffer(data, np.uint8), start, end, lower=False)
        distinct, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        self._learn(data, distinct, start[place], end[place])
        row = np.searchsorted(self.known, distinct)[which]
        size = self.size[row]
        bounds = np.concatenate(([0], np.cumsum(size)))
        return gather(self.flat, self.at[row], size), bounds[first], start, bounds

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text; one to which the units don't apply is encoded as a whole."""
        odd = {i for i, t in enumerate(texts) if self.odd(t)}
        ids, bounds, _, _ = self.block([b"" if i in odd else t for i, t in enumerate(texts)])
        return [self.whole(t.decode("utf-8")) if i in odd else ids[bounds[i]:bounds[i + 1]]
                for i, t in enumerate(texts)]

    def odd(self, text: bytes) -> bool:
        """Whether a text must be encoded as a whole."""
        return any(s in text for s in self.special)


class WordUnits(UnitEncoder):
    """For tokenizers that drop white space: units are runs between ASCII white space, cut at marks."""

    def _units(self, texts):
        runs = Runs(texts, SPACE)
        cuts = _letter_changes(runs.data)
        start, end = np.sort(np.concatenate((runs.start, cuts))), np.sort(np.concatenate((runs.end, cuts)))
        return runs.data.tobytes(), start, end, np.searchsorted(start, np.append(runs.text_start, len(runs.data)))


class SpacedUnits(UnitEncoder):
    """For byte-level tokenizers, where a single space belongs to the word after it.

    Between spaces and line feeds only, the split is: one space with the word after it, the rest of
    a run of white space before, and a line feed directly before a word by itself. Texts with other
    white space or with the text of a special token are encoded as a whole.
    """

    def odd(self, text):
        return super().odd(text) or _ODD.search(text.decode("utf-8")) is not None

    def _units(self, texts):
        runs = Runs(texts, _BREAK)
        data = runs.data
        begins = runs.text_start[np.searchsorted(runs.text_end, runs.start)] if len(runs.start) else runs.start
        previous = np.concatenate(([0], runs.end[:-1])) if len(runs.end) else runs.end
        gap_from = np.maximum(previous, begins)
        gap = runs.start - gap_from
        spaced = (gap > 0) & (data[np.maximum(runs.start - 1, 0)] == 0x20)
        word = runs.start - spaced
        alone = (gap > 1) & ~spaced
        tails = np.where(runs.count > 0, runs.end[np.maximum(runs.last - 1, 0)] if len(runs.end) else runs.text_start, runs.text_start)
        start = np.sort(np.concatenate((word, gap_from[gap_from < word], word[alone] - 1, _letter_changes(data),
                                        tails[tails < runs.text_end], runs.text_end)))
        separator = np.zeros(len(start), bool)
        separator[np.searchsorted(start, runs.text_end)] = True
        end = np.concatenate((start[1:], start[-1:] + 1))[~separator]
        start = start[~separator]
        return data.tobytes(), start, end, np.searchsorted(start, np.append(runs.text_start, len(data)))


@lru_cache(maxsize=4)
def encoder(kind: type, path: str) -> UnitEncoder:
    """One encoder a worker, with what it has learnt."""
    return kind(path)
