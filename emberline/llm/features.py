"""Numbers that describe the form of texts, for whole blocks at once."""

from __future__ import annotations

import numpy as np

from emberline.llm.words import Runs, mix, run_hashes, sums_by_text

NAMES = ("log_words", "word_chars", "log_longest_word", "capitals", "digits", "symbols", "exclamations", "stops",
         "words_a_line", "repeated_lines", "distinct_words", "repeated_windows", "short_words", "log_lines", "bars",
         "beyond_ascii", "most_frequent")


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in characters]] = True
    return out


_CAPITAL, _DIGIT = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
_SYMBOL, _MARK, _STOP, _BAR, _LINE = _table("#*$%&<>|=_~^@{}[]\\/"), _table("!?"), _table(".,;:"), _table("|"), _table("\n")
_CHARACTER = np.ones(256, bool)
_CHARACTER[0x80:0xC0] = False
_HIGH = np.zeros(256, bool)
_HIGH[0xC0:] = True


def form(texts: list[bytes]) -> np.ndarray:
    """A row of NAMES for each text; an empty text has zeros."""
    runs = Runs(texts)
    data, words = runs.data, runs.hashes()
    characters = np.concatenate(([0], np.cumsum(_CHARACTER[data])))
    word_length = characters[runs.end] - characters[runs.start]
    n = runs.count.astype(float)
    some = np.maximum(n, 1)
    of = lambda table: sums_by_text(runs, table[data])
    chars = np.maximum(of(_CHARACTER), 1)
    lines = of(_LINE) + 1.0
    total = np.concatenate(([0], np.cumsum(word_length)))
    short = np.concatenate(([0], np.cumsum(word_length <= 3)))
    distinct, windows, common, repeated, longest = (np.zeros(len(texts)) for _ in range(5))
    rows = Runs(texts, _LINE)
    line_hash = run_hashes(rows.data, rows.start, rows.end, lower=True)
    with np.errstate(over="ignore"):
        triple = mix(words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(5) + words[2:] * np.uint64(7)) if len(words) > 2 else words[:0]
    for i, (a, b, c, d) in enumerate(zip(runs.first.tolist(), runs.last.tolist(), rows.first.tolist(), rows.last.tolist(), strict=True)):
        if b > a:
            own = np.sort(words[a:b])
            change = np.flatnonzero(own[1:] != own[:-1]) + 1
            counts = np.diff(np.concatenate(([0], change, [b - a])))
            distinct[i], common[i], longest[i] = len(counts) / (b - a), counts.max() / (b - a), word_length[a:b].max()
        if b - a > 2:
            own = np.sort(triple[a:b - 2])
            same = own[1:] == own[:-1]
            windows[i] = same.sum() / (b - a - 2)
        if d - c > 1:
            own = np.sort(line_hash[c:d])
            repeated[i] = (own[1:] == own[:-1]).sum() / (d - c)
    return np.stack([
        np.log1p(n), (total[runs.last] - total[runs.first]) / some, np.log1p(longest), of(_CAPITAL) / chars, of(_DIGIT) / chars,
        of(_SYMBOL) / some, of(_MARK) / some, of(_STOP) / some, n / lines, repeated, distinct, windows,
        (short[runs.last] - short[runs.first]) / some, np.log(lines), of(_BAR) / some, of(_HIGH) / chars, common], axis=1)


