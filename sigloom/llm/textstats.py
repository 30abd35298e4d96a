"""Rule statistics of whole texts, computed per Arrow batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sigloom.llm.textops import Words, covered, is_space, mix, rolling

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
#: counts of a text, in the order of ``count_columns``
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits", "n_distinct")


def _per_row(mask: np.ndarray, row_bytes: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return sums[row_bytes[1:]] - sums[row_bytes[:-1]]


def _class_table(letters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(letters, np.uint8)] = True
    return table


_SYMBOL = _class_table(SYMBOLS)
_UPPER = _class_table(bytes(range(65, 91)))
_DIGIT = _class_table(bytes(range(48, 58)))
_PUNCT = _class_table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def repeated_words(words: Words, width: int = REPEAT_WINDOW) -> np.ndarray:
    """Per row, how many words lie in a window of ``width`` words found twice or more in the row."""
    n, rows = len(words.hashes), words.rows()
    if n < width:
        return np.zeros(len(words), np.int64)
    keys = rolling(words.hashes, width) ^ mix(rows[: n - width + 1].astype(np.uint64) + np.uint64(1))
    same = np.flatnonzero(rows[width - 1 :] == rows[: n - width + 1])
    keys = keys[same]
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    return np.bincount(rows[covered(same[among(keys, twice)], width, n)], minlength=len(words))


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Mask of the values that occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def distinct_words(words: Words) -> np.ndarray:
    """Per row, the number of different words (told apart by 40 bits of their hashes)."""
    rows = words.rows().astype(np.uint64)
    keys = np.sort((rows << np.uint64(40)) | (words.hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(words))


def line_counts(data: np.ndarray, row_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them that equal an earlier line of the row."""
    raw = data.tobytes()
    lines, again = np.zeros(len(row_bytes) - 1, np.int64), np.zeros(len(row_bytes) - 1, np.int64)
    for i, (start, end) in enumerate(zip(row_bytes[:-1].tolist(), row_bytes[1:].tolist())):
        own = [x for x in raw[start:end].split(b"\n") if x.strip()]
        lines[i], again[i] = len(own), len(own) - len(set(own))
    return lines, again


def count_columns(column: pa.Array) -> dict[str, np.ndarray]:
    """All of ``COUNTS`` for every text of a batch; words are maximal runs without white space."""
    words = Words(column)
    data, at = words.data, words.row_bytes
    lines, again = line_counts(data, at)
    return {
        "n_words": words.counts(),
        "word_chars": _per_row(((data & 0xC0) != 0x80) & ~is_space(data), at),
        "n_symbols": _per_row(_SYMBOL[data], at),
        "n_dup_lines": again,
        "n_repeat_words": repeated_words(words),
        "n_lines": lines,
        "n_upper": _per_row(_UPPER[data], at),
        "n_punct": _per_row(_PUNCT[data], at),
        "n_digits": _per_row(_DIGIT[data], at),
        "n_distinct": distinct_words(words),
    }


def rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Length-free statistics, one row per text; an empty text gets zeros."""
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    lines = np.maximum(counts["n_lines"], 1)
    return np.stack(
        [
            counts["word_chars"] / words, counts["n_symbols"] / chars, counts["n_dup_lines"] / lines,
            counts["n_repeat_words"] / words, counts["n_upper"] / chars, counts["n_punct"] / chars,
            counts["n_digits"] / chars, counts["n_distinct"] / words ** 0.85,
        ],
        axis=1,
    )


def letter_rates(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Statistics of the letters alone, one row per text: word length and shares of symbols, capitals, punctuation.

    Square roots spread the many values near zero. Repeats are left to rules of their own.
    """
    words, chars = np.maximum(counts["n_words"], 1), np.maximum(counts["word_chars"], 1)
    shares = [counts["word_chars"] / words, *(counts[name] / chars for name in ("n_symbols", "n_upper", "n_punct"))]
    return np.sqrt(np.stack(shares, axis=1))


def byte_shares(data: np.ndarray, row_bytes: np.ndarray) -> np.ndarray:
    """Share of each of 128 letter codes in every row (bytes beyond ASCII meet in the last)."""
    n = len(row_bytes) - 1
    out = np.zeros((n, 128))
    step = max(1, (4 << 20) // max(1, int(np.diff(row_bytes).mean()) if n else 1))
    for a in range(0, n, step):
        b = min(n, a + step)
        part = np.minimum(data[row_bytes[a] : row_bytes[b]], 127).astype(np.int64)
        rows = np.repeat(np.arange(b - a), np.diff(row_bytes[a : b + 1]))
        out[a:b] = np.bincount(rows * 128 + part, minlength=(b - a) * 128).reshape(-1, 128)
    return out / np.maximum(np.diff(row_bytes), 1)[:, None]
