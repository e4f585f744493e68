"""Statistics of whole texts, from their UTF-8 bytes: one histogram, one split, one sort."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

#: name: the bytes that it counts.
CLASSES = {
    "n_symbols": b"#*$%&|<>",
    "n_upper": bytes(range(65, 91)),
    "n_lower": bytes(range(97, 123)),
    "n_digits": bytes(range(48, 58)),
    "n_exclaim": b"!",
    "n_stops": b".?!",
    "n_commas": b",;:",
    "n_quotes": b"\"'()[]{}",
    "n_other_punct": b"-_=+/\\@^~`",
    "n_spaces": b" \t\x0b\x0c\r",
}
FIELDS = ["n_words", "word_chars", "n_dup_lines", "n_repeat_words", "n_chars_seen", "n_lines", "n_distinct_words", "n_distinct_windows", "longest_word", "longest_line", "n_stop_lines", "n_letter_words", *CLASSES]
SCHEMA = [T.StructField(n, T.LongType()) for n in FIELDS]

_counts = np.zeros((256, len(CLASSES)), np.int64)
for _i, _set in enumerate(CLASSES.values()):
    _counts[list(_set), _i] = 1
#: All but letters, bytes of characters beyond ASCII, and what separates words.
_no_letters = bytes(b for b in range(128) if not chr(b).isalpha() and b not in b" \t\n\x0b\x0c\r")
_starts = np.ones(256, np.int64)  # bytes that begin a code point
_starts[0x80:0xC0] = 0
_blank = np.zeros(256, np.int64)
_blank[list(b" \t\n\x0b\x0c\r")] = 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def statistics(text: bytes) -> list[int]:
    """The values of FIELDS for one text; an empty text has one line and no word.

    Words are runs of bytes other than space and 0x09-0x0D. A word counts as repeated if it
    lies in a window of three words that the text has at least twice. A line counts as a
    duplicate if it has a word and equals an earlier line.
    """
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(seen @ _starts)
    words = text.split()
    n = len(words)
    lines = text.split(b"\n")
    earlier: set[bytes] = set()
    dup = stops = longest = 0
    for line in lines:
        if len(line) > longest:
            longest = len(line)
        bare = line.rstrip()
        if bare and not bare.isspace():
            if line in earlier:
                dup += 1
            else:
                earlier.add(line)
            stops += bare[-1:] in b".?!\"'"
    repeated, windows = 0, max(0, n - 2)
    if n >= 4:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        w = h * _A
        w[:-1] ^= (h[1:] << np.uint64(21)) | (h[1:] >> np.uint64(43))
        w = w[:-2] * _B + h[2:]
        order = np.argsort(w, kind="stable")
        same = w[order[1:]] == w[order[:-1]]
        if same.any():
            twice = np.zeros(len(w), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(n, bool)
            cover[:-2] |= twice
            cover[1:-1] |= twice
            cover[2:] |= twice
            repeated = int(cover.sum())
            windows -= int(same.sum())
    return [n, chars - int(seen @ _blank), dup, repeated, chars, len(lines), len(set(words)), windows, max(map(len, words), default=0), longest, stops, len(text.translate(None, _no_letters).split()), *(seen @ _counts).tolist()]


def batch(texts: Sequence[bytes | None]) -> list[pa.Array]:
    """A column for each of FIELDS; a null text counts as empty."""
    rows = np.array([statistics(t or b"") for t in texts], np.int64).reshape(len(texts), len(FIELDS))
    return [pa.array(rows[:, i]) for i in range(len(FIELDS))]
