"""Pre-tokens of the public byte-level pattern, split for a whole slice at once.

The pattern has seven alternatives: contractions, letters, numbers and others
(each with one space before it, if there is one), and white space. Its matches
cover the text, and where they begin depends only on the class of the
neighbouring characters, so the starts come out of array comparisons."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa

OTHER, LETTER, NUMBER, SPACE = range(4)

# The characters with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Letters and numbers that Unicode 16 adds to Python's character
# database (first, last, class); the tokenizer libraries follow Unicode 16.
UNICODE_16 = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER),
    (0x10D40, 0x10D49, NUMBER), (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER),
    (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER), (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER),
    (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER), (0x116D0, 0x116E3, NUMBER),
    (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER),
    (0x1CCF0, 0x1CCF9, NUMBER), (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]


@functools.cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for begin, end, kind in UNICODE_16:
        table[begin : end + 1] = kind
    table[WHITE_SPACE] = SPACE
    return table


def starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; `first` marks the first character of each text."""
    n = len(points)
    kind = classes()[points]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    after_blank = np.zeros(n, bool)  # the character before is a space of the same text
    after_blank[1:] = (points[:-1] == 0x20) & ~first[1:]
    white = kind == SPACE
    start = change & (white | ~after_blank)
    # the last character of a white run goes with what follows, or stands alone
    run_end = np.zeros(n, bool)
    run_end[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= run_end
    # contractions: a lone apostrophe at a start, then s t m d re ve ll
    quote = np.flatnonzero((points == 0x27) & change & ~after_blank)
    if len(quote):
        padded = np.concatenate((points, np.zeros(3, points.dtype)))
        edge = np.concatenate((first, np.ones(3, bool)))
        a, b = padded[quote + 1], padded[quote + 2]
        inside = ~edge[quote + 1]
        one = inside & np.isin(a, [ord(c) for c in "stmd"])
        two = inside & ~edge[quote + 2] & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for found, size in ((quote[one], 2), (quote[two], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    return start


def split(data: np.ndarray, offsets: np.ndarray, special: tuple[str, ...] = ()) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Pre-tokens of the texts data[offsets[i]:offsets[i + 1]] as a dictionary of
    distinct byte strings with one index per pre-token, and the offsets of each
    text's pre-tokens. Occurrences of `special` strings are one pre-token each."""
    raw = data.tobytes()
    if not raw:
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80) if len(points) != len(data) else np.arange(len(data))
    text_at = np.searchsorted(lead, offsets)
    first = np.zeros(len(points), bool)
    first[text_at[text_at < len(points)]] = True
    whole = []
    for word in special:
        key, at = word.encode(), raw.find(word.encode())
        while at >= 0:
            begin, end = np.searchsorted(lead, (at, at + len(key)))
            if not first[begin + 1 : end].any():
                first[begin] = True
                first[end : end + 1] = True
                whole.append((begin, end))
                at = raw.find(key, at + len(key))
            else:
                at = raw.find(key, at + 1)
    start = starts(points, first)
    for begin, end in whole:
        start[begin + 1 : end] = False
    at = lead[np.flatnonzero(start)]
    bounds = np.concatenate((at, [len(data)])).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(raw)])
    return tokens.dictionary_encode(), np.searchsorted(at, offsets)
