"""Vectorised pre-tokenisation of the byte-level vocabularies, without regex.

The pattern of the rank files splits text into contractions, runs of letters,
of numbers and of other signs (each with one leading space) and white space.
Here a whole Arrow batch is handled as one array: bytes -> code points -> a
class per code point by table -> token starts. A start depends on the state of
the automaton before it; all its transitions are resets at a change of class,
so their composition is associative and runs as array scans (shifts and
masks) over the batch, with document starts as resets.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
WHITE = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
SLICE_BYTES = 1 << 18

_table = np.full(0x110000, UNKNOWN, np.uint8)


def classes(cp: np.ndarray) -> np.ndarray:
    """Class per code point; the table fills as code points are met."""
    got = _table[cp]
    new = np.unique(cp[got == UNKNOWN])
    if len(new):
        for c in new.tolist():
            kind = unicodedata.category(chr(c))[0]
            _table[c] = SPACE if c in WHITE else LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
        got = _table[cp]
    return got


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string array; null counts as empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their byte offsets) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, high, keep, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        i = np.flatnonzero((cp >= low) & (cp < high)) if len(data) > len(at) else np.zeros(0, np.int64)
        if len(i):
            v = cp[i] & keep
            for k in range(1, more + 1):
                v = (v << 6) | (pad[at[i] + k] & 0x3F)
            # marked negative so that the next range doesn't take the decoded value for a lead byte
            cp[i] = -v - 1
    return np.where(cp < 0, -cp - 1, cp), at


def token_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Byte offsets at which a pre-token starts; `rows` are the documents' offsets."""
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64)
    cp, at = codepoints(data)
    n = len(cp)
    cls = classes(cp)
    doc = np.zeros(n + 1, bool)
    first = rows[:-1][rows[:-1] < n_bytes]
    doc[np.searchsorted(at, first)] = True
    doc[n] = True
    start = doc.copy()
    start[1:n] |= cls[1:] != cls[:-1]
    change = start.copy()
    # the last white space before a non-space of the same document is a token
    # of its own, or the next token's first character if it is a plain space
    last = np.flatnonzero((cls == SPACE) & change[1:] & ~doc[1:])
    start[last] = True
    plain = last[cp[last] == 0x20]
    start[plain + 1] = False
    # contractions: an apostrophe alone in its run, not led by a plain space
    q = np.flatnonzero((cp == 0x27) & change[:n] & start[:n] & change[1:] & ~doc[1:])
    if len(q):
        ext = np.concatenate([cp, np.zeros(2, cp.dtype)])
        a, b = ext[q + 1], np.where(doc[np.minimum(q + 2, n)], 0, ext[q + 2])
        one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
        two = (a == 0x72) & (b == 0x65) | (a == 0x76) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        for hit, k in ((one, 2), (two & ~one, 3)):
            i = q[hit]
            start[i + 1] = False
            start[np.minimum(i + k, n)] = True
    return at[np.flatnonzero(start[:n])]


def pretokens(arr: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pre-tokens of all rows as one binary array, offsets of the rows in it)."""
    data, rows = utf8(arr)
    starts = token_starts(data, rows)
    bounds = np.append(starts, len(data)).astype(np.int32)
    tokens = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
    return tokens, np.searchsorted(starts, rows)


def row_slices(arr: pa.Array):
    """Ranges of rows of about SLICE_BYTES each; a longer row stands alone."""
    _, rows = utf8(arr)
    i = 0
    while i < len(arr):
        j = int(np.searchsorted(rows, rows[i] + SLICE_BYTES, "right")) - 1
        j = min(max(j, i + 1), len(arr))
        yield arr.slice(i, j - i)
        i = j
