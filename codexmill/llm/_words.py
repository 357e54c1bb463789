"""Words of many texts at once: hashes of all words of an Arrow column by array arithmetic on its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the memory of the power tables and of the intermediate arrays.
SLICE = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if "up" not in _tables or len(_tables["up"]) < n + 1:
        size = max(n + 1, SLICE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(t, out=t)
            _tables[name] = t
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> list[tuple[int, int]]:
    """Row ranges of at most SLICE bytes of text each (more where one text is larger)."""
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4) if len(column) else np.zeros(1, np.int32)
    out, lo = [], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + SLICE, "right")) - 1)
        out.append((lo, min(hi, len(column))))
        lo = out[-1][1]
    return out


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts whose words are parted by space, tab and line feed: (hash, row, start byte, end byte) of each word.

    Null texts have no words. Bytes count from the start of this slice's text.
    """
    column = pc.fill_null(column, "")
    column = column.cast(pa.string()) if column.type != pa.string() else column
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    if n == 0 or column.buffers()[2] is None or off[-1] == off[0]:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    raw = np.frombuffer(column.buffers()[2], np.uint8, int(off[-1] - off[0]), int(off[0]))
    off = off - off[0]
    blank = (raw == 32) | (raw == 10) | (raw == 9)
    first = np.zeros(len(raw), bool)
    inner = off[:-1]
    first[inner[inner < len(raw)]] = True
    word = ~blank
    before = np.empty(len(raw), bool)
    before[0], before[1:] = False, word[:-1]
    start = np.flatnonzero(word & (~before | first))
    stop = np.empty(len(raw), bool)
    stop[-1], stop[:-1] = True, blank[1:] | first[1:]
    end = np.flatnonzero(word & stop) + 1
    up, down = _powers(len(raw))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start, "right") - 1
    return h, row, start, end


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n consecutive words of a text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        g = np.zeros(m, np.uint64)
        for k in range(n):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m]
    ok = row[:m] == row[n - 1 :]
    return mix(g[ok]), row[:m][ok]


def distinct_per_row(g: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) without repeats, ordered by row and hash."""
    if not len(g):
        return g, row
    at = np.lexsort((g, row))
    g, row = g[at], row[at]
    keep = np.ones(len(g), bool)
    keep[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    return g[keep], row[keep]
