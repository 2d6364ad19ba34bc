"""Vectorised word hashing over Arrow string columns.

Texts are never turned into Python strings here: the UTF-8 bytes of an Arrow
column are scanned with numpy in chunks of bounded size, so that a batch of
long texts costs no more memory than one of short texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_U = np.uint64
_R = 0x9E3779B97F4A7C15

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_keys = np.zeros(0, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def place_keys(n: int) -> np.ndarray:
    """A key for each place in a word, odd and without structure: no two words are made to collide, however regular."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, max(n, 1 << 12) + 1, dtype=_U) * _U(_R)) | _U(1)
    return _keys


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts [i, j) of about CHUNK_BYTES bytes together; a longer text stands alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def _scan(b: np.ndarray, heads: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each word, its hash) in bytes b; heads: where texts begin."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, _U)
    white = gap[b]
    cut = np.empty(len(b) + 1, dtype=bool)
    cut[0] = True
    cut[1:-1] = white[:-1]
    cut[-1] = True
    cut[heads[heads <= len(b)]] = True
    start = np.flatnonzero(~white & cut[:-1])
    stop = np.empty(len(b), dtype=bool)
    stop[:-1] = white[1:] | cut[1:-1]
    stop[-1] = True
    end = np.flatnonzero(~white & stop) + 1
    total = np.empty(len(b) + 1, dtype=_U)
    total[0] = 0
    size = end - start
    keys = place_keys(int(size.max(initial=0)) + 1)
    begin = np.zeros(len(b), dtype=np.int64)
    begin[start] = start
    np.maximum.accumulate(begin, out=begin)
    place = np.minimum(np.arange(len(b)) - begin, len(keys) - 1)  # gaps count to no word, whatever their key
    np.cumsum((b.astype(_U) + _U(1)) * keys[place], out=total[1:])
    h = total[end] - total[start]
    return start, mix(h + size.astype(_U) * _U(0xD6E8FEB86659FD93))


def words(raw: np.ndarray, at: np.ndarray, i: int, j: int, lower: bool = True, gap: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts i .. j - 1, and where each text's words begin among them (j - i + 1 bounds).

    A text longer than CHUNK_BYTES is scanned in pieces that end at a gap, so that memory stays bounded.
    """
    lo, hi = int(at[i]), int(at[j])
    if hi - lo <= 2 * CHUNK_BYTES or j - i > 1:
        b = LOWER[raw[lo:hi]] if lower else raw[lo:hi]
        start, h = _scan(b, (at[i:j] - lo).astype(np.int64), gap)
        return h, np.searchsorted(start, at[i : j + 1] - lo)
    found, p = [], lo
    while p < hi:
        q, look = min(p + CHUNK_BYTES, hi), CHUNK_BYTES
        while q < hi:
            back = np.flatnonzero(gap[raw[p:q]])
            if len(back):
                q = p + int(back[-1]) + 1
                break
            q = min(q + look, hi)
        b = LOWER[raw[p:q]] if lower else raw[p:q]
        found.append(_scan(b, np.zeros(1, np.int64), gap)[1])
        p = q
    h = np.concatenate(found)
    return h, np.array([0, len(h)])


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all width-word shingles, and each text's bounds among them.

    A text of fewer words, but at least one, has one shingle: its whole sequence.
    """
    keys = mix(np.arange(1, width + 1, dtype=_U) * _U(_R))
    n = len(h)
    counts = np.diff(bounds)
    full = np.maximum(counts - width + 1, 0)
    if n >= width:
        acc = h[: n - width + 1] * keys[0]
        for k in range(1, width):
            acc = acc + h[k : n - width + 1 + k] * keys[k]
        acc = mix(acc ^ (acc >> _U(29)))
    else:
        acc = np.zeros(0, _U)
    short = (counts > 0) & (counts < width)
    out_n = np.where(short, 1, full)
    out_b = np.concatenate([[0], np.cumsum(out_n)])
    out = np.empty(int(out_b[-1]), dtype=_U)
    keep = np.zeros(len(acc), dtype=bool)
    if len(acc):
        edge = np.zeros(len(acc) + 1, dtype=np.int64)
        np.add.at(edge, bounds[:-1][full > 0], 1)
        np.add.at(edge, (bounds[:-1] + full)[full > 0], -1)
        keep = np.cumsum(edge[:-1]) > 0
    place = np.ones(len(out), dtype=bool)
    place[out_b[:-1][short]] = False
    out[place] = acc[keep]
    for t in np.flatnonzero(short):
        w = h[bounds[t] : bounds[t + 1]]
        out[out_b[t]] = mix(np.array([(w * keys[: len(w)]).sum(dtype=_U) ^ _U(0xA5A5A5A5 + len(w))], dtype=_U))[0]
    return out, out_b
