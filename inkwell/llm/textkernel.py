"""Array kernels over Arrow text columns: words, rolling hashes, window minima.

Everything here is plain numpy over the bytes of a group of documents, so the
cost does not depend on how words fall into rows. Hashes are polynomial sums
modulo 2**64, mixed; prefix sums and the inverse of the odd base give any
range's hash in constant time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_tables: list[np.ndarray] = []
#: Bytes of text handled at a time (a longer document is handled alone, whole).
CHUNK = 1 << 20

_SPACE = np.ones(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = False
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_ALNUM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, of at least n items."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        made = []
        for base in (_BASE, _INV):
            p = np.empty(size, dtype=U)
            p[0], filled = 1, 1
            step = base
            while filled < size:
                take = min(filled, size - filled)
                p[filled : filled + take] = p[:take] * U(step)
                filled += take
                step = step * step % (1 << 64)
            made.append(p)
        _tables[:] = made
    return _tables[0], _tables[1]


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The whole numbers of each range, one range after the other."""
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def groups(column: pa.Array, chunk: int = CHUNK):
    """(first row, end row, bytes, offsets) of groups of whole texts. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string()) if column.nbytes < 1 << 31 else column
    wide = pa.types.is_large_string(column.type)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + chunk, side="right")) - 1)
        end = min(end, n)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


class Words:
    """Words of a group: starts and ends (bytes), ptr (words by document), hashes."""

    __slots__ = ("ends", "hash", "ptr", "starts")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, plain: bool = False):
        """plain: lower-case ASCII letters, words of letters and digits (other
        bytes above 127 are letters); else words as they are between ASCII spaces."""
        n = len(buf)
        if plain:
            buf = _LOWER[buf]
        w = np.zeros(n + 1, dtype=bool)
        w[:n] = (_ALNUM if plain else _SPACE)[buf] if n else False
        edge = np.zeros(n + 1, dtype=bool)
        edge[offs] = True
        first = w[:n].copy()
        first[1:] &= ~w[: n - 1] | edge[1:n]
        last = w[:n] & (~w[1:] | edge[1:])
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, offs)
        p, q = powers(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((buf.astype(U) + U(1)) * p[:n], out=sums[1:])
        self.hash = mix((sums[self.ends] - sums[self.starts]) * q[self.starts])

    def of(self) -> np.ndarray:
        """The document of each word, within the group."""
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k items (len(h) - k + 1 of them), whatever the documents."""
    n = len(h)
    if n < k:
        return np.zeros(0, dtype=U)
    p, q = powers(n + 1)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(h * p[:n], out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * q[: n - k + 1])


def inside(ptr: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether the run of k items at each of n - k + 1 positions is in one document."""
    if n < k:
        return np.zeros(0, dtype=bool)
    end = np.repeat(ptr[1:], np.diff(ptr))
    return np.arange(n - k + 1) + k <= end[: n - k + 1]


def sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least or greatest of each w neighbours (len(x) - w + 1 items)."""
    f, done = (np.minimum if least else np.maximum), 1
    while done < w:
        step = min(done, w - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def minimisers(h: np.ndarray, ptr: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions, and hashes there, of the least k-gram of any w neighbouring k-grams
    that lie in one document; ties are all taken. Two documents that share
    k + w - 1 items share such a position."""
    n = len(h)
    if n < k + w - 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    g = kgrams(h, k)
    g |= U(1)  # so that 0 is none of them
    low = sliding(g, w, True)
    low[~inside(ptr, n, k + w - 1)] = 0
    padded = np.zeros(len(low) + 2 * (w - 1), dtype=U)
    padded[w - 1 : w - 1 + len(low)] = low
    at = np.flatnonzero(sliding(padded, w, False) == g)
    return at, g[at]
