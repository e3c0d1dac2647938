"""Vectorised text primitives used inside Arrow tasks.

A :class:`TextBlock` is a run of whole documents held as one byte array, cut
so that no block is much larger than ``BLOCK_BYTES`` (one longer document is a
block of its own).  Any substring can be hashed in constant time from prefix
sums, so words, lines, shingles and byte windows need no Python loop.

Null texts are empty texts.  Words are runs of bytes outside ``[\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

#: Substrings are hashed as polynomials over the prime field of 2^31 - 1, at two points: no string of two letters makes
#: whole powers cancel, as it can modulo 2^64.
_PRIME = np.uint64((1 << 31) - 1)
_BASES = (1_220_703_125, 1_162_261_467)
_INVERSES = tuple(pow(x, -1, (1 << 31) - 1) for x in _BASES)
_TABLES = np.random.default_rng(20240229).integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

def _folded(x: np.ndarray) -> np.ndarray:
    return (x & _PRIME) + (x >> np.uint64(31))


def _residue(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^63 modulo the prime, by folding its upper bits twice."""
    x = _folded(_folded(x))
    return np.minimum(x, x - _PRIME)  # below the prime, the difference wraps round to more than any residue


_powers: list[np.ndarray] = [np.ones((2, 1), np.uint32), np.ones((2, 1), np.uint32)]


def powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers of both hash bases and of their inverses, by doubling."""
    if _powers[0].shape[1] < n:
        size = max(n, BLOCK_BYTES + 65536)
        for k, bases in enumerate((_BASES, _INVERSES)):
            p = np.ones((2, size), np.uint32)
            for row, base in zip(p, bases, strict=True):
                have = 1
                while have < size:
                    step = np.uint64(pow(base, have, int(_PRIME)))
                    take = min(have, size - have)
                    row[have : have + take] = _residue(row[:take] * step)
                    have += take
            _powers[k] = p
    return _powers


_QUICK = 0x9E3779B97F4A7C15
_quick: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _quick_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _quick
    if len(_quick[0]) < n:
        made = []
        for base in (_QUICK, pow(_QUICK, -1, 1 << 64)):
            p = np.full(max(n, BLOCK_BYTES + 65536), base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _quick = (made[0], made[1])
    return _quick


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """An ordered pair of 64-bit hashes as one."""
    b = np.uint64(b & (2**64 - 1)) if isinstance(b, int) else b
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b + np.uint64(0x632BE59BD9B4E019))


@dataclass
class TextBlock:
    data: np.ndarray  # uint8
    offs: np.ndarray  # int64, one more than documents
    first: int  # row of the first document in its Arrow batch
    null: np.ndarray  # bool by document
    _prefix: np.ndarray | None = field(default=None, repr=False)

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    @property
    def rows(self) -> slice:
        return slice(self.first, self.first + self.n)

    def lowered(self) -> TextBlock:
        return TextBlock(LOWER[self.data], self.offs, self.first, self.null)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [start, end); equal bytes have equal hashes wherever they stand."""
        pw, inv = powers(len(self.data) + 1)
        if self._prefix is None:
            self._prefix = np.zeros((2, len(self.data) + 1), np.uint32)
            for k in range(2):
                for lo in range(0, len(self.data), 1 << 14):  # in pieces that stay in the cache
                    part = self.data[lo : lo + (1 << 14)]
                    sums = np.cumsum(_folded(_TABLES[k][part] * pw[k, lo : lo + len(part)]))  # each below 2^32
                    self._prefix[k, lo + 1 : lo + 1 + len(part)] = _residue(sums + np.uint64(self._prefix[k, lo]))
        h = (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for k in range(2):
            h = mix(h + _residue(_residue(self._prefix[k][end] + _PRIME - self._prefix[k][start]) * inv[k][start]))
        return h

    def window_hashes(self, width: int) -> np.ndarray:
        """A quick hash of the ``width`` bytes from every position on.  It only picks places: strings made for it can share one."""
        n = len(self.data) - width + 1
        pw, inv = _quick_powers(len(self.data))
        prefix = np.zeros(len(self.data) + 1, np.uint64)
        table, piece = _TABLES[0] | np.uint64(1), 1 << 14
        for lo in range(0, len(self.data), piece):
            part = prefix[lo + 1 : lo + 1 + piece]
            np.cumsum(table[self.data[lo : lo + piece]] * pw[lo : lo + len(part)], out=part)
            part += prefix[lo]
        out = np.empty(max(0, n), np.uint64)
        for lo in range(0, n, piece):
            hi = min(n, lo + piece)
            out[lo:hi] = mix((prefix[lo + width : hi + width] - prefix[lo:hi]) * inv[lo:hi])
        return out

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs where ``inside`` holds; no run crosses a document."""
        m = len(inside)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cuts = self.offs[(self.offs > 0) & (self.offs < m)]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document indexes of all words."""
        start, end = self.runs(~SPACE[self.data])
        return start, end, self.owner(start)

    def owner(self, at: np.ndarray) -> np.ndarray:
        """The document index of byte positions."""
        return np.searchsorted(self.offs, at, side="right") - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The strings of an Arrow column as blocks of whole documents, in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    null = np.asarray(column.is_null())
    if null.any():
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), len(column))
        yield TextBlock(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i, null[i:j])
        i = j


def shingle_sets(block: TextBlock, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word shingles of every document of a lower-cased block.

    Returns shingle hashes sorted within each document, the document of each,
    and offsets by document.  Fewer than ``width`` words make one shingle of
    them all; no word makes none.
    """
    start, end, doc = block.words()
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(block.n + 1, np.int64)
    h = block.hashes(start, end)
    count = np.bincount(doc, minlength=block.n)
    at = np.zeros(block.n + 1, np.int64)
    np.cumsum(count, out=at[1:])
    use = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(block.n), use)
    inner = np.arange(int(use.sum())) - np.repeat(np.cumsum(use) - use, use)
    pos = at[owner] + inner
    # An absent word of a short text counts as hash 0, which no word has in practice.
    padded = np.concatenate([h, np.zeros(width, np.uint64)])
    out = np.full(len(pos), width, np.uint64)
    short = count < width
    for k in range(width):
        part = padded[pos + k]
        if short.any():
            part = np.where(short[owner] & (k >= count[owner]), np.uint64(0), part)
        out = combine(out, part)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[keep], owner[keep]
    offs = np.zeros(block.n + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=block.n), out=offs[1:])
    return out, owner, offs
