"""Tokens and n-grams of whole Arrow string columns, as numpy arrays.

All operators of this subpackage that work on words share this helper: it turns the texts of one Arrow batch into flat
arrays (word hashes, the document of every word) without a Python loop over words. Words are hashed to 64 bits; the hash
is a polynomial over the lower-cased (A-Z only) bytes with a random 64-bit value for every byte, then mixed, so equal
words always have equal hashes and different ones collide with a chance of about 2**-64 for each pair.

Null and empty texts simply have no words. A text of any length is tokenised in pieces that are cut between words, so
scratch memory is bounded by the longest single word and not by the longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)
_PIECE = 1 << 19
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z hash as a-z

#: Bytes that end a word: U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of a letter or digit: ASCII letters and digits and all bytes of multibyte characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _PIECE + 1024)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, x, U)])) for x in (U(_MULT), U(_INV))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit hashes (bijective)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(32))
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
        h *= U(0xD6E8FEB86659FD93)
        h ^= h >> U(32)
    return h


@dataclass
class Words:
    """Words of a batch in order: their hashes and documents (row numbers); n: rows of the batch; bounds: n + 1 offsets into words; spans: first and end byte of every word, if asked for."""

    hash: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    spans: tuple[np.ndarray, np.ndarray] | None = None

    @property
    def n(self) -> int:
        return len(self.bounds) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _pieces(buf: np.ndarray, sep: np.ndarray):
    a = 0
    while a < len(buf):
        b = min(len(buf), a + _PIECE)
        step = 4096
        while b < len(buf) and not sep[buf[b]]:
            found = np.flatnonzero(sep[buf[b : b + step]])
            b = b + int(found[0]) if len(found) else min(len(buf), b + step)
            step *= 2
        yield a, b
        a = b


def words(col: pa.Array | pa.ChunkedArray, sep: np.ndarray = SPACE, fold: bool = True, spans: bool = False) -> Words:
    """Split every text at the bytes marked in sep; fold: A-Z count as a-z."""
    buf, off = text_bytes(col)
    byte = _FOLDED if fold else _BYTE
    at: list[tuple[np.ndarray, np.ndarray]] = []
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    hashes, docs = [], []
    for a, b in _pieces(buf, sep):
        part = buf[a:b]
        inside = ~sep[part]
        begins = first[a : b + 1]
        start = inside.copy()
        start[1:] &= ~inside[:-1] | begins[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | begins[1:-1]
        s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
        if not len(s):
            continue
        power, inverse = _power_tables(len(part) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(part) + 1, U)
            np.cumsum(byte[part] * power[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U) * U(0xA0761D6478BD642F)))
        docs.append(np.searchsorted(off, s + a, "right") - 1)
        if spans:
            at.append((s + a, e + a))
    h = np.concatenate(hashes) if hashes else np.zeros(0, U)
    d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    both = tuple(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in at)]) for k in (0, 1)) if spans else None
    return Words(h, d, np.searchsorted(d, np.arange(len(off))), both)


def ngrams(w: Words, n: int, gaps: tuple[int, ...] | None = None, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and documents of all runs of n words inside a document; with gaps, of the words at those offsets instead."""
    at = gaps or tuple(range(n))
    m = max(0, len(w.hash) - at[-1])
    with np.errstate(over="ignore"):
        h = np.full(m, U(salt * 2 + 1))
        for k in at:
            h = h * U(_MULT) + w.hash[k : k + m]
    keep = w.doc[:m] == w.doc[at[-1] : at[-1] + m] if m else np.zeros(0, bool)
    return mix(h[keep]), w.doc[:m][keep]


def per_doc_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values for every document, given offsets; documents without any have 0."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
