"""Array helpers for Arrow batches of text: bytes, words, hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_ROW = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: an invertible scrambling of 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Odd multipliers of byte places.
_PLACE = mix(np.arange(1, _ROW + 1, dtype=U64)) | U64(1)


def place(at: np.ndarray) -> np.ndarray:
    """The multiplier of each byte place, at any length."""
    out = _PLACE[at & (_ROW - 1)]
    if len(at) and int(at.max()) >= _ROW:
        out = out * (mix((at // _ROW).astype(U64)) | U64(1))
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, one text after the other, and
    the offsets of the texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_bounds(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; runs end at the text's end."""
    n = len(is_word)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[:1] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1:] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each non-empty span of bytes; spans are in order and apart."""
    if not len(starts):
        return np.zeros(0, U64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    inside = data[np.repeat(starts, lengths) + at].astype(U64) + U64(1)
    inside *= place(at)
    return mix(np.add.reduceat(inside, first) + lengths.astype(U64))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, digits, letters and all that is not ASCII)
    of every text, one text after the other, and the offsets of the texts' words."""
    data, offsets = column_bytes(column)
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    data = _LOWER[data]
    starts, ends = word_bounds(_IS_WORD[data], offsets)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts 64-bit keys and keeps the order of equal ones, and the
    starts of the groups of equal keys. Key and place are packed into one word for
    the sort; keys that agree in their high bits are told apart after it."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = U64(max(1, int(n - 1).bit_length()))
    packed = np.sort(((keys >> bits) << bits) | np.arange(n, dtype=U64))
    order = (packed & ((U64(1) << bits) - U64(1))).astype(np.int64)
    high = packed >> bits
    sorted_keys = keys[order]
    same = high[1:] == high[:-1]
    wrong = same & (sorted_keys[1:] < sorted_keys[:-1])
    if wrong.any():  # different keys with equal high bits: a plain stable sort
        order = np.argsort(keys, kind="stable")
        sorted_keys = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ranges [start, start + length), one range after the other."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)
