"""Vectorised work on the bytes of many texts at once.

A string column of an Arrow batch is one run of UTF-8 bytes with offsets, so
numpy can find and hash the words of a whole block of texts without making
Python strings.  Blocks are cut at text boundaries at about ``BLOCK_BYTES``;
a longer text is a block of its own.  Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a multiply-xorshift finaliser, one to one)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(29))
    h = h * _MULT
    return h ^ (h >> _U(32))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _MULT)
_BASE = _U(0xA24BAED4963EE407)
_powers = np.cumprod(np.full(256, _BASE, dtype=_U))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(1 << int(n).bit_length(), _BASE, dtype=_U))
    return _powers


def byte_table(chars: bytes) -> np.ndarray:
    """A 256-entry table that is True at the given bytes."""
    t = np.zeros(256, dtype=bool)
    t[list(chars)] = True
    return t


#: Bytes that part words: space and the control characters from tab to carriage return.
SPACE = byte_table(b" \t\n\x0b\x0c\r")
NOT_SPACE = ~SPACE
#: ASCII letters and digits, and every byte of a longer UTF-8 sequence.
ALNUM = byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
SENTENCE_END = byte_table(b".!?\n")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Block:
    """Bytes of consecutive texts; text i is data[offsets[i]:offsets[i + 1]]."""
    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    start: np.ndarray   # byte position of each word
    length: np.ndarray
    doc: np.ndarray     # text of each word
    mask: np.ndarray    # word bytes


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string array (nulls as empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(col: pa.Array, target: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string array into blocks of about ``target`` bytes."""
    if not len(col):
        return
    data, offsets = text_buffers(col)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + target, side="right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first:last + 1]
        yield Block(first, data[own[0]:own[-1]], own - own[0])
        first = last


def find_words(block: Block, word: np.ndarray = NOT_SPACE) -> Words:
    """Maximal runs of word bytes inside each text."""
    mask = word[block.data]
    if not len(mask):
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty, mask)
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    inner = block.offsets[:-1]
    before[inner[inner < len(mask)]] = False
    start = np.flatnonzero(mask & ~before)
    bounds = np.append(start, len(mask))
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    length = total[bounds[1:]] - total[bounds[:-1]]
    doc = np.searchsorted(block.offsets, start, side="right") - 1
    return Words(start, length, doc, mask)


def hash_words(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes (tabulated bytes, polynomial, mixed)."""
    if not len(words.start):
        return np.zeros(0, _U)
    first = np.concatenate(([0], np.cumsum(words.length)[:-1]))
    at = np.arange(int(words.length.sum())) - np.repeat(first, words.length)
    value = _BYTE_VALUE[data[words.mask]] * _power_table(int(words.length.max()))[at]
    return mix(np.add.reduceat(value, first) + words.length.astype(_U))


def byte_ngrams(data: np.ndarray, offsets: np.ndarray, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the n-byte windows inside words (n <= 8).

    A window may begin with the byte before a word or end with the byte after
    it (both read as a blank), so prefixes and suffixes are told apart.
    """
    size = len(data) - n + 1
    if size <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    plain = np.where(mask, data, np.uint8(32)).astype(_U)
    ok = mask[:size] | mask[n - 1:n - 1 + size] if n > 2 else mask[:size] & mask[1:1 + size]
    for k in range(1, n - 1):
        ok &= mask[k:k + size]
    ends = offsets[1:]
    for k in range(1, n):   # windows that run into the next text
        cut = ends - k
        ok[cut[(cut >= 0) & (cut < size)]] = False
    at = np.flatnonzero(ok)
    value = np.full(len(at), n, dtype=_U)
    for k in range(n):
        value = (value << _U(8)) | plain[at + k]
    return mix(value * _MULT), at


def char_ngrams(block: Block, mask: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and texts of the n-character windows inside words.

    A window may begin with the character before a word or end with the one after it (both read as a blank), so
    prefixes and suffixes are told apart.  A character is the packed bytes of its UTF-8 form.
    """
    data, offsets = block.data, block.offsets
    value = np.where(mask, data, np.uint8(32)).astype(_U)
    if data.size and data.max() >= 128:
        start = np.flatnonzero((data & 0xC0) != 0x80)
        length = np.diff(np.append(start, len(data)))
        packed = value[start]
        for k in range(1, 4):
            more = np.flatnonzero(length > k)
            packed[more] = (packed[more] << _U(8)) | data[start[more] + k].astype(_U)
        value, mask, offsets = packed, mask[start], np.searchsorted(start, offsets)
    size = len(value) - n + 1
    if size <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    ok = mask[:size] | mask[n - 1:n - 1 + size] if n > 2 else mask[:size] & mask[1:1 + size]
    for k in range(1, n - 1):
        ok &= mask[k:k + size]
    for k in range(1, n):   # windows that run into the next text
        cut = offsets[1:] - k
        ok[cut[(cut >= 0) & (cut < size)]] = False
    at = np.flatnonzero(ok)
    hashed = np.full(len(at), n, dtype=_U)
    for k in range(n):
        hashed = hashed * _BASE + value[at + k]
    hashed = mix(hashed)
    return hashed, np.searchsorted(offsets, at, side="right") - 1


def split_offsets(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the items of each text when ``doc`` (sorted) names the text of each item."""
    return np.searchsorted(doc, np.arange(n + 1))
