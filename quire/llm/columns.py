"""Words and word hashes of many texts at once, on the bytes of an Arrow column.

A batch of texts is one long byte array with offsets. Words are runs of bytes of a class, found by
comparing each byte's class with that of its neighbour; their hashes take eight bytes of all words at a time.
Nothing loops over words in Python, but for the few very long ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes than this are hashed one by one, by a library hash.
LONG_WORD = 256
#: The low bytes of eight that are kept, by how many.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def byte_class(kept: str = "", ranges: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """A table of 256 booleans: the bytes of kept and of the inclusive ranges."""
    table = np.zeros(256, bool)
    for c in kept.encode("latin-1"):
        table[c] = True
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words of anything but ASCII white space; UTF-8 continuation bytes are never ASCII, so bytes suffice.
SPACE_WORDS = ~byte_class(" ", ((0x09, 0x0D),))
#: Words of digits, letters and everything above ASCII, on lower-cased bytes.
PLAIN_WORDS = byte_class("", ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)))


@dataclass
class Texts:
    """The bytes of some consecutive texts; text i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most_bytes: int = 1 << 20, lower: bool = True) -> Iterator[Texts]:
    """Cut a string column into runs of whole texts of about most_bytes; null reads as empty.

    With lower, A-Z become a-z. A text longer than most_bytes is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = column.buffers()[2] if n else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        part = data[offsets[i] : offsets[j]]
        if lower:
            part = part + (((part >= 65) & (part <= 90)).view(np.uint8) << 5)
        yield Texts(part, offsets[i : j + 1] - offsets[i], i)
        i = j


@dataclass
class Words:
    """start and end: bytes of each word; text: its text; counts and first: words of each text and where they begin."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    counts: np.ndarray
    first: np.ndarray


def words(texts: Texts, kind: np.ndarray) -> Words:
    """Runs of bytes of the class kind; a run never crosses from one text to the next."""
    inside = kind[texts.data]
    n = len(inside)
    fresh = np.zeros(n + 1, bool)
    fresh[texts.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, texts.offsets)
    counts = np.diff(first)
    return Words(start, end, np.repeat(np.arange(len(texts)), counts), counts, first[:-1])


def hashes(texts: Texts, found: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words in any batch.

    Eight bytes at a time, mixed between, so that no relation among the bytes survives: different words collide
    as random numbers would.
    """
    size = found.end - found.start
    padded = np.concatenate((texts.data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix(size.astype(np.uint64) * _BASE)
        who, done = np.flatnonzero(size <= LONG_WORD), 0
        while len(who):
            part = eight[found.start[who] + done] & _KEPT[np.minimum(size[who] - done, 8)]
            out[who] = mix((out[who] ^ part) * _BASE)
            done += 8
            who = who[size[who] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        body = texts.data[found.start[i] : found.end[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little")
    return out


def grams(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words; entries that cross texts are for the caller to leave out."""
    size = max(0, len(word_hashes) - n + 1)
    total = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * _BASE + word_hashes[j : j + size]
    return mix(total)


def within(found: Words, n: int) -> np.ndarray:
    """Which of grams(..., n) lie in one text."""
    size = max(0, len(found.text) - n + 1)
    return found.text[:size] == found.text[n - 1 : n - 1 + size]
