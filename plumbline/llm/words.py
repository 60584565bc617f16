"""Words of a batch of texts as integer codes: Arrow splits on ASCII white space and codes the distinct words."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Words(NamedTuple):
    codes: np.ndarray  # of all texts' words, in order
    offsets: np.ndarray  # text i has codes[offsets[i]:offsets[i + 1]]
    distinct: pa.Array  # the word of each code

    @property
    def of_text(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every process."""
        return mixed(np.fromiter((zlib.crc32(w) | len(w) << 32 for w in self.distinct.cast(pa.binary()).to_pylist()), np.uint64, len(self.distinct)))


def words_of(texts: pa.Array) -> Words:
    """Words `[^\\x20\\x09-\\x0D]+` of each text; a null text has none."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0)  # white space at either end leaves an empty string
    kept = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    coded = flat.filter(there).dictionary_encode()
    return Words(coded.indices.to_numpy().astype(np.int64), kept[offsets - offsets[0]], coded.dictionary)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them (the finalizer of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of `size` words within a text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    room = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n)  # words from here to the text's end
    first = np.flatnonzero(room >= size)
    return mixed(total[first]), first
