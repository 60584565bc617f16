"""Token ids of whole texts by the tokenizers library, through a cache of words.

The pre-tokenizer of `word_bpe_49k.json` never joins characters across ASCII white space, and its normalizer (NFC,
white space, lower case by character) acts on each word alone, so a text's ids are its words' ids in order. Real texts
repeat their words: Arrow splits and codes them, and a worker encodes each word once; it knows words by 128-bit hashes.
A word of Latin-1 letters, with or without ASCII punctuation behind them, is one or two pre-tokens; these are encoded many
at a time, since the last token of each carries the vocabulary's end-of-word mark, which tells their ids apart again.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.words import mixed

#: Words held by a worker before its cache starts anew; bounds memory, not results.
CACHE_WORDS = 1_300_000
#: Bytes of text that are encoded at a time: words that repeat within them are looked up once.
SLICE_BYTES = 3_000_000

_PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,!?;:%$&*#|]*$"
_POINTS = ".,!?;:%$&*#|"
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Bytes from which a word is hashed by itself.
_LONG = 256


def hashes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string: 128 bits tell any words that a worker ever sees apart."""
    at = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, 4 * strings.offset).astype(np.int64)
    size = np.diff(at)
    held = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if at[-1] > at[0]:
        held[:-8] = np.frombuffer(strings.buffers()[2], np.uint8, at[-1] - at[0], at[0])
    at = at[:-1] - at[0]
    eight = np.ndarray(len(held) - 7, "<u8", held, 0, (1,))  # the eight bytes from each place on
    one, two = mixed(size.astype(np.uint64) + np.uint64(1)), mixed(size.astype(np.uint64) + np.uint64(7919))
    some, start = np.flatnonzero(size > 0), 0
    while len(some):
        left = size[some] - start
        word = eight[at[some] + start] & _LOW_BYTES[np.minimum(left, 8)]
        one[some] = mixed((one[some] ^ word) * np.uint64(0x9E3779B97F4A7C15))
        two[some] = mixed((two[some] + word) * np.uint64(0xC2B2AE3D27D4EB4F))
        start += 8
        some = some[(left > 8) & (start < _LONG)]
    for i in np.flatnonzero(size > _LONG).tolist():
        one[i], two[i] = np.frombuffer(hashlib.blake2b(held[at[i] : at[i] + size[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return one, two


class Table:
    """Numbers by pairs of hashes: open addressing, many keys at a time."""

    def __init__(self, bits: int = 12):
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.last = np.uint64((1 << bits) - 1)
        self.one, self.two, self.value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The numbers of some keys; -1 for those that are not there."""
        out = np.full(len(one), -1, np.int64)
        todo, slot = np.arange(len(one)), one & self.last
        while len(todo):
            value = self.value[slot]
            same = (self.one[slot] == one[todo]) & (self.two[slot] == two[todo]) & (value >= 0)
            out[todo[same]] = value[same]
            go = ~same & (value >= 0)
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.last
        return out

    def add(self, one: np.ndarray, two: np.ndarray, value: np.ndarray) -> None:
        """Put in keys that are not there, each once."""
        if 3 * (self.n + len(one)) > 2 * len(self.value):
            old = self.value >= 0
            held = self.one[old], self.two[old], self.value[old]
            self.n, bits = 0, int(3 * (len(held[0]) + len(one))).bit_length()
            self._make(bits)
            self.add(*held)
        todo, slot = np.arange(len(one)), one & self.last
        while len(todo):
            free = np.flatnonzero(self.value[slot] < 0)
            at, key = slot[free], todo[free]
            self.one[at], self.two[at] = one[key], two[key]  # of several keys for a slot, the last stays
            won = (self.one[at] == one[key]) & (self.two[at] == two[key])
            self.value[at[won]] = value[key[won]]
            go = np.ones(len(todo), bool)
            go[free[won]] = False
            todo, slot = todo[go], (slot[go] + np.uint64(1)) & self.last
        self.n += len(one)


class WordEncoder:
    """Encodes texts into one flat array of ids and each text's number of ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # pre-tokens that are normal already need neither normalizer nor pattern
        self.of_parts = Tokenizer(self.tokenizer.model)  # the same model, held once
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache_words = cache_words
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.parts = Table(), Table()
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.codes = self.used = 0

    def _learn_parts(self, parts: pa.Array) -> np.ndarray:
        """Codes of parts, some perhaps known: lower-case Latin-1 letters, or a run of punctuation: a pre-token each."""
        keys = hashes(parts)
        own = self.parts.find(*keys)
        new = np.flatnonzero(own < 0)
        for a in range(0, len(new), 4000):
            some = new[a : a + 4000]
            texts = parts.take(pa.array(some)).to_pylist()
            ids = np.array(self.of_parts.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(some):
                each = [e.ids for e in self.of_parts.encode_batch_fast(texts, add_special_tokens=False)]
                ids, ends = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            own[some] = self._place(ids, np.diff(ends, prepend=0))
        self.parts.add(keys[0][new], keys[1][new], own[new])
        return own

    def _place(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """New codes for as many strings as there are counts, with their ids one after the other."""
        n = len(counts)
        while self.codes + n > len(self.start):
            self.start, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        codes = np.arange(self.codes, self.codes + n)
        self.start[codes], self.count[codes] = self.used + np.cumsum(counts) - counts, counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.codes += n
        self.used += len(ids)
        return codes

    def _ids(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some codes, one after the other, and where each code's end, from 0."""
        n = self.count[codes]
        ends = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=ends[1:])
        at = np.repeat(self.start[codes] - ends[:-1], n)
        at += np.arange(ends[-1])
        return self.flat[at], ends

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Codes of new words."""
        own = np.zeros(len(words), np.int64)
        is_plain = pc.match_substring_regex(words, _PLAIN)
        plain, rest = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (is_plain, pc.invert(is_plain)))
        low = pc.utf8_lower(words.filter(is_plain))
        letters = pc.utf8_rtrim(low, characters=_POINTS)
        by_part = letters.dictionary_encode()
        first = self._learn_parts(by_part.dictionary)[by_part.indices.to_numpy()]
        pointed = pc.not_equal(pc.binary_length(low), pc.binary_length(letters))
        second = np.zeros(len(plain), np.int64)
        where = np.flatnonzero(pointed.to_numpy(zero_copy_only=False))
        by_points = pc.replace_substring_regex(low.filter(pointed), r"^[^.,!?;:%$&*#|]+", "").dictionary_encode()
        second[where] = self._learn_parts(by_points.dictionary)[by_points.indices.to_numpy()]
        own[plain] = first
        ids, ends = self._ids(np.stack([first[where], second[where]], 1).ravel())
        own[plain[where]] = self._place(ids, np.diff(ends[::2]))
        each = [e.ids for e in self.tokenizer.encode_batch_fast(words.take(pa.array(rest)).to_pylist(), add_special_tokens=False)]
        own[rest] = self._place(np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64))
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, ids of each text in number) of a string array. A null text has none."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        if self.words.n > self.cache_words:
            self.clear()
        keys = hashes(coded.dictionary)
        own = self.words.find(*keys)
        if len(new := np.flatnonzero(own < 0)):
            own[new] = self._learn(coded.dictionary.take(pa.array(new)))
            self.words.add(keys[0][new], keys[1][new], own[new])
        ids, by_word = self._ids(own[coded.indices.to_numpy()])
        return ids, np.diff(by_word[np.asarray(words.offsets) - words.offsets[0].as_py()])


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> WordEncoder:
    """This worker's encoder for a tokenizer file; its cache lasts over tasks."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = WordEncoder(path, cache_words)
    return _encoders[path, cache_words]


def in_slices(texts: pa.Array, most: int = 3_000_000):
    """(from, to) over a batch's texts, so that no slice has much over `most` bytes, unless a single text has."""
    size = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b
