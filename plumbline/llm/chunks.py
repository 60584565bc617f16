"""Token ids of whole texts by a byte-level tokenizer, through a cache of chunks.

The pre-tokenizer of `byte_bpe_50k.json` never joins a character that is no white space to white space behind it, so a
text may be cut at each such place, and its ids are its chunks' ids in order; a chunk is a run of ASCII white space with
what follows it. A cut behind white space outside ASCII is left out. Real texts repeat their chunks: numpy finds the
cuts, Arrow codes the chunks, and a worker encodes each chunk once. A chunk that starts with its only space has one token
that begins with the space's mark, so many of these are encoded at a time and told apart again by it.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.tokens import CACHE_WORDS, Table, WordEncoder, hashes

_SPACE_MARK = "Ġ"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Last bytes of white space outside ASCII, and what may stand before them in UTF-8; and separators that some engines take for white space.
_LAST = np.zeros(256, bool)
_LAST[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEFORE_LAST = np.zeros(256, bool)
_BEFORE_LAST[[0xC2, 0x9A, 0x80, 0x81]] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[0x1C:0x20] = True
_PLAIN = r"^ [^\x00-\x20\x7F\x{85}\pZ]+$"


def cuts(held: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each byte of UTF-8 text; starts of texts are the caller's."""
    space = _IS_SPACE[held]
    out = space.copy()
    out[1:] &= ~space[:-1] & ~_SEPARATOR[held[:-1]]
    out[2:] &= ~(_LAST[held[1:-1]] & _BEFORE_LAST[held[:-2]])
    out[:1] = False
    return out


class ChunkEncoder(WordEncoder):
    """Encodes texts into one flat array of ids and each text's number of ids."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.starts[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(_SPACE_MARK)]] = True
        self.clear()

    def clear(self) -> None:
        self.words = Table()
        self.start = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.codes = self.used = 0

    def _each(self, texts: list[str]) -> np.ndarray:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return self._place(np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Codes of new chunks."""
        own = np.zeros(len(words), np.int64)
        is_plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False)
        plain, rest = np.flatnonzero(is_plain), np.flatnonzero(~is_plain)
        for a in range(0, len(plain), 4000):
            some = plain[a : a + 4000]
            texts = words.take(pa.array(some)).to_pylist()
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(self.starts[ids])
            told_apart = len(at) == len(some) and at[0] == 0
            own[some] = self._place(ids, np.diff(at, append=len(ids))) if told_apart else self._each(texts)
        for a in range(0, len(rest), 4000):
            some = rest[a : a + 4000]
            own[some] = self._each(words.take(pa.array(some)).to_pylist())
        return own

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, ids of each text in number) of a string array. A null text has none."""
        texts = pc.fill_null(texts, "")
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
        size = at[-1] - at[0]
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        held, at = np.frombuffer(texts.buffers()[2], np.uint8, size, at[0]), at - at[0]
        first = cuts(held)
        first[at[:-1][at[:-1] < size]] = True
        starts = np.append(np.flatnonzero(first), size)
        chunks = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(held))
        coded = chunks.dictionary_encode()
        if self.words.n > self.cache_words:
            self.clear()
        keys = hashes(coded.dictionary)
        own = self.words.find(*keys)
        if len(new := np.flatnonzero(own < 0)):
            own[new] = self._learn(coded.dictionary.take(pa.array(new)))
            self.words.add(keys[0][new], keys[1][new], own[new])
        ids, by_chunk = self._ids(own[coded.indices.to_numpy()])
        return ids, np.diff(by_chunk[np.searchsorted(starts, at)])


_encoders: dict[tuple[str, int], ChunkEncoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> ChunkEncoder:
    """This worker's encoder for a tokenizer file; its cache lasts over tasks."""
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = ChunkEncoder(path, cache_words)
    return _encoders[path, cache_words]
