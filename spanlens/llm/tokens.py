"""Token ids of whole texts, by a tokenizer file whose words are independent of each other.

``word_bpe`` vocabularies drop white space and never merge across it, so a text's ids are those of its words (runs
outside 0x20 and 0x09-0x0D) in turn. Each slice of a column is reduced to its distinct words; their ids come from a
bounded cache, and the ids of all words are gathered from it at once. Only words not in the cache go to the tokenizer,
many at a time, with closing punctuation and capitals taken off where the tokenizer is known to treat them apart.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from .blocks import Words, raw

CACHE_WORDS, CACHE_PARTS = 1_000_000, 300_000
#: ASCII marks that form a word of their own behind letters; the apostrophe, which starts contractions, isn't one.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_loaded: dict[tuple, WordTokenizer] = {}
_stable = np.zeros(0x110000, dtype=np.int8)  # by code point: 1 a letter that stays one, 2 not, 0 not looked at yet


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of the byte ranges; what isn't UTF-8 is replaced."""
    upto = np.concatenate([[0], np.cumsum(size)])
    flat = data[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]
    out = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(flat))
    try:
        out.validate(full=True)
    except pa.ArrowInvalid:
        data = flat.tobytes()
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], pa.large_string())
    return out


def _letters(stems: pa.Array) -> np.ndarray:
    """Whether a stem consists of letters that stay letters when they are composed and put in lower case."""
    out = pc.utf8_is_alpha(stems).to_numpy(zero_copy_only=False).copy()
    other = np.flatnonzero(out & ~pc.string_is_ascii(stems).to_numpy(zero_copy_only=False))
    if len(other):
        part = stems.take(pa.array(other))
        size = pc.utf8_length(part).to_numpy()
        points = np.frombuffer(raw(part)[0].tobytes().decode().encode("utf-32-le"), dtype="<u4")
        for point in np.flatnonzero((np.bincount(points) > 0) & (_stable[: int(points.max()) + 1] == 0)).tolist():
            _stable[point] = 1 if unicodedata.normalize("NFC", chr(point)).lower().isalpha() else 2
        out[other] = ~np.logical_or.reduceat(_stable[points] == 2, np.cumsum(size) - size)
    return out


class WordTokenizer:
    """Keeps the ids of up to ``words`` words and ``parts`` of their parts (about 40 and 200 bytes each)."""

    def __init__(self, path: str, words: int | None = None, parts: int | None = None) -> None:
        self.most_words, self.most_parts = words or CACHE_WORDS, parts or CACHE_PARTS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a word
        for token, at in vocabulary.items():
            self.last[at] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.parts: dict[str, bytes] = {}  # stems, tails and odd words to packed ids
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # known words: hash (in order), entry
        self.words = self.used = 0  # entries, and ids in the pool; the arrays below have room to spare
        self.length, self.size, self.start, self.pool = (np.zeros(0, kind) for kind in (np.int32, np.int32, np.int64, np.dtype("<u4")))

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Values from ``at`` on in an array that doubles when it is full."""
        old = getattr(self, name)
        if at + len(values) > len(old):
            new = np.empty(2 * (at + len(values)), dtype=old.dtype)
            new[:at] = old[:at]
            setattr(self, name, new)
        getattr(self, name)[at : at + len(values)] = values

    def _alone(self, words: list[str]) -> None:
        for start in range(0, len(words), 4096):
            part = words[start : start + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.parts.update((w, np.array(f.ids, dtype="<u4").tobytes()) for w, f in zip(part, found, strict=True))

    def _together(self, stems: list[str]) -> None:
        """Runs of letters, joined by spaces."""
        for start in range(0, len(stems), 8192):
            part = stems[start : start + 8192]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):  # some letter that the tokenizer takes apart
                if len(part) > 16:
                    half = len(part) // 2
                    self._together(part[:half])
                    self._together(part[half:])
                else:
                    self._alone(part)
                continue
            packed, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
            self.parts.update(zip(part, map(packed.__getitem__, map(slice, bounds, bounds[1:])), strict=True))

    def _pooled(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of the ids of each part in a pool, and the pool."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = np.fromiter((n not in self.parts for n in names), dtype=bool, count=len(names))
        letters = _letters(coded.dictionary)
        self._together([names[i] for i in np.flatnonzero(new & letters).tolist()])
        self._alone([names[i] for i in np.flatnonzero(new & ~letters).tolist()])
        packed = list(map(self.parts.__getitem__, names))
        size = np.fromiter(map(len, packed), dtype=np.int64, count=len(packed)) // 4
        code = coded.indices.to_numpy()
        return (np.cumsum(size) - size)[code], size[code], np.frombuffer(b"".join(packed), dtype="<u4")

    def _packed(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all ids: those of its letters and of the marks that close it, or of it whole.

        Capitals of ASCII letters don't count, as the tokenizer ignores case.
        """
        if len(self.parts) > self.most_parts:
            self.parts.clear()
        stems = pc.utf8_rtrim(words, characters=TAIL)
        core = pc.if_else(pa.array(_letters(stems)), pc.ascii_lower(stems), words)
        whole, kept = (pc.binary_length(x).to_numpy() for x in (words, core))
        data, at = raw(words)
        start, size, pool = self._pooled(core)
        tail = np.flatnonzero(kept < whole)
        starts, sizes = np.zeros((len(words), 2), dtype=np.int64), np.zeros((len(words), 2), dtype=np.int64)
        starts[:, 0], sizes[:, 0] = start, size
        if len(tail):
            start, size, more = self._pooled(_cut(data, at[tail] + kept[tail], whole[tail] - kept[tail]))
            starts[tail, 1], sizes[tail, 1] = start + len(pool), size
            pool = np.concatenate([pool, more])
        flat = sizes.reshape(-1)
        upto = np.cumsum(flat) - flat
        return sizes.sum(axis=1), pool[np.repeat(starts.reshape(-1) - upto, flat) + np.arange(int(flat.sum()))]

    def _learn(self, keys: np.ndarray, words: pa.Array, length: np.ndarray) -> None:
        """Enter new words, of ``length`` bytes each, in order of their hashes."""
        size, ids = self._packed(words)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(self.words, self.words + len(words), dtype=np.int32))
        self._put("length", self.words, length)
        self._put("size", self.words, size)
        self._put("start", self.words, self.used + np.cumsum(size) - size)
        self._put("pool", self.used, ids)
        self.words, self.used = self.words + len(words), self.used + len(ids)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's closed by end_id, and the bounds of each text among them.

        Words are told apart by 64 bits of hash and their length in bytes.
        """
        words = Words(column)
        code, distinct = pd.factorize(words.key)
        first = np.zeros(len(distinct), dtype=np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        length = words.end[first] - words.start[first]
        if len(self.keys) + len(distinct) > self.most_words:
            self._clear()
        order = np.argsort(distinct)  # sorted look-ups stay in the processor's caches
        distinct, length, first = distinct[order], length[order], first[order]
        own = np.searchsorted(self.keys, distinct)
        spot = np.minimum(own, max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[spot] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            pick = first[new]
            self._learn(distinct[new], _cut(words.data, words.start[pick], length[new]), length[new])
            own = np.searchsorted(self.keys, distinct)
        own = self.slot[own]
        if (self.length[own] != length).any():  # another word with the hash is in the cache
            self._clear()
            return self.encode(column, end_id)
        place = np.empty(len(order), dtype=np.int32)
        place[order] = own
        size, start = self.size[place][code].astype(np.int64), self.start[place][code]
        upto = np.concatenate([[0], np.cumsum(size)])
        bounds = upto[words.first] + np.arange(len(words.first))
        out = np.empty(upto[-1] + words.rows, dtype="<u4")
        out[bounds[1:] - 1] = end_id
        inner = np.repeat(start - upto[:-1], size) + np.arange(upto[-1])
        inside = np.ones(len(out), dtype=bool)
        inside[bounds[1:] - 1] = False
        out[inside] = self.pool[inner]
        return out, bounds


def load(path: str, words: int | None = None, parts: int | None = None) -> WordTokenizer:
    """One tokenizer, with its cache, for each worker process and cache size."""
    key = (path, words, parts)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = WordTokenizer(path, words, parts)
    return _loaded[key]
