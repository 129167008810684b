"""Token ids of whole texts, through a cache of words.

The vocabulary's pre-tokenizer never joins characters across ASCII white space, so the ids of a text are the ids of its
words in order. Words are told apart by Arrow; the library encodes each word that a worker has not met yet, and the ids of
the others are gathered from the cache. The cache is emptied when it is full, which bounds a worker's memory and changes
no result.

Plain words (Latin letters, then perhaps ASCII punctuation) are encoded many to a call. Each of their parts ends in an id
whose token has the word-end mark, which tells where a word stops; should the marks not add up, the words are encoded one
by one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and bytes of words that a worker keeps.
CACHE_WORDS = 800_000
CACHE_BYTES = 64 << 20
#: Bytes of text that are split into words at a time.
CHUNK_BYTES = 8 << 20
WORD_END = "</w>"
#: Letters that canonical composition leaves alone, then punctuation without the apostrophe of contractions.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z")
JOINED = 400

_encoders: dict = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[0] .. starts[0] + sizes[0] - 1, then those of the next, and so on."""
    ends = np.cumsum(sizes)
    take = np.repeat(starts - (ends - sizes), sizes)
    take += np.arange(len(take))
    return take


def grown(a: np.ndarray, n: int) -> np.ndarray:
    if n <= len(a):
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for token, i in vocab.items() if token.endswith(WORD_END)]] = True
        if len(self.ends_word) > 1 << 16:
            raise ValueError("the cache holds ids of 16 bits")
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.held = 0
        self.ids = np.zeros(1 << 16, np.uint16)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.size = np.zeros(1 << 16, np.int64)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate([np.array(r, np.uint16) for r in rows]) if rows else np.zeros(0, np.uint16)
        return flat, sizes

    def _joined(self, words: list[str], parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self._rows([" ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)])
        stops = np.flatnonzero(self.ends_word[flat])
        if not words or len(stops) != sum(parts):
            return self._rows(words)
        return flat, np.diff(stops[np.cumsum(parts) - 1] + 1, prepend=0)

    def _learn(self, words: list[str]) -> None:
        plain, parts, others = [], [], []
        for w in words:
            m = PLAIN.match(w)
            if m:
                plain.append(w)
                parts.append((m[1] != "") + (m[2] != ""))
            else:
                others.append(w)
        for own, (flat, sizes) in ((plain, self._joined(plain, parts)), (others, self._rows(others))):
            n, total = len(self.slot), self.used + len(flat)
            self.ids = grown(self.ids, total)
            self.start, self.size = grown(self.start, n + len(own)), grown(self.size, n + len(own))
            self.ids[self.used : total] = flat
            self.start[n : n + len(own)] = self.used + np.cumsum(sizes) - sizes
            self.size[n : n + len(own)] = sizes
            self.used = total
            self.slot.update(zip(own, range(n, n + len(own)), strict=True))
            self.held += sum(map(len, own))

    def _slots(self, words: list[str]) -> np.ndarray:
        if len(self.slot) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.clear()
        at = list(map(self.slot.get, words))
        if None in at:
            self._learn([w for w, k in zip(words, at, strict=True) if k is None])
            at = list(map(self.slot.get, words))
        return np.array(at, np.int64)

    def _chunk(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        found = split.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        if "" in words:  # white space at the start or end of a text
            words[words.index("")] = " "
        at = self._slots(words)[found.indices.to_numpy()] if words else np.zeros(0, np.int64)
        sizes = self.size[at]
        ids = self.ids[ragged(self.start[at], sizes)]
        of_words = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[of_words]) + 1
        out = np.full(int(lengths.sum()), end, np.uint16)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = ids
        return out, lengths

    def encode(self, texts: pa.Array, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, lengths) of some texts after the other, each text followed by `end`; a null is an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        total = np.cumsum(pc.binary_length(texts).to_numpy())
        a = 0
        while a < len(texts):
            before = total[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(total, before + CHUNK_BYTES, "right")))
            yield self._chunk(texts.slice(a, b - a), end)
            a = b


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
