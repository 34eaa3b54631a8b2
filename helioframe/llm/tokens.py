"""Token ids of whole texts, with a cache of words.

The tokenizers of this kind drop white space and never join characters across it, so the ids of a text
are the ids of its words in a row. Words seen before come from a bounded cache. The others are cut before
punctuation that follows a Latin letter, where the tokenizer's own pattern cuts too, and their parts go to the
library. ASCII letters are lower-cased first, as the tokenizer itself does. Texts that may hold a special
token's name go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

CACHE_WORDS = 800_000
CACHED_BYTES = 64          # longer words are not kept beyond their text
END_ID = 1

_CUT = re.compile(rb"(?:(?<=[a-z])|(?<=\xc3[\xa0-\xb6\xb8-\xbf]))(?=[.,!?;:$%&*#|])")
_PLAIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")      # letters whose lower case is one letter
_SENTENCE_END = re.compile(r".*[.!?](</w>)?$", re.DOTALL)


class WordEncoder:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = f.read()
        parts = json.loads(spec)
        kinds = [s["type"] for s in (parts.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and parts["pre_tokenizer"]["type"] == "Sequence"
        self.whole = Tokenizer.from_str(spec)
        vocab = self.whole.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("u2" if max(vocab.values()) < 1 << 16 else "u4").newbyteorder("<")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.sentence_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.sentence_end[[i for t, i in vocab.items() if _SENTENCE_END.match(t)]] = True
        # a run of these letters is one piece for the full tokenizer; this one leaves out the steps that change nothing
        self.plain = Tokenizer.from_str(spec)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache_words, self.cache = cache_words, {}

    def encode(self, text: bytes) -> bytes:
        """Ids of one UTF-8 text as little-endian unsigned numbers of ``dtype``."""
        if not self.by_word or b"<|" in text:
            return self._ids(self.whole.encode(text.decode(), add_special_tokens=False).ids)
        words = text.lower().split()
        found = list(map(self.cache.get, words))
        if None in found:
            if len(self.cache) > self.cache_words:
                self.cache = {}
            learned = self._learn({w for w, ids in zip(words, found, strict=True) if ids is None})
            found = [learned[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)

    def _ids(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of words; short ones and their parts are cached."""
        order = list(words)
        cuts = _CUT.sub(b" ", b"\n".join(order)).split(b"\n")
        parts = {w: cut.split() for w, cut in zip(order, cuts, strict=True) if b" " in cut}
        pieces = set(chain.from_iterable(parts.values()))
        known = {p: self.cache[p] for p in pieces if p in self.cache}
        new = list(words.difference(parts).union(pieces.difference(known)))
        plain, other = [], []
        if new:
            for part, text in zip(new, b"\n".join(new).decode().split("\n"), strict=True):
                (plain if _PLAIN.fullmatch(text) else other).append((part, text))
        for tokenizer, rows in ((self.plain, [(p, t.lower()) for p, t in plain]), (self.whole, other)):
            if rows:
                encoded = tokenizer.encode_batch_fast([t for _, t in rows], add_special_tokens=False)
                known.update((p, self._ids(e.ids)) for (p, _), e in zip(rows, encoded, strict=True))
        learned = {w: b"".join([known[p] for p in cut]) for w, cut in parts.items()} | known
        if len(max(learned, key=len)) <= CACHED_BYTES:
            self.cache.update(learned)
        else:
            self.cache.update((w, ids) for w, ids in learned.items() if len(w) <= CACHED_BYTES)
        return learned


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker, so its cache outlives a task."""
    return WordEncoder(path)
