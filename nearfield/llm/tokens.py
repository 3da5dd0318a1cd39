"""Token ids of whole texts, for use inside tasks.

Texts are cut at ASCII white space and each distinct word is encoded once per worker by the tokenizers
library; ids are kept as little-endian 32-bit bytes, so a text's ids are a join of its words' bytes.
The cut is valid for tokenizers whose pre-tokenizer drops white space: nothing crosses it. Case is
folded for ASCII letters first where the tokenizer folds case itself. A text that holds '<|', the
start of a special token, is encoded whole.
"""

from __future__ import annotations

import os
import struct

CACHE_WORDS = 300_000
TAIL = b".,;:!?*%&$#"
_ENCODERS: dict[str, "WordEncoder"] = {}


class _Known(dict):
    """word -> ids; a word that isn't there is learnt."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = self.learn(word)
        return ids


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.clean, self.cut = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        probe = ["Ab cd, ef. 1", "ab  CD, eF. 1"]
        if len({self.whole(x) for x in probe}) != 1:
            raise ValueError("this tokenizer keeps case or white space: words can't be encoded one by one")
        for word in ("a", "tion", "tokenizers", "zyxwvutsrqponmlkjihgfedcba" * 3, "\u00e9t\u00e9-1", "x\u00a0y", "it's"):
            if self._learn(word.encode()) != self.whole(word):
                raise ValueError("this tokenizer's parts don't add up to its whole")
        self._new()
        self.older: dict[bytes, bytes] = {}  # the cache before the last change: words still in use move over

    def _new(self) -> None:
        self.known, self.marks = _Known(self._recall), {}

    def whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn(self, word: bytes) -> bytes:
        """A word of lower-case ASCII letters is one piece and goes straight to the merges; others are normalized and cut first."""
        text = word.decode("utf-8", "replace")
        if word.isalpha():
            return _bytes([t.id for t in self.merge(text)])
        return _bytes([t.id for piece, _ in self.cut(self.clean(text)) for t in self.merge(piece)])

    def _recall(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            return ids
        plain = word.rstrip(TAIL)
        if plain and plain != word and (97 <= plain[-1] <= 122 or 48 <= plain[-1] <= 57):
            # marks that end a word after an ASCII letter or digit are one piece
            tail = word[len(plain) :]
            if tail not in self.marks:
                self.marks[tail] = self.whole(tail.decode())
            return self.known[plain] + self.marks[tail]
        return self._learn(word)

    def encode(self, texts: list[bytes | None], cache_words: int = CACHE_WORDS) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes; none for null. Up to twice ``cache_words`` stay in memory."""
        if len(self.known) > cache_words:
            self.older = self.known
            self._new()
        found, out = self.known.__getitem__, []
        for text in texts:
            if not text:
                out.append(b"")
            elif b"<|" in text:
                out.append(self.whole(text.decode("utf-8", "replace")))
            else:
                out.append(b"".join(map(found, text.lower().split())))
        return out


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def slices(batch, rows: int = 256):
    """A batch in slices of few rows, so that long texts don't pile up."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
