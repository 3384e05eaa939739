"""Token ids of whole texts by a ``tokenizers`` file, with a bounded cache of pre-tokens.

Both vocabularies in use split a text into pre-tokens that no merge crosses, and the white space
between words is a sure boundary. So words are encoded once per worker and looked up after that; any text
that isn't plainly words with single spaces or line breaks between them goes through the library whole.
Words of Latin letters, with or without one mark behind them, go straight to the library's BPE model
(one pre-token each, the mark one more); so do the parts of other ASCII words, cut by the vocabulary's own pattern, in which
only ASCII can occur there. Other words go through the library's whole chain.
"""

from __future__ import annotations

import re

import numpy as np

CACHE = 600_000
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = ".,;:!?"
#: The patterns by which the two kinds of vocabulary cut a word of ASCII characters.
_LOWER_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_SPACED_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ A-Za-z0-9]+")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def vocabulary(name: str) -> str:
    """The path of a vocabulary: itself if it is one, else that of the installed public file."""
    if name.startswith("/"):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE shows bytes as letters: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Words(dict):
    """word -> bytes of its ids; the first ``room`` of them are kept."""

    def __init__(self, encode, room: int = CACHE):
        super().__init__()
        self.encode, self.room = encode, room

    def __missing__(self, word):
        ids = self.encode(word)
        if len(self) < self.room:
            self[word] = ids
        return ids


class TokenIds:
    """``encode(text)`` gives the ids of a text as little-endian ``dtype`` bytes."""

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(name))
        self.model = self.library.model
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.lower = self.library.normalizer is not None
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.spaced, self.bare = _Words(lambda w: self._word(" ", w)), _Words(lambda w: self._word("", w))
        self.newline = self.whole("\n")
        self.bytes = [np.array([i], self.dtype).tobytes() for i in range(self.library.get_vocab_size(with_added_tokens=True))]
        self.parts = _Words(self._part, CACHE // 6)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token in the model's own letters."""
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(part)])

    def _word(self, before: str, word: str) -> bytes:
        """Ids of one word and the space before it, if any. A word behind a line break has the break
        in front, which is a pre-token of its own there."""
        if word.isascii() and word.isprintable():
            if word.isalpha():
                return self._part("\u0120" + word if before else word.lower() if self.lower else word)
            if word[-1] in _MARKS and word[:-1].isalpha():
                return (self.spaced if before else self.bare)[word[:-1]] + self.bare[word[-1]]
            if self.lower:
                return b"".join(map(self.parts.__getitem__, _LOWER_PARTS.findall(word.lower())))
            return b"".join([self.parts[p if p[0] != " " else "\u0120" + p[1:]] for p in _SPACED_PARTS.findall(before + word)])
        if before and word[0] == "\n":
            return self.newline + self.bare[word[1:]]
        if word[-1] in _MARKS and _LATIN.fullmatch(word, 0, len(word) - 1):
            return (self.spaced if before else self.bare)[word[:-1]] + self.bare[word[-1]]
        if not _LATIN.fullmatch(word):
            return self.whole(before + word)
        if self.lower:
            word = word.lower()
        word = word if word.isascii() else word.translate(self.letters)
        return self._part("\u0120" + word if before else word)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if "<|" in text:  # may hold a special string, which the library finds in the whole text
            return self.whole(text)
        if self.lower:  # white space is dropped; U+001C to U+001F are space to Python only
            odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
            return self.whole(text) if odd else b"".join(map(self.bare.__getitem__, text.split()))
        words = text.replace("\n", " \n").split(" ")
        if "" in words or "\n" in words or any(c in text for c in "\t\r\x0b\x0c\x1c\x1d\x1e\x1f") or not text.isascii() and _WIDE.search(text):
            return self.whole(text)
        first = words[0]
        words[0] = words[-1]  # any known one: the first has no space before it and is put in place below
        ids = list(map(self.spaced.__getitem__, words))
        ids[0] = self.bare[first]
        return b"".join(ids)


_LOADED: dict[str, TokenIds] = {}


def token_ids(name: str) -> TokenIds:
    """One encoder per worker and vocabulary."""
    if name not in _LOADED:
        _LOADED[name] = TokenIds(name)
    return _LOADED[name]
