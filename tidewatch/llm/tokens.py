"""Token ids of whole texts with public tokenizers, each distinct word encoded once per worker.

A text is taken apart only where the tokenizer itself always starts a new piece, so joining the pieces' ids gives
the ids of the whole text. Two kinds are known: ``led`` (byte level, a word takes along the space before it) and
``bare`` (white space is dropped). Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import regex
from tokenizers import Tokenizer

# The tokenizers' own patterns, and characters on which they agree with Python's classes.
BARE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN = re.compile("[\t\n\r -~À-ÿ]*")

LOOSE = re.compile(r" (?!\S)")
WORD_START = re.compile(r" (?=\S)")
#: Words in one generation of a cache, and code points of the longest word that is kept.
MOST_WORDS, LONGEST_KEPT = 250_000, 256
#: Words encoded as one string; longer strings take longer a word.
TOGETHER = 256


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()


class Recent(dict):
    """A bounded cache in two generations: when full, its entries become the old ones, and old ones met since stay.

    So words that come again and again are kept, and the many words seen once fall out.
    """

    def __init__(self, most: int = MOST_WORDS):
        super().__init__()
        self.most, self.old = most, {}

    def turn(self) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()


class Pieces(Recent):
    """Ids (little-endian 32-bit) by piece, filled on first use."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            letters = piece.encode("utf-8").decode("latin-1").translate(LETTERS)
            ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        self.turn()
        self[piece] = ids
        return ids


class BareWords(Recent):
    """Ids by word of a ``bare`` tokenizer, filled on first use."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer, self.pieces = tokenizer, Pieces(tokenizer.model)

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if PLAIN.fullmatch(word):
                ids = b"".join(map(self.pieces.__getitem__, BARE.findall(word.lower())))
            else:
                ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self.turn()
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


class LedWords(Recent):
    """Ids by word of a ``led`` tokenizer. All words that a batch lacks are encoded in few calls.

    Such words are joined by the space that each takes along; as no other token begins with a space, the ids of one
    string are parted there. Words with spaces within, which follow runs of them, are encoded alone.
    """

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(2 * MOST_WORDS)
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.led = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.led[[i for token, i in vocabulary.items() if token.startswith(LETTERS[32])]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def fill(self, words: set[str]) -> list[str]:
        """Have all these words, until the next call; those too long to be kept are returned, for ``forget``."""
        self.turn()
        missing = list(filterfalse(self.__contains__, words))
        self.update((w, self.old[w]) for w in missing if w in self.old)
        missing = list(filterfalse(self.__contains__, missing))
        alone = [w for w in missing if len(w) > LONGEST_KEPT or not w or " " in w]
        self.update(zip(alone, self.encode([" " + w for w in alone]), strict=True))
        joined = [w for w in missing if len(w) <= LONGEST_KEPT and w and " " not in w]
        for begin in range(0, len(joined), TOGETHER):
            some = joined[begin : begin + TOGETHER]
            ids = np.frombuffer(self.encode([" " + " ".join(some)])[0], "<u4")
            first = np.flatnonzero(self.led[ids])
            if len(first) == len(some) and first[0] == 0:
                data, bounds = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
                self.update((w, data[a:b]) for w, a, b in zip(some, bounds, bounds[1:]))
            else:
                self.update(zip(some, self.encode([" " + w for w in some]), strict=True))
        return [w for w in alone if len(w) > LONGEST_KEPT]

    def forget(self, words: list[str]) -> None:
        for word in words:
            self.pop(word, None)


class Encoder:
    def __init__(self, path: str, kind: str | None):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = kind
        self.words = LedWords(self.tokenizer) if kind == "led" else BareWords(self.tokenizer) if kind == "bare" else None

    def ids(self, text: str) -> bytes:
        """All ids of the text as little-endian 32-bit integers."""
        if self.kind == "led":
            return self.many([text])[0]
        if self.kind == "bare":
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def many(self, texts: list[str], step: int = 1 << 20) -> list[bytes]:
        """The ids of each text; words are looked up for about ``step`` characters of whole texts at a time."""
        if self.kind != "led":
            return [self.ids(t) for t in texts]
        out: list[bytes] = []
        begin = 0
        while begin < len(texts):
            end, size = begin, 0
            while end < len(texts) and (size < step or end == begin):
                size += len(texts[end])
                end += 1
            parts = [WORD_START.split(t) if LOOSE.search(t) else t.split(" ") for t in texts[begin:end]]
            firsts = [p.pop(0) for p in parts]  # the only word without a space before it
            long = self.words.fill(set().union(*parts))
            out += [f + b"".join(map(self.words.__getitem__, p)) for f, p in zip(self.words.encode(firsts), parts, strict=True)]
            self.words.forget(long)
            begin = end
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str | None = None) -> Encoder:
    """The encoder of this worker process. ``kind``: ``led``, ``bare``, or None to encode texts in one piece."""
    return Encoder(path, kind)


def crc(ids: bytes) -> int:
    return zlib.crc32(ids)
