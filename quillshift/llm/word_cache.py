"""Encoding by cached words: a BPE never merges across its pre-tokens, and the tokenizer's
pattern never matches white space, so each distinct run between spaces is encoded once per
worker and texts are joins of what is known."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
from tokenizers import Tokenizer

#: Characters for which lower-casing, NFC and white space are certain to agree with the
#: tokenizer's; any other text goes through the tokenizer whole.
SURE = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*+")
#: The tokenizer's own word pattern, spelled out for those characters in lower case.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable bytes as themselves and the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) if b in printable else chr(256 + rest.index(b)) for b in range(256)}


_LETTER = byte_letters()
#: Characters beyond ASCII as the letters of their UTF-8 bytes.
_SPELT = {c: "".join(_LETTER[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit bytes; maps words to theirs.

    When ``max_words`` (some 30 MB) are known the later half is forgotten: frequent words come early.
    """

    def __init__(self, path: str, max_words: int = 150_000) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        words = WORDS.findall(chunk)
        if len(words) == 1:
            # a single word of sure characters: straight to the merges
            spelt = chunk if chunk.isascii() else chunk.translate(_SPELT)
            ids = np.array([t.id for t in self.model.tokenize(spelt)], dtype="<u4").tobytes()
        else:
            ids = b"".join([self[w] for w in words])
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text or not SURE.fullmatch(text):
            return self.whole(text)
        if len(self) > self.max_words:
            kept = dict(islice(self.items(), self.max_words // 2))
            self.clear()
            self.update(kept)
        return b"".join(map(self.__getitem__, text.lower().split()))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
