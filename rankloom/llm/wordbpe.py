"""Token ids of a word-end BPE vocabulary file, with bounded per-worker caches.

The vocabulary drops white space and never joins characters across it, so the ids
of a text are the ids of its pieces between spaces. Most pieces repeat: their ids
are kept as packed 16-bit bytes and a text becomes one ``join`` of cached bytes.

Plain pieces take a direct path that knows one word pattern and lower case. When a file is
loaded, the path is tried against the library on ``PROBES``; for a file that differs, every
piece goes through the library.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Entries of each cache; a full cache is emptied, so a worker's memory is bounded.
CACHE_ENTRIES = 200_000

#: Pieces of Latin letters, digits and ASCII marks take the direct path below; all
#: other pieces go through the library's own normaliser.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
#: The vocabulary's own word pattern, for lower-cased plain pieces.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


#: Pieces on which the direct path must agree with the library.
PROBES = ("it's", "I'LL", "don't!?", "x1y22z", "Straße", "ÉCOLE", "naïve,ça", "a.b-c_d", "(100%)", "'s's", "<|im_end|>", "http://a.b/c?d=1", "CamelCase99", "¿", "ÿÀ")


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a visible byte as itself, any other as the next free letter."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordBpe(dict):
    """Maps a piece without spaces to its ids as little-endian 16-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        if self.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits need another cache format")
        self.model = self.full.model.tokenize
        self.words: dict[str, list[int]] = {}
        self.letters = _byte_letters()
        self.plain = _PLAIN
        if any(list(np.frombuffer(self[p], np.uint16)) != self.full.encode(p, add_special_tokens=False).ids for p in PROBES if _PLAIN(p)):
            self.plain = lambda piece: None
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        if self.plain(piece):
            ids: list[int] = []
            for word in _WORDS(piece.lower()):
                known = self.words.get(word)
                if known is None:
                    if len(self.words) >= CACHE_ENTRIES:
                        self.words.clear()
                    spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                    known = self.words[word] = [x.id for x in self.model(spelled)]
                ids += known
        else:
            ids = self.full.encode(piece, add_special_tokens=False).ids if piece else []
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        packed = array("H", ids).tobytes()
        if len(piece) < 64:
            self[piece] = packed
        return packed

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.uint16)

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 2


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The vocabulary of ``path``, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
