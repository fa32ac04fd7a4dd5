"""Token ids of whole texts by a public tokenizer file, with a bounded word cache."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import struct

import numpy as np

WORD_BPE = "word_bpe_49k.json"
#: Words that a worker's cache holds at most; a full cache starts anew.
CACHE_ENTRIES = 600_000

#: A full stop or comma between a letter and white space is a pre-token of its own.
_LONE_MARK = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer(dict):
    """ids of texts under a lower-casing BPE file whose pre-tokens never cross white space.

    Texts are cut at ASCII white space. A chunk of Latin-1 letters goes
    straight to the BPE model; every other chunk goes through the whole
    tokenizer, and so does a text that may hold a special token. All ways give
    the ids that the tokenizer gives for the whole text. The dict maps the
    chunks met so far to their ids.
    """

    def __init__(self, path: str, limit: int = CACHE_ENTRIES):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model.tokenize
        wide = self.whole.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        self.limit = limit
        self.letters = _byte_letters()

    def packed(self, text: bytes | None) -> bytes:
        """Ids of a text as little-endian bytes of ``kind``; null is empty."""
        if not text:
            return b""
        if b"<|" in text:
            return self._bytes(self.whole.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if len(self) > self.limit:
            self.clear()
        return b"".join(map(self.__getitem__, _LONE_MARK.sub(rb" \1", text.lower()).split()))

    def __missing__(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            ids = [t.id for t in self.bpe(chunk.decode())]
        elif _LATIN.fullmatch(chunk):
            ids = [t.id for t in self.bpe(chunk.decode().lower().encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.whole.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids
        self[chunk] = out = self._bytes(ids)
        return out

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.code}", *ids)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: its own where it has one, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_HELD: dict[str, WordTokenizer] = {}


def held_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a worker process, so that its cache outlives a task."""
    if path not in _HELD:
        _HELD[path] = WordTokenizer(path)
    return _HELD[path]


def release_tokenizers() -> None:
    """Gives this worker's tokenizers and their word caches back to the system, some 100 MB when full, before work that needs none."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
        if trim:
            trim(0)
