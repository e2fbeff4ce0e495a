"""Ids by the `tokenizers` library for whole texts, one encoding per distinct blank-separated chunk.

The vocabulary drops white space before its merges, so no merge and no normalisation crosses a blank: a
text's ids are the ids of its chunks in order. As in the library, the vocabulary's added tokens are found in
texts; they hold no blank, so they too are within a chunk, which then takes the library's way.
"""

from __future__ import annotations

import os
import re
import struct

from .common import trim

#: Distinct chunks kept per worker; a full store is emptied and filled again, which costs time only.
STORE = 600_000
#: One letters-only piece of the vocabulary's own split, before at most one point or comma.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch
_encoders: dict[str, "ChunkEncoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself if it is printed in Latin-1, else the next one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ChunkEncoder(dict):
    """Little-endian unsigned 32-bit ids by chunk; a chunk that is missing is encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        trim()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.points = {c: self[c] for c in ("", ".", ",")}

    def __missing__(self, chunk: str) -> bytes:
        """A word of letters is lowered and goes to the vocabulary's merges at once, without the sign after it: the vocabulary splits there, and such letters have one form. Other chunks take the library's whole way."""
        if m := _WORD(chunk):
            word = m[1].lower()
            if word != chunk:
                found = self[chunk] = self[word] + self.points[m[2]]
                return found
            ids = [x.id for x in self.merge(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode_batch_fast([chunk], add_special_tokens=False)[0].ids
        found = self[chunk] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def encode(self, texts: list[str], store: int = STORE) -> list[bytes]:
        """The ids of each text. store: distinct chunks kept before the store is emptied."""
        if len(self) > store:
            self.clear()
        get = self.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").split(" "))) for t in texts]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def slices(texts: list[str], most: int = 1_000_000):
    """Index ranges of about `most` characters, at least one text each, to bound a step's memory."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and total + len(t) > most:
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
