"""Token ids of whole texts, by a public tokenizer whose pre-tokenizer never joins text across white space."""

from __future__ import annotations

import array
import os

import numpy as np

#: Encoded words a Python worker remembers (about 200 bytes each); further ones are encoded each time, results don't change.
REMEMBERED_WORDS = 1_500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts word by word, remembering words it has met.

    Words are split at ASCII white space, which the tokenizer drops, so the ids of a text are the ids
    of its words in a row.  Ids come as little-endian bytes of ``dtype``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.known: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> dict[bytes, bytes]:
        found: dict[bytes, bytes] = {}
        kind = "H" if self.dtype.itemsize == 2 else "I"
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            ids = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            found.update((w, array.array(kind, e.ids).tobytes()) for w, e in zip(part, ids, strict=True))
        return found

    def encode(self, text: bytes | None) -> bytes:
        words = (text or b"").split()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        new = self._encoded(list(set(words).difference(self.known)))
        if len(self.known) < REMEMBERED_WORDS:
            self.known.update(new)
            return b"".join(map(self.known.__getitem__, words))
        return b"".join([new[w] if w in new else self.known[w] for w in words])


#: Functions of this package go to the workers by value, so what outlasts a task is kept with the tokenizer's own module.
_KEPT = "_redliner_encoders"


def encoder(path: str) -> Encoder:
    """The Python worker's encoder: what one task has learnt serves the next."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault(_KEPT, {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]
