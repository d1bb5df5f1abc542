"""Texts to token ids with a public tokenizer, word by word.

White space always ends a token of this vocabulary, so a text's ids are those of its space-separated pieces
in order.  Pieces that hold one of the tokenizer's added tokens are left to the tokenizer itself.  A batch's distinct pieces are encoded once and the ids are gathered with numpy; each Python
worker remembers the pieces it has met, up to MEMORY bytes.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "word_bpe_49k.json"
MEMORY = 112_000_000  # bytes of remembered pieces, their parts and ids; at the bound the memory starts afresh
ENTRY = 150  # bytes that an entry of a dictionary takes besides its letters
SLICE = 2_000_000  # bytes of text taken at a time

# ASCII and the letters of Latin-1: composed already, with one lower-case letter each
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``ids`` holds the ids of every entry, ``starts`` where they begin; pieces and their parts are entries."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(re.search(r"\s", t) for t in added):
            raise ValueError("an added token with white space is not found in pieces")
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)")  # in any case: the tokenizer decides
        self._forget()

    def _forget(self):
        self.letters_held = 0
        self.place: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.ids, self.starts = array("I"), array("q", [0])

    def _entry(self, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.starts.append(len(self.ids))
        return len(self.starts) - 2

    def _part(self, part: str) -> int:
        got = self.parts.get(part)
        if got is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            got = self.parts[part] = self._entry([t.id for t in self.model.tokenize(spelled)])
            self.letters_held += len(part)
        return got

    def _learn(self, piece: str) -> int:
        lower = piece.lower()
        plain = (piece.isascii() and piece.isprintable() or _PLAIN.fullmatch(piece)) and not self.added.search(lower)
        if plain and lower.isalpha():
            number = self._part(lower)
        elif plain:
            ids = []
            for part in _PARTS.findall(lower):
                n = self._part(part)
                ids += self.ids[self.starts[n] : self.starts[n + 1]]
            number = self._entry(ids)
        else:
            number = self._entry(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        self.place[piece] = number
        self.letters_held += len(piece)
        return number

    def held(self) -> int:
        """Bytes remembered, about."""
        return ENTRY * (len(self.place) + len(self.parts)) + self.letters_held + 4 * len(self.ids) + 8 * len(self.starts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, n + 1 bounds)."""
        if self.held() > MEMORY:
            self._forget()
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        known, learn = self.place.get, self._learn
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes a scalar's way for each, ten times as long
        numbers = [known(w) for w in words]
        if None in numbers:
            numbers = [learn(w) if n is None else n for n, w in zip(numbers, words, strict=True)]
        store, starts = np.frombuffer(self.ids, dtype=np.uint32), np.frombuffer(self.starts, dtype=np.int64)
        which = np.array(numbers, dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        first = starts[which]
        lens = starts[which + 1] - first
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        ids = store[np.repeat(first - (ends - lens), lens) + np.arange(total)] if total else np.zeros(0, dtype=np.uint32)
        bounds = np.concatenate([[0], ends])[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def slices(texts: pa.Array, limit: int = SLICE):
    """(start, stop) of runs of rows with about ``limit`` bytes of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, side="right")))
        yield start, stop
        start = stop


def encoded(batches, path: str, end: int):
    """For each slice of Arrow batches with a ``text``: (slice, ids with ``end`` after each text, bounds)."""
    enc = encoder(path)
    pa.default_memory_pool().release_unused()  # what earlier stages of this worker left
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for start, stop in slices(texts):
            part = batch.slice(start, stop - start)
            ids, bounds = enc.encode(pc.fill_null(texts.slice(start, stop - start), ""))
            ids = np.insert(ids, bounds[1:], end).astype(np.uint32)
            yield part, ids, bounds + np.arange(len(bounds))
