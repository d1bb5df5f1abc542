"""Toxicity by noisy-channel decoding: restore disguised words under a character model, then score the restored text.

Channel: a letter may have been written as a look-alike sign, repeated, or set apart by separators.  A disguised piece
becomes a lattice of what each sign can stand for, and the Viterbi path under a character trigram model of all
documents is the restored piece.  Where nothing is ambiguous the lattice has one path and the text stays.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import crc_fold
from marketday.llm.tokens import slices

#: signs and the letters they are written for
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*"
SWAP, KEEP, DROP, SHORTEN, JOIN = 1.0, 2.5, 4.0, 0.5, 0.2  # costs of the channel, in nats

# classes of the character model: 0 anything between words, 1-26 letters, 27 other letters, 28 digits, 29 signs
CLASSES = 30
_TABLE = np.full(0x250, 27, dtype=np.uint8)
_TABLE[:128] = 29
_TABLE[[9, 10, 11, 12, 13, 32]] = 0
_TABLE[48:58] = 28
_TABLE[65:91] = _TABLE[97:123] = np.arange(1, 27)
_TABLE[[0xA0, 0x85]] = 0
_TABLE[[*range(0xA1, 0xAA), *range(0xAB, 0xB5), *range(0xB6, 0xBA), *range(0xBB, 0xC0), 0xD7, 0xF7]] = 29
_SIGN = np.zeros(0x250, dtype=bool)
_SIGN[[ord(c) for c in LOOK_ALIKE if ord(c) < 0x250]] = True
_SINGLE = _SIGN | np.array([chr(c).isalnum() for c in range(0x250)])  # what a spaced run can be made of

SAMPLE = 8_000  # labelled rows that scoring learns from: the bound of what reaches the driver
STEMS = (4, 5, 6)  # first letters of a word that count as features beside the whole word
LEAST, STRONG = 6, 2.5  # toxic texts a feature needs, and its log-odds

_RUN = re.compile(r"([^\W\d_])\1\1+")
_SPACED = re.compile(r"(?<![^\s\"'(\[{<«“„‘])(?:[^\W_]|[@$!|+(€£])(?:[ ._\-*]{1,2}(?:[^\W_]|[@$!|+(€£])){2,}(?![^\s.,;:?!\"')\]}>»”’])")
_PIECE = re.compile(r"\S+")
_SIGNED = re.compile(r"(?<!\S)[^\s0-9@$!|+(€£]*+[0-9@$!|+(€£]\S*")  # a piece with a look-alike
_LOOK = re.compile(r"[0-9@$!|+(€£]")
_LETTER = re.compile(r"[^\W\d_²³¹¼½¾]")
_WORD = re.compile(r"[^\W\d_]+")


def points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4"), 0x24F)


def classes(text: str) -> np.ndarray:
    return _TABLE[points(text)]


@dataclass
class Letters:
    """Trigram log-probabilities with interpolation, from counts of all documents."""

    logp: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> "Letters":
        c = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        one = (c.sum((0, 1)) + 1) / (c.sum() + CLASSES)
        two = (c.sum(0) + 20 * one) / (c.sum((0, 2))[:, None] + 20)
        return Letters(np.log((c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)))


def _class(ch: str) -> int:
    return int(_TABLE[min(ord(ch), 0x24F)]) if ch else -1


def lattice(piece: str, spaced: bool) -> list[list[tuple[str, float]]]:
    """For each sign or run of equal letters: what it can stand for, with the channel's cost."""
    out: list[list[tuple[str, float]]] = []
    i, text = 0, piece.lower()
    while i < len(text):
        ch, j = text[i], i + 1
        if ch in LOOK_ALIKE:
            out.append([(x, SWAP) for x in LOOK_ALIKE[ch]] + [(ch, KEEP)] + [("", DROP)] * (not ch.isdigit()))
        elif spaced and ch in SEPARATORS:
            while j < len(text) and text[j] in SEPARATORS:
                j += 1
            out.append([("", JOIN), (" ", KEEP)])
        elif ch.isalpha():
            while j < len(text) and text[j] == ch:
                j += 1
            n = j - i
            out.append([(ch * n, 0.0)] if n < 3 else [(ch, SHORTEN), (ch * 2, 2 * SHORTEN), (ch * n, KEEP * (n - 2))])
        else:
            out.append([(ch, 0.0)])
        i = j
    return out


def decode(piece: str, letters: Letters, spaced: bool = False) -> str:
    """The best path; states are the last two classes, and the word's end counts too.

    A piece is decoded whole, however long; the work is linear in its length.
    """
    logp = letters.logp
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(piece, spaced):
        after: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in options:
                s, x, y = score - cost, a, b
                for ch in text:
                    c = _class(ch)
                    s += logp[x, y, c]
                    x, y = y, c
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, (path, text))
        states = after
    best = max(((s + logp[a, b, 0], path) for (a, b), (s, path) in states.items()), key=lambda v: v[0])[1]
    out = []
    while best:
        best, text = best
        out.append(text)
    return "".join(reversed(out))


def _hidden(m: re.Match, letters: Letters) -> str:
    piece = m.group()
    # signs at the ends are punctuation; at the start only when no letter follows
    end = len(piece.rstrip(".,;:?!*%&#\"')]}|"))
    start = int(piece[0] == "(" and ")" in piece[end:])  # a closed bracket is no letter
    core = piece[start:end]
    if not (_LOOK.search(core) and _LETTER.search(core)):
        return piece
    found = decode(core, letters)
    return piece if found == core.lower() else piece[:start] + found + piece[end:]


def _apart(m: re.Match, letters: Letters) -> str:
    run = m.group()
    few = len(run) < 10 and sum(c not in SEPARATORS for c in run) < 4
    return run if few and not _LETTER.search(run) else decode(run, letters, True)  # "1 2 3" is no word


def restore(text: str, letters: Letters) -> str:
    """The text with its disguised pieces decoded; the rest unchanged."""
    text = _SPACED.sub(lambda m: _apart(m, letters), text)
    text = _SIGNED.sub(lambda m: _hidden(m, letters), text)
    if _RUN.search(text):
        text = _PIECE.sub(lambda m: decode(m.group(), letters) if _RUN.search(m.group()) else m.group(), text)
    return text


def suspects(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts can hold anything to decode: a piece with a sign and a letter, three equal letters, or three single characters."""
    kind = _TABLE[cp]
    letter = (kind >= 1) & (kind <= 27)
    far = cp == 0x24F  # whatever lies beyond the table
    hit = np.zeros(len(cp) + 1, dtype=bool)
    if len(cp):
        edge = kind == 0
        edge[bounds[:-1][bounds[:-1] < len(cp)]] = True
        piece = np.cumsum(edge, dtype=np.int32)
        worded = np.zeros(piece[-1] + 1, dtype=bool)
        worded[piece[letter]] = True
        signs = np.flatnonzero(_SIGN[cp] | far)
        hit[signs] = worded[piece[signs]]
    if len(cp) > 2:
        hit[: len(cp) - 2] |= (cp[:-2] == cp[1:-1]) & (cp[1:-1] == cp[2:]) & letter[2:]
        lower = np.where((cp >= 65) & (cp < 91), cp + 32, cp)
        hit[: len(cp) - 2] |= (lower[:-2] == lower[1:-1]) & (lower[1:-1] == lower[2:]) & letter[2:]
        single = _SINGLE[cp] | far
        between = ~single | far
        before, after = np.append(True, between[:-1]), np.append(between[1:], True)
        before[bounds[:-1][bounds[:-1] < len(cp)]] = True
        after[bounds[1:][bounds[1:] > 0] - 1] = True
        at = np.flatnonzero(single & before & after)
        if len(at) > 2:
            hit[at[:-2][at[2:] - at[:-2] <= 6]] = True
    return np.add.reduceat(hit, bounds[:-1]) * (np.diff(bounds) > 0) > 0 if len(bounds) > 1 else np.zeros(0, dtype=bool)


def _counted(batches):
    sums = np.zeros(CLASSES**3, dtype=np.int64)
    for batch in batches:
        texts = batch.column(0)
        for start, stop in slices(texts):
            run = classes("\n\n" + "\n\n".join(t or "" for t in texts.slice(start, stop - start).to_pylist()) + "\n\n")
            run = run[np.append(True, (run[1:] != 0) | (run[:-1] != 0))].astype(np.int32)  # white space counts once
            sums += np.bincount(run[:-2] * CLASSES**2 + run[1:-1] * CLASSES + run[2:], minlength=CLASSES**3)
    seen = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["code", "n"])


def learn_letters(docs: DataFrame) -> Letters:
    """Counts over every text; at most one number for each trigram of classes reaches the driver."""
    rows = docs.select("text").mapInArrow(_counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for code, n in rows:
        counts[code] = n
    return Letters.of(counts)


def features(word: str) -> set[str]:
    return {word} | {word[:n] + "-" for n in STEMS if len(word) >= n}


@dataclass
class Model:
    letters: Letters
    weights: dict[str, float] = field(default_factory=dict)
    line: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        """The strongest feature of a word, 0 if none is toxic."""
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def piece(self, piece: str) -> float:
        """Of what stands between white space: its strongest word."""
        got = self.known.get(piece)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[piece] = max((self.word(w) for w in _WORD.findall(piece.lower())), default=0.0)
        return got

    def score(self, strongest: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.line
        return 1 / (1 + np.exp(-(a + b * strongest + c * np.log1p(total))))


def restored(texts: list[str], letters: Letters) -> list[str]:
    cp = points("".join(texts))
    which = suspects(cp, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return [restore(t, letters) if s else t for t, s in zip(texts, which, strict=True)]


def evidence(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(strongest piece, sum over the distinct toxic pieces) of each restored text."""
    pieces = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    coded = pieces.flatten().dictionary_encode()
    weight = np.array([model.piece(w) for w in coded.dictionary.to_pylist()] + [0.0])
    at = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(texts)), pieces.value_lengths().to_numpy(zero_copy_only=False))
    hot = np.flatnonzero(weight[at] > 0) if len(at) else np.zeros(0, dtype=np.int64)
    pairs = np.unique(doc[hot] * (len(weight) + 1) + at[hot]) if len(hot) else np.zeros(0, dtype=np.int64)
    doc, at = pairs // (len(weight) + 1), pairs % (len(weight) + 1)
    strongest, total = np.zeros(len(texts)), np.zeros(len(texts))
    np.maximum.at(strongest, doc, weight[at])
    np.add.at(total, doc, weight[at])
    return strongest, total


def train(rows: list[tuple[str, int]], letters: Letters) -> Model:
    """Features that toxic texts have far more often than others, and a logistic line through the evidence.

    Without both labels the score is the share of ones, for every text.
    """
    model = Model(letters)
    texts = [t for k in range(0, len(rows), 100) for t in restored([t for t, _ in rows[k : k + 100]], letters)]
    y = np.array([v for _, v in rows], dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.line = (math.log(share / (1 - share)), 0.0, 0.0)
    if len(set(y.tolist())) < 2:
        return model
    words = lambda t: set().union(*[features(w) for w in set(_WORD.findall(t.lower()))])
    slot = lambda f: zlib.crc32(f.encode()) & (1 << 22) - 1
    rough = np.zeros(1 << 22, dtype=np.uint16)  # counts by hash first: rare features never take memory
    for t, v in zip(texts, y, strict=True):
        if v:
            rough[np.unique(np.array([slot(f) for f in words(t)], dtype=np.int64))] += 1
    toxic: Counter = Counter()
    for t, v in zip(texts, y, strict=True):
        if v:
            toxic.update(f for f in words(t) if rough[slot(f)] >= LEAST)
    toxic = Counter({f: n for f, n in toxic.items() if n >= LEAST})
    clean: Counter = Counter()
    for t, v in zip(texts, y, strict=True):
        if not v:
            clean.update(words(t) & toxic.keys())
    ones, zeros = y.sum(), len(y) - y.sum()
    odds = {f: math.log((n + 0.5) / (ones + 1)) - math.log((clean[f] + 0.5) / (zeros + 1)) for f, n in toxic.items()}
    model.weights = {f: w for f, w in odds.items() if w >= STRONG}
    found = [evidence(model, texts[k : k + 500]) for k in range(0, len(texts), 500)]
    strongest, total = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    x = np.column_stack([np.ones(len(y)), strongest, np.log1p(total)])
    line = np.zeros(3)
    for _ in range(30):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-x @ line))
        line += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * line)
    model.line = tuple(line)
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts outside fold 0, the first by a hash of the id; equal texts count once."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & (crc_fold() != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return list({r.text: (r.text, r._y) for r in found.orderBy(F.xxhash64("doc_id"), "text").select("text", "_y").limit(rows).collect()}.values())


def _scored(model: Model, keep: bool):
    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for start, stop in slices(column):
                part = batch.slice(start, stop - start)
                texts = restored([t or "" for t in column.slice(start, stop - start).to_pylist()], model.letters)
                score = model.score(*evidence(model, texts))
                cols, names = [*part.columns, pa.array(score)], [*part.schema.names, "score"]
                if keep:
                    cols, names = [*cols, pa.array(texts, pa.string())], [*names, "restored"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def score(docs: DataFrame, labels: DataFrame, keep_restored: bool = True) -> DataFrame:
    """All rows of ``docs`` with ``score`` (the probability of toxicity) and the ``restored`` text.

    Only texts are read; a null text counts as empty and equal texts score alike.  The character model counts all
    documents; the words' weights come from at most SAMPLE labelled texts.
    """
    model = train(sample(docs, labels, SAMPLE), learn_letters(docs))
    rows = docs.drop("score", "restored")
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double" + ", restored string" * keep_restored
    return rows.mapInArrow(_scored(model, keep_restored), kind)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs.select("doc_id", "text"), labels, keep_restored=False)
    return out.select(
        "doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
