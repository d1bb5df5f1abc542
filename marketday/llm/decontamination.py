"""Benchmark decontamination by spaced seeds: masks that skip token positions find overlaps with substitutions.

A judged stretch of n words may differ in s of them.  Its positions fall into s + 1 classes by their remainder, and a
substitution touches one class, so at least one class is untouched: a mask of every (s + 1)-th position, tried at
all places, hits every overlap there is.  Longer items are judged in stretches of 20 words, with four substitutions
and the mask 1000010000100001.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import Scratch, row_key
from marketday.llm.tokens import slices

STRETCH = 20  # aligned words judged together; a shorter item is judged whole
SHARE = 0.8  # of a stretch that must be equal
FILTER_BITS = 24  # the filter's size does not depend on any table; half full at about ten million item seeds
# Scripts written without spaces between words: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")

WORDS = "r1 bigint, r2 bigint, doc_id bigint, base bigint, words array<bigint>, hits array<struct<h:bigint, pos:bigint>>"


def _stripped(w: str) -> str:
    a, b = 0, len(w)
    while a < b and not w[a].isalnum():
        a += 1
    while b > a and not w[b - 1].isalnum():
        b -= 1
    return w[a:b]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word hashes of all texts, bounds): lower case, pieces between white space, without the marks at their ends.

    A piece is one word or none; one with characters of scripts without spaces is as many words as it has of these, and what stands between them.
    """
    pieces = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    coded = pieces.flatten().dictionary_encode()
    known = np.empty(len(coded.dictionary), dtype=np.uint64)
    held = np.empty(len(coded.dictionary), dtype=np.int64)
    split: dict[int, list[int]] = {}
    for i, w in enumerate(coded.dictionary.to_pylist()):
        if not w.isascii() and UNSPACED.search(w):
            split[i] = [xxhash.xxh64_intdigest(c) for c in map(_stripped, UNSPACED.split(w)) if c]
            held[i] = len(split[i])
            continue
        if not w.isalnum():
            w = _stripped(w)
        held[i] = bool(w)
        known[i] = xxhash.xxh64_intdigest(w)
    at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = held[at] if len(at) else np.zeros(0, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(n)])
    words = np.repeat(known[at], n) if len(at) else np.zeros(0, dtype=np.uint64)
    if split:
        for j in np.flatnonzero(np.isin(at, list(split))):
            words[before[j] : before[j + 1]] = split[int(at[j])]
    return words, before[pieces.offsets.to_numpy() - pieces.offsets[0].as_py()]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def seeds(words: np.ndarray, offsets: tuple[int, ...], salt: int) -> np.ndarray:
    """A hash of the words at ``offsets`` from each position that has them all."""
    n = len(words) - offsets[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, salt, dtype=np.uint64)
    for k in offsets:
        h = _mix(h * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return h


def _masks(n: int) -> list[tuple[int, int]]:
    """(distance, positions) of the masks of an item of ``n`` words: one for a long item, one for each class of a short one."""
    need = min(STRETCH, n)
    apart = need - math.ceil(SHARE * need - 1e-9) + 1
    return [(apart, -(-(need - c) // apart)) for c in range(apart)]


def exact(n: int) -> bool:
    """Whether an item of ``n`` words may differ in none: its mask is the whole item, so a hit is a match."""
    return n < STRETCH and math.ceil(SHARE * n - 1e-9) == n


def shapes(lengths: list[int]) -> list[tuple[tuple[int, ...], int]]:
    """(offsets, salt) of all masks that items of these lengths need."""
    return [(tuple(range(0, d * k, d)), 100 * d + k) for d, k in sorted({m for n in lengths for m in _masks(n)})]


def _items(batches):
    for batch in batches:
        ids = batch.column(0)
        words, bounds = words_of(pc.fill_null(batch.column(1), ""))
        each = [words[a:b].view(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([ids, pa.array(each, pa.list_(pa.int64()))], names=["item_id", "words"])


def _item_seeds(batches):
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = np.array(words, dtype=np.int64).view(np.uint64)
            for offsets, salt in shapes([len(words)]):
                h = seeds(words, offsets, salt)
                out[0] += h.view(np.int64).tolist()
                out[1] += [item] * len(h)
                out[2] += range(len(h))
                out[3] += [len(words) if exact(len(words)) else 0] * len(h)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h", "item_id", "at", "whole"])


def _clusters(filter_bits: np.ndarray, lengths: list[int], reach: int):
    """Rows for the neighbourhoods of filter hits: their words, and the hits."""
    low = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches):
        bits = np.unpackbits(filter_bits, bitorder="little").view(bool)
        for batch in batches:
            for start, stop in slices(batch.column(3)):
                part = batch.slice(start, stop - start)
                words, bounds = words_of(pc.fill_null(part.column(3), ""))
                found, hashes = [], []
                for offsets, salt in shapes(lengths):
                    h = seeds(words, offsets, salt)
                    at = np.flatnonzero(bits[h & low])
                    inside = at + offsets[-1] < bounds[np.searchsorted(bounds, at, side="right")]
                    found.append(at[inside])
                    hashes.append(h[at[inside]])
                if not found:  # no items
                    continue
                at, h = np.concatenate(found), np.concatenate(hashes).view(np.int64)
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                doc = np.searchsorted(bounds, at, side="right") - 1
                fresh = np.ones(len(at), dtype=bool)
                fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)
                edges = np.append(np.flatnonzero(fresh), len(at))
                keys = [part.column(i).to_pylist() for i in range(3)]
                out: list[list] = [[], [], [], [], [], []]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    d = int(doc[a])
                    first, last = max(bounds[d], at[a] - reach), min(bounds[d + 1], at[b - 1] + reach)
                    row = (
                        keys[0][d], keys[1][d], keys[2][d], int(first - bounds[d]), words[first:last].view(np.int64),
                        [{"h": int(x), "pos": int(p - bounds[d])} for x, p in zip(h[a:b], at[a:b], strict=True)],
                    )
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.struct([("h", pa.int64()), ("pos", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["r1", "r2", "doc_id", "base", "words", "hits"]
                )

    return run


def best_stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(first item position, length, equal words) of the best judged stretch with word i + shift under item word i; length 0: none passes."""
    a, b = max(0, -shift), min(len(item), len(words) - shift)
    need = min(STRETCH, len(item))
    if b - a < need:
        return 0, 0, 0
    same = np.concatenate([[0], np.cumsum(words[a + shift : b + shift] == item[a:b])])
    window = same[need:] - same[:-need]
    if window.max() < SHARE * need:
        return 0, 0, 0
    good = np.flatnonzero(window >= SHARE * need)
    first, last = int(good[0]), int(good[-1]) + need
    return a + first, last - first, int(same[last] - same[first])


def _verified(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for row in batch.to_pylist():
            words, item = np.array(row["words"], dtype=np.int64), np.array(row["item_words"], dtype=np.int64)
            at, n, same = best_stretch(words, item, row["shift"] - row["base"])
            if n:
                for col, v in zip(out, (row["r1"], row["r2"], row["doc_id"], row["item_id"], at + row["shift"], at, n, same), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[f.split()[0] for f in FOUND.split(", ")])


FOUND = "r1 bigint, r2 bigint, doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint, n_equal bigint"


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(r1, r2: the row's key; doc_id, item_id, doc_word, item_word, n_words, n_equal), the best overlap of a document with an item.

    A document overlaps an item where, on one alignment, at least 80 % of 20 words in a row are equal (of the whole item, if
    it is shorter).  Items of up to four words match where all of them stand in a row, so an item of one common word marks every document
    that has it.  Not seen: copied runs of under 20 words of a longer item, and of part of a shorter one.  In scripts without
    spaces a word is a character.  Null texts have no words.  Equal items are reported once, by their smallest id;
    rows of documents that repeat give one result.

    Items' seed hashes set bits in a filter of fixed size (2 MB), which goes to every task; what passes it is joined
    with the items' seeds by hash, so false hits vanish.  Each word neighbourhood then meets its items once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "seeds")
    items = (
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_items, "item_id bigint, words array<bigint>")
        .where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words")
    )
    items = scratch.put(items, "items")
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(STRETCH))).distinct().collect()]
    reach = items.agg(F.max(F.size("words"))).first()[0] or 0
    own = scratch.put(items.mapInArrow(_item_seeds, "h bigint, item_id bigint, at bigint, whole bigint").distinct(), "own")
    slot = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("s")
    maps = own.select(slot).groupBy(F.expr("s div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(s % 32768)").alias("m")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for k, m in maps:
        bits[k * 4096 : k * 4096 + len(m)] = np.frombuffer(m, dtype=np.uint8)
    text = F.coalesce("text", F.lit(""))
    r1, r2 = row_key("doc_id", text)
    rows = docs.select(r1.alias("r1"), r2.alias("r2"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    near = scratch.put(rows.mapInArrow(_clusters(bits, lengths, reach), WORDS).dropDuplicates(["r1", "r2", "base"]), "near")
    aligned = (
        near.select("r1", "r2", "base", F.explode("hits").alias("x")).select("r1", "r2", "base", "x.h", "x.pos")
        .join(own.where("whole = 0"), "h").select("r1", "r2", "base", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    )
    pairs = aligned.join(near.drop("hits"), ["r1", "r2", "base"]).join(items.withColumnRenamed("words", "item_words"), "item_id")
    found = pairs.mapInArrow(_verified, FOUND)
    if any(map(exact, lengths)):  # their hits need no words to be compared: the first of each document is the answer
        first = (
            near.select("r1", "r2", "doc_id", F.explode("hits").alias("x"))
            .groupBy("r1", "r2", "doc_id", F.col("x.h").alias("h")).agg(F.min("x.pos").alias("doc_word"))
        )
        whole = first.join(own.where("whole > 0"), "h").select(
            "r1", "r2", "doc_id", "item_id", "doc_word", F.col("at").alias("item_word"),
            F.col("whole").alias("n_words"), F.col("whole").alias("n_equal"),
        )
        found = found.unionByName(whole)
    value = F.struct("n_equal", "n_words", (-F.col("doc_word")).alias("a"), (-F.col("item_word")).alias("b"))
    best = found.groupBy("r1", "r2", "doc_id", "item_id").agg(F.max(value).alias("v"))
    return best.select(
        "r1", "r2", "doc_id", "item_id", (-F.col("v.a")).alias("doc_word"), (-F.col("v.b")).alias("item_word"),
        F.col("v.n_words").alias("n_words"), F.col("v.n_equal").alias("n_equal"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without overlaps; all columns and repeated rows stay."""
    leaks = overlaps(docs, benchmark).select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2")).distinct()
    r1, r2 = row_key("doc_id", F.coalesce("text", F.lit("")))
    return docs.withColumns({"_r1": r1, "_r2": r2}).join(leaks, ["_r1", "_r2"], "left_anti").drop("_r1", "_r2")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return overlaps(docs.select("doc_id", "text"), benchmark).drop("r1", "r2")
