"""Repeated passages by a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

A byte goes if a string of WINDOW bytes that covers it also starts anywhere else.  Every window is owned by one anchor,
the smallest hash of its 32-byte pieces, so equal windows have equal anchors; the bytes of all windows an anchor owns
in a row are its context.  Contexts alike in all bytes are one entry with a count.  Where an anchor has several
entries, they go into one index, and the matching statistics of the index's text against itself, streamed from
the samples at the ends of the runs, say which windows occur in another entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import Scratch, row_key

WINDOW, PIECE = 400, 32
SLICE = 1 << 20  # bytes taken at a time; longer texts are taken in parts that share WINDOW - 1 bytes
POSITION = np.uint64((1 << 21) - 1)  # bits of a window's key that hold the place, for the leftmost of equal hashes
INDEX = 1_000_000  # bytes of an index
GROUP = 1024  # entries of an anchor that may share an index; larger groups are split by what their windows have in common
HOT = 1000  # a context found at over 1/1000 of all places is broadcast: fewer than 1000 are


# ---- anchors ---------------------------------------------------------------------------------------------------


def _hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position."""
    w = b.astype(np.uint64)
    w = w[:-1] | (w[1:] << np.uint64(8))
    w = w[:-2] | (w[2:] << np.uint64(16))
    w = w[:-4] | (w[4:] << np.uint64(32))
    h = w[:-24] * np.uint64(0x9E3779B97F4A7C15)
    for k, (mul, shift) in enumerate(((0xD6E8FEB86659FD93, 32), (0x9E3779B97F4A7C15, 29), (0xD6E8FEB86659FD93, 31)), 1):
        h ^= h >> np.uint64(29)
        h += w[8 * k : len(w) - 24 + 8 * k]
        h *= np.uint64(mul)
        h ^= h >> np.uint64(shift)
    return h


def contexts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, first byte, one past the last, anchor's place, anchor's hash) of each context of the texts in a buffer."""
    none = np.zeros(0, dtype=np.int64)
    if len(buffer) < window:
        return none, none, none, none, none.astype(np.uint64)
    h = _hashes(buffer)
    least = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    width, cover = window - PIECE + 1, 1
    while cover * 2 <= width:
        least = np.minimum(least[:-cover], least[cover:])
        cover *= 2
    if cover < width:
        least = np.minimum(least[: cover - width], least[width - cover :])
    counts = np.maximum(0, ends - starts - window + 1)
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(int(counts.sum())) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    owner = (least[at] & POSITION).astype(np.int64)
    if not len(at):
        return none, none, none, none, none.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return text[first], at[first], at[last] + window, owner[first], h[owner[first]]


def _parts(texts: list[bytes], window: int):
    """Groups of (row, offset, bytes) with about SLICE bytes; a long text's parts hold each window once."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, max(1, len(t) - window + 1), SLICE):
            part = t[k : k + SLICE + window - 1]
            if group and size + len(part) > SLICE:
                yield group
                group, size = [], 0
            group.append((i, k, part))
            size += len(part)
    if group:
        yield group


FOUND = "r1 bigint, r2 bigint, lo bigint, n bigint, anchor bigint, a bigint, d bigint"


def _contexts(window: int):
    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)]
            for group in _parts(batch.column(2).to_pylist(), window):
                sizes = np.array([len(p) for _, _, p in group], dtype=np.int64)
                raw = b"".join(p for _, _, p in group)
                ends = np.cumsum(sizes)
                text, lo, hi, place, h = contexts(np.frombuffer(raw, dtype=np.uint8), ends - sizes, ends, window)
                view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
                d = np.array([digest(view[x:y]) for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], dtype=np.uint64)
                row = np.array([i for i, _, _ in group], dtype=np.int64)[text]
                offset = np.array([k for _, k, _ in group], dtype=np.int64)[text] - (ends - sizes)[text]
                cols = [keys[0][row], keys[1][row], lo + offset, hi - lo, place - lo, h.view(np.int64), d.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in FOUND.split(", ")])

    return run


# ---- the index -------------------------------------------------------------------------------------------------


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffixes in order, [(length, rank of each suffix by its first symbols)]) by doubling; only ties are sorted again."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for k in range(7):
        key = (key << 9) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    heads = np.flatnonzero(new)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    levels, length = [(7, rank)], 7
    tied = np.flatnonzero(~new | ~np.append(new[1:], True))  # places in the order whose rank is shared
    while len(tied):
        at = order[tied]
        follow = np.where(at + length < n, rank[np.minimum(at + length, n - 1)] + 1, 0)
        key = rank[at] * np.int64(n + 1) + follow
        sub = np.argsort(key, kind="stable")
        at, key = at[sub], key[sub]
        order[tied] = at
        new = np.ones(len(tied), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        heads = np.flatnonzero(new)
        rank[at] = np.repeat(tied[heads], np.diff(np.append(heads, len(tied))))
        length *= 2
        levels.append((length, rank))
        tied = tied[~new | ~np.append(new[1:], True)]
    return order, levels


def common(symbols: np.ndarray, levels: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at i and j, pair by pair."""
    n, out = len(symbols), np.zeros(len(i), dtype=np.int64)
    for length, rank in reversed(levels):
        x, y = i + out, j + out
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = rank[x[inside]] == rank[y[inside]]
        out[same & (x + length <= n) & (y + length <= n)] += length
    for _ in range(6):
        x, y = i + out, j + out
        inside = (x < n) & (y < n)
        same = inside.copy()
        same[inside] = symbols[x[inside]] == symbols[y[inside]]
        out[same] += 1
        if not same.any():
            break
    return out


class RunIndex:
    """Runs of the Burrows-Wheeler transform, with the suffix and its agreement with the neighbour at both ends of each."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        order, levels = suffix_order(symbols)
        before = np.where(order > 0, symbols[order - 1], -1)
        cut = np.flatnonzero(before[1:] != before[:-1])
        heads, tails = np.append(0, cut + 1), np.append(cut, self.n - 1)
        self.letters, self.lengths = before[heads], tails - heads + 1  # the run-compressed transform
        self.first, self.last = order[heads], order[tails]  # sampled suffixes
        self.above = np.append(0, common(symbols, levels, order[heads[1:] - 1], order[heads[1:]])) if self.n else heads
        self.below = np.append(self.above[1:], 0)

    def matching(self) -> np.ndarray:
        """The longest match elsewhere of the string from each position, streamed in text order.

        Inside a run the agreement with the neighbour above (or below) is one less than that of the position before; at
        the run's head (or end) it is sampled.  So position plus agreement never falls from left to right.
        """
        out = np.zeros(self.n, dtype=np.int64)
        for at, agreed in ((self.first, self.above), (self.last, self.below)):
            reach = np.zeros(self.n, dtype=np.int64)
            reach[at] = at + agreed
            np.maximum(out, np.maximum.accumulate(reach) - np.arange(self.n), out=out)
        return out


def repeated(entries: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """(entry, first, last): runs of window starts whose window occurs elsewhere among the entries."""
    sizes = np.array([len(e) for e in entries], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(int(ends[-1]), dtype=np.int64)  # 0 stands between entries, bytes are 1 to 256
    raw = np.frombuffer(b"\0".join(entries) + b"\0", dtype=np.uint8)
    symbols[:] = raw
    symbols += 1
    symbols[ends - 1] = 0
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(symbols))
    good = (RunIndex(symbols).matching() >= window) & (left >= window)
    edge = np.diff(np.concatenate([[0], good.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    entry = np.searchsorted(ends, first, side="right")
    base = (ends - sizes - 1)[entry]
    return list(zip(entry.tolist(), (first - base).tolist(), (last - base).tolist(), strict=True))


# ---- the join --------------------------------------------------------------------------------------------------


ENTRY = "r1 bigint, r2 bigint, lo bigint, anchor bigint, low bigint, high bigint, `group` bigint, data binary"
ENTRY_TYPES = [pa.int64()] * 7 + [pa.binary()]
MARKS = "r1 bigint, r2 bigint, x bigint, y bigint"


def _names(kind: str) -> list[str]:
    return [f.split()[0].strip("`") for f in kind.split(", ")]


def _batch(rows: list[tuple], kind: str, types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_names(kind))


def _bytes_of(window: int):
    """Entries: the bytes of each text's wanted contexts, with the range of window starts relative to the anchor."""

    def run(batches):
        for batch in batches:
            col = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for r1, r2, text, wanted in zip(col["r1"], col["r2"], col["raw"], col["wanted"], strict=True):
                rows = [
                    (r1, r2, w["lo"], w["anchor"], PIECE - window, 0, w["a"], text[w["lo"] : w["lo"] + w["n"]]) for w in wanted
                ]
                yield _batch(rows, ENTRY, ENTRY_TYPES)

    return run


def _halves(window: int):
    """Each entry's windows in two halves by where they start; a half's group is what all its windows have in common."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own_low, own_high = -r["anchor"], len(r["data"]) - window - r["anchor"]
                middle = (r["low"] + r["high"]) // 2
                for x, y in ((r["low"], middle), (middle + 1, r["high"])):
                    a, b = max(x, own_low), min(y, own_high)
                    if a <= b:
                        core = r["data"][r["anchor"] + y : r["anchor"] + x + window]
                        group = xxhash.xxh3_64_intdigest(core, seed=(r["group"] + x) & 0xFFFFFFFFFFFFFFFF)
                        start = r["anchor"] + a
                        out.append((
                            r["r1"], r["r2"], r["lo"] + start, r["anchor"] - start, x, y,
                            group - (1 << 64) if group >> 63 else group, r["data"][start : r["anchor"] + b + window],
                        ))
            yield _batch(out, ENTRY, ENTRY_TYPES)

    return run


def _indexed(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = np.array(repeated(rows["data"].tolist(), window), dtype=np.int64).reshape(-1, 3)
        own = rows.iloc[found[:, 0]]
        lo = own["lo"].to_numpy()
        return pd.DataFrame({"r1": own["r1"].to_numpy(), "r2": own["r2"].to_numpy(), "x": lo + found[:, 1], "y": lo + found[:, 2] + window})

    return run


def _alike(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """(r1, r2, x, y): the contexts that are found more than once, at every place.

    One that many texts hold would bring all its places to one task: such are few by their definition and broadcast, and
    their places stay where they were read.
    """
    limit = max(1, (counted.agg(F.sum("c")).first()[0] or 0) // HOT)
    hot = counted.where(F.col("c") > limit).select("a", "d", F.lit(True).alias("hot"))
    cold = counted.where((F.col("c") > 1) & (F.col("c") <= limit)).select("a", "d")
    at = rows.join(F.broadcast(hot), ["a", "d"], "left")
    found = at.where("hot").drop("hot").unionByName(at.where("hot IS NULL").drop("hot").join(cold, ["a", "d"]))
    return found.select("r1", "r2", F.col("lo").alias("x"), (F.col("lo") + F.col("n")).alias("y"))


def _marks(entries: DataFrame, scratch: Scratch, window: int, group: int) -> DataFrame:
    """(r1, r2, x, y): bytes x to y of a row lie in windows that occur in another entry.

    Groups of more than ``group`` entries are split: their windows are halved by where they start, and only halves that
    agree in what all their windows hold can still match.  Halves alike in all bytes are marked at once, and one of
    them goes on.  A range of one start leaves nothing but such halves, so splitting ends.
    """
    found, ready, level = [], [], 0
    while True:
        sizes = entries.groupBy("group").agg(F.count("*").alias("m")).where("m > 1")
        sized = scratch.put(entries.join(sizes, "group"), f"sized-{level}").select(*_names(ENTRY), "m")
        ready.append(sized.where(F.col("m") <= group).drop("m"))
        large = sized.where(F.col("m") > group).drop("m")
        if not large.limit(1).count():
            break
        level += 1
        halves = scratch.put(large.mapInArrow(_halves(window), ENTRY).withColumn("s", F.xxhash64("data")), f"halves-{level}")
        counted = halves.groupBy("group", "s").agg(F.count("*").alias("c"), F.min(F.struct("r1", "r2", "lo")).alias("one"))
        alike = halves.join(counted.where("c > 1").select("group", "s"), ["group", "s"])
        found.append(alike.select("r1", "r2", F.col("lo").alias("x"), (F.col("lo") + F.length("data")).alias("y")))
        entries = halves.join(counted.select("group", "s", "one.r1", "one.r2", "one.lo"), ["group", "s", "r1", "r2", "lo"]).select(*_names(ENTRY))
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)
    total = rest.agg(F.sum(F.length("data"))).first()[0] or 0
    keyed = rest.withColumn("index", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-total // INDEX)))))
    out = keyed.select("index", "r1", "r2", "lo", "data").groupBy("index").applyInPandas(_indexed(window), MARKS)
    for more in found:
        out = out.unionByName(more)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(spans):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [tuple(s) for s in out]


def _removed(keep: bool):
    def run(batches):
        for batch in batches:
            raw, marks = batch.column(batch.schema.get_field_index("_raw")), batch.column(batch.schema.get_field_index("_marks"))
            others = [i for i, n in enumerate(batch.schema.names) if n not in ("_raw", "_marks")]
            spans = [merged([(m["x"], m["y"]) for m in ms or []]) for ms in marks.to_pylist()]
            kept = [
                b"".join([t[a:b] for a, b in zip([0, *[y for _, y in s]], [*[x for x, _ in s], len(t)], strict=True)]) if s else t
                for t, s in zip(raw.to_pylist(), spans, strict=True)
            ]
            cols = [
                pa.array([sum(y - x for x, y in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
            ]
            names = ["n_removed", "n_spans", "kept_sha256"]
            if keep:
                pair = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
                cols += [pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], pa.list_(pair)), pa.array(kept, pa.binary())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in others], *cols], names=[*[batch.schema.names[i] for i in others], *names])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, group: int = GROUP, keep: bool = True) -> DataFrame:
    """All rows of ``docs`` with n_bytes, n_removed, n_spans, kept_sha256, and ``spans`` and ``kept`` (bytes).

    Every byte covered by a string of ``window`` bytes that also starts elsewhere, in any row or the same one, goes; strings
    are judged on the input.  Texts are UTF-8 bytes, null is empty.  Rows that repeat are copies of each other, so all they
    hold of ``window`` bytes or more goes.  ``window`` is at least 2 * PIECE.

    What is shuffled first are hashes, one row for each anchor (about one in 185 bytes); bytes follow only for
    anchors with several contexts.  An index never holds more than about INDEX bytes and one group.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    raw = F.coalesce("text", F.lit("")).cast("binary")
    r1, r2 = row_key("doc_id", F.coalesce("text", F.lit("")))
    texts = docs.select(r1.alias("r1"), r2.alias("r2"), raw.alias("raw"))
    rows = scratch.put(texts.mapInArrow(_contexts(window), FOUND), "contexts")
    one = F.min(F.struct("r1", "r2", "lo", "n", "anchor")).alias("one")
    counted = scratch.put(rows.groupBy("a", "d").agg(F.count("*").alias("c"), one), "counted")
    several = counted.groupBy("a").agg(F.count("*").alias("m")).where("m > 1").select("a")
    wanted = (
        counted.join(several, "a").select("one.r1", "one.r2", F.struct("a", "one.lo", "one.n", "one.anchor").alias("w"))
        .groupBy("r1", "r2").agg(F.collect_list("w").alias("wanted"))
    )
    entries = scratch.put(texts.join(wanted, ["r1", "r2"]).mapInArrow(_bytes_of(window), ENTRY), "entries")
    marks = _alike(rows, counted).unionByName(_marks(entries, scratch, window, group))
    marks = scratch.put(marks.groupBy("r1", "r2").agg(F.collect_set(F.struct("x", "y")).alias("_marks")), "marks")
    for name in ("contexts", "counted", "entries"):
        scratch.drop(name)
    keyed = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept").withColumns({"_r1": r1, "_r2": r2, "_raw": raw})
    marks = marks.withColumnsRenamed({"r1": "_r1", "r2": "_r2"})
    joined = keyed.join(marks, ["_r1", "_r2"], "left").drop("_r1", "_r2", "text").withColumn("n_bytes", F.octet_length("_raw").cast("long"))
    kind = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_raw", "_marks")]
    kind += ["n_removed bigint", "n_spans bigint", "kept_sha256 string"] + ["spans array<struct<start:bigint,stop:bigint>>", "kept binary"] * keep
    return joined.mapInArrow(_removed(keep), ", ".join(kind))


def digest(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), keep=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
