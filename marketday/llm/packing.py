"""Best-fit packing by linear grouping: configurations for rounded large lengths, best fit for the small ones."""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm import tokens
from marketday.llm.common import Scratch, gapless

CAPACITY, END = 2048, 0
GROUPS = 96  # sizes the large lengths are rounded up to
LARGE = (2, 3, 4, 8)  # lengths over capacity / LARGE are large; each is tried until nothing can be better

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int, end: int, keep_ids: bool):
    def run(batches):
        for rows, ids, bounds in tokens.encoded(batches, path, end):
            ids = ids.astype("<u4")
            out: list[list] = [[], [], [], [], [], []]
            for doc, a, b in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for k, s in enumerate(range(a, b, capacity)):
                    x = ids[s : min(b, s + capacity)]
                    for col, v in zip(out, (doc, k, s - a, len(x), zlib.crc32(x), x), strict=True):
                        col.append(v)
            cols = [pa.array(c, t) for c, t in zip(out[:5], (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(out[5], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Linear grouping, largest first: ``groups`` runs of equal cardinality, each (its largest length, [(length, count)])."""
    total, out = sum(counts.values()), []
    quota = -(-total // groups) if total else 1
    room, run = quota, []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            take = min(left, room)
            run.append((length, take))
            left, room = left - take, room - take
            if not room:
                out.append((run[0][0], run))
                room, run = quota, []
    if run:
        out.append((run[0][0], run))
    return out


def _fullest(sizes: list[int], counts: list[int], first: int, capacity: int) -> list[int]:
    """How often to take each size besides one of ``first``, so that the sequence is as full as can be (bounded knapsack by bit sets)."""
    room = capacity - sizes[first]
    usable = [(i, min(counts[i] - (i == first), room // s)) for i, s in enumerate(sizes) if s <= room and counts[i] - (i == first) > 0]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, most in usable:
        steps.append((reach, i, most))
        k = 1
        while most > 0:
            use = min(k, most)
            reach |= (reach << (use * sizes[i])) & mask
            most, k = most - use, 2 * k
    at, taken = reach.bit_length() - 1, [0] * len(sizes)
    taken[first] = 1
    for before, i, most in reversed(steps):
        n = 0
        while not before >> at & 1:  # the fewest of this size that reach the filling
            at, n = at - sizes[i], n + 1
            assert n <= most and at >= 0
        taken[i] += n
    return taken


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of most worth, any number of each size (knapsack by dynamic programming over the room)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    up = np.argsort(sizes)
    s, w = sizes[up], worth[up]
    fitting = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for room in range(int(s[0]), capacity + 1):
        value = best[room - s[: fitting[room]]] + w[: fitting[room]]
        k = int(value.argmax())
        if value[k] > best[room - 1]:
            best[room], choice[room] = value[k], up[k]
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= int(sizes[choice[room]])
    return pattern, float(best[capacity])


def fractional(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """The fewest sequences if they could be split: configurations with how often to use each.

    The linear programme is solved by column generation: from one size to a sequence, configurations of most worth at
    the prices of the moment come in one by one, until none is worth more than a sequence.
    """
    size, need = np.array(sizes), np.array(counts, dtype=np.float64)
    basis = np.diag(np.floor(capacity / size))
    used = need / np.diag(basis)
    for _ in range(20 * len(sizes)):
        pattern, worth = _best_pattern(size, np.linalg.solve(basis.T, np.ones(len(size))), capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern)
        ratio = np.where(step > 1e-9, np.maximum(used, 0) / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        used = used - ratio[out] * step
        used[out] = ratio[out]
        basis[:, out] = pattern
    return [([int(n) for n in basis[:, k]], float(used[k])) for k in range(len(sizes))]


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """[(how many of each size, how many sequences)] for all pieces of few sizes.

    The linear programme's configurations, as often as it uses them rounded down.  For what is left, a few pieces of each
    size, the largest is combined with others into the fullest sequence, as long as its sizes last.
    """
    left, out = list(counts), []
    for taken, times in fractional(sizes, counts, capacity) if sizes else []:
        times = min([int(times + 1e-9), *[left[i] // n for i, n in enumerate(taken) if n]])
        if times:
            left = [n - times * t for n, t in zip(left, taken, strict=True)]
            out.append((taken, times))
    while any(left):
        first = next(i for i, n in enumerate(left) if n)
        taken = _fullest(sizes, left, first, capacity)
        times = min(left[i] // n for i, n in enumerate(taken) if n)
        left = [n - times * t for n, t in zip(left, taken, strict=True)]
        out.append((taken, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """The plan with the fewest sequences, whichever lengths are taken as large."""
    least, best, fewest = -(-sum(n * c for n, c in counts.items()) // capacity), [], None
    for large in LARGE:
        steps, used = _plan(counts, capacity, groups, large)
        if fewest is None or used < fewest:
            best, fewest = steps, used
        if fewest == least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, groups: int, large: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go, from how many there are of each length: (length, first rank, ranks, first sequence, offset).

    The pieces of a length with ranks first .. first + ranks - 1 go to that many sequences from the first one on,
    one to each, at the offset; and the number of sequences.  Works on lengths with counts, so its size depends on the capacity only.
    """
    big = {n: c for n, c in counts.items() if n * large > capacity}
    runs = grouped(big, groups)
    sizes = sorted({size for size, _ in runs}, reverse=True)
    stock: dict[int, list[tuple[int, int]]] = defaultdict(list)  # actual lengths for each rounded size, largest first
    for size, run in runs:
        stock[size] += run
    amounts = [sum(c for _, c in stock[s]) for s in sizes]
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, how many)
    next_seq = 0
    for taken, times in configurations(sizes, amounts, capacity):
        slots = [s for s, n in zip(sizes, taken, strict=True) for _ in range(n)]
        # actual documents take the rounded places, slot by slot; runs of sequences split where a length ends
        open_runs = [(next_seq, times, 0)]
        next_seq += times
        for size in slots:
            after = []
            for first, n, filled in open_runs:
                while n:
                    length, c = stock[size][0]
                    take = min(n, c)
                    out.append((length, used[length], take, first, filled))
                    used[length] += take
                    after.append((first, take, filled + length))
                    stock[size][0] = (length, c - take)
                    if c == take:
                        stock[size].pop(0)
                    first, n = first + take, n - take
            open_runs = after
        for first, n, filled in open_runs:
            free[capacity - filled].append((first, n))
    rooms = sorted(free)
    for length in sorted((n for n in counts if n not in big), reverse=True):  # best fit: the smallest room that holds the piece
        left = counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                run, room = (next_seq, -(-left // (capacity // length))), capacity
                next_seq += run[1]
            else:
                room = rooms[k]
                run = free[room].pop()
                if not free[room]:
                    del free[room], rooms[k]
            first, n = run
            take = min(n, left)
            out.append((length, used[length], take, first, capacity - room))
            used[length] += take
            left -= take
            for rest, part in ((room - length, (first, take)), (room, (first + take, n - take))):
                if part[1] and rest:
                    if rest not in free:
                        bisect.insort(rooms, rest)
                    free[rest].append(part)
    return out, next_seq


def cut(docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Token pieces of all documents (doc_id, text): only documents over the capacity are cut."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or tokens.default_path(), capacity, end, keep_ids), PIECES + ", ids array<bigint>" * keep_ids)


def place(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """``pieces`` (a written table with doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    At most one count for each length reaches the driver, and the plan that goes back is bounded by the capacity too.
    Each piece gets its rank among those of its length (gapless numbers, counted in bins), and the plan's interval
    that holds the rank gives its place.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    steps = sorted(plan(counts, capacity, groups))
    rules: dict[int, list] = defaultdict(list)
    for length, first, n, seq, offset in steps:
        rules[length].append((first, n, seq, offset))
    rows = [(length, [x[0] for x in r], [x[2] for x in r], [x[3] for x in r]) for length, r in sorted(rules.items())]
    table = spark.createDataFrame(rows, "length long, firsts array<long>, seqs array<long>, offsets array<long>")
    ranked = gapless(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank", sum(counts.values()))
    at = F.size(F.filter("firsts", lambda x: x <= F.col("_rank"))) - 1
    return (
        ranked.join(F.broadcast(table), "length").withColumn("_at", at)
        .withColumns({"sequence_id": F.get("seqs", "_at") + F.col("_rank") - F.get("firsts", "_at"), "offset": F.get("offsets", "_at")})
        .drop("_rank", "_at", "firsts", "seqs", "offsets")
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """All ``docs`` (doc_id, text; null: empty) packed into sequences of at most ``capacity`` tokens; see ``place``.

    Every row gives at least one piece (an empty text: the end id alone); repeated rows are packed each.
    """
    pieces = Scratch(docs.sparkSession, "packing").put(cut(docs, capacity, keep_ids=keep_ids), "pieces")
    return place(pieces, capacity)


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs.select("doc_id", "text"), keep_ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
