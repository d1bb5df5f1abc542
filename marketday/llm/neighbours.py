"""Approximate nearest neighbours: p-stable hashing that probes perturbed buckets in estimated success order."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketday.llm.common import Scratch, row_key

TABLES = 4
WIDTH = 2.5  # of a bucket, in standard deviations of a projected unit vector
REACH = 0.65  # of the chance to meet a neighbour that a table's probes add up to
SAMPLE = 64  # queries measured against all rows, to learn how far neighbours are
QUANTILE = 0.9  # of their distances the probes are laid out for
FARTHEST = math.sqrt(2)  # unrelated vectors are about this far apart; no query probes for more
BLOCK = 2048  # vectors, or queries, compared at a time


def _projections(table: int, dims: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([table, dims, m])
    return rng.normal(size=(dims, m)), rng.random(m) * WIDTH


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.linalg.norm(flat, axis=1)[:, None]


def _codes(cells: np.ndarray) -> np.ndarray:
    """One number for the cells of all projections; cells lie far inside +-2**15."""
    out = np.zeros(len(cells), dtype=np.uint64)
    for column in (cells + 32768).astype(np.uint64).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _normal(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x.ravel()]).reshape(x.shape)


def probes(place: np.ndarray, distance: float) -> list[tuple[int, ...]]:
    """Steps (-1, 0, 1 for each projection) to the buckets of most likely neighbours, best first.

    ``place`` is the query's position in its cell, from 0 to 1.  A neighbour at ``distance`` is displaced by a normal
    amount along each projection, so each cell has a known chance; the product over the projections is a
    bucket's.  Buckets are enumerated in falling order until their chances add up to REACH of all.
    """
    edges = (np.array([-1.0, 0.0, 1.0, 2.0])[None, :] - place[:, None]) * WIDTH / max(distance, 1e-6)
    chance = np.maximum(np.diff(_normal(edges), axis=1), 1e-300)
    order = np.argsort(-chance, axis=1)
    cost = -np.log(np.take_along_axis(chance, order, axis=1))
    heap, seen, out, reached = [(float(cost[:, 0].sum()), (0,) * len(place))], {(0,) * len(place)}, [], 0.0
    while heap and reached < REACH:
        c, picks = heapq.heappop(heap)
        out.append(tuple(int(order[i, k]) - 1 for i, k in enumerate(picks)))
        reached += math.exp(-c)
        for i, k in enumerate(picks):
            if k < 2:
                after = (*picks[:i], k + 1, *picks[i + 1 :])
                if after not in seen:
                    seen.add(after)
                    heapq.heappush(heap, (c - float(cost[i, k]) + float(cost[i, k + 1]), after))
    return out


def _matrix(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> (rows, vectors)"""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    return {
        int(d): (rows, flat[(ends[rows] - d)[:, None] + np.arange(d)])
        for d in np.unique(sizes) for rows in [np.flatnonzero(sizes == d)]
    }


def _hashed(m: int, probing: bool):
    """Each vector's bucket in every table, or the buckets it probes for neighbours at its distance ``d``."""

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vec"))
            apart = batch.column(batch.schema.get_field_index("d")).to_numpy() if probing else None
            for dims, (rows, vectors) in _matrix(column).items():
                for table in range(TABLES):
                    a, b = _projections(table, dims, m)
                    at = (_unit(vectors) @ a + b) / WIDTH
                    cells = np.floor(at).astype(np.int64)
                    if not probing:
                        take, codes = rows, _codes(cells)
                    else:
                        steps = [probes(p, d) for p, d in zip(at - cells, apart[rows], strict=True)]
                        take = np.repeat(rows, [len(s) for s in steps])
                        codes = _codes(np.vstack([c + np.array(s) for c, s in zip(cells, steps, strict=True)]))
                    part = batch.take(pa.array(take))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(np.full(len(take), table, dtype=np.int32)), pa.array(codes)],
                        names=[*part.schema.names, "tbl", "code"],
                    )

    return run


def cosines(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row in double precision; the order of summation does not depend on how many rows there are."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def _compared(k: int):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = [[], [], [], []]
        if len(queries) and len(rows):
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(rows["vec"]):
                by_size.setdefault(len(v), []).append(i)
            stacks = {d: (np.array(at), np.stack([rows["vec"].iloc[i] for i in at]).astype(np.float64)) for d, at in by_size.items()}
            ids = rows["ids"].tolist()
            for q1, q2, vec in zip(queries["q1"], queries["q2"], queries["vec"], strict=True):
                if len(vec) not in stacks:
                    continue
                at, vectors = stacks[len(vec)]
                score = cosines(np.asarray(vec, dtype=np.float64), vectors)
                edge = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                best = sorted((-float(score[i]), int(x)) for i in np.flatnonzero(score >= edge) for x in ids[at[i]])[:k]
                for s, x in best:
                    for col, v in zip(out, (q1, q2, x, -s), strict=True):
                        col.append(v)
        return pd.DataFrame({"q1": pd.Series(out[0], dtype="int64"), "q2": pd.Series(out[1], dtype="int64"), "vec_id": pd.Series(out[2], dtype="int64"), "score": pd.Series(out[3], dtype="float64")})

    return run


def _kth_distance(rows: list, k: int):
    """For each sampled vector: the k + 1 largest cosines within a batch."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], []]
            parts = _matrix(batch.column(batch.schema.get_field_index("vec")))
            for i, vec in enumerate(rows):
                if len(vec) in parts:
                    score = cosines(vec, parts[len(vec)][1])
                    for s in np.sort(score)[-k - 1 :]:
                        out[0].append(i)
                        out[1].append(float(s))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64())], names=["i", "s"])

    return run


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec): rows with an id whose vector is neither null nor zero and has finite components only.

    Repeated rows count once; an id with several vectors takes part with the smallest.
    """
    vec = F.col("embedding").cast("array<double>")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec"))
        .where("vec_id IS NOT NULL AND vec IS NOT NULL").where(good & F.exists("vec", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("vec").alias("vec"))
    )


def search(vectors: DataFrame, every: int, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by ``every`` its ``k`` nearest found by cosine, ties to smaller ids.

    Equal vectors are one entry with their k + 1 smallest ids, which is all that any result can show of them; equal
    queries are one probe.  The number of projections follows the number of vectors, the number of probes from
    the chance of meeting a neighbour at the distance measured for SAMPLE queries against all rows; queries that find their
    neighbours farther away, or too few, probe once more for the distance they found.  A bucket of any size
    is compared in blocks of about BLOCK vectors with BLOCK queries: all of it, and only each query's best leave a block.
    """
    scratch = Scratch(vectors.sparkSession, "neighbours")
    base = scratch.put(valid(vectors), "base")
    c1, c2 = row_key(F.col("vec"))
    keyed = base.select("vec_id", "vec", c1.alias("q1"), c2.alias("q2"))
    smallest = F.row_number().over(Window.partitionBy("q1", "q2").orderBy("vec_id"))
    entries = (
        keyed.withColumn("n", smallest).where(F.col("n") <= k + 1).groupBy("q1", "q2")
        .agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vec").alias("vec"))
    )
    entries = scratch.put(entries, "entries")
    queries = keyed.where(F.col("vec_id") % every == 0)
    asked = scratch.put(queries.groupBy("q1", "q2").agg(F.first("vec").alias("vec")), "asked")
    n = entries.count()
    m = max(4, round(math.log2(n + 1) / 2.5))
    some = [np.array(r.vec) for r in asked.orderBy("q1", "q2").limit(SAMPLE).collect()]
    top = entries.select("vec").mapInArrow(_kth_distance(some, k), "i int, s double")
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s")))
    kth = [r.s for r in top.withColumn("n", place).where(F.col("n") <= k + 1).groupBy("i").agg(F.min("s").alias("s")).collect()]
    distance = float(np.quantile([math.sqrt(max(0.0, 2 - 2 * s)) for s in kth], QUANTILE)) if kth else 1.0

    index = scratch.put(entries.mapInArrow(_hashed(m, False), "q1 bigint, q2 bigint, ids array<bigint>, vec array<double>, tbl int, code bigint"), "index")
    sizes = scratch.put(index.groupBy("tbl", "code").agg(F.ceil(F.count("*") / BLOCK).alias("vb")), "sizes")
    key, order = ["tbl", "code", "x", "y"], [F.desc("score"), "vec_id"]

    def first(rows: DataFrame) -> DataFrame:
        rows = rows.groupBy("q1", "q2", "vec_id").agg(F.max("score").alias("score"))
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("q1", "q2").orderBy(*order))).where(F.col("n") <= k + 1).drop("n")

    def met(asking: DataFrame, name: str) -> DataFrame:
        probed = scratch.put(asking.mapInArrow(_hashed(m, True), "q1 bigint, q2 bigint, vec array<double>, d double, tbl int, code bigint"), f"probed{name}")
        asks = probed.groupBy("tbl", "code").agg(F.ceil(F.count("*") / BLOCK).alias("qb"))
        blocks = scratch.put(sizes.join(asks, ["tbl", "code"]), f"blocks{name}")
        left = (
            probed.join(blocks, ["tbl", "code"]).withColumn("y", F.pmod(F.xxhash64("q1", "q2"), "qb"))
            .withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("vb") - 1)))
        )
        right = (
            index.join(blocks, ["tbl", "code"]).withColumn("x", F.pmod(F.xxhash64("q1", "q2"), "vb"))
            .withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - 1)))
        )
        pairs = left.select(*key, "q1", "q2", "vec").groupBy(*key).cogroup(right.select(*key, "ids", "vec").groupBy(*key)).applyInPandas(
            _compared(k + 1), "q1 bigint, q2 bigint, vec_id bigint, score double"
        )
        return scratch.put(first(pairs), f"met{name}")

    near = met(asked.withColumn("d", F.lit(distance)), "1")
    reached = near.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.min("score").alias("s"))
    own = F.when(F.col("n") > k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s")))).otherwise(F.lit(FARTHEST))
    farther = asked.join(reached, ["q1", "q2"], "left").select("q1", "q2", "vec", F.least(own, F.lit(FARTHEST)).alias("d"))
    best = first(near.unionByName(met(farther.where(F.col("d") > distance), "2")))
    found = queries.select("q1", "q2", F.col("vec_id").alias("query_id")).join(best, ["q1", "q2"]).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(vectors: DataFrame) -> DataFrame:
    return search(vectors, every=50)
