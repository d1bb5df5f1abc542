"""Quality classifier: a convolutional network over bytes, in numpy.

A text is its UTF-8 bytes.  Learned filters read overlapping windows of 16 bytes, 8 apart, from the first byte to the
last; each filter's activations are max-pooled over chunks of 64 windows, the chunks' pools are combined by their
mean and their maximum, and one linear layer makes the probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import crc_fold
from marketday.llm.tokens import slices

STEP = 8  # bytes between windows; a window is two steps long
CHUNK = 64  # windows pooled together
WIDTH, FILTERS = 8, 32  # numbers for each byte, filters
SAMPLE = 3000  # labelled rows the network learns from: the bound of what reaches the driver
EPOCHS, BATCH, RATE = 6, 16, 0.004
PIECE = 512 * 2048  # bytes taken through the filters at a time
THRESHOLD = 0.3


@dataclass
class Net:
    table: np.ndarray  # 256 x WIDTH
    early: np.ndarray  # STEP * WIDTH x FILTERS, the window's first half
    late: np.ndarray  # the second half
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS + 1

    def arrays(self) -> list[np.ndarray]:
        return [self.table, self.early, self.late, self.bias, self.out]


def fresh(seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return Net(
        draw(256, WIDTH, scale=0.5), draw(STEP * WIDTH, FILTERS, scale=0.12), draw(STEP * WIDTH, FILTERS, scale=0.12),
        np.zeros(FILTERS, np.float32), draw(2 * FILTERS + 1, scale=0.05),
    )


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks of STEP bytes, first block of each chunk, first chunk of each text); texts end in zero bytes.

    A text of n blocks has n - 1 windows: block i with block i + 1.  The last block starts no window.
    """
    counts = np.array([max(2, -(-len(t) // STEP)) for t in texts], dtype=np.int64)
    ends = np.cumsum(counts)
    buffer = np.zeros((int(ends[-1]), STEP), dtype=np.uint8)
    flat = buffer.reshape(-1)
    for t, start in zip(texts, ((ends - counts) * STEP).tolist(), strict=True):
        flat[start : start + len(t)] = np.frombuffer(t, dtype=np.uint8)
    chunks = -(-(counts - 1) // CHUNK)
    first = np.cumsum(chunks) - chunks
    within = np.arange(int(chunks.sum())) - np.repeat(first, chunks)
    return buffer, np.repeat(ends - counts, chunks) + within * CHUNK, first


def activations(net: Net, blocks: np.ndarray, chunk_at: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(embedded blocks, rectified filter outputs for the window that starts at each block)."""
    x = net.table[blocks].reshape(len(blocks), -1)
    act = x @ net.early
    act[:-1] += x[1:] @ net.late
    act += net.bias
    np.maximum(act, 0, out=act)
    starts = chunk_at[text_at]
    act[np.append(starts[1:], len(blocks)) - 1] = 0  # would reach into the next text
    return x, act


def pooled(act: np.ndarray, chunk_at: np.ndarray, text_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pools of the chunks, mean and maximum pool of each text with a constant)."""
    pool = np.maximum.reduceat(act, chunk_at, axis=0)
    n = np.diff(np.append(text_at, len(pool)))[:, None]
    mean = np.add.reduceat(pool, text_at, axis=0) / n
    return pool, np.hstack([mean, np.maximum.reduceat(pool, text_at, axis=0), np.ones_like(n)]).astype(act.dtype)


def logits(net: Net, texts: list[bytes]) -> np.ndarray:
    """For texts of any length: a long one is taken in parts that share one block, so their windows are the whole's."""
    parts, owner = [], []
    for i, t in enumerate(texts):
        for start in range(0, max(1, len(t) - STEP), PIECE):
            parts.append(t[start : start + PIECE + STEP])
            owner.append(i)
    sums, most = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS), dtype=np.float32)
    chunks = np.zeros(len(texts))
    k = 0
    while k < len(parts):
        stop, size = k, 0
        while stop < len(parts) and (stop == k or size + len(parts[stop]) <= PIECE):
            size += len(parts[stop])
            stop += 1
        blocks, chunk_at, text_at = layout(parts[k:stop])
        pool, feats = pooled(activations(net, blocks, chunk_at, text_at)[1], chunk_at, text_at)
        n = np.diff(np.append(text_at, len(pool)))
        np.add.at(sums, owner[k:stop], feats[:, :FILTERS] * n[:, None])
        np.maximum.at(most, owner[k:stop], feats[:, FILTERS : 2 * FILTERS])
        np.add.at(chunks, owner[k:stop], n)
        k = stop
    feats = np.hstack([sums / chunks[:, None], most, np.ones((len(texts), 1))])
    return feats @ net.out


def gradients(net: Net, texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted logistic loss; only the windows that won their pool pass anything on."""
    blocks, chunk_at, text_at = layout(texts)
    x, act = activations(net, blocks, chunk_at, text_at)
    pool, feats = pooled(act, chunk_at, text_at)
    off = (1 / (1 + np.exp(-(feats @ net.out))) - labels).astype(np.float32) * weights / len(texts)
    n = np.diff(np.append(text_at, len(pool)))
    text_of = np.repeat(np.arange(len(texts)), n)
    best = feats[:, FILTERS : 2 * FILTERS]
    tied = (pool == best[text_of]).astype(np.float32)
    tied /= np.add.reduceat(tied, text_at, axis=0)[text_of]
    to_pool = off[text_of, None] * (net.out[:FILTERS] / n[text_of, None] + net.out[FILTERS : 2 * FILTERS] * tied)
    to_pool[pool <= 0] = 0
    chunk_of = np.repeat(np.arange(len(chunk_at)), np.diff(np.append(chunk_at, len(blocks))))
    row, col = np.nonzero(act == pool[chunk_of])
    won = np.zeros(pool.shape, dtype=np.int64)
    won[chunk_of[row[::-1]], col[::-1]] = row[::-1]  # the first window with the maximum
    follow = np.minimum(won + 1, len(blocks) - 1)
    early = np.einsum("cf,cfk->kf", to_pool, x[won])
    late = np.einsum("cf,cfk->kf", to_pool, x[follow])
    table = np.zeros_like(net.table)
    for at, weights in ((won, net.early), (follow, net.late)):
        back = (to_pool[:, :, None] * weights.T[None]).reshape(-1, WIDTH)
        np.add.at(table, blocks[at].reshape(-1), back)
    return [table, early, late, to_pool.sum(axis=0), feats.T @ off]


def train(rows: list[tuple[bytes, int]], seed: int = 7) -> Net:
    """Adam over the sample, both labels with the same weight in all.  Without both the answer is the share of ones, for every text."""
    net, rng = fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in rows], dtype=np.float32)
    share = float(labels.mean()) if len(rows) else 0.5
    if len(set(labels.tolist())) < 2:
        net.out[:] = 0
        net.out[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return net
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    t, steps = 0, EPOCHS * -(-len(rows) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), BATCH):
            pick = order[k : k + BATCH]
            t += 1
            rate = RATE * (1 - (t - 1) / steps)
            for a, g, m, v in zip(net.arrays(), gradients(net, [rows[i][0] for i in pick], labels[pick], weights[pick]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> list[tuple[bytes, int]]:
    """At most ``rows`` labelled texts outside fold 0, the first by a hash of the id."""
    ids = (
        labels.where(F.col(column).isNotNull() & (crc_fold() != 0)).groupBy("doc_id").agg(F.max(column).cast("int").alias("_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "_y")
    return [(r.text.encode(), r._y) for r in found.orderBy(F.xxhash64("doc_id"), "text").limit(rows).collect()]


def _scored(net: Net):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for start, stop in slices(texts, 8 * PIECE):
                raw = pc.fill_null(texts.slice(start, stop - start), "").cast(pa.binary()).to_pylist()
                score = 1 / (1 + np.exp(-logits(net, raw).astype(np.float64)))
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], names=[*part.schema.names, "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """All rows of ``docs`` (any columns beside doc_id and text) with ``score``, the probability of label 1.

    Only texts are read; a null text scores as an empty one, and equal texts score alike.  Nulls in the labels are left out.  The
    network has under 20 000 numbers; at most SAMPLE labelled texts reach the driver to learn it.
    """
    net = train(sample(docs, labels, column, SAMPLE))
    rows = docs.drop("score")
    return rows.mapInArrow(_scored(net), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs.select("doc_id", "text"), labels)
    return out.select(
        "doc_id", F.coalesce(crc_fold() == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
