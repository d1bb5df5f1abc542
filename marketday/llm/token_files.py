"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Two tables are written.  ``ids``: row r holds the token id of rank r, the most frequent first.
``blocks``: runs of documents in ascending doc_id order with their ids' ranks.  A rank takes one to four bytes in
``data`` (little endian, no leading zero bytes); ``control`` holds two bits for each rank, four ranks to a byte,
the first in the lowest bits: the rank's bytes less one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketday.llm import tokens
from marketday.llm.common import Scratch

END = 2

BLOCKS = "part int, block int, doc_ids array<bigint>, lengths array<int>, control binary, data binary"
#: bytes of each of the four ranks that a control byte describes
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit ranks."""
    ranks = np.asarray(ranks, dtype=np.uint32)
    extra = (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    ends = np.cumsum(extra.astype(np.int64) + 1)
    at = ends - extra - 1
    data = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    data[at] = ranks & 255
    for k in range(1, int(extra.max(initial=0)) + 1):
        long = np.flatnonzero(extra >= k)
        data[at[long] + k] = (ranks[long] >> (8 * k)) & 255
    four = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    four[: len(ranks)] = extra
    control = (four.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks back, by looking the lengths up in the table."""
    lens = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:n]
    at = np.cumsum(lens) - lens
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[at].astype(np.uint32) if n else np.zeros(0, dtype=np.uint32)
    for k in range(1, int(lens.max(initial=1))):
        long = np.flatnonzero(lens > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenised(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        part, block = TaskContext.get().partitionId(), 0
        for rows, ids, bounds in tokens.encoded(batches, path, end):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([block], pa.int32()),
                    pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.diff(bounds).astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([ids.astype("<u2" if ids.size and ids.max() < 65536 else "<u4").tobytes()], pa.binary()),
                ],
                names=["part", "block", "doc_ids", "lengths", "ids"],
            )
            block += 1

    return run


def _ids(row: dict) -> np.ndarray:
    n = sum(row["lengths"])
    return np.frombuffer(row["ids"], dtype="<u2" if len(row["ids"]) == 2 * n else "<u4")


def _counted(batches):
    sums = np.zeros(0, dtype=np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            got = np.bincount(_ids(row))
            if len(got) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(got) - len(sums), dtype=np.int64)])
            sums[: len(got)] += got
    seen = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[seen])], names=["id", "n"])


def _coded(rank_of: np.ndarray):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                control, data = encode(rank_of[_ids(row)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]], pa.int32()), pa.array([row["block"]], pa.int32()),
                        pa.array([row["doc_ids"]], pa.list_(pa.int64())), pa.array([row["lengths"]], pa.list_(pa.int32())),
                        pa.array([control], pa.binary()), pa.array([data], pa.binary()),
                    ],
                    names=["part", "block", "doc_ids", "lengths", "control", "data"],
                )

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END) -> None:
    """Token files of all ``docs`` (doc_id, text) below ``path``; repeated and null ids keep every row.

    Documents are dealt out by ranges of doc_id (ties by text, then they share a range), tokenised once where they land and kept as
    plain ids; then the ids are counted over all documents, and every block is coded by rank, without another
    shuffle.  The counts that reach the driver are one for each id of the vocabulary.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    text = F.coalesce("text", F.lit("")).alias("text")
    ordered = docs.select("doc_id", text, F.xxhash64("text").alias("_tie")).repartitionByRange("doc_id", "_tie")
    ordered = ordered.sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    plain = scratch.put(
        ordered.mapInArrow(
            _tokenised(tokenizer or tokens.default_path(), end),
            "part int, block int, doc_ids array<bigint>, lengths array<int>, ids binary",
        ),
        "plain",
    )
    counts = plain.mapInArrow(_counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = [i for _, i in sorted((-n, i) for i, n in counts)]
    rank_of = np.zeros(max(ranked, default=0) + 1, dtype=np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    spark.createDataFrame([(r, int(i)) for r, i in enumerate(ranked)], "rank int, id bigint").coalesce(1).write.parquet(f"{path}/ids")
    plain.mapInArrow(_coded(rank_of), BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    scratch.drop("plain")


def _read(ids: np.ndarray, keep_ids: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lens = np.array(row["lengths"], dtype=np.int64)
                got = ids[decode(row["control"], row["data"], int(lens.sum()))].astype("<u4")
                ends = np.cumsum(lens)
                each = [got[a:b] for a, b in zip(ends - lens, ends, strict=True)]
                cols = [
                    pa.array([row["part"]] * len(lens), pa.int32()), pa.array([row["block"]] * len(lens), pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lens), pa.array(lens),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                ]
                names = ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, names = [*cols, pa.array(each, pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def read(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files.

    ``start`` adds up block totals: within a file part first, then over the parts; single documents are not sorted.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    ids = np.array([i for _, i in sorted(map(tuple, spark.read.schema("rank int, id bigint").parquet(f"{path}/ids").collect()))], dtype=np.uint32)
    kind = "part int, block int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * keep_ids
    rows = blocks.mapInArrow(_read(ids, keep_ids), kind)
    n = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    totals = blocks.select("part", "block", n.alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    base = totals.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").select("part", "block", (F.col("before") + F.col("within")).alias("base"))
    return rows.join(base, ["part", "block"]).withColumn("start", F.col("base") + F.col("at")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids
    )


def digest(docs: DataFrame) -> DataFrame:
    path = Scratch(docs.sparkSession, "token-files").root
    write(docs.select("doc_id", "text"), path)
    return read(docs.sparkSession, path, keep_ids=False)
