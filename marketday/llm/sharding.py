"""Sharding by histogram sort: probe exact byte counts until the splitters meet a tolerance, exchange once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketday.llm.common import Scratch, gapless

DIGITS = 3  # hexadecimal digits a round adds to a boundary: 4096 probes in its interval
LENGTH = 48  # of a key
TOLERANCE = 0.001  # of a shard's ideal bytes


def _keyed(docs: DataFrame) -> DataFrame:
    """The order of rows, as text: the hash of the text (copies lie side by side), then of id and text."""
    text = F.coalesce("text", F.lit(""))
    halves = [F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("own"), F.col("doc_id"), text))]
    return docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "_key": F.concat(*halves)})


def _told_apart(rows: DataFrame) -> DataFrame:
    """Written rows with their place in the table as the last part of the order, so that rows alike in id and text differ."""
    place = rows.metadataColumn("_metadata")
    own = F.xxhash64(F.lit("copy"), place.getField("file_name"), place.getField("row_index"))
    return rows.withColumn("_key", F.concat("_key", F.lpad(F.hex(own), 16, "0")))


def splitters(keys: DataFrame, shards: int) -> tuple[list[str], int]:
    """(boundaries, rows) for ``keys`` (_key, size): shard i takes the keys from boundary i-1 up to boundary i.

    Each round counts the exact bytes of every probe interval around the boundaries that are still open
    (one aggregation, at most 4096 sums for each of them) and narrows each boundary to one interval.  A boundary
    is done where its interval's bytes are within the tolerance, or the interval holds one key.
    """
    total = keys.agg(F.sum("size"), F.count("*")).first()
    size, rows = total[0] or 0, total[1]
    goals = {i: size * i / shards for i in range(1, shards)}
    state = {i: ("", 0) for i in goals}  # the interval's prefix, the bytes below it
    done: dict[int, str] = {}
    for depth in range(DIGITS, LENGTH + DIGITS, DIGITS):
        still = sorted({state[i][0] for i in goals if i not in done})
        if not still or not size:
            break
        inside = keys.where(F.substring("_key", 1, depth - DIGITS).isin(still)) if depth > DIGITS else keys
        counted = inside.groupBy(F.substring("_key", 1, depth).alias("p")).agg(F.sum("size"), F.min("_key"), F.max("_key"))
        sums: dict[str, list] = {}
        for p, n, least, most in sorted(counted.collect()):
            sums.setdefault(p[: depth - DIGITS], []).append((p, n, least == most))
        for i in [i for i in goals if i not in done]:
            prefix, below = state[i]
            for p, n, single in sums[prefix]:  # noqa: B007
                if below + n > goals[i]:
                    break
                below += n
            else:
                below -= n
            state[i] = (p, below)
            if single or n <= TOLERANCE * size / shards:  # the nearer edge; "~" is above every digit
                done[i] = p if goals[i] - below <= below + n - goals[i] else p + "~"
    return [done.get(i, "") for i in sorted(goals)], rows


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All rows of ``docs`` with ``size`` (UTF-8 bytes of the text, null: none, plus 1), ``shard`` and ``slot``.

    Law ``bytes``: a boundary is off its ideal place by no more than half the tolerance (0.1 % of a shard) or half a
    row.  Rows are sorted by (hash of text, hash of id and text, place in the written table): equal texts lie side by side
    and are split between shards only where a boundary falls among them, rows alike in id and text too.  Slots are
    gapless from 0 in each shard.  An empty table gives an empty result.

    The rows are written once, which fixes their places for every later step, also where an executor is lost; the rounds
    read keys and sizes of that table and move sums only, and the rows move once, when they are numbered.  No shard and no
    row's copies have to fit in one task.
    """
    return _dealt(_keyed(docs), shards)


def _dealt(keyed: DataFrame, shards: int) -> DataFrame:
    rows = _told_apart(Scratch(keyed.sparkSession, "sharding").put(keyed, "rows"))
    bounds, n = splitters(rows.select("_key", "size"), shards)
    number = sum(((F.col("_key") >= b).cast("int") for b in bounds), F.lit(0))
    return gapless(rows.withColumn("shard", number), ["shard"], ["_key"], "slot", n).drop("_key")


def digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    plain = docs.select("doc_id", "text").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    return _dealt(_keyed(plain).drop("text"), shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
