"""What the operators share: row keys, staged tables, gapless numbers, connected components.

Rules for every operator: a null text counts as empty, columns other than those named are ignored and
may clash with nothing (each operator selects what it needs first), rows may repeat.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketday.session import own_folder, shared_dir, tune

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROWS_PER_BIN = 50_000


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> SparkSession:
    """A session as the registered queries need it; Python workers find this package where the driver has it."""
    own_folder(tune(spark))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join([ROOT, env["PYTHONPATH"]] if env.get("PYTHONPATH") else [ROOT])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*cols: Column) -> tuple[Column, Column]:
    """128 bits that stand for a row's content: two hashes under different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def crc_fold(col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out from all learning."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


class Scratch:
    """Tables of one job below the folder that all executors share; each can be dropped by its exact path."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        # shuffle files of a finished job are of no further use: every later step reads a written table
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows: int) -> DataFrame:
    """``out``: 0, 1, 2 ... within each group, for groups of any size.

    Rows go to hash bins of about ROWS_PER_BIN; the bins are counted first, and each row's number is its
    bin's offset plus its place in the bin.  ``df`` is computed twice, so it should be a written table.
    """
    bins = max(1, rows // ROWS_PER_BIN)
    binned = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    before = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*group, "_bin").agg(F.count("*").alias("_n"))
        .select(*group, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy(*group, "_bin").orderBy(*order))
    return (
        binned.withColumn("_place", place).join(offsets, [*group, "_bin"])
        .withColumn(out, F.col("_offset") + F.col("_place") - 1).drop("_bin", "_offset", "_place")
    )


def components(edges: DataFrame, scratch: Scratch, name: str, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable over the links (u, v); nodes without links are absent.

    Large-star and small-star rounds: every node is tied to the smallest neighbour it knows, until nothing
    changes.  Minima are taken by partial aggregation and a join, so no neighbourhood is ever gathered.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct()
    cur, last, step = scratch.put(pairs, f"{name}-0"), None, 0
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: larger neighbours go to the smallest node around u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step += 1
        big = scratch.put(large, f"{name}-{step}")
        # small star: u and its smaller neighbours go to the smallest of them
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        step += 1
        new = scratch.put(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        scratch.drop(f"{name}-{step - 2}")
        sign = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if sign == last:
            return new.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                new.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        cur, last = new, sign
