"""Order lines and headers stored side by side: dealt by order id when they are loaded, joined later without a shuffle.

Both tables are bucketed by order id into the same number of buckets, one sorted file a bucket.  An order with more
lines than an average bucket would make its bucket a task that nothing can split, so such orders (by that rule fewer than
there are buckets) are kept in plain folders beside, and joined the ordinary way, where AQE splits them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketday.session import exists, stage
from marketday.sources.schemas import RAW, names

KEY = "order_id"
DETAIL, HEADER = "order_detail", "order_header"
BUCKET_LINES = 2_000_000  # about 100 MB of stored lines
MIN_BUCKETS = 8


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One sorted file a bucket in a new folder.  The catalog entry is only the means of writing and goes again."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, key)  # by the hash that buckets use, so a task holds one whole bucket
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A bucketed folder with its buckets known to Spark; ``buckets`` must be the number it was written with."""
    if not exists(spark, path):  # a table over no folder would be an empty one
        raise FileNotFoundError(path)
    name = f"bucketed_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    found = spark.table(name)  # resolved here: what is read later does not need the name
    spark.sql(f"DROP TABLE {name}")
    return found


def buckets_for(lines: DataFrame, bucket_lines: int = BUCKET_LINES) -> int:
    """Buckets for these lines, a multiple of eight: one number from the files' footers."""
    return max(MIN_BUCKETS, -(-lines.count() // (8 * bucket_lines)) * 8)


def _folders(root: str, buckets: int, name: str) -> tuple[str, str, str]:
    """Bucketed rows, rows of large orders, rows without an order id.  The number of buckets is part of the path, so it cannot be mistaken."""
    return tuple(f"{root}/{part}/{name}" for part in (f"by-order-{buckets}", "large-orders", "no-order"))


def store_by_order(lines: DataFrame, header: DataFrame, root: str, buckets: int) -> None:
    """Write both tables below ``root``, which must be new.

    ``buckets_for`` gives a number of buckets.  Where it is more than the 100 000 that Spark allows, raise
    ``spark.sql.sources.bucketing.maxBuckets`` or keep a root for each year.
    """
    sizes = lines.filter(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.count(F.lit(1)).alias("_lines"))
    average = lines.select((F.count(F.lit(1)) / buckets).alias("_average")).scalar()
    large = stage(sizes.filter((F.col("_lines") > average) & (F.col("_lines") > 1)).select(KEY), "large-orders")
    for name, df in ((DETAIL, lines), (HEADER, header)):
        df, known = df.select(*names(RAW[name])), F.col(KEY).isNotNull()
        by_order, large_orders, no_order = _folders(root, buckets, name)
        write_bucketed(df.filter(known).join(large, KEY, "left_anti").select(*df.columns), by_order, KEY, buckets)
        df.join(large, KEY, "left_semi").select(*df.columns).write.parquet(large_orders)
        df.filter(~known).write.parquet(no_order)


class ByOrder:
    """The two tables that ``store_by_order`` has written below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root, buckets

    def _plain(self, name: str, part: int) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(_folders(self.root, self.buckets, name)[part])

    def bucketed(self, name: str) -> DataFrame:
        path = _folders(self.root, self.buckets, name)[0]
        return read_bucketed(self.spark, path, RAW[name], KEY, self.buckets)

    def table(self, name: str) -> DataFrame:
        """All rows of one table."""
        return self.bucketed(name).unionByName(self._plain(name, 1)).unionByName(self._plain(name, 2))

    def joined(self, condition: Column | None = None) -> DataFrame:
        """Every line with its header, as ``views.orders_v`` takes them; ``condition`` is a filter on header columns."""
        def pair(lines: DataFrame, header: DataFrame) -> DataFrame:
            return lines.drop("discount_id").join(header if condition is None else header.filter(condition), KEY)

        return pair(self.bucketed(DETAIL), self.bucketed(HEADER)).unionByName(pair(self._plain(DETAIL, 1), self._plain(HEADER, 1)))
