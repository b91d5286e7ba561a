"""Row order, selection, first/last duplicates, and the small set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import checkpointed


def in_ranges(df: DataFrame, order: list[str | Column], place: str | None = None) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written once, with its partition's number in ``_part``.

    ``place`` names a column for a row's 0-based place in the order of its partition, which is sorted for it.

    What is computed from it twice (counts and places) sees the same partitions: sampling and adaptive plans could
    deal two exchanges out differently.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(width, *order)
    if place is not None:
        # The id has the partition in its upper bits, and the place of the row in the partition in the lower 33.
        ranged = ranged.sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return checkpointed(ranged.withColumn("_part", F.spark_partition_id()))


def before_parts(sums: DataFrame, values: list[str], by: list[str] | None = None) -> DataFrame:
    """Running sums over the parts before each one: a row per part (and group) at most, whatever the data's size."""
    earlier = Window.partitionBy(*(by or [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *(by or []), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_before_{v}") for v in values))


def dense_index(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """0-based index in the order of ``order``, without one task that sees all rows.

    Rows are range-partitioned, numbered inside their partition, and written, all in one stage; the offsets are the
    running counts of the partitions, a table of one row each.  Rows that tie are numbered in any order.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = in_ranges(df, cols, "_own")
    before = before_parts(ranged.groupBy("_part").agg(F.count("*").alias("n")), ["n"])
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.col("_before_n") + F.col("_own")).select(*df.columns, name)


def select_rows(df: DataFrame, index: str, limit: int | None = None, start: int | None = None, count: int | None = None, shard_index: int | None = None, num_shards: int | None = None) -> DataFrame:
    """Limit, then offset, then count, then every ``num_shards``-th row; ``index`` is a dense 0-based index."""
    for name, value in (("limit", limit), ("start", start), ("count", count)):
        if value is not None and value < 0:
            raise ValueError(f"{name} must be non-negative")
    if (shard_index is None) != (num_shards is None):
        raise ValueError("shard-index and num-shards must be provided together")
    if num_shards is not None and num_shards <= 0:
        raise ValueError("num-shards must be positive")
    if shard_index is not None and not 0 <= shard_index < num_shards:
        raise ValueError("shard-index must be in [0, num-shards)")
    low = start or 0
    high = [x for x in (limit, None if count is None else low + count) if x is not None]
    keep = F.col(index) >= low
    if high:
        keep = keep & (F.col(index) < min(high))
    if num_shards is not None:
        keep = keep & ((F.col(index) - low) % num_shards == shard_index)
    return df.where(keep)


def one_per_key(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in the order of ``order``: an aggregate with partial results, no sort."""
    pick = F.max_by if last else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*(F.col(c) for c in df.columns)), F.col(order)).alias("_row"))
    return best.select("_row.*")


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done`` yet."""
    return df.join(done.select(F.col(key).cast("string").alias("_done")).distinct(), F.col(key).cast("string") == F.col("_done"), "left_anti")


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text, is in ``ids``."""
    return df.join(ids.select(F.col(key).cast("string").alias("_in")).distinct(), F.col(key).cast("string") == F.col("_in"), "left_semi")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def masked(df: DataFrame) -> DataFrame:
    return df.where(F.col("eval_mask") == 1)
