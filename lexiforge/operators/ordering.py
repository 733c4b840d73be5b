"""Dense numbers over a whole frame without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage_cut import removed, written

_ROW = (1 << 33) - 1


def _placed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df, range-partitioned and sorted, with __part and __row. The rows are written first, so that choosing the ranges does not compute them twice; that table goes when they are placed."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df)
    placed = written(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__row", F.monotonically_increasing_id()))
    removed(rows)
    return placed.withColumn("__part", F.shiftright("__row", 33)).withColumn("__row", F.col("__row").bitwiseAND(F.lit(_ROW)))


def _before(placed: DataFrame, size: Column) -> DataFrame:
    """__part and __before, the sizes of all parts before it."""
    sizes = placed.groupBy("__part").agg(size.alias("__n"))
    return F.broadcast(sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before")))


def dense_numbers(df: DataFrame, keys: list[str], name: str = "seq") -> DataFrame:
    """df with `name`: 0, 1, 2 ... in the order of keys. Rows are range-partitioned and sorted; only a row count for each partition meets in one task."""
    placed = _placed(df, keys)
    return placed.join(_before(placed, F.count("*")), "__part").withColumn(name, F.col("__before") + F.col("__row")).drop("__part", "__row", "__before")


def dense_starts(df: DataFrame, keys: list[str], size: str, name: str = "start") -> DataFrame:
    """df with `name`, the sum of the column `size` over all rows before, in the order of keys: the first number of each row's run where a row stands for `size` rows."""
    placed = _placed(df, keys)
    within = F.sum(size).over(Window.partitionBy("__part").orderBy("__row")) - F.col(size)
    return placed.withColumn("__within", within).join(_before(placed, F.sum(size)), "__part").withColumn(name, F.col("__before") + F.col("__within")).drop("__part", "__row", "__before", "__within")
