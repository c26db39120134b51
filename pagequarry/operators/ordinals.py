"""Ordinals inside groups of any size, by any order.

``row_number`` over a window gathers a whole group in one task.  Here all rows
are sorted over the cluster by ranges of (group, order).  A row's ordinal is its
place among its group's rows of its range plus the group's rows in earlier
ranges.  A range holds about as many rows as the others, whatever its groups'
sizes and whether the order is a dense number, a hash or a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.session import cut_lineage


def with_ordinal(df: DataFrame, keys: list[str], order: str | list[str], out: str, ranges: int | None = None) -> DataFrame:
    """Add ``out``: 1-based place of the row in its group by ``order``, nulls first.

    Rows of one group and order get their places in any order; they lie in one
    range.  Null keys are a group.
    """
    by = [order] if isinstance(order, str) else order
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored, as the ranges are drawn from a sample and must not change between the two uses
    dealt = cut_lineage(df.repartitionByRange(n, *keys, *by).withColumn("_ordinals_range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_ordinals_range").agg(F.count(F.lit(1)).alias("_ordinals_rows"))
    # one row per group and range that has rows of it
    earlier = Window.partitionBy(*keys).orderBy("_ordinals_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_ordinals_key{i}") for i, k in enumerate(keys)], F.col("_ordinals_range").alias("_ordinals_of"),
        F.coalesce(F.sum("_ordinals_rows").over(earlier), F.lit(0)).alias("_ordinals_before"),
    )
    same = F.col("_ordinals_range") == F.col("_ordinals_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_ordinals_key{i}"))
    inside = F.row_number().over(Window.partitionBy("_ordinals_range", *keys).orderBy(*by))
    placed = dealt.withColumn("_ordinals_inside", inside).join(offsets, same)
    return placed.withColumn(out, (F.col("_ordinals_inside") + F.col("_ordinals_before")).cast("bigint")).select(*df.columns, out)
