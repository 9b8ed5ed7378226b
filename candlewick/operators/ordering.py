"""Positions in a global order without putting all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candlewick.config import slice_rows
from candlewick.storage import settle


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Add the 1-based position in ``order`` as the long column ``name``.

    Rows are stored.  As many as fit a slice are numbered by one sort.  More are
    range-partitioned by the order, numbered inside their partition, and moved on
    by the sizes of the partitions before; only those sizes, one row per
    partition, come together.
    """
    stored = settle(df)
    if stored.count() <= slice_rows(df.sparkSession):
        return stored.withColumn(name, F.row_number().over(W.orderBy(*order)).cast("long"))
    part, before = f"{name}__part", f"{name}__before"
    placed = settle(stored.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias(before))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(W.partitionBy(part).orderBy(*order))
    return (
        placed.join(starts, part)
        .withColumn(name, (F.col(before) + inside).cast("long"))
        .drop(part, before)
    )


def median_of(df: DataFrame, value: str) -> Column:
    """The median of a column as a scalar; nulls do not count."""
    known = numbered(df.where(F.col(value).isNotNull()).select(value), [value], "at")
    n = known.agg(F.count(F.lit(1))).scalar()
    # The middle one of an odd number, the two around it of an even number.
    middle = known.where((F.col("at") * 2 >= n) & (F.col("at") * 2 <= n + 2))
    return middle.agg(F.avg(value)).scalar()
