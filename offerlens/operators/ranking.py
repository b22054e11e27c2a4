"""Global ranks of large tables, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlens.session import staged


def with_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with ``name``, the place of each row (from 1) in ``order``; equal rows get different places.

    Rows are sorted across partitions by ranges of ``order`` and numbered within each. The partitions' row counts, one
    row each, are summed up in order and added, so no task ever holds more than its range.
    """
    if name in df.columns:
        raise ValueError(f"a column is named {name}")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = "__place"
    while place in df.columns:
        place += "_"
    # The number holds the partition in its upper bits and the row of the sorted partition in the lower 33.
    numbered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id())
    numbered = staged(numbered, "ranked")
    part, ahead = F.shiftright(place, 33), f"{place}ahead"
    sizes = numbered.groupBy(part.alias(f"{place}part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(f"{place}part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(f"{place}part", F.coalesce(before, F.lit(0)).alias(ahead))
    out = numbered.join(sizes, part == F.col(f"{place}part"))
    return out.select(*df.columns, (F.col(place).bitwiseAND((1 << 33) - 1) + F.col(ahead) + 1).alias(name))
