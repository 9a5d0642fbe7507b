"""Running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.session import cut_lineage


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, total: str) -> DataFrame:
    """Add ``total``: the sum of ``value`` over the earlier rows of the group, in the given full order.

    The rows are range-partitioned by group and order and stored with their partition number, so a group of any
    size is spread over many tasks; only sums per (partition, group) meet in the second step. NULL keys form a group.
    """
    group, order = list(group), list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = cut_lineage(df.repartitionByRange(parts, *group, *order).withColumn("__part", F.spark_partition_id()))
    sums = stored.groupBy("__part", *group).agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumn(total, F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = local["__part"].eqNullSafe(offsets["__part"])
    for g in group:
        on = on & local[g].eqNullSafe(offsets[g])
    return local.join(offsets, on).select(*[local[c] for c in df.columns], (local[total] + offsets["__offset"]).alias(total))
