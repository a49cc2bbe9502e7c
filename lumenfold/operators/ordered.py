"""Neighbours and running sums along an order, without putting a whole group into one task.

A group is cut into chunks of consecutive keys. A window runs inside each chunk only; what a chunk needs from the
ones before it is one row a chunk, found by a window over those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1_000_000


def with_neighbour(df: DataFrame, group: str, order: str, values: dict[str, Column], *, after: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Add ``values`` of the previous row (or the next, if ``after``) of the group; null where there is none."""
    rows = df.withColumn("_c", F.floor(F.col(order) / chunk))
    at = F.struct(F.lit(True).alias("_has"), *[v.alias(k) for k, v in values.items()])
    rows = rows.withColumn("_v", at)
    w = Window.partitionBy(group, "_c").orderBy(order)
    near = F.lead("_v").over(w) if after else F.lag("_v").over(w)
    rows = rows.withColumn("_n", near)
    pick = F.min_by("_v", order) if after else F.max_by("_v", order)
    w2 = Window.partitionBy(group).orderBy("_c")
    ends = rows.groupBy(group, "_c").agg(pick.alias("_e")).withColumn("_far", F.lead("_e").over(w2) if after else F.lag("_e").over(w2)).select(F.col(group).alias("_g"), F.col("_c").alias("_k"), "_far")
    out = rows.join(ends, (F.col(group) == F.col("_g")) & (F.col("_c") == F.col("_k")), "left").withColumn("_n", F.coalesce("_n", "_far"))
    for k in values:
        out = out.withColumn(k, F.col("_n")[k])
    return out.drop("_c", "_v", "_n", "_g", "_k", "_far")


def with_running_sum(df: DataFrame, group: str, order: str, value: Column, name: str, *, chunk: int = CHUNK) -> DataFrame:
    """Add the sum of ``value`` over this row and all earlier ones of the group."""
    rows = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", value.cast("long"))
    w = Window.partitionBy(group, "_c").orderBy(order)
    rows = rows.withColumn("_s", F.sum("_v").over(w))
    w2 = Window.partitionBy(group).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(group, "_c").agg(F.sum("_v").alias("_t")).withColumn("_b", F.coalesce(F.sum("_t").over(w2), F.lit(0))).select(F.col(group).alias("_g"), F.col("_c").alias("_k"), "_b")
    out = rows.join(base, (F.col(group) == F.col("_g")) & (F.col("_c") == F.col("_k")))
    return out.withColumn(name, F.col("_s") + F.col("_b")).drop("_c", "_v", "_s", "_g", "_k", "_b")
