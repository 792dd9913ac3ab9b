"""Row numbers and carried values within groups of which one may hold most of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.session import cut


def spread_row_number(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """df with the row's number from 1 within its group.

    Rows are range-partitioned by group and order, so a large group spreads over many
    tasks; each task counts its own rows and adds how many of the group came in
    the partitions before. Only groups that cross partitions need that sum, at most one
    more than there are partitions, so those sums are broadcast.
    """
    ranged = cut(df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy("_pid", *group).orderBy(*order)
    counts = ranged.groupBy(*group, "_pid").agg(F.count("*").alias("_n"))
    several = counts.withColumn("_parts", F.count("*").over(Window.partitionBy(*group))).where("_parts > 1")
    before = several.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_p"), "_before")
    numbered = ranged.withColumn("_rn", F.row_number().over(own))
    same = F.col("_pid") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return numbered.join(F.broadcast(before), same, "left").withColumn(out, F.col("_rn") + F.coalesce(F.col("_before"), F.lit(0))).drop("_pid", "_p", "_rn", "_before", *[f"_g_{g}" for g in group])


def spread_last(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """df with the last value that is not null at or before each row of its group, rising in the named columns, nulls first.

    The as-of join of rows that bring values with rows that ask for them, as one sorted pass: rows are
    range-partitioned by group and order, each task carries its values forward, and only what a group carries
    over the end of a partition is passed on, at most one row for each partition. Before the first value it is null.
    """
    ranged = cut(df.repartitionByRange(*[F.col(g) for g in group], *[F.col(o) for o in order]).withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy("_pid", *group).orderBy(*[F.col(o).asc_nulls_first() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    carried = ranged.withColumn("_own", F.last(value, ignorenulls=True).over(own))
    ends = ranged.groupBy(*group, "_pid").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    crossing = ends.withColumn("_parts", F.count("*").over(Window.partitionBy(*group))).where("_parts > 1")
    before = crossing.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.where("_before is not null").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pid").alias("_p"), "_before")
    here = F.col("_pid") == F.col("_p")
    for g in group:
        here = here & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return carried.join(F.broadcast(before), here, "left").withColumn(out, F.coalesce("_own", "_before")).drop("_pid", "_p", "_own", "_before", *[f"_g_{g}" for g in group])
