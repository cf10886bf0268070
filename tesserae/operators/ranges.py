"""Numbers of rows within groups without a window over a group: rows are dealt by ranges and each range knows what stands before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import saved

#: Rows of a range, which is one task.
ROWS_PER_RANGE = 1_000_000


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], number: str = "number", size: str | None = None, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with each row's number from 0 within its group, in the given order, nulls first; optionally the group's size too.

    Rows are dealt by ranges of (groups, order), so a group of all rows spreads over as many tasks as the rows need. The
    written ranges give (group, range, rows); only that table, one row for a range and one more for each border of groups,
    meets a window. Equal rows are told apart by their place in the input, so they spread too. A null group is a group.
    """
    keys = [*groups, *order]
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_range))
    by = [*[F.col(f"`{c}`").asc_nulls_first() for c in keys], F.col("run_salt_")]
    dealt = df.withColumn("run_salt_", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    # An id holds its partition in the upper bits and the row's place in the partition in the lower 33.
    placed = saved(dealt.drop("run_salt_").withColumn("run_place_", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("run_place_", 33)
    runs = placed.groupBy(*[F.col(f"`{c}`").alias(f"run_g{k}_") for k, c in enumerate(groups)], part.alias("run_")).agg(F.min("run_place_").alias("run_first_"), F.count("*").alias("run_rows_"))
    same = [f"run_g{k}_" for k in range(len(groups))]
    before = Window.partitionBy(*same).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"run_before_": F.coalesce(F.sum("run_rows_").over(before), F.lit(0)), "run_of_": F.sum("run_rows_").over(Window.partitionBy(*same))})
    match = part == F.col("run_")
    for k, c in enumerate(groups):
        match = match & F.col(f"`{c}`").eqNullSafe(F.col(f"run_g{k}_"))
    made = {number: F.col("run_before_") + F.col("run_place_") - F.col("run_first_")}
    if size is not None:
        made[size] = F.col("run_of_")
    return placed.join(runs, match).withColumns(made).drop("run_place_", "run_", "run_first_", "run_rows_", "run_before_", "run_of_", *same)
