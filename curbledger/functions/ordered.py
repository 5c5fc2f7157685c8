"""Row numbers, running sums and successors that never put a group into one task.

The rows are range-partitioned on their full order, so a hot group spreads over
many blocks.  Work inside a block is a plain window over (block, group); what
crosses blocks is one summary row per group and block, and only groups that
really span several blocks are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbledger.session import durable

BLOCK = "_block"


def in_blocks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with the number of the range block they fall in.

    Block bounds come from sampling, so the frame is made durable: a recomputed
    task must not see other bounds.
    """
    return durable(df.repartitionByRange(*order).withColumn(BLOCK, F.spark_partition_id()))


def _carried(blocks: DataFrame, group: Sequence[str], value: Column, name: str) -> DataFrame:
    """Sum of `value` over the group's earlier blocks, for blocks after its first."""
    total = blocks.groupBy(*group, BLOCK).agg(value.alias("_total"))
    earlier = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return (
        total.withColumn(name, F.sum("_total").over(earlier))
        .filter(F.col(name).isNotNull())
        .select(*group, BLOCK, name)
    )


def _joined(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys, NULL matching NULL."""
    other = carried.select(*[F.col(k).alias(f"_on_{k}") for k in keys], "_carried")
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return rows.join(other, on, "left").drop(*[f"_on_{k}" for k in keys])


def running_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Running sum per group; (group, order) must be unique, so merge peers first."""
    blocks = in_blocks(df, [*group, *order])
    inside = (
        Window.partitionBy(BLOCK, *group).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = blocks.withColumn("_local", F.sum(value).over(inside))
    carried = _carried(blocks, group, F.sum(value), "_carried")
    out = _joined(local, carried, [*group, BLOCK])
    kind = df.schema[value].dataType
    return out.withColumn(
        name, (F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0).cast(kind)))
    ).drop("_local", "_carried", BLOCK)


def row_number(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Row number per group in ascending `order` (an empty group numbers all rows)."""
    keys = list(group) or ["_all"]
    numbered = df if group else df.withColumn("_all", F.lit(0))
    blocks = in_blocks(numbered, [*group, *order])
    local = blocks.withColumn(
        "_local", F.row_number().over(Window.partitionBy(BLOCK, *keys).orderBy(*order))
    )
    carried = _carried(blocks, keys, F.count(F.lit(1)), "_carried")
    out = _joined(local, carried, [*keys, BLOCK]).withColumn(
        name, F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0))
    )
    return out.drop("_local", "_carried", BLOCK, "_all")


def with_next(df: DataFrame, group: Sequence[str], order: str, name: str) -> DataFrame:
    """The value of `order` in the group's next row (NULL on its last row)."""
    blocks = in_blocks(df, [*group, order])
    local = blocks.withColumn(
        "_local", F.lead(order).over(Window.partitionBy(BLOCK, *group).orderBy(order))
    )
    heads = blocks.groupBy(*group, BLOCK).agg(F.min(order).alias("_head"))
    crossing = (
        heads.withColumn(
            "_carried", F.lead("_head").over(Window.partitionBy(*group).orderBy(BLOCK))
        )
        .filter(F.col("_carried").isNotNull())
        .select(*group, BLOCK, "_carried")
    )
    out = _joined(local, crossing, [*group, BLOCK])
    return out.withColumn(name, F.coalesce("_local", "_carried")).drop("_local", "_carried", BLOCK)
