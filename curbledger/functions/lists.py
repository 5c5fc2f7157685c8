"""Sorted text lists per group, in parts that no group outgrows.

The items of a group stand in one order, whatever its size, and a part is a run of them: the part of
an item follows from the bytes before it in its group, by a running sum over range blocks.  Parts put one
after the other are the list, no item is cut in two, and no task holds more than a part and an item.
Part 0 is always there; a part begins where the bytes before an item pass a multiple of the limit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import ordered

PART_BYTES = 16 << 20


def place(items: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, limit: int | None = PART_BYTES) -> DataFrame:
    """Add the `part` of each item; `order` begins with what the list is sorted by.  Without a limit all is part 0."""
    if limit is None:
        return items.withColumn("part", F.lit(0))
    sized = items.withColumn("_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    running = ordered.running_sum(sized, keys, order, "_bytes", "_upto")
    return running.withColumn("part", F.floor((F.col("_upto") - F.col("_bytes")) / F.lit(limit)).cast("int")).drop("_bytes", "_upto")


def sorted_text(value: Column, separator: str, head: str = "", tail: str = "") -> Column:
    """Sorted list of the non-null values as one text; NULL when there is none."""
    found = F.collect_list(value)
    text = F.concat(F.lit(head), F.array_join(F.array_sort(found), separator), F.lit(tail))
    return F.when(F.size(found) > 0, text)


def packed(
    items: DataFrame,
    keys: Sequence[str],
    kinds: Mapping[object, str],
    separator: str = ",",
    head: str = "[",
    tail: str = "]",
    limit: int | None = PART_BYTES,
) -> DataFrame:
    """One row per key and part, with one list column per kind.

    `items` has the key columns, `kind`, `text`, and `copy` telling equal texts apart.
    """
    spots = place(items, [*keys, "kind"], ["text", "copy"], "text", limit)
    lists = [
        sorted_text(F.when(F.col("kind") == kind, F.col("text")), separator, head, tail).alias(name)
        for kind, name in kinds.items()
    ]
    return spots.groupBy(*keys, "part").agg(*lists)
