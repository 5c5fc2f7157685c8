"""Connected components by contraction: rounds grow with the logarithm of the longest chain.

In a round every node points to its smallest neighbour (itself, if that is smaller), the
pointers are followed to their ends by doubling, and the links move to those ends.  Only one
row per link and per node is shuffled, and a hub is an aggregation with map-side partials,
never a list.  Each step's files go when the next step is stored, and pointers of few nodes
are broadcast, as a shuffle would cost a task for each partition in every step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.session import discard, near, stored


def _roots(parent: DataFrame, rows: int) -> DataFrame:
    """Follow `rows` stored (node, root) pointers, which go, to their ends by pointer doubling."""
    while True:
        up = parent.select(F.col("node").alias("_up"), F.col("root").alias("_top"))
        jumped = stored(
            parent.select("node", "root").join(near(up, rows), F.col("root") == F.col("_up"), "left")
            .select("node", F.coalesce("_top", "root").alias("root"), (F.col("_top") != F.col("root")).alias("_moved"))
        )
        discard(parent)
        if not jumped.filter("_moved").limit(1).count():
            return jumped
        parent = jumped


def _moved(label: DataFrame, moves: DataFrame, rows: int) -> DataFrame:
    """`label` with the roots that its roots have in `moves`, which has `rows` rows."""
    move = near(moves.select(F.col("node").alias("_from"), F.col("root").alias("_to")), rows)
    return label.join(move, F.col("root") == F.col("_from"), "left").select("node", F.coalesce("_to", "root").alias("root"))


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root), stored, for every node of a link; root is the smallest node that it reaches.

    Nodes are of any orderable type.  Links with a NULL end are left out, a link of a node to
    itself gives that node alone.
    """
    first = stored(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    )
    ends = first.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = None  # node -> its end so far
    edges, within = first, first.filter("u <> v")
    while within.limit(1).count():
        both = within.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        parent = stored(both.groupBy(F.col("e.u").alias("node")).agg(F.min("e.v").alias("_least")).select(
            "node", F.least("node", "_least").alias("root")))
        # a root points to itself, and every other node to a smaller one: no cycles
        rows = parent.count()
        tops = _roots(parent, rows)
        left = near(tops.select(F.col("node").alias("u"), F.col("root").alias("_u")), rows)
        right = near(tops.select(F.col("node").alias("v"), F.col("root").alias("_v")), rows)
        after = stored(within.join(left, "u").join(right, "v").filter("_u <> _v")
                       .select(F.col("_u").alias("u"), F.col("_v").alias("v")).distinct())
        if label is None:
            label = tops
        else:
            grown = stored(_moved(label, tops, rows))
            discard(label, tops)
            label = grown
        if edges is not first:
            discard(edges)
        edges = within = after
    if label is None:
        out = stored(ends.select("node", F.col("node").alias("root")))
    else:
        known = near(label.select("node", "root"), label.count())
        out = stored(ends.join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
        discard(label)
    discard(first, edges)
    return out


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label`, the result of `connected`, after more links (a, b) between its roots and nodes that it has not.

    The earlier links are not read again; `label` goes.
    """
    moves = connected(links)
    if rows := moves.count():
        fresh = moves.join(near(label.select("node"), label.count()), "node", "left_anti")
        before, label = label, stored(_moved(label, moves, rows).unionByName(fresh))
        discard(before)
    discard(moves)
    return label
