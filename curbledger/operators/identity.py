"""Which plates belong to one customer: plates that share a phone number.

A plate is linked to every larger plate under the same phone, and along chains of
such links.  The plates that nothing smaller links to are roots.  A root's reach is
the number of plates it is linked to; a plate belongs to the root with the largest
(reach, plate) among those that reach it.

Pairs are never made for a whole phone.  A root enters a phone once, at its smallest
reached plate, and takes the plates after it.  Phones with more than `hot_size`
plates are not expanded at all: all that follows plate `e` of a hot phone is nested
in what follows a smaller one, so one label per plate (the largest plate of the hot
phone that leads to it) answers both "how many" and "which root" for every entry.
A plate with more than `hot_size` phones counts as a hot phone of its own.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbledger.functions import ordered
from curbledger.session import stored

PROPERTY_OFFICE = "管理處"  # fixed value: contacts of property managers do not link plates
HOT_SIZE = 1_000
UNION_EVERY = 8


def link_rows(contact: DataFrame) -> DataFrame:
    """Distinct (phone, plate) rows that may link plates."""
    usable = contact.filter((F.col("c_num") != "") & ~F.col("c_name").contains(PROPERTY_OFFICE))
    return usable.select(F.col("c_num").alias("phone"), F.col("cd_license").alias("plate")).distinct()


def successor_links(rows: DataFrame) -> DataFrame:
    """Each plate with the next one under the same phone: major, minor.

    Chains of these links reach exactly what links between all pairs would reach.
    """
    nexts = ordered.with_next(rows, ["phone"], "plate", "minor")
    return nexts.filter(F.col("minor").isNotNull()).select(F.col("plate").alias("major"), "minor").distinct()


class _Phones(NamedTuple):
    cold: DataFrame  # phone, plate of phones small enough to expand
    hot: DataFrame   # phone, plate of the others
    roots: DataFrame  # plate


def _split(rows: DataFrame, hot_size: int) -> _Phones:
    sizes = rows.groupBy("phone").agg(F.count(F.lit(1)).alias("_size"), F.min("plate").alias("_first"))
    shared = stored(rows.join(sizes.filter(F.col("_size") > 1), "phone"))
    later = shared.filter(F.col("plate") > F.col("_first")).select("plate").distinct()
    roots = shared.select("plate").distinct().join(later, "plate", "left_anti")
    pick = lambda cond: shared.filter(cond).select("phone", "plate")
    busy = shared.groupBy("plate").agg(F.count(F.lit(1)).alias("_phones")).filter(F.col("_phones") > hot_size)
    alone = busy.select(F.concat(F.lit("plate "), "plate").alias("phone"), "plate")
    hot = pick(F.col("_size") > hot_size).unionByName(alone)
    return _Phones(pick(F.col("_size") <= hot_size), stored(hot), stored(roots))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _expand(roots: DataFrame, cold: DataFrame, hot_plates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plates that roots reach over cold phones, and the hot plates where they stop.

    Returns (root, plate) without the roots themselves and without hot plates, and
    (root, plate) with hot plates only.
    """
    start = roots.select(F.col("plate").alias("root"), "plate")
    stops = [stored(start.join(hot_plates, "plate", "left_semi").select("root", "plate"))]
    frontier = start.join(hot_plates, "plate", "left_anti").select("root", "plate")
    reached: list[DataFrame] = [stored(frontier)]
    entries: list[DataFrame] = []
    frontier = reached[0]
    while True:
        into = frontier.join(cold, "plate").groupBy("root", "phone").agg(F.min("plate").alias("entry"))
        if entries:
            known = _union(entries).groupBy("root", "phone").agg(F.min("entry").alias("_known"))
            into = into.join(known, ["root", "phone"], "left").filter(
                F.col("_known").isNull() | (F.col("entry") < F.col("_known"))
            ).drop("_known")
        into = stored(into)
        entries.append(into)
        found = (
            into.join(cold, "phone").filter(F.col("plate") > F.col("entry")).select("root", "plate").distinct()
            .join(_union(reached), ["root", "plate"], "left_anti")
        )
        marked = stored(found.join(hot_plates.withColumn("_hot", F.lit(True)), "plate", "left"))
        stops.append(marked.filter(F.col("_hot")).select("root", "plate"))
        frontier = marked.filter(F.col("_hot").isNull()).select("root", "plate")
        if frontier.isEmpty():
            break
        reached.append(frontier)
        if len(reached) > UNION_EVERY:
            reached, entries = [stored(_union(reached))], [stored(_union(entries))]
    pairs = _union(reached).filter(F.col("root") != F.col("plate"))
    return pairs, _union(stops).distinct()


def _running_best(rows: DataFrame, group: list[str], order: str, value: str, name: str) -> DataFrame:
    """Running maximum of `value` per group in ascending `order`, over range blocks."""
    blocks = ordered.in_blocks(rows, [*group, order])
    block = ordered.BLOCK
    inside = Window.partitionBy(block, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.groupBy(*group, block).agg(F.max(value).alias("_best"))
        .withColumn("_carried", F.max("_best").over(before)).filter(F.col("_carried").isNotNull())
        .select(*group, block, "_carried")
    )
    local = blocks.withColumn("_local", F.max(value).over(inside))
    return local.join(carried, [*group, block], "left").withColumn(
        name, F.greatest("_local", "_carried")
    ).drop("_local", "_carried", block)


def _hot_labels(phones: _Phones) -> DataFrame:
    """For each hot phone and plate reached from it: the largest plate of the phone that leads there.

    Rounds of running maxima along every phone until no label changes.
    """
    rows = stored(phones.cold.unionByName(phones.hot))
    labels = stored(phones.hot.select(F.col("phone").alias("hot"), "plate", F.col("plate").alias("label")))
    while True:
        touched = rows.join(labels.select("hot", "plate").distinct(), "plate").select("phone", "hot").distinct()
        lanes = rows.join(touched, "phone").join(labels, ["hot", "plate"], "left")
        scanned = _running_best(lanes, ["phone", "hot"], "plate", "label", "best")
        new = scanned.filter(F.col("best").isNotNull()).groupBy("hot", "plate").agg(F.max("best").alias("label"))
        new = stored(new)
        changed = new.join(labels, ["hot", "plate", "label"], "left_anti")
        if changed.isEmpty():
            return new
        labels = new


def _entry_points(stops: DataFrame, hot: DataFrame, labels: DataFrame) -> DataFrame:
    """Smallest entry per root and hot phone, without entries that another one leads to."""
    home = hot.groupBy("plate").agg(F.min("phone").alias("hot"))
    entry = stored(stops.join(home, "plate").groupBy("root", "hot").agg(F.min("plate").alias("entry")))
    other = entry.select("root", F.col("hot").alias("_hot"), F.col("entry").alias("_entry"))
    led = (
        entry.join(other, "root").filter(F.col("hot") != F.col("_hot"))
        .join(labels.select(F.col("hot").alias("_hot"), F.col("plate").alias("entry"), "label"), ["_hot", "entry"])
        .filter(F.col("label") >= F.col("_entry"))
        .filter((F.col("entry") != F.col("_entry")) | (F.col("hot") > F.col("_hot")))
        .select("root", "hot").distinct()
    )
    return stored(entry.join(led, ["root", "hot"], "left_anti"))


def _hot_reach(entry: DataFrame, labels: DataFrame) -> DataFrame:
    """Number of plates behind the hot entries of each root (the entry itself included).

    One entry: a suffix count of the labels.  Several entries that do not lead to each
    other: their plates are listed and counted once each.
    """
    spread = entry.groupBy("root").agg(F.count(F.lit(1)).alias("_entries"))
    sized = entry.join(spread, "root")
    steps = labels.groupBy("hot", "label").agg(F.count(F.lit(1)).alias("_n"))
    total = steps.groupBy("hot").agg(F.sum("_n").alias("_total"))
    upto = ordered.running_sum(steps, ["hot"], ["label"], "_n", "_upto")
    behind = upto.join(total, "hot").select(
        "hot", F.col("label").alias("entry"), (F.col("_total") - F.col("_upto") + F.col("_n")).alias("n")
    )
    single = sized.filter(F.col("_entries") == 1).join(behind, ["hot", "entry"]).select("root", "n")
    several = (
        sized.filter(F.col("_entries") > 1).join(labels, "hot").filter(F.col("label") >= F.col("entry"))
        .groupBy("root").agg(F.countDistinct("plate").alias("n"))
    )
    return single.unionByName(several)


def _reach(pairs: DataFrame, hot_reach: DataFrame | None, covered: DataFrame | None) -> DataFrame:
    """Plates each root is linked to, itself left out."""
    own = pairs if covered is None else pairs.join(covered, ["root", "plate"], "left_anti")
    counts = own.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    if hot_reach is not None:
        counts = counts.unionByName(hot_reach)
    return counts.groupBy("root").agg(F.sum("n").alias("reach"))


def link_owners(rows: DataFrame, hot_size: int = HOT_SIZE) -> tuple[DataFrame, DataFrame]:
    """Owner root per linked plate, and reach per root: (plate, owner), (root, reach)."""
    phones = _split(rows, hot_size)
    hot_plates = stored(phones.hot.select("plate").distinct())
    pairs, stops = _expand(phones.roots, phones.cold, hot_plates)
    rank = F.max(F.struct("reach", "root"))["root"].alias("owner")
    if hot_plates.isEmpty():
        reach = stored(_reach(pairs, None, None))
        own = reach.select("root", F.col("root").alias("plate"))
        return pairs.unionByName(own).join(reach, "root").groupBy("plate").agg(rank), reach

    labels = _hot_labels(phones)
    entry = _entry_points(stops, phones.hot, labels)
    covered = (
        pairs.join(entry, "root").join(labels, ["hot", "plate"]).filter(F.col("label") >= F.col("entry"))
        .select("root", "plate").distinct()
    )
    # a root on a hot phone is behind its own entry
    itself = entry.filter(F.col("root") == F.col("entry")).select("root", F.lit(-1).cast("long").alias("n"))
    reach = stored(_reach(pairs, _hot_reach(entry, labels).unionByName(itself), covered))
    ranked = entry.join(reach, "root").groupBy("hot", F.col("entry").alias("plate")).agg(
        F.max(F.struct("reach", "root")).alias("_top")
    )
    lanes = labels.select("hot", F.col("label").alias("plate")).distinct().join(ranked, ["hot", "plate"], "left")
    best = _running_best(lanes, ["hot"], "plate", "_top", "top").select("hot", F.col("plate").alias("label"), "top")
    behind = labels.join(best, ["hot", "label"]).filter(F.col("top").isNotNull()).select(
        "plate", F.col("top.reach").alias("reach"), F.col("top.root").alias("root")
    )
    near = pairs.join(reach, "root").select("plate", "reach", "root")
    own = reach.select(F.col("root").alias("plate"), "reach", "root")
    return near.unionByName(behind).unionByName(own).groupBy("plate").agg(rank), reach


def customer_groups(contact: DataFrame, owners: DataFrame) -> DataFrame:
    """Contacts with the plate that stands for their customer (NULL without any phone).

    Plates with a phone but no link stand for themselves.
    """
    phoned = contact.filter(F.col("c_num") != "").select("cd_license").distinct().withColumn("_phoned", F.lit(True))
    named = owners.select(F.col("plate").alias("cd_license"), "owner")
    return contact.join(named, "cd_license", "left").join(phoned, "cd_license", "left").withColumn(
        "owner", F.coalesce("owner", F.when(F.col("_phoned"), F.col("cd_license")))
    ).drop("_phoned")


def login_names(grouped: DataFrame) -> DataFrame:
    """Contacts with a unique login: the customer's smallest phone, else CU and a number.

    Phones of property offices do not count; plates left without a login are numbered
    in plate order.
    """
    named = (
        grouped.filter(F.col("owner").isNotNull() & (F.col("c_num") != "") & ~F.col("c_name").contains(PROPERTY_OFFICE))
        .groupBy("owner").agg(F.min("c_num").alias("login_name"))
    )
    with_login = grouped.join(named, "owner", "left")
    plain = with_login.filter(F.col("login_name").isNull()).select("cd_license").distinct()
    numbered = ordered.row_number(plain, [], ["cd_license"], "_no").select("cd_license", _fallback(F.col("_no")).alias("_login"))
    return with_login.join(numbered, "cd_license", "left").withColumn(
        "login_name", F.coalesce("login_name", "_login")
    ).drop("_login")


def _fallback(number: Column) -> Column:
    """CU and the whole number, padded with zeros to six digits at least."""
    text = number.cast("string")
    return F.concat(F.lit("CU"), F.repeat(F.lit("0"), F.greatest(F.lit(6) - F.length(text), F.lit(0))), text)
