"""Compare computed bills with stored ones, and apply the differences.

Cases of a difference (`st`, `paid`):
  1  st=-1 paid=0  open bill without service          -> bill deleted
  2  st=-1 paid=1  archived bill without service      -> archive deleted, refund
  3  st= 1 paid=0  service without bill               -> bill inserted
  6  st= 0 paid=0  open bill with another amount      -> bill updated
  7  st= 0 paid=1  archived bill below new amount     -> refund and new bill
  8  st= 0 paid=1  archived bill above new amount     -> part refund, archive updated
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.operators.billing import BILL_KEY

DIFF_COLUMNS = [
    "st", "paid", "company", "ix_yrmo", "uid", "cd_license",
    "b_amount", "f_amount", "discount", "bill_start", "bill_end", "due_dtm",
]
MONEY = "decimal(15,2)"


class BillState(NamedTuple):
    bill: DataFrame
    bill_archive: DataFrame
    customer: DataFrame


def stored_bills(bill: DataFrame, bill_archive: DataFrame) -> DataFrame:
    columns = [*BILL_KEY, "amount", "discount", "bill_start", "bill_end", "due_dtm"]
    return (
        bill.select(F.lit(0).alias("paid"), *columns)
        .unionByName(bill_archive.select(F.lit(1).alias("paid"), *columns))
    )


def diff_bills(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Differences between stored bills and computed ones of the same months and payers.

    Computed bills are unique per key and payer row, and one full join finds removed, changed and new
    bills, so each side is read and shuffled once.
    """
    f = computed.select(
        *BILL_KEY, F.col("amount").alias("f_amount"), F.col("bill_start").alias("f_start"),
        F.col("bill_end").alias("f_end"), F.col("due_dtm").alias("f_due"),
    )
    zero = F.lit(0).cast(MONEY)
    fresh, gone = F.col("paid").isNull(), F.col("f_amount").isNull()
    pick = lambda new, old: F.when(fresh, new).otherwise(old)
    joined = stored.join(f, BILL_KEY, "full").filter(fresh | gone | (F.col("amount") != F.col("f_amount")))
    return joined.select(
        F.when(fresh, 1).when(gone, -1).otherwise(0).alias("st"), F.coalesce("paid", F.lit(0)).alias("paid"), *BILL_KEY,
        pick(zero, F.col("amount").cast(MONEY)).alias("b_amount"),
        pick(F.col("f_amount"), F.coalesce("f_amount", zero)).cast(MONEY).alias("f_amount"),
        pick(zero, F.col("discount").cast(MONEY)).alias("discount"),
        pick(F.col("f_start"), F.coalesce("f_start", "bill_start")).alias("bill_start"),
        pick(F.col("f_end"), F.coalesce("f_end", "bill_end")).alias("bill_end"),
        pick(F.col("f_due"), F.coalesce("f_due", "due_dtm")).alias("due_dtm"),
    ).select(*DIFF_COLUMNS)


def bill_diff(
    bill: DataFrame, bill_archive: DataFrame, computed: DataFrame, ix_yrmo: int, uid: int | None = None
) -> DataFrame:
    """Differences of one month, for one payer or all."""
    stored = stored_bills(bill, bill_archive).filter(F.col("ix_yrmo") == ix_yrmo)
    if uid is not None:
        stored = stored.filter(F.col("uid") == uid)
    return diff_bills(stored, computed)


def diff_case() -> Column:
    """Case number of a difference row."""
    st, paid = F.col("st"), F.col("paid")
    grown = F.col("f_amount") > F.col("b_amount")
    return (
        F.when((st == -1) & (paid == 0), 1).when((st == -1) & (paid == 1), 2).when(st == 1, 3)
        .when(paid == 0, 6).when(grown, 7).otherwise(8)
    )


def case_counts(diff: DataFrame) -> DataFrame:
    """Rows per case."""
    return diff.groupBy(diff_case().cast("int").alias("case_no")).agg(F.count(F.lit(1)).alias("n"))


def refunds(diff: DataFrame) -> DataFrame:
    """Refund per payer: cases 2, 7 and 8, each dropped where its own test sum is zero."""
    case = diff_case()
    b, f = F.col("b_amount"), F.col("f_amount")
    per_case = (
        diff.withColumn("case_no", case).filter(F.col("case_no").isin(2, 7, 8))
        .groupBy("uid", "case_no")
        .agg(
            F.sum(F.when(case == 8, b - f).when(case == 7, b - F.col("discount")).otherwise(b)).alias("amount"),
            F.sum(F.when(case == 8, b - f).otherwise(b)).alias("test"),
        )
        .filter(F.col("test") != 0)
    )
    return per_case.groupBy("uid").agg(F.sum("amount").cast(MONEY).alias("refund"))


def _keys(diff: DataFrame, *cases: int) -> DataFrame:
    return diff.filter(diff_case().isin(*cases)).select(*BILL_KEY).distinct()


def aligned(rows: DataFrame, like: DataFrame) -> DataFrame:
    """`rows` with the columns and types of `like`; missing columns are NULL."""
    have = set(rows.columns)
    return rows.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in like.schema.fields
    ])


def apply_bills(bill: DataFrame, diff: DataFrame, batch_dtm: dt.datetime) -> DataFrame:
    """Open bills after cases 1, 3, 6 and 7."""
    stamp = F.lit(batch_dtm)
    changed = (
        diff.filter(diff_case() == 6)
        .groupBy(*BILL_KEY)
        .agg(F.max("f_amount").alias("_amount"), F.max("due_dtm").alias("_due"))
    )
    left = bill.join(_keys(diff, 1), BILL_KEY, "left_anti").join(changed, BILL_KEY, "left")
    hit = F.col("_amount").isNotNull()
    updated = left.withColumns({
        "amount": F.coalesce("_amount", "amount"),
        "due_dtm": F.coalesce("_due", "due_dtm"),
        **({"create_dtm": F.when(hit, stamp).otherwise(F.col("create_dtm"))} if "create_dtm" in bill.columns else {}),
    })
    inserted = diff.filter(diff_case().isin(3, 7)).select(
        *BILL_KEY, F.lit(1).alias("bill_type"), stamp.alias("create_dtm"), F.col("f_amount").alias("amount"),
        "discount", "bill_start", "bill_end", "due_dtm",
    )
    return aligned(updated, bill).unionByName(aligned(inserted, bill))


def apply_archive(bill_archive: DataFrame, diff: DataFrame) -> DataFrame:
    """Archived bills after cases 2, 7 and 8."""
    lowered = diff.filter(diff_case() == 8).groupBy(*BILL_KEY).agg(F.max("f_amount").alias("_amount"))
    left = (
        bill_archive.join(_keys(diff, 2, 7), BILL_KEY, "left_anti")
        .join(lowered, BILL_KEY, "left")
        .withColumn("amount", F.coalesce("_amount", "amount"))
    )
    return aligned(left, bill_archive)


def apply_refunds(customer: DataFrame, diff: DataFrame) -> DataFrame:
    """Customers with refunds added to their balance."""
    credited = customer.join(refunds(diff), F.col("id") == F.col("uid"), "left").withColumn(
        "balance", F.col("balance") + F.coalesce("refund", F.lit(0).cast(MONEY))
    )
    return aligned(credited, customer)


def apply_bill_diff(state: BillState, diff: DataFrame, batch_dtm: dt.datetime) -> BillState:
    """The three tables after all cases; the inputs stay as they are (dry run: do not call)."""
    return BillState(
        apply_bills(state.bill, diff, batch_dtm),
        apply_archive(state.bill_archive, diff),
        apply_refunds(state.customer, diff),
    )
