"""Monthly bills: months per service, proration by plan, roll-up per license."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions.calendar import (
    billing_span,
    month_key,
    months_between_first,
    weekday_hits,
    yrmo,
)

BILL_KEY = ["company", "ix_yrmo", "uid", "cd_license"]


def service_months(services: DataFrame, low: Column, high: Column) -> DataFrame:
    """One row per service and month it touches within [low, high] (first days).

    `batch_start`/`batch_end` bound the month, `bill_start`/`bill_end` the served part.
    """
    touched = services.filter(
        (F.col("start_dtm") <= F.last_day(high))
        & (F.col("end_dtm").isNull() | (F.col("end_dtm") >= low))
        & (F.col("end_dtm").isNull() | (F.trunc("end_dtm", "month") >= F.trunc("start_dtm", "month")))
    )
    months = touched.withColumn(
        "batch_start", F.explode(months_between_first(F.col("start_dtm"), F.col("end_dtm"), low, high))
    )
    batch_end = F.last_day("batch_start")
    return months.select(
        "*",
        yrmo(F.col("batch_start")).alias("ix_yrmo"),
        batch_end.alias("batch_end"),
        F.greatest("batch_start", "start_dtm").alias("bill_start"),
        F.least(batch_end, F.coalesce("end_dtm", batch_end)).alias("bill_end"),
    )


def prorated_fee() -> Column:
    """Fee of one service-month: A and B by day, C by visit, every other plan in full."""
    by_day = F.datediff("bill_end", "bill_start") + 1
    visits = weekday_hits(F.col("weekday1"), F.col("bill_start"), F.col("bill_end"))
    month_visits = weekday_hits(F.col("weekday1"), F.col("batch_start"), F.col("batch_end"))
    plan = F.col("srv_plan")
    served = F.when(plan.isin("A", "B"), by_day).when(plan == "C", visits).otherwise(1)
    whole = (
        F.when(plan.isin("A", "B"), F.dayofmonth("batch_end")).when(plan == "C", month_visits).otherwise(1)
    )
    ratio = F.when(whole == 0, F.lit(0)).otherwise(F.col("fee") * served / whole)
    return F.round(ratio, 2).cast("decimal(15,2)")


def bill_totals(months: DataFrame, *more: Column) -> DataFrame:
    """Roll service-months up to one bill per company, month, payer and license; `more` are further aggregates."""
    return (
        months.withColumn("uid", F.col("owner_id"))
        .withColumn("_fee", prorated_fee())
        .groupBy(*BILL_KEY)
        .agg(
            (F.max("extra_fee") + F.round(F.sum("_fee"), 0)).cast("decimal(15,2)").alias("amount"),
            F.min("bill_start").alias("bill_start"),
            F.max("bill_end").alias("bill_end"),
            F.min("batch_start").alias("batch_start"),
            *more,
        )
    )


def with_due_date(totals: DataFrame, payers: DataFrame) -> DataFrame:
    """Keep bills of known payers; month-end payers get one more month to pay."""
    month_end = F.last_day("batch_start")
    due = F.when(F.col("is_mobill"), F.last_day(F.date_add(month_end, 1))).otherwise(month_end)
    billed = totals.join(payers.select(F.col("id").alias("uid"), "is_mobill"), "uid")
    return billed.select(*BILL_KEY, "amount", "bill_start", "bill_end", due.alias("due_dtm"))


def unbilled_payers(
    customer: DataFrame, bill: DataFrame, bill_archive: DataFrame, sd: dt.date, ed: dt.date
) -> DataFrame:
    """Customers with neither an open nor an archived bill in the billing months."""
    first, last = billing_span(sd, ed)
    in_span = F.col("ix_yrmo").between(month_key(first), month_key(last))
    billed = (
        bill.filter(in_span).select("uid").unionByName(bill_archive.filter(in_span).select("uid")).distinct()
    )
    return customer.join(billed, F.col("id") == F.col("uid"), "left_anti")


def calc_bills(
    services: DataFrame, payers: DataFrame, sd: dt.date, ed: dt.date, uid: int | None = None
) -> DataFrame:
    """Monthly bills of the payers (all customers, or the result of `unbilled_payers`).

    Columns: company, ix_yrmo, uid, cd_license, amount, bill_start, bill_end, due_dtm.
    """
    first, last = billing_span(sd, ed)
    if uid is not None:
        services = services.filter(F.col("owner_id") == uid)
        payers = payers.filter(F.col("id") == uid)
    months = service_months(services, F.lit(first), F.lit(last))
    return with_due_date(bill_totals(months), payers)
