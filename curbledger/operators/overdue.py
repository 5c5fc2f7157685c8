"""Overdue bills with severity, contact channels and the latest service."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.functions.calendar import first_of, month_first, month_gap, month_key, shift_month

REFERENCE_DAY = 22

# Contact type codes of the four billing channels.
CHANNELS = {1: "is_whatsapp", 2: "is_email", 3: "is_mail", 4: "is_fax"}

BILL_COLUMNS = [
    "company", "ix_yrmo", "uid", "cd_license", "bill_type", "create_dtm", "amount", "discount",
    "bill_start", "bill_end", "due_dtm",
]


def reference_month(as_of: dt.date) -> dt.date:
    """First day of the month that counts: the previous one before the 22nd."""
    return month_first(as_of) if as_of.day >= REFERENCE_DAY else shift_month(as_of, -1)


def contact_flags(contact: DataFrame) -> DataFrame:
    """One row per payer with a flag per billing channel."""
    wanted = contact.filter(F.col("c_type").isin(*CHANNELS))
    return wanted.groupBy("uid").agg(*[F.max(F.col("c_type") == k).alias(name) for k, name in CHANNELS.items()])


def due_bills(bill: DataFrame, account: DataFrame, customer: DataFrame, as_of: dt.date) -> DataFrame:
    """Bills up to the reference month, and next month's of payers who pay in month.

    `d_diff` is the age in months.
    """
    month = reference_month(as_of)
    following = month_key(shift_month(month, 1))
    payer = customer.select(
        F.col("id").alias("uid"), "is_mobill", "is_print_bill", "is_rtn_envelope", "balance"
    ).join(account.select(F.col("id").alias("uid"), F.col("display_name").alias("cust_name")), "uid")
    due = bill.filter(F.col("ix_yrmo") <= following).join(payer, "uid")
    return due.filter((F.col("ix_yrmo") < following) | ~F.col("is_mobill")).withColumn(
        "d_diff", month_gap(first_of(F.col("ix_yrmo")), F.lit(month))
    )


def due_level(due: DataFrame) -> DataFrame:
    """Severity 0, 1 or 2 per payer and license, from the oldest bill."""
    oldest = due.groupBy("uid", "cd_license").agg(F.max("d_diff").alias("_age"))
    return oldest.select(
        "uid", "cd_license", F.least(F.lit(2), F.greatest(F.lit(0), F.col("_age"))).cast("int").alias("due_lv")
    )


def latest_service(services: DataFrame) -> DataFrame:
    """Place and plan of the latest service per owner and license."""
    newest = services.groupBy(F.col("owner_id").alias("uid"), "cd_license").agg(
        F.max(F.struct("start_dtm", "srv_dis", "srv_loc", "srv_plan", "srv_floor", "srv_psn")).alias("s")
    )
    return newest.select(
        "uid", "cd_license", "s.srv_dis", "s.srv_loc", "s.srv_plan",
        F.trim(F.concat(F.coalesce("s.srv_floor", F.lit("")), F.lit(" "), F.coalesce("s.srv_psn", F.lit("")))).alias("loc_psn"),
    )


def overdue_bills(
    bill: DataFrame,
    account: DataFrame,
    customer: DataFrame,
    contact: DataFrame,
    services: DataFrame,
    location: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """Due bills with severity; bills whose license never had a service drop out."""
    due = due_bills(bill, account, customer, as_of)
    level = due_level(due)
    vehicles = level.groupBy("uid").agg(F.count(F.lit(1)).cast("int").alias("cvc"))
    plates = level.join(latest_service(services), ["uid", "cd_license"])
    payers = vehicles.join(contact_flags(contact), "uid", "left")
    place = location.select("srv_dis", "srv_loc", "mgt_dis", "name_zh")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    loc_key = F.concat(
        text("srv_dis"), text("srv_loc"), F.lit(" ("), text("mgt_dis"), F.lit(") - "), text("name_zh")
    )
    full = due.join(plates, ["uid", "cd_license"]).join(place, ["srv_dis", "srv_loc"]).join(payers, "uid")
    return full.select(
        "due_lv", *[c for c in BILL_COLUMNS if c in bill.columns],
        "cust_name", "is_mobill", "is_print_bill", "is_rtn_envelope", "balance",
        *[flag(name) for name in CHANNELS.values()],
        "srv_dis", "srv_loc", "srv_plan", "loc_psn", "mgt_dis", loc_key.alias("loc_key"), "cvc",
    )
