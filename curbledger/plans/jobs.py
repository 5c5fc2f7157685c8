"""Write jobs: compute on the published tables, then publish the parts that change at once.

An error leaves the tables as they are and adds a row to the error log.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbledger.functions.calendar import key_month, month_last
from curbledger.operators import billing, reconcile, replay, settlement
from curbledger.session import durable
from curbledger.sources.schemas import BUCKETS
from curbledger.sources.tables import Change, Snapshot, append_error, publish


class SettlementFailed(RuntimeError):
    """A payment job did not go through; the tables are unchanged."""


def _buckets(uids: DataFrame) -> tuple[int, ...]:
    """Parts of the customer table that hold the payers."""
    return tuple(sorted(r.b for r in uids.select(F.pmod("uid", F.lit(BUCKETS)).cast("int").alias("b")).filter("b IS NOT NULL").distinct().collect()))


def recalc_bills(
    spark: SparkSession, root: str, ix_yrmo: int, version: str, now: dt.datetime,
    uid: int | None = None, dry_run: bool = False,
) -> DataFrame | None:
    """Reconcile one month, whose bills alone are read and written, with the payers that get a refund.

    Returns the differences, or None after a logged error.
    """
    try:
        tables = Snapshot(spark, root)
        services, customer = tables.read("vehicle_service"), tables.read("customer")
        bill, archive = tables.read("bill", [ix_yrmo]), tables.read("bill_archive", [ix_yrmo])
        sd = key_month(ix_yrmo)
        payers = billing.unbilled_payers(customer, bill, archive, sd, month_last(sd)) if uid == -1 else customer
        computed = billing.calc_bills(services, payers, sd, month_last(sd), None if uid == -1 else uid)
        diff = durable(reconcile.bill_diff(bill, archive, computed, ix_yrmo, uid))
        cases = {r.case_no for r in reconcile.case_counts(diff).collect()}
        if dry_run or not cases:
            return diff
        buckets = _buckets(reconcile.refunds(diff)) if cases & {2, 7, 8} else ()
        state = reconcile.apply_bill_diff(reconcile.BillState(bill, archive, tables.read("customer", buckets)), diff, now)
        changes = {}
        if cases & {1, 3, 6, 7}:
            changes["bill"] = Change(state.bill, (ix_yrmo,))
        if cases & {2, 7, 8}:
            changes["bill_archive"] = Change(state.bill_archive, (ix_yrmo,))
        if buckets:
            changes["customer"] = Change(state.customer, buckets)
        publish(changes, root, version, now)
        return diff
    except Exception as error:
        append_error(spark, root, "recalc_bills", str(error), now)
        return None


def _publish_settled(
    done: settlement.Settlement, rejected: DataFrame, payers: DataFrame, member: str, root: str, version: str, now: dt.datetime
) -> DataFrame:
    """The payment rows, after one publication of all that the payments change and of those that were rejected."""
    months = tuple(sorted(r.ix_yrmo for r in done.months.distinct().collect()))
    rows = durable(done.payment)
    stamped = rows.withColumn("mod_by", F.col("create_by")) if "create_by" in rows.columns else rows
    errors = rejected.select(
        F.lit(now).alias("create_dtm"), F.lit("SPARK_JOB").alias("caller_class"), F.lit(member).alias("caller_member"),
        F.concat(F.lit("payment of "), F.coalesce(F.col("uid").cast("string"), F.lit("nobody")), F.lit(": "), F.col("reason")).alias("msg"))
    publish({
        "bill": Change(done.bill, months), "bill_archive": Change(done.bill_archive, months), "customer": Change(done.customer, _buckets(payers)),
        "payment": Change(stamped, added=True), "audit_error": Change(errors, added=True),
    }, root, version, now)
    return rows


def process_payments(
    spark: SparkSession, root: str, requests: DataFrame, version: str, now: dt.datetime, dry_run: bool = False
) -> DataFrame:
    """Settle one payment of each payer.  Returns the payment rows, or in a dry run the candidate months per payer.

    Payments that cannot be settled go to the error log; the others are published with it, at once.
    """
    try:
        tables = Snapshot(spark, root)
        bill, archive, services = tables.read("bill"), tables.read("bill_archive"), tables.read("vehicle_service")
        if dry_run:
            return settlement.month_probes(requests, bill, archive, services)
        customer, account = tables.read("customer"), tables.read("account")
        good, rejected = settlement.checked(requests, customer, account)
        done = settlement.settle(good, bill, archive, tables.read("payment"), customer, services, account, now)
        return _publish_settled(done, rejected, good, "process_payments", root, version, now)
    except Exception as error:
        append_error(spark, root, "process_payments", str(error), now)
        raise SettlementFailed(str(error)) from error


def process_all_payments(
    spark: SparkSession, root: str, requests: DataFrame, arrival: str, version: str, now: dt.datetime
) -> DataFrame:
    """Settle payments of which a payer may have several, in the order of `arrival`: one pass, one publication.

    Returns the payment rows.  Payments that cannot be settled go to the error log.
    """
    try:
        tables = Snapshot(spark, root)
        customer, account = tables.read("customer"), tables.read("account")
        good, rejected = settlement.checked(requests, customer, account)
        done = replay.settle_all(good, arrival, tables.read("bill"), tables.read("bill_archive"), tables.read("payment"), customer,
                                 tables.read("vehicle_service"), account, now)
        return _publish_settled(done, rejected, good, "process_all_payments", root, version, now)
    except Exception as error:
        append_error(spark, root, "process_all_payments", str(error), now)
        raise SettlementFailed(str(error)) from error
