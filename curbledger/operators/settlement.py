"""Settle payments against the oldest bills, many payers at once.

A wave holds at most one payment per payer; `waves` numbers payments so that a
payer's payments run one after another while all payers of a wave run together.
Within a wave every step is a join, an aggregation or a distributed running sum.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import lists, ordered
from curbledger.functions.calendar import first_of, month_key, month_last, shift_month, yrmo
from curbledger.operators.billing import BILL_KEY, bill_totals, service_months, with_due_date
from curbledger.operators.reconcile import MONEY, aligned, apply_archive, apply_bills, diff_bills, stored_bills
from curbledger.session import durable, near

NO_BILL = "*BALANCE(CR)*"  # fixed value: license text of a payment that settled no bill
FIRST_MONTHS, MOST_MONTHS = 12, 96


class Settlement(NamedTuple):
    bill: DataFrame
    bill_archive: DataFrame
    customer: DataFrame
    payment: DataFrame
    paid: DataFrame
    months: DataFrame  # ix_yrmo: months whose open or archived bills may have changed


def checked(requests: DataFrame, customer: DataFrame, account: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that can be settled, and the others with `reason`; nothing raises an error here.

    A payment needs a payer with an account and a customer row that has a balance, a payment type, and an amount that fits
    the money type alone and with the balance.
    """
    known = account.select(F.col("id").alias("uid"), F.lit(True).alias("_account")).distinct()
    have = customer.groupBy(F.col("id").alias("uid")).agg(F.max("balance").alias("_balance"))
    money = F.col("amount").try_cast(MONEY)
    total = F.try_add(F.abs(money).cast("decimal(25,2)"), F.abs(F.col("_balance")).cast("decimal(25,2)")).try_cast(MONEY)
    reason = (
        F.when(F.col("uid").isNull(), "no payer").when(F.col("_account").isNull(), "unknown account")
        .when(F.col("_balance").isNull(), "unknown payer").when(F.col("payment_type").isNull(), "no payment type")
        .when(F.col("amount").isNull(), "no amount").when(money.isNull() | total.isNull(), "amount out of range")
    )
    judged = durable(requests.join(known, "uid", "left").join(have, "uid", "left").withColumn("reason", reason).drop("_account", "_balance"))
    good = judged.filter("reason IS NULL").drop("reason").withColumn("amount", F.col("amount").cast(MONEY))
    return good.select(*requests.columns), judged.filter("reason IS NOT NULL")


def waves(requests: DataFrame, arrival: str) -> DataFrame:
    """Wave number per payment: 1 for a payer's first, by arrival, then by its other columns."""
    rest = [c for c, kind in requests.dtypes if c not in ("uid", arrival) and not kind.startswith("map")]
    return ordered.row_number(requests, ["uid"], [arrival, *rest], "wave")


def next_sequence(payment: DataFrame, ix_yrmo: int) -> DataFrame:
    """Highest sequence number per payer in the month, plus one."""
    return (
        payment.filter(F.col("ix_yrmo") == ix_yrmo).groupBy("uid")
        .agg((F.max("useq") + 1).cast("int").alias("useq"))
    )


def qualify(requests: DataFrame, customer: DataFrame) -> DataFrame:
    """Requests with the money at hand: balance plus payment.

    A payer without a customer row has no money to settle with (NULL), but keeps the request.
    """
    have = customer.select(F.col("id").alias("uid"), "balance")
    return requests.join(have, "uid", "left").withColumn(
        "qualified", (F.col("balance") + F.col("amount")).cast(MONEY)
    )


def _per_payer(requests: DataFrame, facts: DataFrame, value: Column, name: str) -> DataFrame:
    """Aggregate facts per (uid, cd_license) first, then over what each request asks for."""
    wanted = requests.select("uid", F.col("cd_license").alias("_only"))
    slim = facts.groupBy("uid", "cd_license").agg(value.alias(name))
    return slim.join(wanted, "uid").filter(F.col("_only").isNull() | (F.col("_only") == F.col("cd_license")))


def month_probes(
    requests: DataFrame, bill: DataFrame, bill_archive: DataFrame, services: DataFrame
) -> DataFrame:
    """The three candidate months per request: oldest open bill, month after the
    newest archived bill, month of the newest service start."""
    open_ = _per_payer(requests, bill, F.min("ix_yrmo"), "ix").groupBy("uid").agg(F.min("ix").alias("bill_ix"))
    done = _per_payer(requests, bill_archive, F.max("ix_yrmo"), "ix").groupBy("uid").agg(F.max("ix").alias("ix"))
    done = done.select("uid", yrmo(F.add_months(first_of(F.col("ix")), 1)).alias("archive_ix"))
    served = services.select(F.col("owner_id").alias("uid"), "cd_license", "start_dtm")
    start = _per_payer(requests, served, F.max("start_dtm"), "d").groupBy("uid").agg(F.max("d").alias("d"))
    start = start.select("uid", yrmo(F.col("d")).alias("service_ix"))
    return (
        requests.select("uid").join(open_, "uid", "left").join(done, "uid", "left").join(start, "uid", "left")
    )


def start_month(probes: DataFrame) -> DataFrame:
    """First month to bill forward: the latest of the candidates (NULL if none)."""
    return probes.select("uid", F.greatest("bill_ix", "archive_ix", "service_ix").cast("int").alias("start_ix"))


def _open_after(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Amount still to pay per computed bill as it will be after reconciliation, with the other columns of `computed`.

    Computed bills are unique per key: one join tells changed bills and new ones, and reads each side once.
    """
    f = computed.withColumnRenamed("amount", "f_amount")
    old = stored.select(*BILL_KEY, "paid", "amount", "discount")
    extra = [c for c in f.columns if c not in (*BILL_KEY, "f_amount")]
    return (
        f.join(old, BILL_KEY, "left")
        .filter(F.col("paid").isNull() | (F.col("paid") == 0) | (F.col("f_amount") > F.col("amount")))
        .select(*BILL_KEY, *extra, F.when(F.col("paid").isNull(), F.col("f_amount")).otherwise(F.col("f_amount") - F.col("discount")).alias("net"))
    )


def _spend(nets: Column, fund: Column) -> Column:
    """Replay of the month loop: bill month after month while whole money is left and
    the last month was not empty.  The fund loses its cents at every step."""
    start = F.struct(
        fund.alias("fund"), F.lit(-1).cast("decimal(25,2)").alias("net"), F.lit(0).alias("months")
    )

    def step(state: Column, net: Column) -> Column:
        more = F.struct(
            (state["fund"] - net).cast("int").alias("fund"),
            net.cast("decimal(25,2)").alias("net"),
            (state["months"] + 1).alias("months"),
        )
        return F.when((state["fund"] > 0) & (state["net"] != 0), more).otherwise(state)

    return F.aggregate(nets, start, step)


def forward_billing(
    requests: DataFrame,
    bill: DataFrame,
    bill_archive: DataFrame,
    services: DataFrame,
    customer: DataFrame,
    first_months: int = FIRST_MONTHS,
) -> DataFrame:
    """Months to reconcile per payer before settling: uid, ix_yrmo.

    `requests` has uid, cd_license, qualified, start_ix.  The first round bills
    `first_months` months; each later one twice as many, for the payers whose money is
    not used up.  Rounds go on until no payer is left, so no payer is cut off.
    """
    state = requests.filter(F.col("start_ix").isNotNull()).select(
        "uid", F.col("cd_license").alias("only"), F.col("qualified").cast("int").alias("fund"),
        first_of(F.col("start_ix")).alias("month"),
    ).filter(F.col("fund") > 0)
    payers = customer.groupBy(F.col("id").alias("uid")).agg(F.count(F.lit(1)).alias("_known"))
    state = durable(state.join(payers, "uid", "left").fillna(0, ["_known"]))
    visited = [state.select("uid", F.lit(0).alias("ix_yrmo")).filter(F.lit(False))]
    h = first_months
    while True:
        # one row: the months of this round as plain bounds, which reach the scans
        left, low, last = state.agg(F.count(F.lit(1)), F.min("month"), F.max("month")).first()
        if not left:
            break
        high = shift_month(last, h - 1)
        within = F.col("ix_yrmo").between(month_key(low), month_key(high))
        served = (F.col("start_dtm") <= F.lit(month_last(high))) & (F.col("end_dtm").isNull() | (F.col("end_dtm") >= F.lit(low)))
        nets = _round_nets(state, left, bill.filter(within), bill_archive.filter(within), services.filter(served), h)
        by_order = F.transform(
            F.sequence(F.lit(0), F.lit(h - 1)),
            lambda i: F.coalesce(
                F.try_element_at(F.col("by_month"), yrmo(F.add_months(F.col("month"), i))), F.lit(0)
            ).cast("decimal(25,2)"),
        )
        played = durable(
            state.join(nets, "uid", "left")
            .select("uid", "only", "month", "_known", _spend(by_order, F.col("fund")).alias("end"))
        )
        steps = F.explode(F.sequence(F.lit(0), F.col("end.months") - 1))
        visited.append(
            played.filter(F.col("end.months") > 0).select("uid", "month", steps.alias("_i"))
            .select("uid", yrmo(F.add_months("month", F.col("_i"))).alias("ix_yrmo"))
        )
        more = (F.col("end.months") == h) & (F.col("end.fund") > 0) & (F.col("end.net") != 0)
        state = played.filter(more).select(
            "uid", "only", F.col("end.fund").alias("fund"), F.add_months("month", h).alias("month"), "_known"
        )
        h = min(2 * h, MOST_MONTHS)
    return reduce(DataFrame.unionByName, visited)


def _round_nets(
    state: DataFrame, rows: int, bill: DataFrame, bill_archive: DataFrame, services: DataFrame, h: int
) -> DataFrame:
    """Amount to pay per payer and month of the round, as a map of at most `h` months.

    What a payer asks for (all licenses or one) goes with the payer's row, so licenses that nobody
    asks for are left out before months are made, and nothing has to meet the payer again.
    """
    wants = state.groupBy("uid").agg(F.count_if(F.col("only").isNull()).alias("_all"), F.collect_list("only").alias("_only"))
    span = near(state.join(wants, "uid").select(
        "uid", F.col("month").alias("low"), F.add_months("month", h - 1).alias("high"), "_all", "_only", "_known"), rows)
    asked = F.col("_all") + F.size(F.filter("_only", lambda x: x == F.col("cd_license")))
    own = services.join(span.withColumnRenamed("uid", "owner_id"), "owner_id").withColumn("_times", asked * F.col("_known")).filter("_times > 0")
    months = service_months(own.drop("_all", "_only", "_known"), F.col("low"), F.col("high"))
    computed = bill_totals(months, F.max("_times").alias("_times")).select(*BILL_KEY, "amount", "_times")
    window = span.select("uid", yrmo(F.col("low")).alias("_from"), yrmo(F.col("high")).alias("_to"), "_all", "_only")
    stored = (
        stored_bills(bill, bill_archive).join(window, "uid")
        .filter(F.col("ix_yrmo").between(F.col("_from"), F.col("_to")) & (asked > 0))
    )
    monthly = _open_after(stored, computed).groupBy("uid", "ix_yrmo").agg(
        F.sum(F.col("net") * F.col("_times")).cast("decimal(25,2)").alias("net"))
    return monthly.groupBy("uid").agg(
        F.map_from_entries(F.collect_list(F.struct("ix_yrmo", "net"))).alias("by_month")
    )


def reconcile_months(
    visited: DataFrame,
    bill: DataFrame,
    bill_archive: DataFrame,
    services: DataFrame,
    customer: DataFrame,
    batch_dtm: dt.datetime,
) -> tuple[DataFrame, DataFrame]:
    """Open and archived bills after reconciling each visited payer-month.

    Refunds are left out: the final balance replaces them.
    """
    visited = visited.select("uid", "ix_yrmo")
    spans = visited.groupBy(F.col("uid").alias("owner_id")).agg(
        first_of(F.min("ix_yrmo")).alias("low"), first_of(F.max("ix_yrmo")).alias("high")
    )
    months = service_months(services.join(spans, "owner_id"), F.col("low"), F.col("high"))
    computed = with_due_date(bill_totals(months), customer.select("id", "is_mobill"))
    stored = stored_bills(bill, bill_archive).join(visited, ["uid", "ix_yrmo"], "left_semi")
    diff = durable(diff_bills(stored, computed))
    return apply_bills(bill, diff, batch_dtm), apply_archive(bill_archive, diff)


def affordable(bill: DataFrame, requests: DataFrame) -> DataFrame:
    """Bills a payment covers: running total, oldest first, within the money at hand.

    A license picks its own bills, else the company does.  Bills equal in month, amount
    and license are taken or left together, so they are merged before the running sum.
    """
    asked = requests.select(
        "uid", F.col("company").alias("_company"), F.col("cd_license").alias("_only"), "qualified"
    )
    own = bill.join(asked, "uid").filter(
        F.when(F.col("_only").isNull(), F.col("company") == F.col("_company"))
        .otherwise(F.col("cd_license") == F.col("_only"))
    )
    own = durable(own.withColumn("net", (F.col("amount") - F.col("discount")).cast("decimal(25,2)")))
    peer = ["ix_yrmo", "net", "cd_license"]
    steps = own.groupBy("uid", *peer).agg(F.sum("net").cast("decimal(25,2)").alias("_step"))
    cut = ordered.running_sum(steps, ["uid"], peer, "_step", "cumulative_amount").drop("_step")
    return (
        own.join(cut, ["uid", *peer])
        .filter(F.col("cumulative_amount") <= F.col("qualified"))
        .drop("_company", "_only", "qualified")
    )


def settled_per_payer(paid: DataFrame) -> DataFrame:
    return paid.groupBy("uid").agg(F.sum("net").cast(MONEY).alias("settled"), F.min("company").alias("paid_company"))


def new_balance(requests: DataFrame, settled: DataFrame) -> DataFrame:
    """Balance per payer after the payment (NULL without a customer row)."""
    zero = F.lit(0).cast(MONEY)
    return requests.join(settled, "uid", "left").select(
        "uid", "qualified", F.coalesce("settled", zero).alias("settled"),
        (F.col("qualified") - F.coalesce("settled", zero)).cast(MONEY).alias("balance"),
    )


def payment_rows(
    requests: DataFrame,
    paid: DataFrame,
    settled: DataFrame,
    sequence: DataFrame,
    services: DataFrame,
    account: DataFrame,
    ix_yrmo: int,
    limit: int | None = lists.PART_BYTES,
) -> DataFrame:
    """Payment records: settled licenses as text, and the company they belong to.

    Company: of the settled bills (the smallest if several), else of the latest service
    under the requested license, else the requested one.  A payment whose
    licenses are more than `limit` bytes has further rows with part > 0 and amount 0.
    """
    plates = paid.select("uid", "cd_license").distinct()
    texts = (
        lists.place(plates, ["uid"], ["cd_license"], "cd_license", limit).groupBy("uid", "part")
        .agg(lists.sorted_text(F.col("cd_license"), ",").alias("licenses"))
    )
    last = services.groupBy(F.col("owner_id").alias("uid"), F.col("cd_license")).agg(
        F.max(F.struct("start_dtm", "company"))["company"].alias("last_company")
    )
    head = (
        requests.join(settled, "uid", "left").join(last, ["uid", "cd_license"], "left")
        .join(sequence, "uid", "left")
        .join(account.select(F.col("id").alias("uid"), F.col("display_name").alias("cust_name")), "uid", "left")
    )
    part = F.coalesce("part", F.lit(0))
    extra = [c for c in ("ref_code", "transfer_dtm", "remarks", "create_by") if c in requests.columns]
    return head.join(texts, "uid", "left").select(
        F.coalesce("paid_company", "last_company", "company").alias("company"),
        F.lit(ix_yrmo).alias("ix_yrmo"), "uid", F.coalesce("useq", F.lit(1)).cast("int").alias("useq"),
        part.alias("part"), F.coalesce("licenses", F.lit(NO_BILL)).alias("cd_license"), "cust_name",
        F.when(part == 0, F.col("amount")).otherwise(F.lit(0)).cast(MONEY).alias("amount"), "payment_type", *extra,
    )


def settle(
    requests: DataFrame,
    bill: DataFrame,
    bill_archive: DataFrame,
    payment: DataFrame,
    customer: DataFrame,
    services: DataFrame,
    account: DataFrame,
    now: dt.datetime,
    visited: DataFrame | None = None,
) -> Settlement:
    """One wave of payments: tables afterwards, the payment records, and the paid bills.

    `requests`: uid, company, cd_license (NULL for all), amount, payment_type; one row per payer.
    `visited` is the result of `forward_billing` for the same requests, if it is known.
    """
    ix = month_key(now.date())
    asked = qualify(requests, customer)
    starts = start_month(month_probes(requests, bill, bill_archive, services))
    asked = durable(asked.join(starts, "uid", "left"))
    if visited is None:
        visited = durable(forward_billing(asked, bill, bill_archive, services, customer))
    open_bills, archived = reconcile_months(visited, bill, bill_archive, services, customer, now)
    paid = durable(affordable(open_bills, asked))
    sequence = next_sequence(payment, ix)
    settled = settled_per_payer(paid)

    tagged = paid.join(sequence, "uid", "left").withColumns({
        "iv_ix": F.lit(ix), "iv_seq": F.coalesce("useq", F.lit(1)),
    })
    archive_after = archived.unionByName(aligned(tagged, archived))
    # auto-made bills of a settled key leave the open table; others stay (they are archived too)
    gone = paid.select(*BILL_KEY).distinct().withColumn("bill_type", F.lit(1))
    bill_after = open_bills.join(gone, [*BILL_KEY, "bill_type"], "left_anti")
    after = new_balance(asked, settled).select(F.col("uid").alias("id"), F.col("balance").alias("_balance"))
    customer_after = aligned(
        customer.join(after, "id", "left").withColumns({
            "balance": F.coalesce("_balance", "balance"),
            "last_payment": F.when(F.col("_balance").isNotNull(), F.lit(now)).otherwise(F.col("last_payment")),
        }),
        customer,
    )
    rows = payment_rows(asked, paid, settled, sequence, services, account, ix)
    months = visited.select("ix_yrmo").unionByName(paid.select("ix_yrmo")).distinct()
    return Settlement(bill_after.select(*bill.columns), archive_after, customer_after, rows, paid, months)
