"""All payments of a payer in one pass.

A payer's payments, open bills, archived bills and computed bills meet in one place, sorted, and the
payments are replayed over them with the balance carried along; payers run side by side.  The computed
bills cover a window of months; payers whose money reaches beyond it are replayed again over a larger
one, so the number of rounds grows with the logarithm of the months.  Payers with very many bills are
not gathered: they go payment after payment through the distributed steps of `settlement.settle`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbledger.functions.calendar import first_of, month_key, yrmo
from curbledger.operators.billing import BILL_KEY, bill_totals, service_months, with_due_date
from curbledger.operators.reconcile import aligned
from curbledger.operators.settlement import FIRST_MONTHS, MOST_MONTHS, NO_BILL, Settlement, next_sequence, settle, waves
from curbledger.session import durable, near, stored

GATHERED = 100_000  # bills and payments of a payer that are replayed in one place
HEAD, PAYMENT, ARCHIVED_TO, SERVED_FROM, COMPUTED, ARCHIVE, BILL = range(7)  # kinds of rows, in the order of reading
MONTH, BEYOND, PAID = 7, 8, 9                                               # kinds of rows that only come back
_FACTS = "uid long, kind int, place int, company string, ix_yrmo int, cd_license string, amount decimal(25,2), until int, text string"


def _after(ix: int) -> int:
    return ix + 89 if ix % 100 == 12 else ix + 1


class Payer:
    """One payer while its payments are replayed."""

    def __init__(self, head: dict, now: dt.datetime) -> None:
        self.balance, self.useq, self.low, self.high, self.now = head["amount"], head["place"], head["ix_yrmo"], head["until"], now
        self.bills: list[dict] = []
        self.archive: list[dict] = []
        self.archived_to: dict[str, int] = {}           # newest archived month by license
        self.served: dict[str, tuple[int, str]] = {}    # newest service start and its company by license
        self.computed: dict[int, dict[tuple, dict]] = {}
        self.months: set[int] = set()
        self.out: list[dict] = []

    def take(self, row: dict) -> None:
        kind, own = row["kind"], row["row"]
        if kind == ARCHIVED_TO:
            self.archived_to[row["cd_license"]] = row["ix_yrmo"]
        elif kind == SERVED_FROM:
            self.served[row["cd_license"]] = row["ix_yrmo"], row["company"]
        elif kind == COMPUTED:
            self.computed.setdefault(own["ix_yrmo"], {})[own["company"], own["cd_license"]] = own
        elif kind == ARCHIVE:
            self.archive.append(own)
        else:
            self.bills.append(own)

    def first_month(self, only: str | None) -> int | None:
        """The latest of: oldest open bill, month after the newest archived one, newest service start."""
        mine = lambda license_: only is None or license_ == only
        open_ = [b["ix_yrmo"] for b in self.bills if mine(b["cd_license"])]
        done = [ix for c, ix in self.archived_to.items() if mine(c)] + [a["ix_yrmo"] for a in self.archive if mine(a["cd_license"])]
        starts = [ix for c, (ix, _) in self.served.items() if mine(c)]
        return max([*([min(open_)] if open_ else []), *([_after(max(done))] if done else []), *([max(starts)] if starts else [])], default=None)

    def stored(self, ix: int) -> list[tuple[bool, dict]]:
        return [(False, b) for b in self.bills if b["ix_yrmo"] == ix] + [(True, a) for a in self.archive if a["ix_yrmo"] == ix]

    def net(self, ix: int, only: str | None) -> Decimal:
        """What the month will cost once it is reconciled."""
        fresh, have = self.computed.get(ix, {}), self.stored(ix)
        known = {(r["company"], r["cd_license"]) for _, r in have}
        due = [(c, f["amount"] - r["discount"]) for paid, r in have for c in [(r["company"], r["cd_license"])]
               if (f := fresh.get(c)) and (not paid or f["amount"] > r["amount"])]
        due += [(c, f["amount"]) for c, f in fresh.items() if c not in known]
        return sum((n for (_, license_), n in due if only is None or license_ == only), Decimal(0))

    def reconcile(self, ix: int) -> None:
        """Open and archived bills of the month as computed; refunds are left out, as the final balance replaces them."""
        fresh, have = self.computed.get(ix, {}), self.stored(ix)
        self.months.add(ix)
        grown, lower, changed = [], set(), set()
        for paid, r in have:
            c = r["company"], r["cd_license"]
            if (f := fresh.get(c)) and f["amount"] != r["amount"]:
                if not paid:
                    changed.add(c)
                elif f["amount"] > r["amount"]:
                    grown.append((c, r))
                else:
                    lower.add(c)
        gone = {c for c, _ in grown}
        made = lambda f, discount: {**dict.fromkeys(f), **{k: f[k] for k in (*BILL_KEY, "bill_start", "bill_end", "due_dtm", "amount")},
                                    "bill_type": 1, "create_dtm": self.now, "discount": discount}
        known = {(r["company"], r["cd_license"]) for _, r in have}
        new = [made(f, Decimal(0)) for c, f in fresh.items() if c not in known] + [made(fresh[c], r["discount"]) for c, r in grown]

        def kept(r: dict, paid: bool) -> dict | None:
            c = r["company"], r["cd_license"]
            if r["ix_yrmo"] != ix:
                return r
            if c not in fresh or (paid and c in gone):
                return None
            if not paid and c in changed:
                return {**r, "amount": fresh[c]["amount"], "due_dtm": fresh[c]["due_dtm"], "create_dtm": self.now}
            return {**r, "amount": fresh[c]["amount"]} if paid and c in lower else r

        self.bills = [x for r in self.bills if (x := kept(r, False))] + new
        self.archive = [x for r in self.archive if (x := kept(r, True))]

    def pay(self, p: dict) -> int | None:
        """One payment; a month that is not in the window, if the money reaches it."""
        only, company = p["cd_license"], p["company"]
        qualified = self.balance + p["amount"]
        ix, fund, cost, visited = self.first_month(only), int(qualified), Decimal(-1), []
        while ix is not None and fund > 0 and cost:
            if not self.low <= ix <= self.high:
                return ix
            cost = self.net(ix, only)
            fund = int(fund - cost)
            visited.append(ix)
            ix = _after(ix)
        for ix in visited:
            self.reconcile(ix)

        steps: dict[tuple, Decimal] = {}
        peer = lambda b: (b["ix_yrmo"], b["amount"] - b["discount"], b["cd_license"])
        own = [b for b in self.bills if (b["company"] == company is not None if only is None else b["cd_license"] == only)]
        for b in own:
            steps[peer(b)] = steps.get(peer(b), Decimal(0)) + peer(b)[1]
        covered, total = set(), Decimal(0)
        for k in sorted(steps):
            total += steps[k]
            if total <= qualified:
                covered.add(k)
        paid = [b for b in own if peer(b) in covered]
        month = month_key(self.now.date())
        tagged = [{**b, "iv_ix": month, "iv_seq": self.useq} for b in paid]
        self.archive += tagged
        self.out += [{"kind": PAID, "row": r} for r in tagged]
        gone = {tuple(b[k] for k in BILL_KEY) for b in paid}
        self.bills = [b for b in self.bills if b["bill_type"] != 1 or tuple(b[k] for k in BILL_KEY) not in gone]
        self.months |= {b["ix_yrmo"] for b in paid}
        self.balance = qualified - sum((peer(b)[1] for b in paid), Decimal(0))
        last = self.served.get(only, (0, None))[1] if only is not None else None
        self.out.append({
            "kind": PAYMENT, "place": self.useq, "until": p["place"], "amount": p["amount"],
            "company": min((b["company"] for b in paid), default=last if last is not None else company),
            "text": ",".join(sorted({b["cd_license"] for b in paid})) or NO_BILL,
        })
        self.useq += 1
        return None

    def rows(self, payments: list[dict]) -> list[dict]:
        for p in payments:
            if (ix := self.pay(p)) is not None:
                return [{"kind": BEYOND, "ix_yrmo": ix}]
        return [*self.out, {"kind": HEAD, "amount": self.balance}, *[{"kind": MONTH, "ix_yrmo": m} for m in sorted(self.months)],
                *[{"kind": BILL, "row": b} for b in self.bills], *[{"kind": ARCHIVE, "row": a} for a in self.archive]]


def _replayed(now: dt.datetime):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid, payer, payments = None, None, []
        arrow = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"uid": uid, **r} for r in payer.rows(payments)], schema=arrow)

        for batch in batches:
            arrow = arrow or batch.schema
            for row in batch.to_pylist():
                if row["kind"] == HEAD:
                    if payer:
                        yield done()
                    uid, payer, payments = row["uid"], Payer(row, now), []
                elif row["kind"] == PAYMENT:
                    payments.append(row)
                else:
                    payer.take(row)
        if payer:
            yield done()

    return run


def _starts(requests: DataFrame, bill: DataFrame, archive: DataFrame, services: DataFrame) -> DataFrame:
    """uid, low: the earliest first month that any of the payer's payments would bill from, as things stand."""
    facts = bill.groupBy("uid", "cd_license").agg(F.min("ix_yrmo").alias("open"))
    done = archive.groupBy("uid", "cd_license").agg(yrmo(F.add_months(first_of(F.max("ix_yrmo")), 1)).alias("done"))
    served = services.groupBy(F.col("owner_id").alias("uid"), "cd_license").agg(yrmo(F.max("start_dtm")).alias("served"))
    by_license = facts.join(done, ["uid", "cd_license"], "full").join(served, ["uid", "cd_license"], "full")
    whole = by_license.groupBy("uid").agg(F.min("open").alias("open"), F.max("done").alias("done"), F.max("served").alias("served"))
    latest = F.greatest("open", "done", "served").alias("start")
    asked = requests.select("uid", "cd_license").distinct()
    each = asked.join(by_license, ["uid", "cd_license"]).select("uid", latest).unionByName(
        asked.filter("cd_license IS NULL").select("uid").join(whole, "uid").select("uid", latest))
    return each.groupBy("uid").agg(F.min("start").alias("low"))


def _gathered(
    requests: DataFrame, bill: DataFrame, archive: DataFrame, payment: DataFrame, customer: DataFrame, services: DataFrame, now: dt.datetime, months: int
) -> tuple[DataFrame, DataFrame]:
    """(what comes back from the replay, uid and the month from which archived bills were in it)."""
    payers = requests.select("uid").distinct()
    state = durable(payers.join(_starts(requests, bill, archive, services), "uid", "left").withColumn(
        "low", first_of(F.coalesce("low", F.lit(month_key(now.date()))))).withColumn("high", F.add_months("low", months - 1)))
    kind = aligned(bill, archive).schema
    extra = [f for f in bill.schema.fields if f.name not in kind.names]
    names = T.StructType([*kind.fields, *extra, *([] if "create_dtm" in kind.names else [T.StructField("create_dtm", T.TimestampNTZType())])])
    as_row = lambda df: F.struct(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in names.fields])
    empty = {"place": "int", "company": "string", "ix_yrmo": "int", "cd_license": "string", "amount": "decimal(25,2)", "until": "int", "text": "string"}

    def facts(df: DataFrame, number: int, row=None, **values) -> DataFrame:
        made = {k: values.get(k, F.lit(None)) for k in empty}
        return df.select(F.col("uid").cast("long").alias("uid"), F.lit(number).alias("kind"), *[v.cast(empty[k]).alias(k) for k, v in made.items()],
                         (row if row is not None else F.lit(None).cast(names)).alias("row"))

    c = F.col
    beyond: DataFrame = state
    results, windows = [], []
    while True:
        left = beyond.count()
        if not left:
            break
        few = near(beyond, left)
        span = few.select(c("uid").alias("owner_id"), "low", "high")
        computed = with_due_date(bill_totals(service_months(services.join(span, "owner_id"), c("low"), c("high"))), customer.select("id", "is_mobill"))
        heads = few.join(customer.select(c("id").alias("uid"), "balance"), "uid", "left").join(next_sequence(payment, month_key(now.date())), "uid", "left")
        own = few.select("uid", yrmo(c("low")).alias("_from"))
        kept, older = archive.join(own, "uid"), archive.join(own, "uid").filter("ix_yrmo < _from")
        kept = kept.filter("ix_yrmo >= _from")
        last = services.withColumn("uid", c("owner_id")).join(own.select("uid"), "uid").groupBy("uid", "cd_license").agg(
            F.max(F.struct("start_dtm", "company")).alias("s"))
        everything = reduce(DataFrame.unionByName, [
            facts(heads, HEAD, place=F.coalesce("useq", F.lit(1)), amount=c("balance"), ix_yrmo=yrmo(c("low")), until=yrmo(c("high"))),
            facts(requests.join(own.select("uid"), "uid"), PAYMENT, place=c("wave"), company=c("company"), cd_license=c("cd_license"), amount=c("amount")),
            facts(older.groupBy("uid", "cd_license").agg(F.max("ix_yrmo").alias("ix")), ARCHIVED_TO, cd_license=c("cd_license"), ix_yrmo=c("ix")),
            facts(last, SERVED_FROM, cd_license=c("cd_license"), ix_yrmo=yrmo(c("s.start_dtm")), company=c("s.company")),
            facts(computed, COMPUTED, as_row(computed)), facts(kept, ARCHIVE, as_row(kept)),
            facts(bill.join(own.select("uid"), "uid"), BILL, as_row(bill)),
        ])
        order = ["uid", "kind", "place"]
        out = stored(everything.repartition("uid").sortWithinPartitions(*order).mapInArrow(_replayed(now), everything.schema))
        asked = out.filter(c("kind") == BEYOND).select("uid", first_of(c("ix_yrmo")).alias("_wanted"))
        results.append(out.filter(c("kind") != BEYOND))
        windows.append(beyond.join(asked, "uid", "left_anti").select("uid", yrmo(c("low")).alias("_from")))
        months = min(2 * months, MOST_MONTHS)
        beyond = durable(beyond.join(asked, "uid").select(
            "uid", F.least("low", "_wanted").alias("low"), F.greatest(F.add_months("high", months), "_wanted").alias("high")))
    if not results:
        nothing = bill.sparkSession.createDataFrame([], T.StructType([*T._parse_datatype_string(_FACTS).fields, T.StructField("row", names)]))
        return nothing, payers.select("uid", F.lit(0).alias("_from"))
    return reduce(DataFrame.unionByName, results), reduce(DataFrame.unionByName, windows)


def settle_waves(
    requests: DataFrame, bill: DataFrame, bill_archive: DataFrame, payment: DataFrame, customer: DataFrame, services: DataFrame, account: DataFrame,
    now: dt.datetime,
) -> Settlement:
    """Payments numbered by `wave` through `settle`, one wave after the other; nothing is written in between."""
    last = requests.agg(F.max("wave")).first()[0] or 0
    months, paid, rows = [], [], []
    for wave in range(1, last + 1):
        done = settle(requests.filter(F.col("wave") == wave), bill, bill_archive, payment, customer, services, account, now)
        bill, bill_archive, customer = durable(done.bill), durable(done.bill_archive), durable(done.customer)
        rows.append(durable(done.payment))
        payment = payment.unionByName(aligned(rows[-1], payment))
        months.append(durable(done.months))
        paid.append(done.paid)
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Settlement(bill, bill_archive, customer, union(rows), union(paid), union(months).distinct())


def settle_all(
    requests: DataFrame, arrival: str, bill: DataFrame, bill_archive: DataFrame, payment: DataFrame, customer: DataFrame, services: DataFrame,
    account: DataFrame, now: dt.datetime, gathered: int = GATHERED, months: int = FIRST_MONTHS,
) -> Settlement:
    """Tables after all payments, of which a payer may have several, in the order of `arrival`.

    Every payer has a customer row with a balance (see `settlement.checked`).
    """
    numbered = durable(waves(requests, arrival))
    sizes = numbered.select("uid").unionByName(bill.select("uid")).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    large = durable(numbered.select("uid").distinct().join(sizes.filter(F.col("n") > gathered), "uid", "left_semi"))
    n_large = large.count()
    small = numbered.join(near(large, n_large), "uid", "left_anti") if n_large else numbered
    back, windows = _gathered(small, bill, bill_archive, payment, customer, services, now, months)
    c = F.col
    rows_of = lambda number, like: aligned(back.filter(c("kind") == number).select("row.*"), like)
    bill_after = bill.join(windows.select("uid"), "uid", "left_anti").select(*bill.columns).unionByName(rows_of(BILL, bill))
    untouched = bill_archive.join(windows, "uid", "left").filter("_from IS NULL OR ix_yrmo < _from").select(*bill_archive.columns)
    archive_after = untouched.unionByName(rows_of(ARCHIVE, bill_archive))
    balances = back.filter(c("kind") == HEAD).select(c("uid").alias("id"), c("amount").alias("_balance"))
    customer_after = aligned(customer.join(balances, "id", "left").withColumns({
        "balance": F.coalesce("_balance", "balance"), "last_payment": F.when(c("_balance").isNotNull(), F.lit(now)).otherwise(c("last_payment"))}), customer)
    texts = back.filter(c("kind") == PAYMENT).select("uid", c("until").alias("wave"), c("place").alias("useq"), c("company").alias("_company"), c("text").alias("_text"))
    extra = [x for x in ("ref_code", "transfer_dtm", "remarks", "create_by") if x in requests.columns]
    names = account.select(c("id").alias("uid"), c("display_name").alias("cust_name"))
    payments = small.join(texts, ["uid", "wave"]).join(names, "uid", "left").select(
        c("_company").alias("company"), F.lit(month_key(now.date())).alias("ix_yrmo"), "uid", "useq", F.lit(0).alias("part"), c("_text").alias("cd_license"),
        "cust_name", c("amount").cast("decimal(15,2)").alias("amount"), "payment_type", *extra)
    touched = back.filter(c("kind") == MONTH).select("ix_yrmo").distinct()
    done = Settlement(bill_after, archive_after, customer_after, payments, rows_of(PAID, bill_archive), touched)
    if not n_large:
        return done
    mine = lambda df, key="uid": df.join(near(large.select(c("uid").alias(key)), n_large), key, "left_semi").select(*df.columns)
    others = lambda df, key="uid": df.join(near(large.select(c("uid").alias(key)), n_large), key, "left_anti").select(*df.columns)
    rest = settle_waves(mine(numbered), mine(bill), mine(bill_archive), mine(payment), mine(customer, "id"), mine(services, "owner_id"), account, now)
    return Settlement(
        others(done.bill).unionByName(rest.bill), others(done.bill_archive).unionByName(rest.bill_archive),
        others(done.customer, "id").unionByName(rest.customer), done.payment.unionByName(rest.payment),
        done.paid.unionByName(aligned(rest.paid, done.paid)), done.months.unionByName(rest.months).distinct())
