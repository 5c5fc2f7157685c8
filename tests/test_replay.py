"""All payments of a payer in one pass against wave after wave."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from curbledger.operators import replay, settlement
from curbledger.session import durable
from curbledger.sources.schemas import tables

NOW = dt.datetime(1998, 6, 20, 12, 0)
BILL = ("company string, ix_yrmo int, uid int, cd_license string, k int, bill_type smallint, create_dtm timestamp_ntz, amount decimal(15,2), "
        "discount decimal(15,2), bill_start date, bill_end date, due_dtm timestamp_ntz, remarks string")


def world(spark, seed, payers=14, longest=9):
    rng = random.Random(seed)
    services, bills, archive, payments, requests = [], [], [], [], []
    for uid in range(1, payers + 1):
        licenses = [f"{uid}L{k}" for k in range(rng.randint(1, 4))]
        for c in licenses:
            for _ in range(rng.randint(0, 2)):
                start = dt.date(1997 + rng.randint(0, 1), rng.randint(1, 12), rng.randint(1, 28))
                end = None if rng.random() < 0.5 else start + dt.timedelta(days=rng.randint(20, 500))
                services.append((rng.choice(["TK", "TF"]), c, uid, 0, rng.choice("ABCD"), start, start, end, D(rng.randint(1, 40) * 10), "K", 1, "", "",
                                 rng.randint(1, 7), 1, 2, None, D(rng.choice([0, 15])), False, 1, NOW, "x"))
        for where, chance in ((bills, 0.5), (archive, 0.4)):
            for ix in [*range(199707, 199713), *range(199801, 199810)]:
                for c in licenses:
                    for _ in range(2 if rng.random() < 0.1 else 1):
                        if rng.random() < chance * (0.5 if ix > 199804 else 1):
                            day = dt.date(ix // 100, ix % 100, 1)
                            row = (rng.choice(["TK", "TF"]), ix, uid, c, rng.randint(1, 9), rng.choice([1, 1, 1, 2]), NOW, D(rng.randint(1, 40) * 10), D(rng.choice([0, 0, 5])), day, day,
                                   dt.datetime(1998, 1, 1), "r")
                            where.append(row if where is bills else (*row[:-1], 199801, 3, "r"))
        if rng.random() < 0.5:
            payments.append((199806, uid, rng.randint(1, 5)))
        for n in range(rng.choice([1, 1, 2, longest])):
            requests.append((uid, rng.choice(["TK", "TF"]), rng.choice([None, None, *licenses]), D(rng.choice([0, 50, 333, 900, 2500, -20])) + D(rng.randint(0, 99)) / 100, "Q", n, f"u{n}"))
    names = ", ".join(f"{k} {v.rstrip('?')}" for k, v in tables()["vehicle_service"].columns.items())
    make = spark.createDataFrame
    return dict(
        requests=make(requests, "uid int, company string, cd_license string, amount decimal(15,2), payment_type string, arrival int, create_by string"),
        bill=make(bills, BILL), bill_archive=make(archive, BILL.replace(", remarks", ", iv_ix int, iv_seq int, remarks")),
        payment=make(payments, "ix_yrmo int, uid int, useq int"),
        customer=make([(u, D(random.Random(u).randint(-50, 400)), u % 2 == 0, None) for u in range(1, payers + 4)], "id int, balance decimal(15,2), is_mobill boolean, last_payment timestamp_ntz"),
        services=make(services, names), account=make([(u, f"n{u}") for u in range(1, payers + 4)], "id int, display_name string"))


def rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


@pytest.mark.parametrize("seed, payers, longest, gathered, months", [(1, 30, 2, 10**6, 12), (2, 12, 2, 60, 2)])
def test_same_as_wave_after_wave(spark, seed, payers, longest, gathered, months):
    w = world(spark, seed, payers, longest)
    asked = w.pop("requests")
    one = replay.settle_all(asked, "arrival", **w, now=NOW, gathered=gathered, months=months)
    many = replay.settle_waves(settlement.waves(asked, "arrival"), **w, now=NOW)
    for name in ("bill", "bill_archive", "customer", "payment"):
        assert rows(getattr(one, name)) == rows(getattr(many, name)), name
    changed = {r.ix_yrmo for a, b in ((w["bill"], one.bill), (w["bill_archive"], one.bill_archive))
               for r in a.exceptAll(b).unionByName(b.exceptAll(a)).select("ix_yrmo").distinct().collect()}
    assert changed <= {r.ix_yrmo for r in one.months.collect()}
    assert len(rows(one.paid)) > 0


def test_fifty_payments_at_once_or_in_two_runs(spark):
    w = world(spark, 3, 4, 50)
    asked = w.pop("requests")
    one = replay.settle_all(asked, "arrival", **w, now=NOW, months=3)
    first = replay.settle_all(asked.filter("arrival < 20"), "arrival", **w, now=NOW)
    w |= {k: durable(getattr(first, k)) for k in ("bill", "bill_archive", "customer")}
    paid = durable(first.payment)
    w["payment"] = w["payment"].unionByName(paid.select(*w["payment"].columns))
    second = replay.settle_all(asked.filter("arrival >= 20"), "arrival", **w, now=NOW)
    assert asked.filter("arrival >= 20").count() >= 30
    for name in ("bill", "bill_archive", "customer"):
        assert rows(getattr(one, name)) == rows(getattr(second, name)), name
    assert rows(one.payment) == sorted(rows(paid) + rows(second.payment))


def test_no_payments(spark):
    w = world(spark, 5, 2)
    asked = w.pop("requests").limit(0)
    done = replay.settle_all(asked, "arrival", **w, now=NOW)
    assert rows(done.bill) == rows(w["bill"]) and rows(done.customer) == rows(w["customer"]) and done.payment.count() == 0
