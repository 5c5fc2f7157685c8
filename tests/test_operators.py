"""Single rules on inline rows."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from curbledger.operators import billing, bonus, census, overdue, payroll, quality, reconcile, schedule, settlement
from curbledger.sources import seed

D0, D1 = dt.date(1998, 6, 1), dt.date(1998, 6, 30)
NOW = dt.datetime(1998, 6, 20, 12, 0)

SERVICE = (
    "company string, cd_license string, owner_id long, vh_type int, srv_plan string, reg_dtm date, start_dtm date, end_dtm date, "
    "fee decimal(15,2), srv_dis string, srv_loc int, srv_floor string, srv_psn string, weekday1 int, weekday2 int, weekday3 int, "
    "rotation string, extra_fee decimal(15,2), waxing boolean, worker long"
)


def service(plan="A", start=D0, end=None, **over):
    row = dict(
        company="TK", cd_license="AB1", owner_id=1, vh_type=1, srv_plan=plan, reg_dtm=start, start_dtm=start, end_dtm=end,
        fee=D(300), srv_dis="H", srv_loc=1, srv_floor="G", srv_psn="7", weekday1=1, weekday2=3, weekday3=5, rotation=None,
        extra_fee=D(0), waxing=False, worker=900,
    )
    row.update(over)
    return tuple(row.values())


@pytest.fixture(scope="module")
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SERVICE)


@pytest.fixture(scope="module")
def payers(spark):
    return spark.createDataFrame([(1, False, D(0)), (2, True, D(0))], "id long, is_mobill boolean, balance decimal(15,2)")


@pytest.mark.parametrize("row, amount", [
    (service("A", dt.date(1998, 6, 16)), 150),
    (service("B", dt.date(1998, 6, 16)), 150),
    (service("C", D0, dt.date(1998, 6, 14)), 120),  # 2 of 5 Mondays
    (service("D", dt.date(1998, 6, 29)), 300),
    (service("Z", dt.date(1998, 6, 29)), 300),
    (service("A", dt.date(1998, 6, 30), fee=D("100.10"), extra_fee=D("2.50")), D("5.50")),
    (service("A", D0, D0, fee=D("15")), 1),  # 0.50 rounds up
])
def test_proration(make, payers, row, amount):
    assert [r.amount for r in billing.calc_bills(make(row), payers, D0, D1).collect()] == [D(amount)]


def test_extra_fee_is_the_largest_and_fees_add_up(make, payers):
    rows = make(service("D", extra_fee=D(10)), service("D", extra_fee=D(25), fee=D("10.40")))
    assert billing.calc_bills(rows, payers, D0, D1).first().amount == D(335)


def test_end_on_the_first_drops_its_month(make, payers):
    bills = billing.calc_bills(make(service(start=dt.date(1997, 1, 1))), payers, dt.date(1998, 1, 1), dt.date(1998, 3, 1))
    assert sorted(r.ix_yrmo for r in bills.collect()) == [199801, 199802]


def test_due_date(make, payers):
    bills = billing.calc_bills(make(service(), service(owner_id=2, cd_license="X")), payers, D0, D1).collect()
    assert {r.uid: r.due_dtm for r in bills} == {1: dt.date(1998, 6, 30), 2: dt.date(1998, 7, 31)}


def test_single_payer_and_unknown_payer(make, payers):
    rows = make(service(), service(owner_id=2), service(owner_id=3))
    assert [r.uid for r in billing.calc_bills(rows, payers, D0, D1, uid=2).collect()] == [2]
    assert billing.calc_bills(rows, payers, D0, D1).count() == 2


BILL = (
    "company string, ix_yrmo int, uid long, cd_license string, bill_type int, create_dtm timestamp_ntz, amount decimal(15,2), "
    "discount decimal(15,2), bill_start date, bill_end date, due_dtm date"
)
OLD = dt.datetime(1998, 1, 1)


def bill(plate, amount, discount=0, kind=1, uid=1, ix=199806, company="TK"):
    return (company, ix, uid, plate, kind, OLD, D(amount), D(discount), D0, D1, D1)


@pytest.fixture(scope="module")
def applied(spark, make, payers):
    """One key per case; 'both' is open and archived at once."""
    stored = spark.createDataFrame([bill("c1", 50), bill("c6", 50), bill("same", 300), bill("both", 50)], BILL)
    archived = spark.createDataFrame(
        [bill("c2", 70), bill("c7", 200, 20), bill("c8", 400, 5), bill("both", 200)], BILL
    )
    live = make(*[service("D", cd_license=p) for p in ("c3", "c6", "c7", "c8", "same", "both")])
    diff = reconcile.bill_diff(stored, archived, billing.calc_bills(live, payers, D0, D1), 199806)
    state = reconcile.apply_bill_diff(reconcile.BillState(stored, archived, payers), diff, NOW)
    return diff, state


def test_reconcile_cases(applied):
    diff, state = applied
    cases = sorted((r.cd_license, r.case_no) for r in diff.select("cd_license", reconcile.diff_case().alias("case_no")).collect())
    assert cases == [("both", 6), ("both", 7), ("c1", 1), ("c2", 2), ("c3", 3), ("c6", 6), ("c7", 7), ("c8", 8)]
    bills = sorted((r.cd_license, r.amount, r.discount, r.create_dtm == NOW) for r in state.bill.collect())
    assert bills == [
        ("both", 300, 0, True), ("both", 300, 0, True), ("c3", 300, 0, True), ("c6", 300, 0, True), ("c7", 300, 20, True),
        ("same", 300, 0, False),
    ]
    assert sorted((r.cd_license, r.amount) for r in state.bill_archive.collect()) == [("c8", 300)]
    # refunds: case 2 70, case 7 (200-20)+200, case 8 400-300
    assert {r.id: r.balance for r in state.customer.collect()} == {1: D(550), 2: D(0)}


def test_second_reconcile_finds_nothing_new(make, payers, applied):
    _, state = applied
    live = make(*[service("D", cd_license=p) for p in ("c3", "c6", "c7", "c8", "same", "both")])
    again = reconcile.bill_diff(state.bill, state.bill_archive, billing.calc_bills(live, payers, D0, D1), 199806)
    assert again.count() == 0


def test_refund_test_sum_of_zero_pays_nothing(spark, payers):
    rows = [(0, 1, "TK", 199806, 1, p, D(b), D(10), D(3), D0, D1, D1) for p, b in (("a", 5), ("b", -5))]
    diff = spark.createDataFrame(
        rows, "st int, paid int, company string, ix_yrmo int, uid long, cd_license string, b_amount decimal(15,2), "
        "f_amount decimal(15,2), discount decimal(15,2), bill_start date, bill_end date, due_dtm date"
    )
    assert reconcile.refunds(diff).count() == 0


def request(spark, uid=1, plate=None, amount=100, company="TK", qualified=None):
    return spark.createDataFrame(
        [(uid, company, plate, D(amount), "C", D(qualified if qualified is not None else amount))],
        "uid long, company string, cd_license string, amount decimal(15,2), payment_type string, qualified decimal(15,2)",
    )


def test_equal_bills_are_taken_or_left_together(spark):
    bills = spark.createDataFrame([bill("x", 60), bill("x", 60, company="KY"), bill("y", 10, ix=199805)], BILL)
    paid = lambda money: sorted(
        r.cd_license for r in settlement.affordable(bills, request(spark, plate="x", qualified=money)).collect()
    )
    assert paid(100) == []
    assert paid(120) == ["x", "x"]


def test_company_counts_only_without_license(spark):
    bills = spark.createDataFrame([bill("x", 10), bill("y", 10, company="KY")], BILL)
    assert [r.cd_license for r in settlement.affordable(bills, request(spark)).collect()] == ["x"]
    assert [r.cd_license for r in settlement.affordable(bills, request(spark, plate="y")).collect()] == ["y"]


def settled(spark, make, bills, archive, services, amount, plate=None, balance=0):
    customer = spark.createDataFrame(
        [(1, False, D(balance), None)], "id long, is_mobill boolean, balance decimal(15,2), last_payment timestamp_ntz"
    )
    archive_type = BILL + ", iv_ix int, iv_seq int"
    return settlement.settle(
        request(spark, plate=plate, amount=amount).drop("qualified"),
        spark.createDataFrame(bills, BILL), spark.createDataFrame([(*b, None, None) for b in archive], archive_type),
        spark.createDataFrame([(1, 199806, 4)], "uid long, ix_yrmo int, useq int"), customer, make(*services),
        spark.createDataFrame([(1, "Ann")], "id long, display_name string"), NOW,
    )


def test_settlement_bills_forward_until_the_money_is_used(spark, make):
    done = settled(spark, make, [bill("AB1", 300)], [], [service("D")], 700)
    assert sorted(r.ix_yrmo for r in done.paid.collect()) == [199806, 199807]
    assert sorted((r.ix_yrmo, r.iv_ix, r.iv_seq) for r in done.bill_archive.collect()) == [(199806, 199806, 5), (199807, 199806, 5)]
    assert [r.ix_yrmo for r in done.bill.collect()] == [199808]
    after = done.customer.first()
    assert (after.balance, after.last_payment) == (D(100), NOW)
    row = done.payment.first()
    assert (row.company, row.useq, row.cd_license, row.amount, row.cust_name) == ("TK", 5, "AB1", D(700), "Ann")


def test_settlement_conserves_money(spark, make):
    done = settled(spark, make, [bill("AB1", 300), bill("Q", 40, kind=2)], [], [service("D")], 650, balance=33)
    paid = sum(r.net for r in done.paid.collect())
    assert done.customer.first().balance == 33 + 650 - paid


def test_payment_without_affordable_bill(spark, make):
    done = settled(spark, make, [], [], [service("D", company="PF")], 10, plate="AB1")
    row = done.payment.first()
    assert (row.cd_license, row.company) == ("*BALANCE(CR)*", "PF")
    assert done.customer.first().balance == D(10)
    none = settled(spark, make, [], [], [service("D", owner_id=5)], 10)
    assert (none.payment.first().company, none.customer.first().balance) == ("TK", D(10))


def test_other_bill_types_are_archived_but_stay_open(spark, make):
    done = settled(spark, make, [bill("AB1", 300, kind=2)], [], [service("D")], 300)
    assert (199806, 2) in {(r.ix_yrmo, r.bill_type) for r in done.bill.collect()}
    assert [r.bill_type for r in done.bill_archive.collect()] == [2]


def test_cents_are_lost_at_each_forward_step(spark):
    start = spark.createDataFrame([(100, [D("99.50"), D("1.00"), D("5.00")])], "fund int, nets array<decimal(25,2)>")
    end = start.select(settlement._spend(F.col("nets"), F.col("fund")).alias("e")).first().e
    assert (end.months, end.fund) == (1, 0)  # 100 - 99.50 leaves 0.50, cut to 0


def test_waves_number_the_payments_of_a_payer(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (2, 2)], "uid long, arrival int")
    assert sorted((r.uid, r.arrival, r.wave) for r in settlement.waves(df, "arrival").collect()) == [(1, 1, 1), (1, 3, 2), (2, 2, 1)]


def test_payment_text_in_parts(spark, make):
    paid = spark.createDataFrame([(1, f"P{i:03d}", D(1), "TK") for i in range(50)], "uid long, cd_license string, net decimal(15,2), company string")
    rows = settlement.payment_rows(
        request(spark), paid, settlement.settled_per_payer(paid), spark.createDataFrame([], "uid long, useq int"),
        make(service()), spark.createDataFrame([(1, "Ann")], "id long, display_name string"), 199806, limit=10,
    ).collect()
    assert len(rows) > 1 and sum(r.amount for r in rows) == 100
    assert [p for r in sorted(rows, key=lambda r: r.part) for p in r.cd_license.split(",")] == [f"P{i:03d}" for i in range(50)]


# schedule

def _place(spark):
    return spark.createDataFrame(
        [("H", 1, "屋", None, "M1", "F1", True)],
        "srv_dis string, srv_loc int, name_zh string, name_en string, mgt_dis string, cd_fleet string, mpf boolean",
    )


def _accounts(spark, remarks=None):
    return spark.createDataFrame(
        [(1, "Ann", True, remarks), (900, "Wo", True, None), (901, "Off", False, None)],
        "id long, display_name string, active boolean, remarks string",
    )


def _cars(spark, remarks=None, source=2):
    return spark.createDataFrame([("AB1", 1, source, remarks)], "cd_license string, owner_id long, source int, remarks string")


def test_visit_days(spark, make):
    count = lambda plan, **over: schedule.worker_schedule(
        make(service(plan, **over)), _accounts(spark), _cars(spark), _place(spark), D0, dt.date(1998, 6, 7)
    ).count()
    assert [count(p) for p in "ABCD"] == [6, 3, 1, 0]
    assert count("A", worker=901) == 0
    long = schedule.worker_schedule(make(service("C")), _accounts(spark), _cars(spark), _place(spark), D0, D0 + dt.timedelta(days=699))
    assert long.count() == 100  # 700 days, one visit a week
    with pytest.raises(ValueError):
        schedule.worker_schedule(make(service()), _accounts(spark), _cars(spark), _place(spark), D0, D0 - dt.timedelta(days=1))


@pytest.mark.parametrize("user, car, expected", [
    (None, None, ""), ("", "dent", ""), ("note", None, None), ("note", "dent", "note;\r\ndent"),
])
def test_schedule_remarks(spark, make, user, car, expected):
    out = schedule.worker_schedule(make(service("C")), _accounts(spark, user), _cars(spark, car), _place(spark), D0, dt.date(1998, 6, 7))
    assert [r.remarks for r in out.collect()] == [expected]


# overdue

def test_reference_month():
    assert overdue.reference_month(dt.date(1998, 6, 21)) == dt.date(1998, 5, 1)
    assert overdue.reference_month(dt.date(1998, 6, 22)) == dt.date(1998, 6, 1)


def test_severity(spark):
    due = spark.createDataFrame([(i, "p", age) for i, age in enumerate((-1, 0, 1, 2, 5))], "uid long, cd_license string, d_diff int")
    assert [r.due_lv for r in overdue.due_level(due).orderBy("uid").collect()] == [0, 0, 1, 2, 2]


# bonus

def _counts(spark, base, sub, plan="A"):
    rows = [(199804, "w1", plan, "base", f"b{i}") for i in range(base)] + [(199804, "w1", plan, "sub", f"b{i}") for i in range(sub)]
    return spark.createDataFrame(rows, "join_ix int, worker string, srv_plan string, kind string, cd_license string")


@pytest.fixture(scope="module")
def rates(spark):
    return spark.createDataFrame([("w1", 400, 300, 200, 100)], "uid string, bonus_a int, bonus_b int, bonus_c int, bonus_extra int")


@pytest.mark.parametrize("base, sub, deduct", [(6, 2, 100 * 2 + 800), (3, 2, 800), (4, 2, 100 + 800), (9, 0, 0)])
def test_claw_back(spark, rates, base, sub, deduct):
    assert bonus.month_bonus(_counts(spark, base, sub), rates).first().deduct == deduct


def test_plan_without_rate_gives_null(spark, rates):
    assert bonus.month_bonus(_counts(spark, 1, 0, "D"), rates).first().bonus is None


def _bonus(spark, make, *services):
    workers = spark.createDataFrame(
        [(900, 400, 300, 200, 100, 60, None)],
        "uid long, bonus_a int, bonus_b int, bonus_c int, bonus_extra int, sal_rot int, sal_wax int",
    )
    gone = spark.createDataFrame([], "ix_yrmo int, cd_license string, srv_plan string, end_dtm date, worker long, is_terminate boolean")
    config = spark.createDataFrame([("data", "Salary_Ex ", "rotation", "50.9"), ("DATA", "SALARY_EX", "WAXING ", "15"), ("DATA", "SALARY", "WAXING", "9")],
                                   "dict_key string, grp_key string, c_value1 string, c_value2 string")
    return bonus.calc_bonus(make(*services), _cars(spark), gone, workers, D0, config).collect()


def test_bonus_row_dropped_when_the_test_is_unknown(spark, make):
    quiet = service("A", dt.date(1998, 4, 1), dt.date(1998, 5, 1))
    assert _bonus(spark, make, quiet) == []


def test_bonus_rates(spark, make):
    row = _bonus(spark, make, service("A", D0, rotation="R", waxing=True))[0]
    assert (row.bonus, row.total, row.rot_sal, row.wax_sal, row.json_add) == (400, 400, 60, 15, '[{"l":"AB1","p":"A"}]')
    other = _bonus(spark, make, service("A", dt.date(1997, 1, 1), rotation="R"))[0]
    assert (other.bonus, other.rot_sal) == (0, 50)  # no referral: the default rate


# payroll

def _salary(spark, make, *services, leave=(), plans=(), own=None, limit=1000):
    workers = spark.createDataFrame([(900, own, None, None)], "uid long, salary_a int, salary_b int, salary_c int")
    prices = spark.createDataFrame(
        list(plans), "srv_dis string, srv_loc int, company string, cd_plan string, vh_type int, salary decimal(15,2), effect date"
    )
    off = spark.createDataFrame(list(leave), "uid long, leave_dtm date, pay_ratio decimal(5,4)")
    gone = spark.createDataFrame([("AB1", dt.date(1998, 6, 25), True)], "cd_license string, end_dtm date, is_terminate boolean")
    return payroll.calc_salary(
        make(*services), workers, prices, off, seed.system_config(spark), _accounts(spark), _cars(spark), gone, _place(spark),
        D0, D1, NOW, limit=limit,
    ).collect()


PRICE = ("H", 1, "TK", "A", 1, D("210.90"), dt.date(1998, 1, 1))


def test_salary_rate_lookup(spark, make):
    full = lambda **k: _salary(spark, make, service("A"), **k)[0].salary_1
    assert full() == D(195)
    assert full(plans=[PRICE]) == D(210)  # cents of the price are lost
    assert full(plans=[PRICE], own=99) == D(99)
    assert full(plans=[PRICE, (*PRICE[:5], D(250), dt.date(1998, 6, 15))]) == D(195)  # across a change: default


def test_leave_and_pension(spark, make):
    half = (900, dt.date(1998, 6, 2), D("0.5"))
    row = _salary(spark, make, service("A"), leave=[half])[0]
    assert (row.salary_1, row.leave_deduct_1, row.mpf) == (D(195), D("3.25"), D("9.59"))
    weekly = service("C", weekday1=2)
    assert _salary(spark, make, weekly, leave=[half])[0].leave_deduct_3 == D("10.50")
    assert _salary(spark, make, service("C"), leave=[half])[0].leave_deduct_3 == 0
    assert _salary(spark, make, service("D")) == []


def test_salary_detail(spark, make):
    row = _salary(spark, make, service("A"))[0]
    assert row.srv_detail == (
        '{"AB1":{"range":[{"p":"A","s":"1998-06-01","e":"1998-06-30","psn":"G 7","d1":1,"d2":3,"d3":5,"wx":false}],'
        '"remarks":"\\r\\n","fs_end":"1998-06-25"}}'
    )


def test_salary_detail_of_a_hot_place_goes_on_in_parts(spark, make):
    hot = [service("A", D0 + dt.timedelta(days=i)) for i in range(30)]
    rows = _salary(spark, make, *hot, limit=5)
    assert len(rows) == 1  # a license is never cut in two
    assert rows[0].srv_detail.count('"p":"A"') == 30 and rows == _salary(spark, make, *hot, limit=None)


# census

def test_plate_with_two_owners_counts_twice(spark, make):
    gone = spark.createDataFrame([], "company string, cd_license string, end_dtm date, reason_id int, is_terminate boolean")
    cars = spark.createDataFrame([("AB1", 1, 0), ("AB1", 2, 1)], "cd_license string, owner_id long, source int")
    rows = census.census_rows(make(service("A")), gone, cars, D0, D1)
    counts = census.census_counts(rows).first()
    assert (counts.cnt_total, counts.cnt_new_flt, counts.cnt_new_oth) == (2, 1, 1)
    wide = census.location_census(make(service("A")), gone, cars, _place(spark), D0, D1).first()
    assert wide["json_TK_Total"] == '["AB1","AB1"]'


def test_last_day_of_a_month_counts_for_the_next(spark, make):
    gone = spark.createDataFrame(
        [("TK", "AB1", dt.date(1998, 5, 31), 4, True)], "company string, cd_license string, end_dtm date, reason_id int, is_terminate boolean"
    )
    out = census.terminations_in_period(make(service("A", dt.date(1998, 1, 1), dt.date(1998, 5, 31))), gone, D0, D1).collect()
    assert [(r.ix, r.reason_id, r.n) for r in out] == [(199806, 4, 1)]


def test_a_payer_without_a_customer_row_keeps_the_request(spark):
    from curbledger.operators import settlement

    requests = spark.createDataFrame([(1, "10"), (2, "20")], "uid int, a string").withColumn("amount", F.col("a").cast("decimal(15,2)"))
    customer = spark.createDataFrame([(1, "5")], "id int, b string").withColumn("balance", F.col("b").cast("decimal(15,2)"))
    got = {r.uid: r.qualified for r in settlement.qualify(requests, customer).collect()}
    assert got[1] == 15 and got[2] is None


def test_waves_break_ties(spark):
    from curbledger.operators import settlement

    rows = [(1, 5, "b"), (1, 5, "a"), (2, 5, "c")]
    got = settlement.waves(spark.createDataFrame(rows, "uid int, at int, kind string"), "at").collect()
    assert sorted((r.uid, r.kind, r.wave) for r in got) == [(1, "a", 1), (1, "b", 2), (2, "c", 1)]


def test_logins_keep_all_digits(spark):
    from curbledger.operators import identity

    got = spark.range(1).select(*[identity._fallback(F.lit(n)).alias(str(n)) for n in (5, 999999, 1000005)]).first()
    assert list(got) == ["CU000005", "CU999999", "CU1000005"]


def test_a_master_row_without_a_plate_is_no_contact(spark):
    from curbledger.operators import legacy

    schema = "car_number string, customer_name string, customer_phone string"
    cars = spark.createDataFrame([(None, "x", "1"), ("AB1", "y", "2")], schema)
    changes = spark.createDataFrame([], schema)
    assert [r.cd_license for r in legacy.contact_candidates(changes, cars).collect()] == ["AB1"]


def test_differences_read_each_side_once(make, payers, capsys):
    """One join: at 6 GB the second one, with its distinct keys, shuffled all stored and computed bills again."""
    computed = billing.calc_bills(make(service()), payers, D0, D1)
    empty = computed.sparkSession.createDataFrame([], BILL)
    reconcile.diff_bills(reconcile.stored_bills(empty, empty), computed).explain("extended")
    logical = capsys.readouterr().out.split("== Analyzed Logical Plan ==")[1].split("== Optimized Logical Plan ==")[0]
    assert logical.count("Join FullOuter") == 1 and "LeftAnti" not in logical


def test_audit_deals_large_tables_over_tasks(spark):
    """A table in one file was one task, whose keys grew with the table: 5.8 GB of memory at 6 GB."""
    rows = spark.range(0, 1000, 1, 1).select(F.col("id"), F.lit("x").alias("name"))
    c = [quality.Unique("pk", "t", ["id"])]
    assert quality._spread({"t": rows}, c, 100)["t"].rdd.getNumPartitions() == 10
    assert quality._spread({"t": rows}, c, 1000)["t"].rdd.getNumPartitions() == 1
    twice = rows.unionByName(rows.filter("id IN (7, 8)"))
    assert sorted((r.key, r.n) for r in quality.constraint_audit({"t": twice}, c, 100).collect()) == [("7", 2), ("8", 2)]
