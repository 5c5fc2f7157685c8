import datetime as dt
from decimal import Decimal as D
from pathlib import Path

import pytest

from curbledger.operators import quality
from curbledger.plans import jobs
from curbledger.sources import seed, tables
from curbledger.sources.legacy import snake_name
from curbledger.sources.schemas import tables as all_tables
from tests.test_operators import SERVICE, service

NOW = dt.datetime(1998, 6, 20, 12, 0)


@pytest.fixture()
def root(spark, tmp_path):
    folder = str(tmp_path / "store")
    tables.publish({
        "vehicle_service": spark.createDataFrame([service("D")], SERVICE),
        "customer": spark.createDataFrame([(1, D(5))], "id int, balance decimal(15,2)"),
        "account": spark.createDataFrame([(1, "Ann", "CUSTOMER")], "id int, display_name string, role string"),
    }, folder, "v0", NOW)
    return folder


def test_reconcile_then_pay(spark, root):
    dry = jobs.recalc_bills(spark, root, 199806, "dry", NOW, dry_run=True)
    assert dry.count() == 1 and tables.read_table(spark, root, "bill").count() == 0
    jobs.recalc_bills(spark, root, 199806, "v1", NOW + dt.timedelta(seconds=1))
    assert [(r.cd_license, r.amount) for r in tables.read_table(spark, root, "bill").collect()] == [("AB1", D(300))]
    ask = spark.createDataFrame(
        [(1, "TK", None, D(295), "Q", "chq 1234567", "web")],
        "uid int, company string, cd_license string, amount decimal(15,2), payment_type string, ref_code string, create_by string",
    )
    probes = jobs.process_payments(spark, root, ask, "dry", NOW, dry_run=True).first()
    assert (probes.bill_ix, probes.archive_ix, probes.service_ix) == (199806, None, 199806)
    jobs.process_payments(spark, root, ask, "v2", NOW + dt.timedelta(seconds=2))
    assert tables.read_table(spark, root, "customer").first().balance == D(0)
    paid = tables.read_table(spark, root, "payment").first()
    assert (paid.useq, paid.part, paid.ix_chq, paid.cd_license, paid.create_by, paid.mod_by) == (1, 0, "1234567", "AB1", "web", "web")
    assert tables.read_table(spark, root, "bill_archive").first().iv_seq == 1
    assert tables.read_table(spark, root, "bill").count() == 0


def files(root, name):
    return sorted(str(p.relative_to(root)) for p in (Path(root) / name).rglob("*.parquet"))


def test_one_month_is_written_and_other_parts_keep_their_files(spark, root):
    month = lambda k: (k // 12) * 100 + k % 12 + 199800
    bills = [("TK", month(k), uid, "X", 1, D(5), D(0), dt.date(1998, 1, 1), dt.date(1998, 1, 1), NOW) for k in range(1, 9) for uid in (1, 2)]
    names = "company string, ix_yrmo int, uid int, cd_license string, bill_type smallint, amount decimal(15,2), discount decimal(15,2), bill_start date, bill_end date, due_dtm timestamp_ntz"
    tables.publish({"bill": spark.createDataFrame(bills, names), "bill_archive": spark.createDataFrame(bills[:6], names),
                    "customer": spark.createDataFrame([(k, D(5)) for k in range(1, 41)], "id int, balance decimal(15,2)")}, root, "v1", NOW + dt.timedelta(seconds=1))
    old = {name: files(root, name) for name in ("bill", "bill_archive", "customer")}
    jobs.recalc_bills(spark, root, 199802, "v2", NOW + dt.timedelta(seconds=2))
    new = {name: [f for f in files(root, name) if f not in old[name]] for name in old}
    assert {f.split("/")[1:3][1] for f in new["bill"]} == set() and new["bill_archive"] == []  # nothing is served then: the month is empty
    assert {f.split("/")[2] for f in new["customer"]} == {"part_no=1", "part_no=2"}
    shot = tables.Snapshot(spark, root)
    assert {p: v for p, v in shot.live["bill"].items()} == {month(k): ["v1"] for k in range(1, 9) if k != 2}
    assert 199802 not in shot.live["bill_archive"] and shot.live["customer"][3] == ["v1"] and shot.live["customer"][1] == ["v2"]
    assert {r.id: r.balance for r in shot.read("customer").collect()} == {k: D(10) if k < 3 else D(5) for k in range(1, 41)}
    assert shot.read("bill", [199803, 199802]).count() == 2 and shot.read("bill").count() == 14
    jobs.recalc_bills(spark, root, 199806, "v3", NOW + dt.timedelta(seconds=3))
    assert {f.split("/")[2] for f in files(root, "bill") if "version=v3" in f} == {"ix_yrmo=199806"}


def test_readers_see_a_publication_whole_or_not_at_all(spark, root, monkeypatch):
    before, real = tables.Snapshot(spark, root).live, tables._write_manifest
    failed = []

    def once(*args):
        if not failed:
            failed.append(1)
            raise OSError("lost")
        real(*args)

    monkeypatch.setattr(tables, "_write_manifest", once)
    assert jobs.recalc_bills(spark, root, 199806, "v1", NOW + dt.timedelta(seconds=1)) is None
    shot = tables.Snapshot(spark, root)
    assert files(root, "bill") and shot.read("bill").count() == 0  # written, but not published
    assert {k: v for k, v in shot.live.items() if k != "audit_error"} == before
    assert [r.msg for r in shot.read("audit_error").collect()] == ["lost"]


def test_added_parts_and_compaction(spark, root):
    row = lambda n: spark.createDataFrame([(NOW, "c", "m", f"{n}")], "create_dtm timestamp_ntz, caller_class string, caller_member string, msg string")
    for n in range(3):
        tables.publish({"audit_error": tables.Change(row(n), added=True)}, root, f"e{n}", NOW + dt.timedelta(seconds=n))
    assert tables.Snapshot(spark, root).live["audit_error"] == {0: ["e0", "e1", "e2"]}
    tables.compact(spark, root, "audit_error", [0], "c", NOW + dt.timedelta(seconds=9))
    assert tables.Snapshot(spark, root).live["audit_error"] == {0: ["c"]}
    assert sorted(r.msg for r in tables.read_errors(spark, root).collect()) == ["0", "1", "2"]
    tables.publish({"audit_error": row(7)}, root, "whole", NOW + dt.timedelta(seconds=10))
    assert [r.msg for r in tables.read_errors(spark, root).collect()] == ["7"]


def test_payments_of_one_payer_in_order(spark, root):
    ask = spark.createDataFrame(
        [(1, "TK", None, D(100), "C", "web", 2), (1, "TK", None, D(200), "C", "web", 1)],
        "uid int, company string, cd_license string, amount decimal(15,2), payment_type string, create_by string, arrival int",
    )
    assert jobs.process_all_payments(spark, root, ask, "arrival", "w", NOW + dt.timedelta(seconds=1)).count() == 2
    assert {v for parts in tables.Snapshot(spark, root).live.values() for versions in parts.values() for v in versions} == {"v0", "w"}
    rows = sorted((r.useq, r.amount, r.cd_license) for r in tables.read_table(spark, root, "payment").collect())
    assert rows == [(1, D(200), "*BALANCE(CR)*"), (2, D(100), "AB1")]  # 5 + 200 is too little, 305 pays June
    assert tables.read_table(spark, root, "customer").first().balance == D(5)


def test_errors_are_logged_and_change_nothing(spark, root):
    assert jobs.recalc_bills(spark, root, 199813, "v1", NOW) is None
    with pytest.raises(jobs.SettlementFailed):
        jobs.process_payments(spark, root, spark.createDataFrame([(1,)], "nothing int"), "v1", NOW)
    assert sorted(r.caller_member for r in tables.read_errors(spark, root).collect()) == ["process_payments", "recalc_bills"]
    assert tables.read_table(spark, root, "customer").first().balance == D(5)


def test_bad_payments_are_logged_and_the_others_settled(spark, root):
    n = 1000
    tables.publish({
        "customer": spark.createDataFrame([(k, D(0)) for k in range(1, n + 1)] + [(5000, D(1))], "id int, balance decimal(15,2)"),
        "account": spark.createDataFrame([(k, f"n{k}", "CUSTOMER") for k in range(1, n + 2)], "id int, display_name string, role string"),
    }, root, "v1", NOW + dt.timedelta(seconds=1))
    big = D(10) ** 16
    rows = [(k, "TK", None, D(10), "Q", "web", 1) for k in range(1, n)] + [
        (n, "TK", None, big, "Q", "web", 1), (n + 1, "TK", None, D(1), "Q", "web", 1), (5000, "TK", None, D(1), "Q", "web", 1),
        (None, "TK", None, D(1), "Q", "web", 1), (1, "TK", None, None, "Q", "web", 2), (2, "TK", None, D(1), None, "web", 2)]
    ask = spark.createDataFrame(rows, "uid int, company string, cd_license string, amount decimal(20,2), payment_type string, create_by string, arrival int")
    done = jobs.process_all_payments(spark, root, ask, "arrival", "w", NOW + dt.timedelta(seconds=2))
    assert done.count() == n - 1
    shot = tables.Snapshot(spark, root)
    assert sorted(r.msg for r in shot.read("audit_error").collect()) == sorted([
        f"payment of {n}: amount out of range", f"payment of {n + 1}: unknown payer", "payment of 5000: unknown account",
        "payment of nobody: no payer", "payment of 1: no amount", "payment of 2: no payment type"])
    assert shot.read("payment").count() == n - 1
    assert {r.balance for r in shot.read("customer").filter("id BETWEEN 2 AND 999").collect()} == {D(10)}
    one = jobs.process_payments(spark, root, ask.filter("arrival = 1"), "x", NOW + dt.timedelta(seconds=3))
    assert one.count() == n - 1 and {r.useq for r in one.collect()} == {2}


def test_conform_fills_defaults_and_strips_padding(spark):
    row = tables.conform(
        spark.createDataFrame([(7, "Ann  ", "ADMIN   ")], "id int, display_name string, role string"), all_tables()["account"], NOW
    ).first()
    assert (row.display_name, row.role, row.active, row.mod_by, row.create_dtm, row.remarks) == ("Ann", "ADMIN", True, "#sa", NOW, None)


def test_audit_reports_each_kind(spark):
    found = quality.constraint_audit({
        "account": spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, login_name string"),
        "customer": spark.createDataFrame([(1,), (9,), (9,)], "id int"),
    }).collect()
    assert sorted((r.constraint_name, r.key, r.n) for r in found) == [
        ("fk_customer_account", "9", 2), ("pk_customer", "9", 2), ("uq_account_login", "A", 2),
    ]


def test_audit_compares_as_the_collation_does_and_scans_a_table_once(spark, tmp_path):
    frames = {
        "vehicle": spark.createDataFrame([("ab12 ", 1), ("AB12", 1), ("x|y", 2), ("x", 3), (None, 4), ("NULL", 4)], "cd_license string, owner_id int"),
        "vehicle_service": spark.createDataFrame([("Ab12", 1, "TK", None), ("AB12 ", 1, "tk", None), ("x|y", 3, "TK", None), (None, 5, "TK", None)],
                                                 "cd_license string, owner_id int, company string, end_dtm date"),
        "account": spark.createDataFrame([(k,) for k in (1, 2, 3)], "id int"),
    }
    stored = {}
    for name, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    audit = quality.constraint_audit(stored)
    assert sorted((r.constraint_name, r.key, r.n) for r in audit.collect()) == [
        ("fk_service_vehicle", "X|Y|3", 1), ("fk_vehicle_account", "4", 2), ("pk_vehicle", "AB12|1", 2), ("uq_open_service", "AB12|TK", 2)]
    plan = audit._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3 and plan.count("Aggregate [") == 1


def test_seed_rows(spark):
    config = seed.system_config(spark)
    assert config.count() == 2 + 3 + 11 + 4 + 3 + 9 + 9 + 4 + 2 + 41 + 9
    assert quality.constraint_audit({"system_config": config}).count() == 0
    groups, services = seed.unit_service_group(spark), seed.unit_service(spark)
    report = quality.constraint_audit({"unit_service_group": groups, "unit_service": services})
    assert (groups.count(), services.count(), report.count()) == (9, 26, 0)
    assert seed.service_location(spark).count() == 3
    assert seed.system_accounts(spark).count() == 7
    assert seed.commission_locations(spark).count() == 25


@pytest.mark.parametrize("old, new", [
    ("CAR_ChangeItemDate", "change_item_date"), ("CAR_MonthEndYN", "month_end_yn"), ("PAY_RecAmount", "pay_rec_amount"),
    ("HNP_HouseNameCHN", "house_name_chn"), ("WKR_ServicePrice", "worker_service_price"), ("PAY_CarNumber", "car_number"),
])
def test_legacy_names(old, new):
    assert snake_name(old) == new
