"""The load job: all stages, a loss after any of them, ids that stay, and the lists made by hand."""

import datetime as dt

import pytest

from curbledger.operators import ids, legacy
from curbledger.plans import load
from curbledger.sources.fixtures import domain_tables
from curbledger.sources.tables import Snapshot

NOW = dt.datetime(1998, 6, 20, 12, 0)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def extracts(spark):
    t = domain_tables(spark, SMALL)
    out = {n: t.table(f"legacy_{n}") for n in ("car", "change", "receipt", "worker", "staff", "house", "plan")}
    return out | {
        "assignment": spark.createDataFrame([("w1 ", "K", 84, None), ("nobody", "K", 1, None)], load.ASSIGNMENTS),
        "name": spark.createDataFrame([("W1", "Given name")], load.NAMES),
    }


def content(spark, root):
    shot = Snapshot(spark, root)
    out = {}
    for name in sorted(shot.live):
        if name != "load_stage":
            frame = shot.read(name)
            skip = {"create_dtm", "mod_dtm", "last_reunion"}  # the time of the load, where there is no other
            out[name] = sorted(repr(tuple(r)) for r in frame.select(*[c for c in frame.columns if c not in skip]).collect())
    return out


def test_whole_load_and_a_load_lost_on_the_way(spark, extracts, tmp_path, monkeypatch):
    whole, lost = str(tmp_path / "whole"), str(tmp_path / "lost")
    assert load.load(spark, whole, extracts, "first", NOW) == [s for s, _ in load.STAGES]
    want = content(spark, whole)
    assert {"account", "bill_archive", "contact", "customer", "employee", "id_registry", "load_login", "order_item", "payment", "service_location", "service_order",
            "service_plan", "system_config", "unit_service", "unit_service_group", "vehicle", "worker", "worker_location"} == set(want)
    assert all(want.values())
    assert load.load(spark, whole, extracts, "first", NOW + dt.timedelta(days=1)) == []  # nothing is left to do

    real, left = load.publish, [4]

    def publish(*args):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("lost")
        real(*args)

    ran = []
    with monkeypatch.context() as m:
        m.setattr(load, "publish", publish)
        for k in range(3):  # lost after the fourth, the ninth and the twelfth stage
            left[0] = (4, 5, 3)[k]
            with pytest.raises(OSError):
                load.load(spark, lost, extracts, "first", NOW + dt.timedelta(minutes=k))
            ran.append(len(Snapshot(spark, lost).read("load_stage").collect()))
    assert ran == [4, 9, 12]
    assert load.load(spark, lost, extracts, "first", NOW + dt.timedelta(hours=1)) == ["lists"]
    assert content(spark, lost) == want

    shot = Snapshot(spark, whole)
    numbers = [r.id for r in shot.read("account").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))  # one sequence
    roles = [r.role for r in shot.read("account").orderBy("id").collect()]
    assert roles[7:] == sorted(roles[7:], key=lambda r: {"WORKER": 1, "CUSTOMER": 2}.get(r, 0))
    assert [r.uid for r in shot.read("worker_location").collect()] == [r.id for r in shot.read("account").filter("display_name = 'Given name'").collect()]
    roles = {r.id: r.role for r in shot.read("account").collect()}
    assert {roles[r.uid] for r in shot.read("employee").collect()} == {"VIEWER", "OPERATOR", "OTHER", "WORKER"}


def test_ids_stay_and_new_logins_follow(spark):
    make = lambda *names: spark.createDataFrame([(n, f"d{n}") for n in names], "login_name string, display_name string")
    first, registry = ids.assigned(make("b", "a", None), spark.createDataFrame([], "login_key string, id int"))
    assert sorted((r.login_name, r.id) for r in first.collect() if r.login_name) == [("a", 2), ("b", 3)]
    again, new = ids.assigned(make("B ", "a", "0", "c"), registry)
    assert sorted((r.login_name, r.id) for r in again.collect()) == [("0", 4), ("B ", 3), ("a", 2), ("c", 5)]
    assert new.count() == 2


def test_worker_lists(spark):
    worker = spark.createDataFrame([(5, "W0050"), (6, "W0051")], "uid int, worker_code string")
    places = legacy.worker_locations(spark.createDataFrame([("w0050 ", "K", 84, None), ("x", "K", 1, "2")], load.ASSIGNMENTS), worker).collect()
    assert sorted((r.uid or 0, r.srv_dis, r.srv_loc, r.srv_floor, r.work_type) for r in places) == [(0, "K", 1, "2", 0), (5, "K", 84, None, 0)]
    accounts = spark.createDataFrame([(5, "old"), (6, "stays")], "id int, display_name string")
    named = legacy.renamed_workers(accounts, spark.createDataFrame([("W0050", "New"), ("none", "x")], load.NAMES), worker).collect()
    assert sorted((r.id, r.display_name) for r in named) == [(5, "New"), (6, "stays")]


def test_contact_candidates_leave_the_change_records_behind(spark, tmp_path):
    """The change records are read, cleaned and made distinct once; what follows reads the stored rows."""
    car = "car_number string, customer_name string, customer_phone string"
    folder = str(tmp_path / "changes")
    spark.createDataFrame([("ａ 1", " n ", "t 12345678"), ("ａ 1", "n", "t 12345678"), ("B2", None, None), (" ", "x", "1")], car).write.parquet(folder)
    changes = legacy.with_plate(legacy.normalized(spark.read.parquet(folder)))
    cars = legacy.normalized(spark.createDataFrame([("A1", "m", "2"), ("c3", "m", None), (None, "m", "3")], car))
    found = legacy.contact_candidates(changes, cars)
    assert not [f for f in found.inputFiles() if folder in f]
    assert sorted(map(tuple, found.collect())) == [("A1", "n", "t 12345678#"), ("B2", "", "#"), ("C3", "m", "#")]
