"""The load of old extracts into the published tables, stage by stage.

Each stage reads the extracts and what earlier stages have published, and publishes its tables at once
with a row of `load_stage` that says it is done.  A load that was lost goes on with the stage after the last
one published; a load that is run again does nothing.  Ids come from the published registry, so a later load of
newer extracts gives known logins the ids they have.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbledger.operators import identity, ids, legacy
from curbledger.session import durable
from curbledger.sources import seed
from curbledger.sources.tables import Change, Snapshot, publish

ASSIGNMENTS = "worker_code string, srv_dis string, srv_loc int, srv_floor string"
NAMES = "worker_code string, display_name string"


class Load:
    """One load: the extracts, and the tables as published so far."""

    def __init__(self, spark: SparkSession, root: str, extracts: Mapping[str, DataFrame]) -> None:
        self.spark, self.root, self.extracts = spark, root, extracts
        self.tables = Snapshot(spark, root)

    def cars(self) -> DataFrame:
        return legacy.normalized(self.extracts["car"])

    def changes(self) -> DataFrame:
        return legacy.with_plate(legacy.normalized(self.extracts["change"]))

    def receipts(self) -> DataFrame:
        newer = legacy.normalized(self.extracts["receipt"])
        return legacy.backfilled(newer, legacy.normalized(self.extracts["receipt_old"])) if "receipt_old" in self.extracts else newer

    def numbered(self, accounts: DataFrame) -> dict[str, DataFrame | Change]:
        """The accounts and their registry rows, added to those that are published."""
        known = self.tables.read("account")
        rows, new = ids.assigned(accounts, self.tables.read("id_registry"))
        fresh = durable(rows).join(known.select("id"), "id", "left_anti")
        return {"account": Change(fresh, added=True), "id_registry": Change(new, added=True)}

    def owned(self) -> DataFrame:
        return legacy.with_customer_ids(self.tables.read("load_login"), self.tables.read("account"))


Stage = Callable[[Load], Mapping[str, DataFrame | Change]]


def _reference(load: Load) -> Mapping[str, DataFrame | Change]:
    spark = load.spark
    return {"system_config": seed.system_config(spark), "unit_service_group": seed.unit_service_group(spark), "unit_service": seed.unit_service(spark)}


def _system(load: Load) -> Mapping[str, DataFrame | Change]:
    return load.numbered(seed.system_accounts(load.spark))


def _staff(load: Load) -> Mapping[str, DataFrame | Change]:
    return load.numbered(legacy.staff_accounts(load.extracts["staff"]))


def _workers(load: Load) -> Mapping[str, DataFrame | Change]:
    return load.numbered(legacy.worker_accounts(load.extracts["worker"], load.changes()))


def _employees(load: Load) -> Mapping[str, DataFrame | Change]:
    account = load.tables.read("account")
    return {"worker": legacy.worker_rows(account, load.extracts["worker"]), "employee": legacy.employee_rows(account),
            "contact": legacy.worker_contacts(load.extracts["worker"], account.filter("role = 'WORKER'"))}


def _links(load: Load) -> Mapping[str, DataFrame | Change]:
    contacts = durable(legacy.without_blank(legacy.split_contacts(legacy.contact_candidates(load.changes(), load.cars()))))
    owners, _ = identity.link_owners(identity.link_rows(contacts))
    return {"load_login": identity.login_names(identity.customer_groups(contacts, owners))}


def _customer_accounts(load: Load) -> Mapping[str, DataFrame | Change]:
    return load.numbered(legacy.customer_accounts(load.tables.read("load_login"), load.cars(), load.changes()))


def _customers(load: Load) -> Mapping[str, DataFrame | Change]:
    accounts, owned = load.tables.read("account").filter("role = 'CUSTOMER'"), load.owned()
    return {"customer": legacy.customer_rows(accounts, owned, load.cars()),
            "contact": Change(legacy.customer_contacts(owned).filter("uid IS NOT NULL"), added=True)}


def _places(load: Load) -> Mapping[str, DataFrame | Change]:
    known = legacy.locations(load.extracts["house"])
    given = known.select("srv_dis", "srv_loc")
    dummies = seed.service_location(load.spark).join(given, ["srv_dis", "srv_loc"], "left_anti")
    rows = known.unionByName(dummies.select(*known.columns))
    filled = rows.unionByName(legacy.missing_locations(rows)).filter("srv_dis IS NOT NULL")
    return {"service_location": legacy.with_commission(filled, seed.commission_locations(load.spark)),
            "service_plan": legacy.service_plans(load.extracts["plan"])}


def _vehicles(load: Load) -> Mapping[str, DataFrame | Change]:
    return {"vehicle": legacy.vehicles(load.owned(), load.cars(), load.changes()).filter("owner_id IS NOT NULL")}


def _receipts(load: Load) -> Mapping[str, DataFrame | Change]:
    vehicle, account = load.tables.read("vehicle"), load.tables.read("account")
    return {"bill_archive": legacy.receipt_bills(load.receipts(), vehicle).filter("ix_yrmo IS NOT NULL"),
            "payment": legacy.receipt_payments(load.receipts(), vehicle, account).filter("ix_yrmo IS NOT NULL")}


def _orders(load: Load) -> Mapping[str, DataFrame | Change]:
    orders = durable(legacy.orders(load.changes(), load.tables.read("vehicle")))
    return {"service_order": orders, "order_item": legacy.order_items(orders)}


def _lists(load: Load) -> Mapping[str, DataFrame | Change]:
    """Worker locations and names from the lists made by hand."""
    worker, account = load.tables.read("worker"), load.tables.read("account")
    places = load.extracts.get("assignment", load.spark.createDataFrame([], ASSIGNMENTS))
    names = load.extracts.get("name", load.spark.createDataFrame([], NAMES))
    return {"worker_location": legacy.worker_locations(places, worker).filter("uid IS NOT NULL"),
            "account": durable(legacy.renamed_workers(account, names, worker))}


STAGES: list[tuple[str, Stage]] = [
    ("reference", _reference), ("system", _system), ("staff", _staff), ("workers", _workers), ("employees", _employees), ("links", _links),
    ("customer_accounts", _customer_accounts), ("customers", _customers), ("places", _places), ("vehicles", _vehicles), ("receipts", _receipts),
    ("orders", _orders), ("lists", _lists),
]


def load(spark: SparkSession, root: str, extracts: Mapping[str, DataFrame], name: str, now: dt.datetime) -> list[str]:
    """Run the stages of load `name` that are not published yet; their names.

    `extracts`: car, change, receipt, worker, staff, house, plan (see `sources.legacy`), and, where there are such,
    receipt_old, assignment and name.
    """
    rows = Snapshot(spark, root).read("load_stage").filter(F.col("load_name") == name).collect()  # one for each stage
    done, ran = {r.stage for r in rows}, []
    for number, (stage, make) in enumerate(STAGES):
        if stage in done:
            continue
        at = now + dt.timedelta(microseconds=number)
        mark = spark.createDataFrame([(name, stage, at)], "load_name string, stage string, done_dtm timestamp_ntz")
        # a lost attempt has left files of its version behind, so every attempt has a version of its own
        attempt = spark.sql("SELECT uuid() AS u").first().u
        publish({**make(Load(spark, root, extracts)), "load_stage": Change(mark, added=True)}, root, f"{name}-{stage}-{attempt}", at)
        ran.append(stage)
    return ran
