"""Constraint audit: primary keys, foreign keys, unique and filtered unique keys, in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Unique(NamedTuple):
    """`columns` must be unique, among the rows where `where` holds."""

    name: str
    table: str
    columns: Sequence[str]
    where: str | None = None


class Reference(NamedTuple):
    """`columns` must be found in `parent` under `parent_columns`, if none is NULL."""

    name: str
    table: str
    columns: Sequence[str]
    parent: str
    parent_columns: Sequence[str]


# The declared constraints of the data model.
CONSTRAINTS: list[Unique | Reference] = [
    Unique("pk_config", "system_config", ["dict_key", "grp_key", "c_value1"]),
    Unique("pk_location", "service_location", ["srv_dis", "srv_loc"]),
    Unique("pk_plan", "service_plan", ["srv_dis", "srv_loc", "cd_plan", "vh_type", "effect", "company"]),
    Reference("fk_plan_location", "service_plan", ["srv_dis", "srv_loc"], "service_location", ["srv_dis", "srv_loc"]),
    Unique("pk_account", "account", ["id"]),
    Unique("uq_account_login", "account", ["login_name"], "login_name IS NOT NULL"),
    Reference("fk_contact_account", "contact", ["uid"], "account", ["id"]),
    Unique("pk_customer", "customer", ["id"]),
    Reference("fk_customer_account", "customer", ["id"], "account", ["id"]),
    Unique("pk_employee", "employee", ["uid"]),
    Reference("fk_employee_account", "employee", ["uid"], "account", ["id"]),
    Reference("fk_employee_supervisor", "employee", ["supervisor"], "employee", ["uid"]),
    Unique("pk_contract", "employee_contract", ["uid", "start_dtm"]),
    Reference("fk_contract_account", "employee_contract", ["uid"], "account", ["id"]),
    Unique("pk_worker", "worker", ["uid"]),
    Reference("fk_worker_account", "worker", ["uid"], "account", ["id"]),
    Unique("pk_worker_location", "worker_location", ["uid", "srv_dis", "srv_loc"]),
    Reference("fk_worker_location_account", "worker_location", ["uid"], "account", ["id"]),
    Reference("fk_worker_location", "worker_location", ["srv_dis", "srv_loc"], "service_location", ["srv_dis", "srv_loc"]),
    Unique("pk_leave", "leave", ["leave_dtm", "uid"]),
    Reference("fk_leave_account", "leave", ["uid"], "account", ["id"]),
    Unique("pk_vehicle", "vehicle", ["cd_license", "owner_id"]),
    Reference("fk_vehicle_account", "vehicle", ["owner_id"], "account", ["id"]),
    Reference("fk_service_vehicle", "vehicle_service", ["cd_license", "owner_id"], "vehicle", ["cd_license", "owner_id"]),
    Reference("fk_service_location", "vehicle_service", ["srv_dis", "srv_loc"], "service_location", ["srv_dis", "srv_loc"]),
    Reference("fk_service_worker", "vehicle_service", ["worker"], "account", ["id"]),
    Unique("uq_open_service", "vehicle_service", ["cd_license", "company"], "end_dtm IS NULL"),
    Unique("pk_service_group", "unit_service_group", ["id"]),
    Reference("fk_service_group_parent", "unit_service_group", ["parent_id"], "unit_service_group", ["id"]),
    Unique("pk_unit_service", "unit_service", ["id"]),
    Reference("fk_unit_service_group", "unit_service", ["srv_grp"], "unit_service_group", ["id"]),
    Unique("pk_order", "service_order", ["ix_yrmo", "id"]),
    Unique("uq_order", "service_order", ["id"]),
    Reference("fk_order_customer", "service_order", ["cust_id"], "customer", ["id"]),
    Reference("fk_item_order", "order_item", ["oid"], "service_order", ["id"]),
    Reference("fk_item_service", "order_item", ["item_id"], "unit_service", ["id"]),
    Unique("pk_suspended", "suspended_service", ["cd_license", "company", "end_dtm"]),
    Reference("fk_bill_account", "bill", ["uid"], "account", ["id"]),
    Unique("pk_payment", "payment", ["ix_yrmo", "uid", "useq", "part"]),
    Unique("pk_print_config", "print_config", ["company", "print_id"]),
    Unique("pk_send_log", "invoice_send_log", ["cd_license", "id"]),
]


TASK_ROWS = 250_000  # rows whose keys a task sums up before the shuffle


def _key(columns: Sequence[str], kinds: Mapping[str, str]) -> Column:
    """A key as text values: without regard to case and trailing blanks, as the model's collation compares."""
    value = lambda c: F.upper(F.rtrim(F.col(c))) if kinds[c].startswith(("string", "char", "varchar")) else F.col(c).cast("string")
    return F.array(*[value(c) for c in columns])


def _given(tables: Mapping[str, DataFrame], c: Unique | Reference) -> bool:
    if c.table not in tables or not set(c.columns) <= set(tables[c.table].columns):
        return False
    return isinstance(c, Unique) or (c.parent in tables and set(c.parent_columns) <= set(tables[c.parent].columns))


def _spread(tables: Mapping[str, DataFrame], known: Sequence[Unique | Reference], most: int) -> dict[str, DataFrame]:
    """The tables with the columns that constraints name; large ones dealt over tasks of about `most` rows.

    A task sums up its keys in memory, so its rows are bounded, whatever the size of the files.
    """
    used = {name: [x for x in rows.columns if any(
        (c.table == name and (x in c.columns or x in (getattr(c, "where", None) or ""))) or (isinstance(c, Reference) and c.parent == name and x in c.parent_columns)
        for c in known)] for name, rows in tables.items()}
    slim = {name: rows.select(*used[name]) for name, rows in tables.items() if used[name]}
    sizes = reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in slim.items()]).collect()
    for name, n in sizes:
        if n > most:
            slim[name] = slim[name].repartition(-(-n // most), F.xxhash64(*used[name]))
    return slim


def _entries(name: str, rows: DataFrame, constraints: Sequence[Unique | Reference]) -> DataFrame | None:
    """What one scan of a table has to say to the constraints: constraint, key, 1 for a row under it, 1 for a parent."""
    kinds = dict(rows.dtypes)
    entry = lambda c, key, holds, n, parents: F.when(holds, F.struct(
        F.lit(c.name).alias("constraint_name"), key.alias("key"), F.lit(n).cast("long").alias("n"), F.lit(parents).cast("long").alias("parents")))
    found = []
    for c in constraints:
        if c.table == name and isinstance(c, Unique):
            found.append(entry(c, _key(c.columns, kinds), F.expr(c.where) if c.where else F.lit(True), 1, 0))
        elif c.table == name:
            found.append(entry(c, _key(c.columns, kinds), reduce(Column.__and__, [F.col(x).isNotNull() for x in c.columns]), 1, 0))
        if isinstance(c, Reference) and c.parent == name:
            found.append(entry(c, _key(c.parent_columns, kinds), F.lit(True), 0, 1))
    if not found:
        return None
    return rows.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*")


def constraint_audit(
    tables: Mapping[str, DataFrame], constraints: Sequence[Unique | Reference] = CONSTRAINTS, most: int = TASK_ROWS
) -> DataFrame:
    """Violations of all constraints whose tables and columns are given: constraint_name, key, n (rows of the key).

    Every table is counted and then scanned once, whatever number of constraints it takes part in, and all keys
    meet in one aggregation, which sums up the keys of at most about `most` rows in a task before the shuffle.
    """
    known = [c for c in constraints if _given(tables, c)]
    if not known:
        raise ValueError("no constraint applies to the given tables")
    parts = [p for name, rows in _spread(tables, known, most).items() if (p := _entries(name, rows, known)) is not None]
    counted = reduce(DataFrame.unionByName, parts).groupBy("constraint_name", "key").agg(F.sum("n").alias("n"), F.sum("parents").alias("parents"))
    unique = F.col("constraint_name").isin([c.name for c in known if isinstance(c, Unique)])
    text = F.concat_ws("|", F.transform("key", lambda k: F.coalesce(k, F.lit("NULL"))))
    return counted.filter((unique & (F.col("n") > 1)) | (~unique & (F.col("n") > 0) & (F.col("parents") == 0))).select(
        "constraint_name", text.alias("key"), "n")
