"""Clean legacy extracts and load them into the data model.

Legacy tables use the snake-case form of their source columns without the table
prefix (see sources.legacy).  Ids are numbered over a business key plus an offset,
so a rerun gives the same ids.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import ordered, text
from curbledger.functions.calendar import yrmo
from curbledger.session import stored

# Fixed values of the load.
EPOCH = dt.date(1970, 1, 1)
STAFF_SINCE = dt.date(2021, 1, 1)  # fixed value: office staff have no dates of their own
LOADER = "SYSMIG"
HKID = "A1234567"  # fixed value: stands for an identity card that is not known
OWNER_NAME = "車主"
STAFF_ROLE = {1: "VIEWER", 2: "OPERATOR", 3: "ADMIN"}
NOT_EMPLOYED = ("ADMIN", "SYSTEM", "CUSTOMER")
WORKER_RATES = {"bonus_a": 400, "bonus_b": 300, "bonus_c": 200, "bonus_extra": 100}
FALLBACK_SALARY = {"A": 180, "B": 140, "C": 90}
SOURCE_CODE = {"新": 1, "工": 2, "優": 3}
PAYMENT_CODE = {"A": "A", "B": "T", "C": "Q", "D": "C"}
ORDER_DONE, ORDER_PLAN, ORDER_ITEM = 12, "X", 7
PHONE_CONTACT = 10
MONEY = "decimal(15,2)"

WIDE_COLUMNS = ("house_code", "worker_code")
DIGIT_COLUMNS = ("car_type", "change_item", "servicedate1", "servicedate2", "servicedate3")


def _choose(value: Column, table: dict, default) -> Column:
    out = F.lit(default)
    for key, code in table.items():
        out = F.when(value == key, code).otherwise(out)
    return out


def _last(order: Column, *columns: str) -> Column:
    """The columns of the row with the largest `order` (ties: largest values)."""
    return F.max(F.struct(order.alias("_order"), *columns))


def normalized(records: DataFrame) -> DataFrame:
    """Records with plain upper-case plates, codes and digits, and unpadded company codes."""
    have = set(records.columns)
    changes = {"car_number": text.plate(F.col("car_number"))}
    if "company_code" in have:
        changes["company_code"] = F.rtrim("company_code")
    changes.update({c: text.narrow(F.col(c)) for c in WIDE_COLUMNS if c in have})
    changes.update({c: text.narrow_digits(F.col(c).cast("string")) for c in DIGIT_COLUMNS if c in have})
    return records.withColumns(changes)


def with_plate(records: DataFrame) -> DataFrame:
    """Records that name a plate."""
    return records.filter(F.rtrim("car_number") != "")


def backfilled(receipts: DataFrame, older: DataFrame, until_year: int = 2015, before: dt.date = dt.date(2018, 1, 1)) -> DataFrame:
    """Receipts, with the older system's ones added if there is none up to `until_year`."""
    has_old = receipts.filter(F.col("pay_year") <= until_year).exists()
    return receipts.unionByName(older.filter((F.col("pay_date") < F.lit(before)) & ~has_old))


# staff and workers

def staff_accounts(staff: DataFrame) -> DataFrame:
    return staff.filter(F.col("status_code") == "00").select(
        F.lower("userid").alias("login_name"),
        F.when(F.rtrim("user_name") == "", F.col("userid")).otherwise(F.col("user_name")).alias("display_name"),
        _choose(F.col("authorization"), STAFF_ROLE, "OTHER").alias("role"),
        F.lit(True).alias("active"), F.lit(STAFF_SINCE).alias("create_dtm"), F.lit(STAFF_SINCE).alias("mod_dtm"),
        F.lit(LOADER).alias("mod_by"), F.lit(None).cast("string").alias("remarks"),
    )


def worker_accounts(workers: DataFrame, changes: DataFrame) -> DataFrame:
    """Workers of the master list and worker codes seen only in the change records."""
    code = lambda c: text.match_key(F.col(c))
    seen = changes.select(F.col("worker_code").alias("_seen")).withColumn("_key", code("_seen"))
    seen = seen.groupBy("_key").agg(F.min("_seen").alias("_seen"))
    master = workers.withColumn("_code", code("worker_code"))
    both = master.join(seen, F.col("_code") == F.col("_key"), "full").withColumn(
        "cd", F.coalesce("worker_code", "_seen")
    )
    return both.filter(F.rtrim("cd") != "").select(
        F.lower(F.trim("cd")).alias("login_name"),
        F.coalesce("worker_name", F.lit("no-record")).alias("display_name"),
        F.lit("WORKER").alias("role"),
        F.coalesce(F.col("status_code") == "00", F.lit(False)).alias("active"),
        F.lit(EPOCH).alias("create_dtm"),
        F.coalesce("update_date", F.lit(EPOCH)).alias("mod_dtm"),
        F.coalesce("user_id", F.lit(LOADER)).alias("mod_by"),
        F.col("worker_dept").alias("remarks"),
    )


def with_ids(accounts: DataFrame, offset: int = 0) -> DataFrame:
    """Accounts numbered in login order, after `offset`."""
    numbered = ordered.row_number(accounts, [], ["login_name"], "_no")
    return numbered.withColumn("id", F.col("_no") + offset).drop("_no")


def largest_id(accounts: DataFrame) -> int:
    """The largest id given so far: later accounts go on from it."""
    return accounts.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]


def worker_rows(accounts: DataFrame, workers: DataFrame) -> DataFrame:
    """Worker rows with default rates; type A where the master list says so."""
    day_workers = workers.filter(text.match_key(F.col("type")) == "A").select(
        text.match_key(F.col("worker_code")).alias("worker_code")
    ).distinct().withColumn("_a", F.lit("A"))
    rows = accounts.filter(F.col("role") == "WORKER").select(
        F.col("id").alias("uid"), F.upper("login_name").alias("worker_code"),
        *[F.lit(v).alias(k) for k, v in WORKER_RATES.items()],
    )
    return rows.join(day_workers, "worker_code", "left").withColumn(
        "work_type", F.coalesce("_a", F.lit(""))
    ).drop("_a")


def employee_rows(accounts: DataFrame) -> DataFrame:
    """Employees: every account, of staff and workers alike, that is not an administrator, system or customer."""
    return accounts.filter(~F.col("role").isin(*NOT_EMPLOYED)).select(
        F.col("id").alias("uid"), F.col("create_dtm").alias("employ_dtm"), "create_dtm", "mod_dtm", "mod_by", F.lit(HKID).alias("hkid")
    )


def worker_contacts(workers: DataFrame, accounts: DataFrame) -> DataFrame:
    """Phone numbers of workers, one row each (equal numbers of one worker stay)."""
    numbers = workers.filter(F.rtrim("phone") != "").select(
        text.match_key(F.col("worker_code")).alias("_key"), F.trim("worker_name").alias("c_name"),
        F.explode(text.worker_phones(F.col("phone"))).alias("c_num"),
    )
    ids = accounts.select(F.col("id").alias("uid"), text.match_key(F.col("login_name")).alias("_key"))
    return numbers.join(ids, "_key").select("uid", F.lit(PHONE_CONTACT).alias("c_type"), "c_name", "c_num")


# customer contacts

def contact_candidates(changes: DataFrame, cars: DataFrame) -> DataFrame:
    """Plate, name and phone text from the change records, and from the master list
    for plates without any change record; a master row without a plate is none.  The text
    ends in a mark."""
    mark = lambda c: F.concat(F.coalesce(F.col(c), F.lit("")), F.lit("#")).alias("c_num")
    history = stored(with_plate(changes).select(
        F.col("car_number").alias("cd_license"), F.trim(F.coalesce("customer_name", F.lit(""))).alias("c_name"),
        mark("customer_phone"),
    ).distinct())
    master = cars.filter(F.col("car_number").isNotNull()).select(
        F.col("car_number").alias("cd_license"), F.coalesce("customer_name", F.lit("")).alias("c_name"),
        mark("customer_phone"),
    ).distinct()
    return history.unionByName(master.join(history.select("cd_license").distinct(), "cd_license", "left_anti"))


def split_contacts(candidates: DataFrame) -> DataFrame:
    """One row per plate, name and number; blanks inside numbers dropped."""
    return candidates.select(
        F.trim("cd_license").alias("cd_license"), "c_name",
        F.explode(text.customer_phones(F.col("c_num"))).alias("c_num"),
    ).withColumn("c_num", F.replace("c_num", F.lit(" "), F.lit(""))).distinct()


def without_blank(contacts: DataFrame) -> DataFrame:
    """Contacts without the blank numbers of plates that have another one."""
    phoned = contacts.filter(F.col("c_num") != "").select("cd_license").distinct()
    blank = contacts.filter(F.col("c_num") == "").join(phoned, "cd_license", "left_anti")
    return contacts.filter(F.col("c_num") != "").unionByName(blank)


# customers

def customer_accounts(contacts: DataFrame, cars: DataFrame, changes: DataFrame) -> DataFrame:
    """One account per login: first and last service dates, and the latest editor.

    Change records count for plates that are not in the master list.
    """
    columns = ["car_number", "start_date", "change_item_date", "user_id"]
    history = changes.join(cars.select("car_number").distinct(), "car_number", "left_anti")
    moves = cars.select(*columns).unionByName(history.select(*columns))
    latest = F.coalesce("change_item_date", "start_date")
    plates = contacts.select("cd_license", "login_name").distinct()
    dated = (
        moves.withColumnRenamed("car_number", "cd_license").join(plates, "cd_license").groupBy("login_name")
        .agg(
            F.min("start_date").alias("create_dtm"), F.max(latest).alias("mod_dtm"),
            _last(latest, "user_id")["user_id"].alias("mod_by"),
        )
    )
    named = contacts.groupBy("login_name").agg(
        F.min("c_name").alias("_name"), F.min("cd_license").alias("_plate")
    )
    return named.join(dated, "login_name").select(
        "login_name", F.when(F.coalesce(F.rtrim("_name"), F.lit("")) == "", F.col("_plate")).otherwise(F.col("_name")).alias("display_name"),
        F.lit("CUSTOMER").alias("role"), F.lit(True).alias("active"), "create_dtm", "mod_dtm", "mod_by",
    )


def with_customer_ids(contacts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contacts with the account id of their login; it stays NULL where none was made."""
    ids = accounts.filter(F.col("role") == "CUSTOMER").select("login_name", F.col("id").alias("uid"))
    return contacts.join(ids, "login_name", "left")


def customer_rows(accounts: DataFrame, contacts: DataFrame, cars: DataFrame) -> DataFrame:
    """Customers with the payment flags of their latest master record."""
    plates = contacts.select("cd_license", "uid").distinct()
    flags = ["month_end_yn", "reminder_yn", "transfer_yn"]
    latest = cars.withColumnRenamed("car_number", "cd_license").join(plates, "cd_license").groupBy("uid").agg(
        _last(F.coalesce("change_item_date", "start_date"), "user_id", *flags).alias("s")
    )
    flag = lambda c: F.coalesce(F.col(f"s.{c}").cast("boolean"), F.lit(False))
    return accounts.filter(F.col("role") == "CUSTOMER").join(latest, F.col("id") == F.col("uid"), "left").select(
        "id", F.col("create_dtm").alias("last_reunion"), F.lit(None).cast("date").alias("last_payment"),
        F.lit(0).cast(MONEY).alias("balance"), flag("month_end_yn").alias("is_mobill"),
        flag("reminder_yn").alias("is_print_bill"), flag("transfer_yn").alias("is_rtn_envelope"), "mod_dtm", "mod_by",
    )


def customer_contacts(contacts: DataFrame) -> DataFrame:
    """One phone contact per customer and number."""
    return contacts.filter(F.col("c_num") != "").groupBy("uid", "c_num").agg(
        F.coalesce(F.max(F.trim("c_name")), F.lit(OWNER_NAME)).alias("c_name")
    ).withColumn("c_type", F.lit(PHONE_CONTACT))


# locations and plans

def _house_number(code: Column) -> Column:
    return (
        F.when(F.left(code, F.lit(1)) == "1", code).when(F.left(code, F.lit(1)) == "9", F.lit("1"))
        .otherwise(F.right(code, F.lit(2))).cast("int")
    )


def locations(houses: DataFrame) -> DataFrame:
    """Service locations from house codes."""
    code = F.col("house_code")
    rows = houses.select(
        F.when(code == "999", F.lit("X")).otherwise(F.col("location_code")).alias("srv_dis"),
        _house_number(code).alias("srv_loc"), F.coalesce("house_name_chn", F.lit("")).alias("name_zh"),
        F.coalesce("house_name_eng", F.lit("")).alias("name_en"), F.trim("car_team").alias("cd_fleet"),
    )
    return rows.groupBy("srv_dis", "srv_loc").agg(
        F.max("name_zh").alias("name_zh"), F.max("name_en").alias("name_en"),
        F.coalesce(F.max("cd_fleet"), F.lit("")).alias("cd_fleet"),
    ).withColumn("mgt_dis", F.col("srv_dis"))


def missing_locations(known: DataFrame) -> DataFrame:
    """Numbers from 1 to the district's largest that no location has yet."""
    all_numbers = known.groupBy("srv_dis").agg(F.max("srv_loc").alias("_top")).select(
        "srv_dis", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_top"), F.lit(1)))).alias("srv_loc")
    )
    gaps = all_numbers.join(known.select("srv_dis", "srv_loc").distinct(), ["srv_dis", "srv_loc"], "left_anti")
    blank = F.lit("")
    return gaps.select(
        "srv_dis", "srv_loc", blank.alias("name_zh"), blank.alias("name_en"), blank.alias("cd_fleet"),
        F.col("srv_dis").alias("mgt_dis"),
    )


def with_commission(location: DataFrame, commission: DataFrame) -> DataFrame:
    """Locations with the commission flag set for the listed ones."""
    listed = commission.select("srv_dis", "srv_loc").distinct().withColumn("_on", F.lit(True))
    return location.join(listed, ["srv_dis", "srv_loc"], "left").withColumn(
        "lhs_cmr", F.coalesce("_on", F.lit(False))
    ).drop("_on")


def worker_locations(assignments: DataFrame, worker_table: DataFrame) -> DataFrame:
    """Manual worker-location list (worker_code, srv_dis, srv_loc, srv_floor) with worker ids."""
    ids = worker_table.select("uid", text.match_key(F.col("worker_code")).alias("_key"))
    return assignments.withColumn("_key", text.match_key(F.col("worker_code"))).join(ids, "_key", "left").select(
        "uid", "srv_dis", "srv_loc", "srv_floor", F.lit(0).alias("work_type"),
        F.lit(dt.date(2022, 1, 1)).alias("create_dtm"), F.lit(LOADER).alias("mod_by"),
    )


def renamed_workers(accounts: DataFrame, names: DataFrame, worker_table: DataFrame) -> DataFrame:
    """Accounts with display names from a manual list (worker_code, display_name)."""
    ids = worker_table.select(F.col("uid").alias("id"), text.match_key(F.col("worker_code")).alias("_key"))
    listed = names.select(text.match_key(F.col("worker_code")).alias("_key"), F.col("display_name").alias("_name"))
    given = listed.join(ids, "_key").groupBy("id").agg(F.max("_name").alias("_name"))
    return accounts.join(given, "id", "left").withColumn(
        "display_name", F.coalesce("_name", "display_name")
    ).drop("_name")


def service_plans(plans: DataFrame) -> DataFrame:
    """Price rows of active plans A to C; a zero salary gets the default of its plan."""
    first = F.left("house_code", F.lit(1))
    price = F.col("worker_service_price")
    default = F.lit(None).cast("int")
    for plan, value in FALLBACK_SALARY.items():
        default = F.when(F.col("plan_code") == plan, value).otherwise(default)
    active = plans.filter(
        (F.col("status_code") == "00") & (F.rtrim("house_code") != "")
        & F.col("car_type").isin("1", "2", "3") & F.col("plan_code").isin("A", "B", "C")
    )
    return active.select(
        F.when(first == "1", F.lit("K")).when(first == "9", F.lit("X")).otherwise(first).alias("srv_dis"),
        _house_number(F.col("house_code")).alias("srv_loc"), F.col("company_code").alias("company"),
        F.col("plan_code").alias("cd_plan"), F.col("car_type").cast("int").alias("vh_type"),
        F.col("service_price").cast(MONEY).alias("price"),
        F.when(price == 0, default).otherwise(price).cast(MONEY).alias("salary"),
        F.col("updatedate").alias("effect"), F.col("updatedate").alias("create_dtm"), F.col("user_id").alias("create_by"),
    )


# vehicles

def vehicles(contacts: DataFrame, cars: DataFrame, changes: DataFrame) -> DataFrame:
    """Vehicles per owner with the attributes of the latest record.

    A plate that is only in the change records takes, per attribute, the newest value
    that is not NULL; its first change date counts as start, its newest start date as change.
    """
    fields = ["car_type", "customer_source", "car_color", "user_id", "remark"]
    latest = F.coalesce("change_item_date", "start_date")
    master = cars.groupBy("car_number").agg(
        F.min("start_date").alias("create_dtm"), F.max(latest).alias("mod_dtm"), _last(latest, *fields).alias("s")
    ).select("car_number", "create_dtm", "mod_dtm", *[F.col(f"s.{c}").cast("string").alias(c) for c in fields])

    def newest(name: str) -> Column:
        keep = F.when(F.col(name).isNotNull(), F.struct("change_fm_date", name))
        return F.max(keep)[name].alias(name)

    history = changes.join(cars.select("car_number").distinct(), "car_number", "left_anti")
    only = history.groupBy("car_number").agg(
        F.min("change_fm_date").alias("create_dtm"), F.max("change_fm_date").alias("_changed"),
        newest("start_date"), *[newest(c) for c in fields],
    ).select(
        "car_number", "create_dtm", F.coalesce("start_date", "_changed").alias("mod_dtm"),
        *[F.col(c).cast("string").alias(c) for c in fields],
    )
    owners = contacts.select(F.col("uid").alias("owner_id"), "cd_license").distinct()
    merged = master.unionByName(only).withColumnRenamed("car_number", "cd_license")
    return owners.join(merged, "cd_license").select(
        "cd_license", "owner_id", F.col("car_type").cast("int").alias("vh_type"),
        _choose(F.trim("customer_source"), SOURCE_CODE, 0).alias("source"),
        F.nullif(F.trim("car_color"), F.lit("")).alias("brand"),
        F.coalesce("create_dtm", F.lit(EPOCH)).alias("create_dtm"), "mod_dtm",
        F.col("user_id").alias("mod_by"), F.col("remark").alias("remarks"),
    )


# receipts

def receipt_bills(receipts: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Paid bills: receipts summed per plate, company and month, numbered per payment month."""
    rec, discount = F.col("pay_rec_amount"), F.col("pay_discount")
    usable = receipts.filter(
        F.col("pay_type").isNotNull() & F.col("pay_year").isNotNull() & F.col("pay_month").isNotNull()
        & rec.isNotNull() & ~((rec == 0) & (discount == 0))
    )
    summed = usable.groupBy("car_number", "company_code", "pay_year", "pay_month").agg(
        F.sum("pay_rec_amount").cast(MONEY).alias("rec"), F.sum("pay_discount").cast(MONEY).alias("discount"),
        F.max("pay_date").alias("pay_date"),
    )
    owned = summed.join(
        vehicle.select(F.col("cd_license").alias("car_number"), F.col("owner_id").alias("uid")), "car_number"
    ).withColumn("iv_ix", yrmo(F.col("pay_date")))
    numbered = ordered.row_number(
        owned, ["company_code", "uid", "iv_ix"], ["car_number", "pay_date", "pay_year", "pay_month"], "iv_seq"
    )
    start = F.make_date(F.col("pay_year").cast("int"), F.col("pay_month").cast("int"), F.lit(1))
    return numbered.select(
        F.trim("company_code").alias("company"), yrmo(start).alias("ix_yrmo"), "uid",
        F.col("car_number").alias("cd_license"), F.lit(1).alias("bill_type"), F.col("pay_date").alias("create_dtm"),
        (F.col("rec") + F.col("discount")).cast(MONEY).alias("amount"), "discount", start.alias("bill_start"),
        F.last_day(start).alias("bill_end"), F.last_day(start).alias("due_dtm"), "iv_ix", "iv_seq",
    )


def receipt_payments(receipts: DataFrame, vehicle: DataFrame, accounts: DataFrame) -> DataFrame:
    """Payments: receipts merged per number, then per equal record, numbered per payer-month."""
    merged = receipts.filter((F.col("pay_rec_amount") > 0) & F.col("pay_no").isNotNull()).groupBy(
        "car_number", "pay_type_detail", "company_code", "pay_no"
    ).agg(
        F.max("pay_date").alias("transfer_dtm"), F.max("pay_update_date").alias("create_dtm"),
        F.max("pay_type").alias("_type"), F.max(F.coalesce("pay_user_id", F.lit(""))).alias("create_by"),
        F.sum("pay_rec_amount").alias("amount"), F.max("pay_remark").alias("remarks"),
    )
    payer = vehicle.select(F.col("cd_license").alias("car_number"), F.col("owner_id").alias("uid"))
    name = accounts.select(F.col("id").alias("uid"), F.col("display_name").alias("cust_name"))
    record = ["company", "cd_license", "ix_yrmo", "uid", "cust_name", "_type", "ref_code", "transfer_dtm", "create_dtm", "create_by", "remarks"]
    joined = merged.join(payer, "car_number").join(name, "uid").withColumns({
        "company": F.col("company_code"), "cd_license": F.col("car_number"),
        "ix_yrmo": yrmo(F.col("transfer_dtm")), "ref_code": F.col("pay_type_detail"),
    })
    equal = joined.groupBy(*record).agg(F.sum("amount").cast(MONEY).alias("amount"))
    ties = ["company", "transfer_dtm", "_type", "ref_code", "create_by", "remarks"]
    numbered = ordered.row_number(equal, ["ix_yrmo", "uid"], ["create_dtm", "cd_license", *ties], "useq")
    return numbered.withColumn("payment_type", _choose(F.col("_type"), PAYMENT_CODE, "0")).drop("_type").withColumns({
        "mod_dtm": F.col("create_dtm"), "mod_by": F.lit(LOADER),
    })


# orders

def orders(changes: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Ad-hoc orders from change records of the order plan, numbered by date, plate and amount."""
    owner = vehicle.select(F.col("cd_license").alias("car_number"), F.col("owner_id").alias("cust_id"))
    rows = changes.filter(F.col("plan_code") == ORDER_PLAN).join(owner, "car_number").select(
        F.trim("company_code").alias("company"), "cust_id", F.col("car_number").alias("cd_license"),
        F.lit(ORDER_DONE).alias("o_status"), F.lit("C").alias("payment_type"),
        F.col("service_price").cast(MONEY).alias("payment_amount"), F.col("change_fm_date").alias("order_dtm"),
        F.col("update_date").alias("create_dtm"), F.col("update_date").alias("mod_dtm"), F.col("user_id").alias("mod_by"),
    )
    order = ["order_dtm", "cd_license", "payment_amount", "company", "cust_id", "create_dtm", "mod_by"]
    return ordered.row_number(rows, [], order, "id").withColumn("ix_yrmo", yrmo(F.col("order_dtm")))


def order_items(order: DataFrame) -> DataFrame:
    """One line per order."""
    return order.select(
        F.col("id").alias("oid"), F.lit(ORDER_ITEM).alias("item_id"), F.lit(1).alias("qty"),
        F.col("payment_amount").alias("unit_price"), F.lit(0).cast(MONEY).alias("discount"),
    )
