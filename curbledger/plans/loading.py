"""Registered queries of the legacy load: clean, link, number, and audit."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.operators import identity, legacy, quality
from curbledger.plans.catalog import Query, Tables
from curbledger.session import durable, stored
from curbledger.sources import seed

CONTACT_VIEWS = ("legacy_car", "legacy_change", "legacy_worker")


class Loaded:
    """Stages of one load, made on first use."""

    def __init__(self, t: Tables) -> None:
        self.t = t

    @cached_property
    def cars(self) -> DataFrame:
        return legacy.normalized(self.t.legacy_car)

    @cached_property
    def changes(self) -> DataFrame:
        return legacy.with_plate(legacy.normalized(self.t.legacy_change))

    @cached_property
    def receipts(self) -> DataFrame:
        return legacy.normalized(self.t.legacy_receipt)

    @cached_property
    def candidates(self) -> DataFrame:
        return legacy.contact_candidates(self.changes, self.cars)

    @cached_property
    def contacts(self) -> DataFrame:
        return stored(legacy.without_blank(stored(legacy.split_contacts(self.candidates))))

    @cached_property
    def logins(self) -> DataFrame:
        owners, _ = identity.link_owners(identity.link_rows(self.contacts))
        return stored(identity.login_names(identity.customer_groups(self.contacts, owners)))

    @cached_property
    def accounts(self) -> DataFrame:
        return durable(legacy.with_ids(
            legacy.customer_accounts(self.logins, self.cars, self.changes), legacy.largest_id(_workers(self.t))))

    @cached_property
    def owned(self) -> DataFrame:
        return legacy.with_customer_ids(self.logins, self.accounts)

    @cached_property
    def vehicles(self) -> DataFrame:
        return legacy.vehicles(self.owned, self.cars, self.changes)


class Households:
    """Plates linked by the phones of the household extract."""

    def __init__(self, t: Tables) -> None:
        self.contacts = legacy.without_blank(legacy.split_contacts(t.legacy_phone))
        self.rows = identity.link_rows(self.contacts)


NORMAL_SQL = """
car AS (
  SELECT * REPLACE (replace(translate(upper(car_number), 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９',
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'), ' ', '') AS car_number,
    translate(upper(house_code), 'ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ０１２３４５６７８９', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789') AS house_code,
    translate(upper(car_type), '０１２３４５６７８９', '0123456789') AS car_type, rtrim(company_code) AS company_code)
  FROM legacy_car),
change AS (
  SELECT * REPLACE (replace(upper(car_number), ' ', '') AS car_number, rtrim(company_code) AS company_code, upper(worker_code) AS worker_code)
  FROM legacy_change WHERE car_number <> '')"""


def peel_sql(source: str) -> str:
    """Phone texts of `source`(cd_license, c_name, c_num) taken apart piece by piece."""
    run = "[0-9]{8}[0-9 ]*"
    piece = f"CASE WHEN regexp_matches(t, '[0-9]{{8}}') THEN regexp_extract(t, '{run}') ELSE regexp_extract(t, '^[0-9 ]*') END"
    return f"""
peel AS (
  SELECT cd_license, c_name, {piece.replace('(t', '(c_num')} AS piece,
    replace(c_num, {piece.replace('(t', '(c_num')}, '') AS rest FROM {source}
  UNION ALL
  SELECT cd_license, c_name, {piece.replace('(t', '(rest')}, replace(rest, {piece.replace('(t', '(rest')}, '')
  FROM peel WHERE regexp_matches(rest, '[0-9]{{8}}')),
split AS (SELECT DISTINCT trim(cd_license) AS cd_license, c_name, replace(piece, ' ', '') AS c_num FROM peel),
contact_t AS (SELECT * FROM split WHERE c_num <> '' OR cd_license NOT IN (SELECT cd_license FROM split WHERE c_num <> ''))"""


CANDIDATE_SQL = NORMAL_SQL + """,
history AS (
  SELECT DISTINCT car_number AS cd_license, trim(coalesce(customer_name, '')) AS c_name, concat(coalesce(customer_phone, ''), '#') AS c_num FROM change),
candidate AS (
  SELECT * FROM history
  UNION ALL
  SELECT DISTINCT car_number, coalesce(customer_name, ''), concat(coalesce(customer_phone, ''), '#') FROM car
  WHERE car_number NOT IN (SELECT cd_license FROM history))"""

LINK_SQL = """
direct AS (
  SELECT DISTINCT a.cd_license AS major, b.cd_license AS minor FROM contact_t AS a JOIN contact_t AS b ON a.c_num = b.c_num
  WHERE a.cd_license < b.cd_license AND a.c_num <> '' AND a.c_name NOT LIKE '%管理處%' AND b.c_name NOT LIKE '%管理處%'),
linked AS (SELECT major, minor FROM direct UNION SELECT d.major, e.minor FROM direct AS d JOIN linked AS e ON d.minor = e.major),
ranks AS (SELECT major, count(*) AS reach, row_number() OVER (ORDER BY count(*), major) AS place FROM linked GROUP BY major),
member AS (
  SELECT major AS item, place, major FROM ranks
  UNION ALL SELECT l.minor, place, l.major FROM linked AS l JOIN ranks USING (major)),
owned AS (SELECT item AS plate, arg_max(major, place) AS owner FROM member GROUP BY item)"""

LOGIN_SQL = CANDIDATE_SQL + "," + peel_sql("candidate") + "," + LINK_SQL + """,
grouped AS (
  SELECT c.*, coalesce(owner, CASE WHEN c_num <> '' THEN cd_license END) AS owner FROM contact_t AS c LEFT JOIN owned ON plate = cd_license),
named AS (SELECT owner, min(c_num) AS login FROM grouped WHERE owner IS NOT NULL AND c_num <> '' AND c_name NOT LIKE '%管理處%' GROUP BY owner),
logged AS (SELECT g.*, login FROM grouped AS g LEFT JOIN named ON named.owner = g.owner),
numbered AS (SELECT cd_license, row_number() OVER (ORDER BY cd_license) AS no FROM (SELECT DISTINCT cd_license FROM logged WHERE login IS NULL)),
login_t AS (
  SELECT l.cd_license, c_name, c_num, l.owner, coalesce(login, 'CU' || CASE WHEN no < 100000 THEN right('00000' || no, 6) ELSE CAST(no AS VARCHAR) END) AS login_name
  FROM logged AS l LEFT JOIN numbered AS n ON l.cd_license = n.cd_license)"""

WORKER_ID_SQL = """
worker_login AS (
  SELECT lower(trim(coalesce(w.worker_code, c.worker_code))) AS login_name, coalesce(worker_name, 'no-record') AS display_name, 'WORKER' AS role,
    coalesce(status_code = '00', FALSE) AS active, DATE '1970-01-01' AS create_dtm, coalesce(update_date, DATE '1970-01-01') AS mod_dtm,
    coalesce(user_id, 'SYSMIG') AS mod_by, worker_dept AS remarks
  FROM legacy_worker AS w FULL JOIN (SELECT DISTINCT worker_code FROM change) AS c ON c.worker_code = upper(w.worker_code)
  WHERE coalesce(w.worker_code, c.worker_code) <> ''),
worker_id AS (SELECT *, row_number() OVER (ORDER BY login_name) AS id FROM worker_login)"""

WORKER_SQL = NORMAL_SQL + "," + WORKER_ID_SQL

ACCOUNT_SQL = LOGIN_SQL + "," + WORKER_ID_SQL + """,
visit AS (
  SELECT car_number AS cd_license, start_date, coalesce(change_item_date, start_date) AS day, user_id FROM car
  UNION ALL SELECT car_number, start_date, coalesce(change_item_date, start_date), user_id FROM change ANTI JOIN car USING (car_number)),
customer_t AS (
  SELECT login_name, coalesce(nullif(min(c_name), ''), min(l.cd_license)) AS display_name, min(start_date) AS create_dtm, max(day) AS mod_dtm,
    max({known: day IS NOT NULL, day: day, who: user_id}).who AS mod_by
  FROM login_t AS l JOIN visit USING (cd_license) GROUP BY login_name),
account_t AS (SELECT (SELECT coalesce(max(id), 0) FROM worker_id) + row_number() OVER (ORDER BY login_name) AS id, * FROM customer_t),
owner_t AS (SELECT l.*, id AS uid FROM login_t AS l LEFT JOIN account_t AS a ON a.login_name = l.login_name)"""

VEHICLE_SQL = ACCOUNT_SQL + """,
history_car AS (
  SELECT car_number, min(change_fm_date) AS create_dtm, max(change_fm_date) AS changed,
    arg_max(start_date, (change_fm_date, start_date)) FILTER (start_date IS NOT NULL) AS start_date,
    arg_max(car_type, (change_fm_date, car_type)) FILTER (car_type IS NOT NULL) AS car_type,
    arg_max(customer_source, (change_fm_date, customer_source)) FILTER (customer_source IS NOT NULL) AS customer_source,
    arg_max(car_color, (change_fm_date, car_color)) FILTER (car_color IS NOT NULL) AS car_color,
    arg_max(user_id, (change_fm_date, user_id)) FILTER (user_id IS NOT NULL) AS user_id,
    arg_max(remark, (change_fm_date, remark)) FILTER (remark IS NOT NULL) AS remark
  FROM change WHERE car_number NOT IN (SELECT car_number FROM car) GROUP BY car_number),
all_car AS (
  SELECT car_number, start_date AS create_dtm, coalesce(change_item_date, start_date) AS mod_dtm, car_type, customer_source, car_color, user_id, remark FROM car
  UNION ALL
  SELECT car_number, create_dtm, coalesce(start_date, changed), car_type::VARCHAR, customer_source, car_color, user_id, remark FROM history_car),
vehicle_t AS (
  SELECT cd_license, uid AS owner_id, car_type AS vh_type, CASE trim(customer_source) WHEN '新' THEN 1 WHEN '工' THEN 2 WHEN '優' THEN 3 ELSE 0 END AS source,
    CASE WHEN trim(car_color) = '' THEN NULL ELSE trim(car_color) END AS brand, coalesce(create_dtm, DATE '1970-01-01') AS create_dtm, mod_dtm,
    user_id AS mod_by, remark AS remarks
  FROM (SELECT DISTINCT cd_license, uid FROM owner_t) JOIN all_car ON car_number = cd_license)"""

LOCATION_SQL = """
house AS (
  SELECT CASE WHEN house_code = '999' THEN 'X' ELSE location_code END AS srv_dis,
    CAST(CASE left(house_code, 1) WHEN '1' THEN house_code WHEN '9' THEN '1' ELSE right(house_code, 2) END AS INTEGER) AS srv_loc,
    coalesce(house_name_chn, '') AS name_zh, coalesce(house_name_eng, '') AS name_en, trim(car_team) AS cd_fleet FROM legacy_house),
location_t AS (
  SELECT srv_dis, srv_loc, max(name_zh) AS name_zh, max(name_en) AS name_en, coalesce(max(cd_fleet), '') AS cd_fleet, srv_dis AS mgt_dis
  FROM house GROUP BY srv_dis, srv_loc)"""

PHONE_SQL = """
text AS (SELECT worker_code, worker_name, phone FROM legacy_worker WHERE phone <> ''),
phones AS (
  SELECT worker_code, worker_name, CASE WHEN regexp_matches(phone, '[0-9]') THEN regexp_extract(phone, '[0-9].{0,7}') ELSE left(phone, 7) END AS piece, phone AS whole FROM text),
peeled AS (
  SELECT worker_code, worker_name, piece, replace(whole, piece, '') AS rest FROM phones
  UNION ALL
  SELECT worker_code, worker_name, regexp_extract(rest, '[0-9].{0,7}'), replace(rest, regexp_extract(rest, '[0-9].{0,7}'), '')
  FROM peeled WHERE regexp_matches(rest, '[0-9]{8}'))"""

RECEIPT_BILL_SQL = VEHICLE_SQL + """,
summed AS (
  SELECT car_number, rtrim(company_code) AS company, pay_year, pay_month, sum(pay_rec_amount) AS rec, sum(pay_discount) AS discount, max(pay_date) AS pay_date
  FROM legacy_receipt WHERE pay_type IS NOT NULL AND pay_year IS NOT NULL AND pay_month IS NOT NULL AND pay_rec_amount IS NOT NULL
    AND NOT (pay_rec_amount = 0 AND pay_discount = 0) GROUP BY ALL),
result AS (
  SELECT company, pay_year * 100 + pay_month AS ix_yrmo, owner_id AS uid, cd_license, 1 AS bill_type, pay_date AS create_dtm, rec + discount AS amount, discount,
    make_date(pay_year, pay_month, 1) AS bill_start, last_day(make_date(pay_year, pay_month, 1)) AS bill_end,
    last_day(make_date(pay_year, pay_month, 1)) AS due_dtm, year(pay_date) * 100 + month(pay_date) AS iv_ix,
    row_number() OVER (PARTITION BY company, owner_id, year(pay_date) * 100 + month(pay_date) ORDER BY car_number, pay_date, pay_year, pay_month) AS iv_seq
  FROM summed JOIN vehicle_t ON car_number = cd_license)"""

RECEIPT_PAYMENT_SQL = VEHICLE_SQL + """,
merged AS (
  SELECT car_number, pay_type_detail, rtrim(company_code) AS company, pay_no, max(pay_date) AS pay_date, max(pay_update_date) AS create_dtm, max(pay_type) AS pay_type,
    max(coalesce(pay_user_id, '')) AS create_by, sum(pay_rec_amount) AS amount, max(pay_remark) AS remarks
  FROM legacy_receipt WHERE pay_rec_amount > 0 AND pay_no IS NOT NULL GROUP BY car_number, pay_type_detail, rtrim(company_code), pay_no),
equal AS (
  SELECT company, cd_license, year(pay_date) * 100 + month(pay_date) AS ix_yrmo, id AS uid, display_name AS cust_name, pay_type, pay_type_detail AS ref_code,
    pay_date AS transfer_dtm, m.create_dtm, create_by, m.remarks, sum(amount) AS amount
  FROM merged AS m JOIN vehicle_t AS v ON car_number = cd_license JOIN account_t AS a ON a.id = v.owner_id GROUP BY ALL),
result AS (
  SELECT company, ix_yrmo, uid, row_number() OVER (PARTITION BY ix_yrmo, uid ORDER BY create_dtm NULLS FIRST, cd_license, company, transfer_dtm NULLS FIRST,
      pay_type NULLS FIRST, ref_code NULLS FIRST, create_by, remarks NULLS FIRST) AS useq,
    cd_license, cust_name, amount, CASE pay_type WHEN 'A' THEN 'A' WHEN 'B' THEN 'T' WHEN 'C' THEN 'Q' WHEN 'D' THEN 'C' ELSE '0' END AS payment_type,
    ref_code, transfer_dtm, create_dtm, create_by, remarks FROM equal)"""

ORDER_SQL = VEHICLE_SQL + """,
order_t AS (
  SELECT row_number() OVER (ORDER BY change_fm_date, cd_license, service_price, company_code, owner_id, update_date, user_id) AS id, company_code AS company,
    year(change_fm_date) * 100 + month(change_fm_date) AS ix_yrmo, owner_id AS cust_id, cd_license, 12 AS o_status, 'C' AS payment_type,
    service_price AS payment_amount, change_fm_date AS order_dtm, update_date AS create_dtm, c.user_id AS mod_by
  FROM change AS c JOIN vehicle_t ON car_number = cd_license WHERE plan_code = 'X')"""

#: Tables of the audit, and what they are called in its SQL; seed rows are not in the SQL, as they break nothing.
AUDITED = {
    "vehicle": "vehicle", "vehicle_service": "vehicle_service", "suspended_service": "suspended_service", "leave": "leave_t", "service_location": "location_t",
    "account": "account", "service_plan": "plan_t", "bill": "bill", "payment": "paid_t", "contact": "contact", "customer": "billing_customer",
    "worker": "worker", "service_order": "order_t", "order_item": "item_t",
}
ABSENT = {"uq_account_login", "fk_item_service"}  # no login names there; items are seed rows


def audit_sql() -> str:
    """Every constraint as a query of its own."""
    text = lambda c, t="": f"upper(rtrim(CAST({t}{c} AS VARCHAR)))"
    parts = []
    for c in quality.CONSTRAINTS:
        if c.table not in AUDITED or c.name in ABSENT or getattr(c, "parent", c.table) not in AUDITED:
            continue
        key = "concat_ws('|', " + ", ".join(f"coalesce({text(x)}, 'NULL')" for x in c.columns) + ")"
        if isinstance(c, quality.Unique):
            parts.append(f"SELECT '{c.name}' AS constraint_name, {key} AS key, count(*) AS n FROM {AUDITED[c.table]} "
                         f"WHERE {c.where or 'TRUE'} GROUP BY ALL HAVING count(*) > 1")
        else:
            same = " AND ".join(f"{text(b, 'p.')} = {text(a, 's.')}" for a, b in zip(c.columns, c.parent_columns))
            there = " AND ".join(f"{x} IS NOT NULL" for x in c.columns)
            parts.append(f"SELECT '{c.name}', {key}, count(*) FROM (SELECT * FROM {AUDITED[c.table]} AS s WHERE {there} "
                         f"AND NOT EXISTS (SELECT 1 FROM {AUDITED[c.parent]} AS p WHERE {same})) GROUP BY ALL")
    return """
item_t AS (SELECT id AS oid, 7 AS item_id FROM order_t),
paid_t AS (SELECT *, 0 AS part FROM payment),
result AS (
  """ + "\n  UNION ALL ".join(parts) + ")"


PLAN_SQL = """
plan_t AS (
  SELECT CASE left(house_code, 1) WHEN '1' THEN 'K' WHEN '9' THEN 'X' ELSE left(house_code, 1) END AS srv_dis,
    CAST(CASE left(house_code, 1) WHEN '1' THEN house_code WHEN '9' THEN '1' ELSE right(house_code, 2) END AS INTEGER) AS srv_loc,
    company_code AS company, plan_code AS cd_plan, CAST(car_type AS INTEGER) AS vh_type, service_price AS price,
    CASE WHEN worker_service_price = 0 THEN CASE plan_code WHEN 'A' THEN 180 WHEN 'B' THEN 140 WHEN 'C' THEN 90 END ELSE worker_service_price END AS salary,
    updatedate AS effect
  FROM legacy_plan WHERE status_code = '00' AND house_code <> '' AND car_type IN ('1', '2', '3') AND plan_code IN ('A', 'B', 'C'))"""

STAFF_SQL = """
staff_t AS (
  SELECT lower(userid) AS login_name, coalesce(nullif(user_name, ''), userid) AS display_name,
    coalesce(['VIEWER', 'OPERATOR', 'ADMIN']["authorization"], 'OTHER') AS role, TRUE AS active,
    DATE '2021-01-01' AS create_dtm, DATE '2021-01-01' AS mod_dtm, 'SYSMIG' AS mod_by, NULL AS remarks
  FROM legacy_staff WHERE status_code = '00')"""

CONTACT = "cd_license:text c_name:text c_num:text"
LOCATION = "srv_dis:text srv_loc:int name_zh:text name_en:text cd_fleet:text mgt_dis:text"
ACCOUNT = "login_name:text display_name:text role:text active:bool"


def _workers(t: Tables) -> DataFrame:
    return legacy.with_ids(legacy.worker_accounts(t.legacy_worker, t.run(Loaded).changes))


def _locations(t: Tables) -> DataFrame:
    known = legacy.locations(t.legacy_house)
    return known.unionByName(legacy.missing_locations(known))


def _audit(t: Tables) -> DataFrame:
    loaded = t.run(Loaded)
    orders = legacy.orders(loaded.changes, loaded.vehicles)
    return quality.constraint_audit({
        "vehicle": t.vehicle, "vehicle_service": t.vehicle_service, "suspended_service": t.suspended_service, "leave": t.leave_t,
        "service_location": legacy.locations(t.legacy_house), "account": t.account, "service_plan": legacy.service_plans(t.legacy_plan),
        "bill": t.bill, "payment": t.payment.withColumn("part", F.lit(0)), "contact": t.contact, "customer": t.billing_customer, "worker": t.worker,
        "service_order": orders, "order_item": legacy.order_items(orders), "system_config": seed.system_config(t.spark),
        "unit_service_group": seed.unit_service_group(t.spark), "unit_service": seed.unit_service(t.spark),
    })


def _staff_and_workers(t: Tables) -> DataFrame:
    """Accounts of the staff, then of the workers, numbered in one sequence."""
    staff = legacy.with_ids(legacy.staff_accounts(t.legacy_staff))
    workers = legacy.with_ids(legacy.worker_accounts(t.legacy_worker, t.run(Loaded).changes), legacy.largest_id(staff))
    return staff.unionByName(workers)


def _backfilled(t: Tables) -> DataFrame:
    """Receipts by month for both outcomes of the guard: older ones are added only if there are none that old."""
    receipts = t.run(Loaded).receipts
    newer, older = receipts.filter(F.col("pay_year") >= 1997), receipts.filter(F.col("pay_year") < 1997)
    by_month = lambda guard, until: legacy.backfilled(newer, older, until_year=until, before=dt.date(1996, 7, 1)).groupBy(
        F.lit(guard).alias("guard"), "pay_year", "pay_month").agg(F.count(F.lit(1)).alias("n"))
    return by_month("added", 1996).unionByName(by_month("kept", 1997))


QUERIES: dict[str, Query] = {
    "plate_normalize": Query(
        "car_number:text house_code:text company_code:text car_type:text", lambda t: t.run(Loaded).cars, CONTACT_VIEWS,
        NORMAL_SQL + ",\nresult AS (SELECT * FROM car)",
    ),
    "receipt_backfill": Query(
        "guard:text pay_year:int pay_month:int n:long", _backfilled, ("legacy_receipt",),
        """newer AS (SELECT * FROM legacy_receipt WHERE pay_year >= 1997),
older AS (SELECT * FROM legacy_receipt WHERE pay_year < 1997 AND pay_date < DATE '1996-07-01'),
result AS (
  SELECT 'added' AS guard, pay_year, pay_month, count(*) AS n
  FROM (FROM newer UNION ALL FROM older WHERE (SELECT min(pay_year) FROM newer) > 1996) GROUP BY ALL
  UNION ALL
  SELECT 'kept', pay_year, pay_month, count(*)
  FROM (FROM newer UNION ALL FROM older WHERE (SELECT min(pay_year) FROM newer) > 1997) GROUP BY ALL)""",
    ),
    "staff_accounts": Query(
        ACCOUNT + " create_dtm:date mod_dtm:date mod_by:text remarks:text", lambda t: legacy.staff_accounts(t.legacy_staff), ("legacy_staff",),
        STAFF_SQL + ",\nresult AS (SELECT * FROM staff_t)",
    ),
    "worker_accounts": Query(
        "id:long " + ACCOUNT + " create_dtm:date mod_dtm:date mod_by:text remarks:text", _workers,
        CONTACT_VIEWS, WORKER_SQL + ",\nresult AS (SELECT * FROM worker_id)",
    ),
    "worker_rows": Query(
        "uid:long worker_code:text work_type:text bonus_a:int bonus_b:int bonus_c:int bonus_extra:int",
        lambda t: legacy.worker_rows(_workers(t), t.legacy_worker), CONTACT_VIEWS,
        WORKER_SQL + """,
result AS (
  SELECT id AS uid, upper(login_name) AS worker_code, 400 AS bonus_a, 300 AS bonus_b, 200 AS bonus_c, 100 AS bonus_extra,
    CASE WHEN upper(login_name) IN (SELECT upper(worker_code) FROM legacy_worker WHERE type = 'A') THEN 'A' ELSE '' END AS work_type
  FROM worker_id)""",
    ),
    "employee_rows": Query(
        "uid:long employ_dtm:date create_dtm:date mod_dtm:date mod_by:text hkid:text",
        lambda t: legacy.employee_rows(_staff_and_workers(t)), (*CONTACT_VIEWS, "legacy_staff"),
        WORKER_SQL + "," + STAFF_SQL + """,
numbered AS (
  SELECT row_number() OVER (ORDER BY login_name) AS uid, role, create_dtm, mod_dtm, mod_by FROM staff_t
  UNION ALL SELECT (SELECT count(*) FROM staff_t) + id, role, create_dtm, mod_dtm, mod_by FROM worker_id),
result AS (
  SELECT uid, create_dtm AS employ_dtm, create_dtm, mod_dtm, mod_by, 'A1234567' AS hkid FROM numbered WHERE role IN ('VIEWER', 'OPERATOR', 'OTHER', 'WORKER'))""",
    ),
    "worker_phones": Query(
        "uid:long c_type:int c_name:text c_num:text",
        lambda t: legacy.worker_contacts(t.legacy_worker, _workers(t)), CONTACT_VIEWS,
        WORKER_SQL + "," + PHONE_SQL + """,
result AS (
  SELECT id AS uid, 10 AS c_type, trim(p.worker_name) AS c_name, piece AS c_num FROM peeled AS p JOIN worker_id AS w ON w.login_name = lower(p.worker_code))""",
    ),
    "phone_candidates": Query(
        CONTACT, lambda t: t.run(Loaded).candidates, CONTACT_VIEWS, CANDIDATE_SQL + ",\nresult AS (SELECT * FROM candidate)",
    ),
    "phone_split": Query(
        CONTACT, lambda t: t.run(Loaded).contacts, CONTACT_VIEWS,
        CANDIDATE_SQL + "," + peel_sql("candidate") + ",\nresult AS (SELECT * FROM contact_t)",
    ),
    "phone_split_household": Query(
        CONTACT, lambda t: t.run(Households).contacts, ("legacy_phone",),
        peel_sql("legacy_phone").strip() + ",\nresult AS (SELECT * FROM contact_t)",
    ),
    "link_direct": Query(
        "major:text minor:text", lambda t: identity.successor_links(t.run(Households).rows), ("legacy_phone",),
        peel_sql("legacy_phone").strip() + """,
result AS (
  SELECT DISTINCT cd_license AS major, minor FROM (
    SELECT cd_license, lead(cd_license) OVER (PARTITION BY c_num ORDER BY cd_license) AS minor
    FROM (SELECT DISTINCT cd_license, c_num FROM contact_t WHERE c_num <> '' AND c_name NOT LIKE '%管理處%')) WHERE minor IS NOT NULL)""",
    ),
    "link_owner": Query(
        "plate:text owner:text", lambda t: identity.link_owners(t.run(Households).rows)[0], ("legacy_phone",),
        peel_sql("legacy_phone").strip() + "," + LINK_SQL + ",\nresult AS (SELECT * FROM owned)",
    ),
    "link_reach": Query(
        "root:text reach:long", lambda t: identity.link_owners(t.run(Households).rows)[1], ("legacy_phone",),
        peel_sql("legacy_phone").strip() + "," + LINK_SQL + """,
result AS (SELECT major AS root, reach FROM ranks WHERE major NOT IN (SELECT minor FROM linked))""",
    ),
    "link_owner_hot": Query(
        "plate:text owner:text", lambda t: identity.link_owners(t.run(Households).rows, hot_size=2)[0], ("legacy_phone",),
        peel_sql("legacy_phone").strip() + "," + LINK_SQL + ",\nresult AS (SELECT * FROM owned)",
    ),
    "customer_logins": Query(
        CONTACT + " owner:text login_name:text", lambda t: t.run(Loaded).logins, CONTACT_VIEWS,
        LOGIN_SQL + ",\nresult AS (SELECT * FROM login_t)",
    ),
    "customer_accounts": Query(
        "id:long login_name:text display_name:text create_dtm:date mod_dtm:date mod_by:text", lambda t: t.run(Loaded).accounts,
        CONTACT_VIEWS, ACCOUNT_SQL + ",\nresult AS (SELECT * FROM account_t)",
    ),
    "customer_rows": Query(
        "id:long last_reunion:date balance:money is_mobill:bool is_print_bill:bool is_rtn_envelope:bool mod_dtm:date mod_by:text",
        lambda t: legacy.customer_rows(t.run(Loaded).accounts, t.run(Loaded).owned, t.run(Loaded).cars), CONTACT_VIEWS,
        ACCOUNT_SQL + """,
flagged AS (
  SELECT uid, max({known: coalesce(change_item_date, start_date) IS NOT NULL, day: coalesce(change_item_date, start_date), who: user_id,
      month_end: month_end_yn, reminder: reminder_yn, told: transfer_yn IS NOT NULL, transfer: transfer_yn}) AS last
  FROM car JOIN (SELECT DISTINCT cd_license AS car_number, uid FROM owner_t) USING (car_number) GROUP BY uid),
result AS (
  SELECT id, create_dtm AS last_reunion, 0 AS balance, coalesce(last.month_end, FALSE) AS is_mobill, coalesce(last.reminder, FALSE) AS is_print_bill,
    coalesce(last.transfer, FALSE) AS is_rtn_envelope, mod_dtm, mod_by FROM account_t LEFT JOIN flagged ON uid = id)""",
    ),
    "customer_contacts": Query(
        "uid:long c_type:int c_name:text c_num:text", lambda t: legacy.customer_contacts(t.run(Loaded).owned), CONTACT_VIEWS,
        ACCOUNT_SQL + """,
result AS (
  SELECT uid, 10 AS c_type, coalesce(max(trim(c_name)), '車主') AS c_name, c_num FROM owner_t WHERE c_num <> '' GROUP BY uid, c_num)""",
    ),
    "location_base": Query(
        LOCATION, lambda t: legacy.locations(t.legacy_house), ("legacy_house",),
        LOCATION_SQL + ",\nresult AS (SELECT * FROM location_t)",
    ),
    "location_fill": Query(
        LOCATION, lambda t: legacy.missing_locations(legacy.locations(t.legacy_house)), ("legacy_house",),
        LOCATION_SQL + """,
number AS (SELECT srv_dis, unnest(generate_series(1, greatest(1, max(srv_loc)))) AS srv_loc FROM location_t GROUP BY srv_dis),
result AS (
  SELECT srv_dis, srv_loc, '' AS name_zh, '' AS name_en, '' AS cd_fleet, srv_dis AS mgt_dis
  FROM (SELECT srv_dis, srv_loc FROM number EXCEPT SELECT srv_dis, srv_loc FROM location_t))""",
    ),
    "location_commission": Query(
        "srv_dis:text srv_loc:int lhs_cmr:bool",
        lambda t: legacy.with_commission(_locations(t), seed.commission_locations(t.spark)), ("legacy_house",),
        LOCATION_SQL + """,
number AS (SELECT srv_dis, unnest(generate_series(1, greatest(1, max(srv_loc)))) AS srv_loc FROM location_t GROUP BY srv_dis),
listed(dis, loc) AS (VALUES """ + ", ".join(f"('{d}', {n})" for d, n in seed.COMMISSION_LOCATION) + """),
result AS (
  SELECT srv_dis, srv_loc, EXISTS (SELECT 1 FROM listed WHERE dis = srv_dis AND loc = srv_loc) AS lhs_cmr
  FROM (SELECT srv_dis, srv_loc FROM number UNION SELECT srv_dis, srv_loc FROM location_t))""",
    ),
    "price_list": Query(
        "srv_dis:text srv_loc:int company:text cd_plan:text vh_type:int price:money salary:money effect:date",
        lambda t: legacy.service_plans(t.legacy_plan), ("legacy_plan",), PLAN_SQL + ",\nresult AS (SELECT * FROM plan_t)",
    ),
    "latest_vehicle": Query(
        "cd_license:text owner_id:long vh_type:int source:int brand:text create_dtm:date mod_dtm:date mod_by:text remarks:text",
        lambda t: t.run(Loaded).vehicles, CONTACT_VIEWS, VEHICLE_SQL + ",\nresult AS (SELECT * FROM vehicle_t)",
    ),
    "receipt_bills": Query(
        "company:text ix_yrmo:int uid:long cd_license:text bill_type:int create_dtm:date amount:money discount:money "
        "bill_start:date bill_end:date due_dtm:date iv_ix:int iv_seq:int",
        lambda t: legacy.receipt_bills(t.run(Loaded).receipts, t.run(Loaded).vehicles),
        (*CONTACT_VIEWS, "legacy_receipt"), RECEIPT_BILL_SQL,
    ),
    "receipt_payments": Query(
        "company:text ix_yrmo:int uid:long useq:int cd_license:text cust_name:text amount:money payment_type:text "
        "ref_code:text transfer_dtm:date create_dtm:date create_by:text remarks:text",
        lambda t: legacy.receipt_payments(t.run(Loaded).receipts, t.run(Loaded).vehicles, t.run(Loaded).accounts),
        (*CONTACT_VIEWS, "legacy_receipt"), RECEIPT_PAYMENT_SQL,
    ),
    "orders": Query(
        "id:long company:text ix_yrmo:int cust_id:long cd_license:text o_status:int payment_type:text payment_amount:money "
        "order_dtm:date create_dtm:date mod_by:text",
        lambda t: legacy.orders(t.run(Loaded).changes, t.run(Loaded).vehicles), CONTACT_VIEWS,
        ORDER_SQL + ",\nresult AS (SELECT * FROM order_t)",
    ),
    "order_items": Query(
        "oid:long item_id:int qty:int unit_price:money discount:money",
        lambda t: legacy.order_items(legacy.orders(t.run(Loaded).changes, t.run(Loaded).vehicles)), CONTACT_VIEWS,
        ORDER_SQL + ",\nresult AS (SELECT id AS oid, 7 AS item_id, 1 AS qty, payment_amount AS unit_price, 0 AS discount FROM order_t)",
    ),
    "constraint_audit": Query(
        "constraint_name:text key:text n:long", _audit,
        (*CONTACT_VIEWS, "vehicle", "vehicle_service", "suspended_service", "leave_t", "account", "legacy_house", "legacy_plan", "bill", "payment", "contact",
         "billing_customer", "worker"),
        ORDER_SQL + "," + LOCATION_SQL + "," + PLAN_SQL + "," + audit_sql(),
    ),
}
