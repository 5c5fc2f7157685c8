"""Domain tables derived from the star-schema test tables.

Each view is one SQL text that Spark and DuckDB both read; `EACH(a, b, ...)` stands
for "one row per value" and is written as explode() or unnest().  A view is used as
a CTE, preceded by the views it needs.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from curbledger.session import ensure_checkpoint_dir

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_WORKER = "1000000 + {key} % (SELECT count(*) FROM supplier)"

VIEWS: dict[str, str] = {
    "vehicle_service": f"""
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY' ELSE 'PF' END AS company,
  concat('P', o_custkey, '-', o_orderkey % 4) AS cd_license,
  o_custkey AS owner_id, 1 + o_orderkey % 3 AS vh_type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B'
       WHEN '3' THEN 'C' WHEN '4' THEN 'A' ELSE 'D' END AS srv_plan,
  CAST(o_orderdate AS DATE) AS reg_dtm, CAST(o_orderdate AS DATE) AS start_dtm,
  CASE WHEN o_orderstatus = 'O' THEN NULL
       ELSE CAST(o_orderdate AS DATE) + CAST(10 + o_orderkey % 700 AS INT) END AS end_dtm,
  CAST(100 + o_orderkey % 400 AS DECIMAL(15,2)) AS fee,
  CAST((o_orderkey % 5) * 10 AS DECIMAL(15,2)) AS extra_fee,
  concat('D', c_nationkey % 5) AS srv_dis, c_nationkey AS srv_loc,
  concat('F', o_orderkey % 9) AS srv_floor, concat('S', o_orderkey % 90) AS srv_psn,
  1 + o_orderkey % 7 AS weekday1, 1 + (o_orderkey + 2) % 7 AS weekday2,
  1 + (o_orderkey + 4) % 7 AS weekday3,
  CASE WHEN o_orderkey % 6 = 0 THEN 'R1' ELSE ' ' END AS rotation,
  o_orderkey % 4 = 0 AS waxing,
  {_WORKER.format(key='o_orderkey')} AS worker,
  o_orderkey AS src_key
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "vehicle": """
SELECT cd_license, owner_id, min(vh_type) AS vh_type, min(src_key) % 4 AS source,
  CASE WHEN min(src_key) % 3 = 0 THEN concat('car ', min(src_key)) END AS remarks
FROM vehicle_service GROUP BY cd_license, owner_id""",
    "suspended_service": """
SELECT company, cd_license, end_dtm, min(owner_id) AS owner_id, min(srv_plan) AS srv_plan,
  min(worker) AS worker, min(src_key) % 6 AS reason_id, min(src_key) % 2 = 0 AS is_terminate,
  year(end_dtm) * 100 + month(end_dtm) AS ix_yrmo
FROM vehicle_service WHERE end_dtm IS NOT NULL GROUP BY company, cd_license, end_dtm""",
    "billing_customer": """
SELECT c_custkey AS id, CAST(c_acctbal AS DECIMAL(15,2)) AS balance, c_custkey % 3 = 0 AS is_mobill,
  c_custkey % 4 = 0 AS is_print_bill, c_custkey % 5 = 0 AS is_rtn_envelope,
  CAST(NULL AS DATE) AS last_payment
FROM customer""",
    "account": """
SELECT c_custkey AS id, c_name AS display_name, 'CUSTOMER' AS role, TRUE AS active,
  CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'note' END AS remarks FROM customer
UNION ALL
SELECT 1000000 + s_suppkey, s_name, 'WORKER', s_suppkey % 10 <> 9, NULL FROM supplier""",
    "worker": """
SELECT 1000000 + s_suppkey AS uid, concat('W', s_suppkey) AS worker_code,
  CASE WHEN s_suppkey % 4 = 0 THEN 210 END AS salary_a, CASE WHEN s_suppkey % 4 = 0 THEN 170 END AS salary_b,
  CASE WHEN s_suppkey % 4 = 0 THEN 120 END AS salary_c, 400 + s_suppkey % 3 * 10 AS bonus_a,
  300 + s_suppkey % 4 * 5 AS bonus_b, 200 + s_suppkey % 2 * 20 AS bonus_c, 100 + s_suppkey % 5 * 10 AS bonus_extra, CASE WHEN s_suppkey % 3 = 0 THEN 60 END AS sal_rot,
  CASE WHEN s_suppkey % 3 = 0 THEN 20 END AS sal_wax FROM supplier""",
    "leave_t": f"""
SELECT {_WORKER.format(key='user_id')} AS uid,
  CAST(ts AS DATE) + CAST(-9345 AS INT) AS leave_dtm,
  CAST(max(event_id % 3) * 0.5 AS DECIMAL(5,4)) AS pay_ratio
FROM events WHERE event_type = 'error' AND event_id % 5 = 0 GROUP BY 1, 2""",
    "service_location": """
SELECT concat('D', n_nationkey % 5) AS srv_dis, n_nationkey AS srv_loc, concat('M', n_regionkey) AS mgt_dis,
  concat('FL', n_nationkey % 3) AS cd_fleet, n_name AS name_zh,
  CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) END AS name_en, n_nationkey % 2 = 0 AS mpf FROM nation""",
    "service_plan": """
SELECT srv_dis, srv_loc, company, cd_plan, vh_type, CAST(150 + srv_loc + vh_type * 5.5 AS DECIMAL(15,2)) AS salary,
  CAST(eff AS DATE) AS effect
FROM (SELECT srv_dis, srv_loc, company, cd_plan, vh_type, EACH('1995-01-01', '1998-06-15') AS eff
  FROM (SELECT srv_dis, srv_loc, company, cd_plan, EACH(1, 2) AS vh_type
    FROM (SELECT srv_dis, srv_loc, company, EACH('A', 'B', 'C') AS cd_plan
      FROM (SELECT srv_dis, srv_loc, EACH('TK', 'KY') AS company FROM service_location) AS c) AS p) AS v) AS e""",
    "contact": """
SELECT uid, t AS c_type, concat('n', uid) AS c_num
FROM (SELECT c_custkey AS uid, EACH(1, 2, 3, 4, 10) AS t FROM customer) AS k WHERE (uid + t) % 3 = 0""",
    "bill_base": """
SELECT company, year(first_day) * 100 + month(first_day) AS ix_yrmo, owner_id AS uid, cd_license,
  min(src_key) AS k, CASE WHEN min(src_key) % 17 = 0 THEN 2 ELSE 1 END AS bill_type,
  CAST(max(extra_fee) + sum(fee) - (min(src_key) % 3) * 10 AS DECIMAL(15,2)) AS amount,
  CAST(CASE WHEN min(src_key) % 5 = 0 THEN 5 ELSE 0 END AS DECIMAL(15,2)) AS discount,
  first_day AS bill_start, last_day(first_day) AS bill_end, last_day(first_day) AS due_dtm
FROM (SELECT company, owner_id, cd_license, src_key, extra_fee, fee, start_dtm, end_dtm,
    EACH(DATE '1998-04-01', DATE '1998-05-01', DATE '1998-06-01') AS first_day FROM vehicle_service) AS m
WHERE start_dtm <= last_day(first_day) AND (end_dtm IS NULL OR end_dtm >= first_day + CAST(-90 AS INT))
GROUP BY company, owner_id, cd_license, first_day HAVING min(src_key) % 7 <> 0""",
    "bill": "SELECT * FROM bill_base WHERE k % 2 = 0 OR k % 11 = 0",
    "bill_archive": "SELECT * FROM bill_base WHERE k % 2 = 1 AND ix_yrmo < 199807",
    "payment": """
SELECT uid, 199806 AS ix_yrmo, count(DISTINCT cd_license) AS useq
FROM bill_archive WHERE k % 3 = 0 GROUP BY uid""",
    "payment_request": """
SELECT c_custkey AS uid, CASE c_custkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY' ELSE 'PF' END AS company,
  CASE WHEN c_custkey % 2 = 0 THEN concat('P', c_custkey, '-', c_custkey % 4) END AS cd_license,
  CAST(500 + c_custkey % 900 AS DECIMAL(15,2)) AS amount, 'C' AS payment_type FROM customer WHERE c_custkey % 4 < 3""",
    "legacy_phone": """
SELECT concat('P', c_custkey) AS cd_license, CASE WHEN c_custkey % 20 = 0 THEN '管理處' ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 9 = 0 THEN ''
       ELSE concat('Tel ', 20000000 + CAST(floor(c_custkey / 3) AS BIGINT), '/',
                   60000000 + CAST(floor((c_custkey + 1) / 4) AS BIGINT), ' #') END AS c_num FROM customer""",
    # legacy extract: master cars, change records, receipts, houses, plans, workers, staff
    "legacy_car": """
SELECT concat('p', c_custkey, ' ') AS car_number, concat('Ａ', c_custkey % 4) AS house_code,
  CASE c_custkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY ' ELSE 'PF' END AS company_code,
  CASE c_custkey % 3 WHEN 0 THEN '１' WHEN 1 THEN '2' ELSE '3' END AS car_type,
  CASE WHEN c_custkey % 9 = 1 THEN NULL ELSE DATE '1997-01-01' + CAST(c_custkey % 300 AS INT) END AS start_date,
  CASE WHEN c_custkey % 2 = 0 THEN DATE '1998-01-01' + CAST(c_custkey % 100 AS INT) END AS change_item_date,
  DATE '1998-03-01' + CAST(c_custkey % 60 AS INT) AS update_date,
  concat('U', c_custkey % 7) AS user_id,
  CASE c_custkey % 4 WHEN 0 THEN '新 ' WHEN 1 THEN '工' WHEN 2 THEN '優' END AS customer_source,
  CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE concat(' brand ', c_custkey % 11) END AS car_color,
  c_mktsegment AS remark, CASE WHEN c_custkey % 20 = 0 THEN '管理處' ELSE c_name END AS customer_name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL
       ELSE concat('Tel ', 20000000 + CAST(floor(c_custkey / 3) AS BIGINT), '/',
                   60000000 + CAST(floor((c_custkey + 1) / 4) AS BIGINT), ' ') END AS customer_phone,
  c_custkey % 3 = 0 AS month_end_yn, c_custkey % 4 = 0 AS reminder_yn,
  CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 2 = 0 END AS transfer_yn
FROM customer WHERE c_custkey % 3 <> 2""",
    "legacy_change": f"""
SELECT CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE concat('P', o_custkey) END AS car_number,
  CASE o_orderkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY ' ELSE 'PF' END AS company_code,
  CASE WHEN o_orderkey % 40 = 0 THEN 'X' WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS plan_code,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 3 END AS car_type,
  CAST(o_orderdate AS DATE) AS change_fm_date,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(-30 AS INT) END AS start_date,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(5 AS INT) END AS change_item_date,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INT) AS update_date,
  concat('U', o_orderkey % 13) AS user_id,
  CASE o_orderkey % 5 WHEN 0 THEN '新' WHEN 1 THEN ' 工' WHEN 2 THEN '優' WHEN 3 THEN NULL ELSE '?' END AS customer_source,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('brand ', o_orderkey % 17, ' ') END AS car_color,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat('r', o_orderkey % 23) END AS remark,
  concat(' N', o_custkey % 5, ' ') AS customer_name,
  CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('t', 30000000 + o_custkey % 1000, ' ', o_orderkey % 3, ';') END AS customer_phone,
  concat('w', o_orderkey % (SELECT count(*) + 5 FROM supplier)) AS worker_code,
  CAST(o_totalprice AS DECIMAL(15,2)) AS service_price
FROM orders""",
    "legacy_receipt": """
SELECT concat('P', o_custkey) AS car_number,
  CASE o_orderkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY ' ELSE 'PF' END AS company_code,
  year(o_orderdate) AS pay_year, month(o_orderdate) AS pay_month,
  CAST(l_shipdate AS DATE) AS pay_date, CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INT) AS pay_update_date,
  CASE l_linenumber % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'Z' END AS pay_type,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('chq', l_partkey % 40) END AS pay_type_detail,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE concat('U', l_suppkey % 5) END AS pay_user_id,
  CAST(l_quantity * 10 AS DECIMAL(15,2)) AS pay_amount,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity * (l_linenumber % 3) AS DECIMAL(15,2)) END AS pay_rec_amount,
  CAST(CASE WHEN l_linenumber % 4 = 0 THEN l_quantity ELSE 0 END AS DECIMAL(15,2)) AS pay_discount,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE o_orderkey % 100 END AS pay_no,
  CASE WHEN l_linenumber = 1 THEN l_returnflag END AS pay_remark
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "legacy_house": """
SELECT CASE WHEN c_custkey % 50 = 7 THEN '999' WHEN c_custkey % 10 = 1 THEN concat('1', lpad(CAST(c_custkey % 90 AS VARCHAR(9)), 2, '0'))
    ELSE concat(substr('DHMN', CAST(1 + c_custkey % 4 AS INT), 1), lpad(CAST(c_custkey % 60 AS VARCHAR(9)), 2, '0')) END AS house_code,
  substr('DHMN', CAST(1 + c_custkey % 4 AS INT), 1) AS location_code,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_name END AS house_name_chn, c_mktsegment AS house_name_eng,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE concat(' T', c_custkey % 9, ' ') END AS car_team
FROM customer WHERE c_custkey % 3 = 1""",
    "legacy_plan": """
SELECT CASE p_partkey % 12 WHEN 0 THEN '' WHEN 1 THEN '999' WHEN 2 THEN concat('1', lpad(CAST(p_partkey % 90 AS VARCHAR(9)), 2, '0'))
    ELSE concat(substr('DHMN', CAST(1 + p_partkey % 4 AS INT), 1), lpad(CAST(p_partkey % 60 AS VARCHAR(9)), 2, '0')) END AS house_code,
  CASE p_partkey % 3 WHEN 0 THEN 'TK' WHEN 1 THEN 'KY' ELSE 'PF' END AS company_code,
  substr('ABCDX', CAST(1 + p_partkey % 5 AS INT), 1) AS plan_code,
  CAST(1 + p_partkey % 4 AS VARCHAR(9)) AS car_type,
  CAST(p_retailprice AS DECIMAL(15,2)) AS service_price,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 100 + p_size END AS DECIMAL(15,2)) AS worker_service_price,
  DATE '1996-01-01' + CAST(p_size AS INT) AS updatedate, concat('U', p_size % 4) AS user_id,
  CASE WHEN p_partkey % 11 = 0 THEN '99' ELSE '00' END AS status_code
FROM part""",
    "legacy_worker": """
SELECT CASE WHEN s_suppkey % 9 = 8 THEN '' ELSE concat('W', s_suppkey) END AS worker_code, s_name AS worker_name,
  CASE WHEN s_suppkey % 5 = 0 THEN '99' ELSE '00' END AS status_code,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE DATE '1997-05-01' + CAST(s_suppkey % 90 AS INT) END AS update_date,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'U1' END AS user_id, concat('dept', s_nationkey) AS worker_dept,
  CASE WHEN s_suppkey % 2 = 0 THEN 'A' ELSE 'B' END AS type,
  CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat('Tel ', 91230000 + s_suppkey, '/', 61230000 + s_suppkey)
    WHEN 2 THEN concat(51230000 + s_suppkey, ' ', 51230000 + s_suppkey, ' x ', 41230000 + s_suppkey) ELSE 'no number' END AS phone
FROM supplier""",
    "legacy_staff": """
SELECT s_name AS userid, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE concat('staff ', s_suppkey) END AS user_name,
  s_suppkey % 5 AS authorization, CASE WHEN s_suppkey % 4 = 0 THEN '99' ELSE '00' END AS status_code
FROM supplier""",
}

_EACH = re.compile(r"EACH\(([^()]*)\)")


def _needs(name: str) -> list[str]:
    """Views that `name` uses, itself last, in an order in which they can be defined."""
    found: list[str] = []

    def visit(view: str) -> None:
        if view in found:
            return
        for other in VIEWS:
            if other != view and re.search(rf"\b(FROM|JOIN) {other}\b", VIEWS[view]):
                visit(other)
        found.append(view)

    visit(name)
    return found


def _ctes(names: list[str], each: str) -> str:
    order: list[str] = []
    for name in names:
        order += [view for view in _needs(name) if view not in order]
    bodies = (f"{view} AS ({_EACH.sub(each, VIEWS[view])})" for view in order)
    return ",\n".join(bodies)


def duckdb_ctes(*names: str) -> str:
    """`a AS (...), b AS (...)` for the views, to follow WITH."""
    return _ctes(list(names), r"unnest([\1])")


def _inputs(body: str) -> list[str]:
    return [name for name in (*BASE_TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {name}\b", body)]


class DomainTables:
    """Domain tables of one data folder, each made on first use.

    Tables that several operators share are written once to the shared checkpoint
    folder, so operators read columns and row groups of a stored table instead of
    deriving it again; the others stay views.
    """

    STORED = frozenset({"vehicle_service", "vehicle", "suspended_service", "bill_base"})

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self.runs: dict[type, object] = {}  # multi-stage jobs over these tables, by their class

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._make(name)
        return self._frames[name]

    def _make(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir.rstrip('/')}/{name}.parquet")
        body = _EACH.sub(r"explode(array(\1))", VIEWS[name])
        used = _inputs(body)
        for table in used:
            body = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 {{{table}}}", body)
        frame = self.spark.sql(body, **{table: self.table(table) for table in used})
        if name not in self.STORED:
            return frame
        path = f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/domain-{uuid.uuid4().hex}/{name}"
        cores = self.spark.sparkContext.defaultParallelism
        if self.table("orders").rdd.getNumPartitions() < cores:  # one small file: spread it once
            frame = frame.repartition(cores)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)


_OPEN: dict[tuple[str, str], DomainTables] = {}


def domain_tables(spark: SparkSession, sf_dir: str) -> DomainTables:
    """The domain tables of a data folder, kept for the life of the Spark application."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _OPEN or _OPEN[key].spark is not spark:
        _OPEN[key] = DomainTables(spark, str(sf_dir))
    return _OPEN[key]


def domain_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return domain_tables(spark, sf_dir).table(name)
