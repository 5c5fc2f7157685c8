"""Registered queries of payment settlement."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.operators import settlement
from curbledger.plans.catalog import Query, Tables
from curbledger.plans.monthly import IX, NOW, STORED
from curbledger.session import durable

VIEWS = (
    "vehicle_service", "billing_customer", "bill", "bill_archive", "payment", "payment_request", "account",
)

PROBE_SQL = """
req AS (
  SELECT r.*, CAST(balance + amount AS DECIMAL(15,2)) AS qualified FROM payment_request AS r LEFT JOIN billing_customer AS c ON c.id = r.uid),
probe AS (
  SELECT r.uid,
    (SELECT min(ix_yrmo) FROM bill AS b WHERE b.uid = r.uid AND (r.cd_license IS NULL OR b.cd_license = r.cd_license)) AS bill_ix,
    (SELECT max(ix_yrmo) FROM bill_archive AS b WHERE b.uid = r.uid AND (r.cd_license IS NULL OR b.cd_license = r.cd_license)) AS old_ix,
    (SELECT max(start_dtm) FROM vehicle_service AS s WHERE s.owner_id = r.uid AND (r.cd_license IS NULL OR s.cd_license = r.cd_license)) AS last_start
  FROM req AS r),
probes AS (
  SELECT uid, bill_ix, CASE WHEN old_ix % 100 = 12 THEN old_ix + 89 ELSE old_ix + 1 END AS archive_ix,
    year(last_start) * 100 + month(last_start) AS service_ix FROM probe),
started AS (SELECT uid, greatest(bill_ix, archive_ix, service_ix) AS start_ix FROM probes)"""


def payer_bills_sql(months: str, name: str) -> str:
    """Bills of payers for the months (uid, first_day) of a table, by the closed form for weekdays in a span."""
    hits = lambda a, b: f"greatest(0, ({b} - {a} - (weekday1 + 7 - isodow({a})) % 7 + 7) // 7)"
    return f"""
{name}_part AS MATERIALIZED (
  SELECT s.company, m.uid, s.cd_license, srv_plan, weekday1, CAST(100 * fee AS BIGINT) AS cents, extra_fee, m.first_day, last_day(m.first_day) AS last_one,
    greatest(start_dtm, m.first_day) AS since, least(coalesce(end_dtm, last_day(m.first_day)), last_day(m.first_day)) AS until
  FROM {months} AS m JOIN vehicle_service AS s ON owner_id = m.uid AND start_dtm <= last_day(m.first_day) AND coalesce(end_dtm, m.first_day) >= m.first_day),
{name} AS MATERIALIZED (
  SELECT company, year(first_day) * 100 + month(first_day) AS ix_yrmo, uid, cd_license, min(since) AS bill_start, max(until) AS bill_end,
    any_value(last_one) AS batch_end, max(extra_fee) + (50 + sum((share[2] + 2 * cents * share[1]) // (2 * share[2]))) // 100 AS amount
  FROM (SELECT *, CASE srv_plan WHEN 'A' THEN [until - since + 1, day(last_one)] WHEN 'B' THEN [until - since + 1, day(last_one)]
      WHEN 'C' THEN [{hits("since", "until")}, {hits("first_day", "last_one")}] ELSE [1, 1] END AS share FROM {name}_part)
  GROUP BY company, first_day, uid, cd_license)"""


#: From the month after the last date of any service or bill on, every month of a payer costs the same.
FORWARD_SQL = PROBE_SQL + """,
settled_after AS (
  SELECT date_trunc('month', greatest((SELECT max(greatest(start_dtm, coalesce(end_dtm, start_dtm))) FROM vehicle_service),
    (SELECT max(make_date(ix_yrmo // 100, ix_yrmo % 100, 1)) FROM (SELECT ix_yrmo FROM bill UNION ALL SELECT ix_yrmo FROM bill_archive)))
    + INTERVAL 1 MONTH)::DATE AS steady),
payer_span AS (
  SELECT uid, start_ix, make_date(start_ix // 100, start_ix % 100, 1) AS low, greatest(steady, make_date(start_ix // 100, start_ix % 100, 1)) AS high
  FROM started, settled_after WHERE start_ix IS NOT NULL),
payer_month AS MATERIALIZED (
  SELECT uid, unnest(generate_series(low, high, INTERVAL 1 MONTH))::DATE AS first_day FROM payer_span),""" + payer_bills_sql("payer_month", "f") + """,
b AS MATERIALIZED (
  SELECT paid, x.* EXCLUDE (paid) FROM (SELECT 0 AS paid, * FROM bill UNION ALL SELECT 1, * FROM bill_archive) AS x
  SEMI JOIN payer_month AS p ON x.uid = p.uid AND x.ix_yrmo = year(first_day) * 100 + month(first_day)),
after_month AS (
  SELECT b.company, b.ix_yrmo, b.uid, b.cd_license, f.amount - b.discount AS net
  FROM b JOIN f USING (company, ix_yrmo, uid, cd_license) WHERE b.paid = 0 OR f.amount > b.amount
  UNION ALL
  SELECT company, ix_yrmo, uid, cd_license, amount FROM f ANTI JOIN b USING (company, ix_yrmo, uid, cd_license)),
monthly AS MATERIALIZED (
  SELECT a.uid, a.ix_yrmo, CAST(sum(net) AS DECIMAL(25,2)) AS net FROM after_month AS a JOIN req AS r
    ON a.uid = r.uid AND (r.cd_license IS NULL OR a.cd_license = r.cd_license) GROUP BY a.uid, a.ix_yrmo),
walk AS (
  SELECT uid, low AS month, high, CAST(trunc(qualified) AS BIGINT) AS fund, CAST(-1 AS DECIMAL(25,2)) AS net
  FROM req JOIN payer_span USING (uid)
  UNION ALL
  SELECT w.uid, (w.month + INTERVAL 1 MONTH)::DATE, high, CAST(trunc(fund - coalesce(m.net, 0)) AS BIGINT), coalesce(m.net, 0)::DECIMAL(25,2)
  FROM walk AS w LEFT JOIN monthly AS m ON m.uid = w.uid AND m.ix_yrmo = year(least(month, high)) * 100 + month(least(month, high))
  WHERE fund > 0 AND w.net <> 0),
visited_month AS MATERIALIZED (
  SELECT w.uid, (month - INTERVAL 1 MONTH)::DATE AS first_day FROM walk AS w JOIN payer_span AS p ON p.uid = w.uid WHERE month > low),
visited AS (SELECT uid, year(first_day) * 100 + month(first_day) AS ix_yrmo FROM visited_month)"""

SETTLE_SQL = FORWARD_SQL + "," + payer_bills_sql("visited_month", "made") + """,
stored AS MATERIALIZED (SELECT b.* FROM b SEMI JOIN visited USING (uid, ix_yrmo)),
fresh AS MATERIALIZED (
  SELECT made.*, CASE WHEN is_mobill THEN last_day(batch_end + 1) ELSE batch_end END AS due_dtm FROM made JOIN billing_customer AS c ON c.id = made.uid),
open_bill AS MATERIALIZED (
  SELECT x.company, x.ix_yrmo, x.uid, x.cd_license, x.k, x.bill_type, x.amount, x.discount, x.bill_start, x.bill_end, x.due_dtm
  FROM bill AS x WHERE NOT EXISTS (SELECT 1 FROM visited AS v WHERE v.uid = x.uid AND v.ix_yrmo = x.ix_yrmo)
  UNION ALL
  SELECT s.company, s.ix_yrmo, s.uid, s.cd_license, s.k, s.bill_type, n.amount, s.discount, s.bill_start, s.bill_end,
    CASE WHEN bool_or(s.amount <> n.amount) OVER (PARTITION BY s.company, s.ix_yrmo, s.uid, s.cd_license) THEN n.due_dtm ELSE s.due_dtm END
  FROM stored AS s JOIN fresh AS n USING (company, ix_yrmo, uid, cd_license) WHERE s.paid = 0
  UNION ALL
  SELECT n.company, n.ix_yrmo, n.uid, n.cd_license, NULL, 1, n.amount, s.discount, n.bill_start, n.bill_end, n.due_dtm
  FROM stored AS s JOIN fresh AS n USING (company, ix_yrmo, uid, cd_license) WHERE s.paid = 1 AND n.amount > s.amount
  UNION ALL
  SELECT n.company, n.ix_yrmo, n.uid, n.cd_license, NULL, 1, n.amount, 0, n.bill_start, n.bill_end, n.due_dtm FROM fresh AS n
  WHERE NOT EXISTS (SELECT 1 FROM stored AS s WHERE s.company = n.company AND s.ix_yrmo = n.ix_yrmo AND s.uid = n.uid AND s.cd_license = n.cd_license)),
running AS MATERIALIZED (
  SELECT b.*, qualified, sum(b.amount - discount) OVER (PARTITION BY b.uid ORDER BY ix_yrmo, b.amount - discount, b.cd_license) AS cumulative_amount
  FROM open_bill AS b JOIN req AS r ON b.uid = r.uid AND (r.cd_license IS NOT NULL OR b.company = r.company)
    AND (r.cd_license IS NULL OR b.cd_license = r.cd_license)),
paid_bill AS (SELECT * FROM running WHERE cumulative_amount <= qualified),
settled AS (SELECT uid, sum(amount - discount) AS settled, min(company) AS company, string_agg(DISTINCT cd_license, ',' ORDER BY cd_license) AS licenses
  FROM paid_bill GROUP BY uid)"""


class Settled:
    """One settlement of the test tables, made on first use by the queries that share it."""

    def __init__(self, t: Tables) -> None:
        self.t = t

    @cached_property
    def asked(self) -> DataFrame:
        t = self.t
        requests = settlement.qualify(t.payment_request, t.billing_customer)
        return requests.join(settlement.start_month(self.probes), "uid", "left")

    @cached_property
    def probes(self) -> DataFrame:
        t = self.t
        return settlement.month_probes(t.payment_request, t.bill, t.bill_archive, t.vehicle_service)

    @cached_property
    def visited(self) -> DataFrame:
        t = self.t
        return durable(settlement.forward_billing(
            self.asked, t.bill, t.bill_archive, t.vehicle_service, t.billing_customer
        ))

    @cached_property
    def whole(self) -> settlement.Settlement:
        t = self.t
        return settlement.settle(
            t.payment_request, t.bill, t.bill_archive, t.payment, t.billing_customer, t.vehicle_service, t.account,
            NOW, self.visited,
        )


QUERIES: dict[str, Query] = {
    "settle_probes": Query(
        "uid:long bill_ix:int archive_ix:int service_ix:int", lambda t: t.run(Settled).probes, VIEWS,
        PROBE_SQL + ",\nresult AS (SELECT * FROM probes)",
    ),
    "settle_start_month": Query(
        "uid:long start_ix:int", lambda t: settlement.start_month(t.run(Settled).probes), VIEWS,
        PROBE_SQL + ",\nresult AS (SELECT * FROM started)",
    ),
    "settle_sequence": Query(
        "uid:long useq:int", lambda t: settlement.next_sequence(t.payment, IX), VIEWS,
        "result AS (SELECT uid, 1 + max(useq) AS useq FROM payment WHERE ix_yrmo = 199806 GROUP BY uid)",
    ),
    "forward_months": Query(
        "uid:long ix_yrmo:int", lambda t: t.run(Settled).visited, VIEWS,
        FORWARD_SQL + ",\nresult AS (SELECT * FROM visited)",
    ),
    "settle_affordable": Query(
        STORED + " cumulative_amount:money",
        lambda t: t.run(Settled).whole.paid, VIEWS, SETTLE_SQL + ",\nresult AS (SELECT * FROM paid_bill)",
    ),
    "settle_open_bills": Query(
        STORED, lambda t: t.run(Settled).whole.bill, VIEWS,
        SETTLE_SQL + """,
result AS (SELECT * FROM open_bill ANTI JOIN (
    SELECT DISTINCT company, ix_yrmo, uid, cd_license, 1 AS bill_type FROM paid_bill) AS p USING (company, ix_yrmo, uid, cd_license, bill_type))""",
    ),
    "settle_balance": Query(
        "id:long balance:money last_payment:date", lambda t: t.run(Settled).whole.customer, VIEWS,
        SETTLE_SQL + """,
result AS (
  SELECT id, CASE WHEN r.uid IS NULL THEN balance ELSE qualified - coalesce(settled, 0) END AS balance,
    CASE WHEN r.uid IS NOT NULL THEN DATE '1998-06-20' END AS last_payment
  FROM billing_customer LEFT JOIN req AS r ON id = r.uid LEFT JOIN settled AS s ON id = s.uid)""",
    ),
    "settle_payment_row": Query(
        "company:text ix_yrmo:int uid:long useq:int part:int cd_license:text cust_name:text amount:money payment_type:text",
        lambda t: t.run(Settled).whole.payment, VIEWS,
        SETTLE_SQL + """,
last_service AS (
  SELECT owner_id, cd_license, company, row_number() OVER (PARTITION BY owner_id, cd_license ORDER BY start_dtm DESC, company DESC) AS rn
  FROM vehicle_service),
result AS (
  SELECT coalesce(s.company, l.company, r.company) AS company, 199806 AS ix_yrmo, r.uid,
    1 + coalesce((SELECT max(useq) FROM payment AS p WHERE p.uid = r.uid AND p.ix_yrmo = 199806), 0) AS useq, 0 AS part,
    coalesce(licenses, '*BALANCE(CR)*') AS cd_license, display_name AS cust_name, r.amount, payment_type
  FROM req AS r LEFT JOIN settled AS s ON r.uid = s.uid
  LEFT JOIN last_service AS l ON l.owner_id = r.uid AND l.cd_license = r.cd_license AND rn = 1 LEFT JOIN account AS u ON u.id = r.uid)""",
    ),
    "settle_payment_license": Query(
        "uid:long cd_license:text settled:money", lambda t: t.run(Settled).whole.paid.groupBy("uid", "cd_license").agg(F.sum("net").alias("settled")),
        VIEWS, SETTLE_SQL + ",\nresult AS (SELECT uid, cd_license, sum(amount - discount) AS settled FROM paid_bill GROUP BY ALL)",
    ),
}
