"""Registered queries of payroll, bonus and the location census."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.operators import bonus, census, payroll
from curbledger.plans.catalog import Query, Tables
from curbledger.plans.monthly import ED, NOW, SD
from curbledger.sources import seed

MONTH = SD


def _config(t: Tables) -> DataFrame:
    return seed.system_config(t.spark)


SALARY_RATES = ", ".join(f"('{code}', {value})" for code, value, _ in seed.SALARY)

SALARY_SQL = f"""
rate(code, default_salary) AS (VALUES {SALARY_RATES}),
june AS (SELECT CAST(d AS DATE) AS day FROM unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY)) AS g(d)),
work_day AS (
  SELECT src_key, worker, weekday1 = isodow(day) AS visit, day, 1 - pay_ratio AS off
  FROM vehicle_service JOIN june ON day >= start_dtm AND (end_dtm IS NULL OR day <= end_dtm) LEFT JOIN leave_t ON uid = worker AND leave_dtm = day),
work AS (
  SELECT src_key, min(day) AS task_start, max(day) AS task_end, count(*) AS days, count(*) FILTER (visit) AS visits, sum(off) AS off_days,
    sum(off) FILTER (visit) AS off_visits
  FROM work_day GROUP BY src_key),
unit AS (
  SELECT s.*, task_start, task_end,
    CASE srv_plan WHEN 'C' THEN off_visits WHEN 'D' THEN 1 ELSE coalesce(off_days, 0) END AS leave_cnt,
    CASE srv_plan WHEN 'C' THEN visits WHEN 'D' THEN 1 ELSE days END AS num,
    CASE srv_plan WHEN 'C' THEN (SELECT count(*) FROM june WHERE isodow(day) = weekday1) WHEN 'D' THEN 1 ELSE 30 END AS den
  FROM vehicle_service AS s JOIN work USING (src_key))"""

PAY_SQL = SALARY_SQL + """,
price AS (
  SELECT src_key, CASE WHEN count(*) FILTER (effect > task_start) = 0 THEN max_by(salary, effect) END AS listed
  FROM unit AS u JOIN service_plan AS p USING (company, srv_dis, srv_loc, vh_type) WHERE cd_plan = srv_plan AND effect <= task_end GROUP BY src_key),
wage AS (
  SELECT u.*, 100 * CAST(floor(coalesce(map {'A': salary_a, 'B': salary_b, 'C': salary_c}[srv_plan], listed, default_salary)) AS BIGINT) AS cents
  FROM unit AS u JOIN rate ON code = srv_plan || u.vh_type LEFT JOIN worker AS w ON w.uid = u.worker LEFT JOIN price USING (src_key)),
paid AS (
  SELECT *, (cents * num * 2 + den) // (den * 2) AS pay_cents, (cents * CAST(leave_cnt * 10000 AS BIGINT) * 2 // 100 + den * 100) // (den * 200) AS leave_cents,
    to_json({p: srv_plan, s: strftime(task_start, '%Y-%m-%d'), e: strftime(task_end, '%Y-%m-%d'), psn: srv_floor || ' ' || srv_psn,
      d1: weekday1, d2: weekday2, d3: weekday3, wx: waxing})::VARCHAR AS item
  FROM wage),
ending AS (
  SELECT cd_license, min(end_dtm) AS fs_end FROM suspended_service
  WHERE is_terminate AND end_dtm >= TIMESTAMP '1998-05-21 12:00:00' GROUP BY cd_license),
per_license AS (
  SELECT p.worker, p.srv_dis, p.srv_loc, p.cd_license, string_agg(item, ',' ORDER BY item) AS ranges,
    trim(concat(coalesce(min(u.remarks), ''), chr(13), chr(10), coalesce(min(v.remarks), ''))) AS remarks,
    sum(CASE WHEN srv_plan = 'A' THEN pay_cents ELSE 0 END) AS s1, sum(CASE WHEN srv_plan = 'B' THEN pay_cents ELSE 0 END) AS s2,
    sum(CASE WHEN srv_plan = 'C' THEN pay_cents ELSE 0 END) AS s3,
    sum(CASE WHEN srv_plan = 'A' THEN leave_cents ELSE 0 END) AS l1, sum(CASE WHEN srv_plan = 'B' THEN leave_cents ELSE 0 END) AS l2,
    coalesce(sum(CASE WHEN srv_plan = 'C' THEN leave_cents END), 0) AS l3
  FROM paid AS p JOIN account AS u ON p.owner_id = u.id
  JOIN vehicle AS v ON p.owner_id = v.owner_id AND p.cd_license = v.cd_license
  GROUP BY p.worker, p.srv_dis, p.srv_loc, p.cd_license),
per_place AS (
  SELECT worker, srv_dis, srv_loc, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3, sum(l1) AS l1, sum(l2) AS l2, sum(l3) AS l3,
    concat('{', string_agg(concat('"', p.cd_license, '":{"range":[', ranges, '],"remarks":"',
      replace(replace(remarks, chr(13), '\\r'), chr(10), '\\n'), '","fs_end":',
      CASE WHEN fs_end IS NULL THEN 'null' ELSE concat('"', strftime(fs_end, '%Y-%m-%d'), '"') END, '}'), ',' ORDER BY p.cd_license), '}') AS srv_detail
  FROM per_license AS p LEFT JOIN ending AS e ON e.cd_license = p.cd_license GROUP BY worker, srv_dis, srv_loc),
span AS (
  SELECT worker, srv_dis, srv_loc, count(DISTINCT CASE WHEN srv_plan = 'A' THEN cd_license END) AS c1,
    count(DISTINCT CASE WHEN srv_plan = 'B' THEN cd_license END) AS c2, count(DISTINCT CASE WHEN srv_plan = 'C' THEN cd_license END) AS c3,
    min(task_start) AS task_start, max(task_end) AS task_end FROM unit GROUP BY worker, srv_dis, srv_loc),
result AS (
  SELECT o.worker, o.srv_dis, o.srv_loc, 0 AS part, rtrim(concat(name_zh, ' ', coalesce(name_en, ''))) AS loc_name, task_start, task_end,
    c1 AS count_1, c2 AS count_2, c3 AS count_3, s1 / 100.0::DECIMAL(5,2) AS salary_1, s2 / 100.0::DECIMAL(5,2) AS salary_2,
    s3 / 100.0::DECIMAL(5,2) AS salary_3, l1 / 100.0::DECIMAL(5,2) AS leave_deduct_1, l2 / 100.0::DECIMAL(5,2) AS leave_deduct_2,
    l3 / 100.0::DECIMAL(5,2) AS leave_deduct_3,
    CASE WHEN mpf THEN sign(s1 + s2 + s3 - l1 - l2 - l3) * ((abs(s1 + s2 + s3 - l1 - l2 - l3) * 5 + 50) // 100) ELSE 0 END
      / 100.0::DECIMAL(5,2) AS mpf, srv_detail
  FROM per_place AS o LEFT JOIN span ON o.worker = span.worker AND o.srv_dis = span.srv_dis AND o.srv_loc = span.srv_loc
  JOIN service_location AS l ON o.srv_dis = l.srv_dis AND o.srv_loc = l.srv_loc)"""

BONUS_SQL = """
newcomer AS (
  SELECT cd_license, join_ix, first.worker AS worker, first.srv_plan AS srv_plan, first.reg_dtm AS reg_dtm FROM (
    SELECT s.cd_license, year(reg_dtm) * 100 + month(reg_dtm) AS join_ix,
      min({start_dtm: start_dtm, reg_dtm: reg_dtm, worker: worker, srv_plan: srv_plan}) AS first
    FROM vehicle_service AS s SEMI JOIN (SELECT * FROM vehicle WHERE source = 2) AS v USING (owner_id, cd_license)
    WHERE reg_dtm >= DATE '1998-03-01' GROUP BY ALL)),
leaving AS (
  SELECT cd_license, worker, ix_yrmo AS left_ix, srv_plan AS left_plan, end_dtm FROM suspended_service
  WHERE is_terminate AND end_dtm BETWEEN DATE '1998-03-01' AND DATE '1998-06-30' GROUP BY ALL),
pair AS (
  SELECT n.*, left_ix, left_ix = 199806 AND (year(end_dtm) * 12 + month(end_dtm)) - (year(reg_dtm) * 12 + month(reg_dtm)) < 3 AS clawed
  FROM newcomer AS n LEFT JOIN leaving USING (cd_license, worker)),
item AS (
  SELECT worker, join_ix, srv_plan, cd_license, unnest(CASE WHEN clawed THEN [stay, 'sub'] WHEN left_ix IS NULL THEN [stay] ELSE [] END) AS t
  FROM (SELECT *, if(join_ix = 199806, 'add', 'base') AS stay FROM pair)),
tally AS (
  SELECT join_ix, worker, srv_plan, count(DISTINCT cd_license) FILTER (t = 'add') AS adds,
    count(DISTINCT cd_license) FILTER (t = 'base') AS bases, count(DISTINCT cd_license) FILTER (t = 'sub') AS subs
  FROM item GROUP BY ALL),
month_sum AS (
  SELECT join_ix, t.worker, sum(adds * amount) AS bonus,
    sum(subs * amount) + any_value(bonus_extra) * greatest(0, least(sum(bases) - 3, sum(subs))) AS deduct
  FROM (SELECT tally.*, bonus_extra, map {'A': bonus_a, 'B': bonus_b, 'C': bonus_c}[srv_plan] AS amount FROM tally LEFT JOIN worker AS w ON uid = tally.worker) AS t
  GROUP BY join_ix, t.worker),
earned AS (SELECT worker, sum(bonus) AS bonus, sum(deduct) AS deduct FROM month_sum GROUP BY worker),
listed AS (
  SELECT worker, string_agg(x, ',' ORDER BY x) FILTER (t = 'add') AS json_add, string_agg(x, ',' ORDER BY x) FILTER (t = 'sub') AS json_sub
  FROM (SELECT *, concat('{"l":"', cd_license, '","p":"', srv_plan, '"}') AS x FROM item) GROUP BY worker),
extra AS (
  SELECT worker, cd_license, max(rotation) AS rotation, bool_or(trim(rotation) <> '') AS turns, bool_or(waxing) AS waxed
  FROM vehicle_service WHERE start_dtm <= DATE '1998-06-30' AND coalesce(end_dtm, DATE '9999-01-01') >= DATE '1998-06-01' GROUP BY ALL),
srv AS (
  SELECT worker, nullif(count(*) FILTER (turns), 0) AS rot_cnt, nullif(count(*) FILTER (waxed), 0) AS wax_cnt,
    '[' || string_agg(r, ',' ORDER BY r) FILTER (turns) || ']' AS json_rot, '[' || string_agg(w, ',' ORDER BY w) FILTER (waxed) || ']' AS json_wax
  FROM (SELECT *, concat('"', cd_license, ' / ', rotation, '"') AS r, concat('"', cd_license, '"') AS w FROM extra WHERE turns OR waxed)
  GROUP BY worker)"""

BONUS_RESULT = """,
result AS (
  SELECT worker, 0 AS part, coalesce(bonus, 0) AS bonus, coalesce(deduct, 0) AS deduct, coalesce(bonus - deduct, 0) AS total,
    '[' || json_add || ']' AS json_add, '[' || json_sub || ']' AS json_sub, coalesce(rot_cnt, 0) AS rot_cnt, coalesce(wax_cnt, 0) AS wax_cnt,
    coalesce(rot_cnt, 0) * coalesce(sal_rot, 50) AS rot_sal, coalesce(wax_cnt, 0) * coalesce(sal_wax, 15) AS wax_sal, json_rot, json_wax
  FROM (SELECT e.*, sal_rot, sal_wax FROM earned AS e LEFT JOIN worker ON uid = e.worker) AS r
  FULL JOIN srv USING (worker) LEFT JOIN listed USING (worker)
  WHERE bonus <> 0 OR deduct <> 0 OR rot_cnt <> 0 OR wax_cnt <> 0)"""


def census_sql(first: str, last: str) -> str:
    return f"""
month_list AS (
  SELECT CAST(m AS DATE) AS m0, last_day(m) AS m1, year(m) * 100 + month(m) AS ix
  FROM unnest(generate_series(DATE '{first}', DATE '{last}', INTERVAL 1 MONTH)) AS g(m)),
stop AS (SELECT *, year(end_dtm + 1) * 100 + month(end_dtm + 1) AS ix FROM suspended_service WHERE is_terminate),
stopped AS (
  SELECT s.ix, s.reason_id, r.company, r.cd_license, r.srv_dis, r.srv_loc
  FROM stop AS s JOIN month_list USING (ix) JOIN vehicle_service AS r ON r.cd_license = s.cd_license AND s.end_dtm BETWEEN r.start_dtm AND r.end_dtm),
history AS (SELECT company, cd_license, list({{d: end_dtm, r: reason_id}}) AS ends FROM stop GROUP BY ALL),
present AS (
  SELECT ix, m1, company, cd_license, srv_dis, srv_loc, min(reg_dtm) AS reg, max(start_dtm) AS latest, min(start_dtm) AS earliest
  FROM vehicle_service JOIN month_list ON start_dtm <= m1 AND coalesce(end_dtm, m0) >= m0 GROUP BY ALL),
dated AS (
  SELECT ix, company, cd_license, srv_dis, srv_loc, reg, latest,
    len(list_filter(ends, lambda e: e.d < latest AND e.d > reg - INTERVAL 1 YEAR)) > 0 AS had,
    len(list_filter(ends, lambda e: e.d > latest AND e.d < earliest + INTERVAL 3 MONTH)) > 0 AS soon,
    list_min(list_transform(list_filter(ends, lambda e: e.d < m1 AND e.d >= latest - 1), lambda e: e.r)) AS reason
  FROM present LEFT JOIN history USING (company, cd_license)),
every AS (
  SELECT 1 AS here, p.* EXCLUDE (had, soon, reason), coalesce(had, FALSE) AS had, coalesce(soon, FALSE) AS soon, coalesce(reason, s.reason_id) AS reason
  FROM dated AS p LEFT JOIN stopped AS s ON s.ix = p.ix AND s.cd_license = p.cd_license
  UNION ALL
  SELECT 0, ix, company, cd_license, srv_dis, srv_loc, NULL, NULL, NULL, NULL, reason_id FROM stopped AS s ANTI JOIN present USING (ix, cd_license)),
marked AS (
  SELECT e.ix, e.company, e.cd_license, e.srv_dis, e.srv_loc, here AS m_total,
    coalesce((source = 0 AND NOT had AND NOT soon AND ix = year(reg) * 100 + month(reg))::INT, 0) AS m_new_flt,
    coalesce((source <> 0 AND NOT had AND NOT soon AND ix = year(reg) * 100 + month(reg))::INT, 0) AS m_new_oth,
    coalesce((had AND NOT soon AND ix = year(latest) * 100 + month(latest))::INT, 0) AS m_reu,
    coalesce((reason = 4)::INT, 0) AS m_term_cmp, coalesce((reason <> 4)::INT, 0) AS m_term_nrm
  FROM every AS e LEFT JOIN vehicle USING (cd_license))"""


def census_wide_sql(first: str, last: str) -> str:
    cells = []
    for company in census.COMPANIES:
        for metric, label in census.METRICS.items():
            cells.append(f"coalesce(sum(CASE WHEN company = '{company}' THEN m_{metric} END), 0) AS \"{company}_{label}\"")
            one = f"CASE WHEN company = '{company}' AND m_{metric} = 1 THEN cd_license END"
            cells.append(f"'[\"' || string_agg({one}, '\",\"' ORDER BY cd_license) || '\"]' AS \"json_{company}_{label}\"")
    return census_sql(first, last) + f""",
wide AS (SELECT ix, srv_dis, srv_loc, {", ".join(cells)} FROM marked GROUP BY ix, srv_dis, srv_loc),
result AS (
  SELECT w.*, 0 AS part, mgt_dis, cd_fleet, trim(name_zh) AS loc_name
  FROM wide AS w LEFT JOIN service_location AS l ON w.srv_dis = l.srv_dis AND w.srv_loc = l.srv_loc)"""


LONG = "ix:int company:text srv_dis:text srv_loc:int " + " ".join(f"cnt_{m}:long" for m in census.METRICS)
WIDE = "ix:int srv_dis:text srv_loc:int part:int mgt_dis:text cd_fleet:text loc_name:text " + " ".join(
    [f"{c}_{label}:long" for c in census.COMPANIES for label in census.METRICS.values()]
    + [f"json_{c}_{label}:text" for c in census.COMPANIES for label in census.METRICS.values()]
)
CENSUS_VIEWS = ("vehicle_service", "suspended_service", "vehicle", "service_location")
PAY_VIEWS = (
    "vehicle_service", "worker", "service_plan", "leave_t", "account", "vehicle", "suspended_service", "service_location",
)


def _salary(t: Tables) -> DataFrame:
    return payroll.calc_salary(
        t.vehicle_service, t.worker, t.service_plan, t.leave_t, _config(t), t.account, t.vehicle,
        t.suspended_service, t.service_location, SD, ED, NOW,
    )


def _leave_units(t: Tables) -> DataFrame:
    units = payroll.leave_units(payroll.tasks(t.vehicle_service, SD, ED), t.leave_t, SD, ED)
    return units.groupBy("worker", "srv_plan").agg(F.count(F.lit(1)).alias("n"), F.sum("leave_cnt").alias("units"))


def _referral_counts(t: Tables) -> DataFrame:
    facts = bonus.matched_referrals(
        bonus.referrals(t.vehicle_service, t.vehicle, dt.date(1998, 3, 1)),
        bonus.defaulters(t.suspended_service, dt.date(1998, 3, 1), ED),
    )
    rows = bonus.kinds(facts, 199806).select("join_ix", "worker", "srv_plan", "kind", "cd_license").distinct()
    return rows.groupBy("join_ix", "worker", "srv_plan", "kind").agg(F.count(F.lit(1)).alias("cnt"))


QUERIES: dict[str, Query] = {
    "salary": Query(
        "worker:long srv_dis:text srv_loc:int part:int loc_name:text task_start:date task_end:date "
        + " ".join(f"count_{i}:int" for i in (1, 2, 3)) + " "
        + " ".join(f"{c}_{i}:money" for c in ("salary", "leave_deduct") for i in (1, 2, 3)) + " mpf:money srv_detail:text",
        _salary, PAY_VIEWS, PAY_SQL,
    ),
    "salary_detail": Query(
        "worker:long srv_dis:text srv_loc:int cd_license:text owner_id:long srv_plan:text salary:money leave_deduct:money task_text:text",
        lambda t: payroll.salary_lines(t.vehicle_service, t.worker, t.service_plan, t.leave_t, _config(t), t.account, t.vehicle, SD, ED),
        PAY_VIEWS, PAY_SQL.split(",\nending AS (")[0] + """,
result AS (
  SELECT worker, srv_dis, srv_loc, cd_license, owner_id, srv_plan, pay_cents / 100.0::DECIMAL(5,2) AS salary, leave_cents / 100.0::DECIMAL(5,2) AS leave_deduct,
    item AS task_text
  FROM paid SEMI JOIN account AS u ON u.id = owner_id JOIN vehicle AS v USING (owner_id, cd_license))""",
    ),
    "plan_validity": Query(
        "srv_dis:text srv_loc:int company:text cd_plan:text vh_type:int salary:money effect:date valid_to:date",
        lambda t: payroll.plan_validity(t.service_plan, ED), PAY_VIEWS,
        """result AS (
  SELECT p.*, coalesce((SELECT min(q.effect) FROM service_plan AS q WHERE q.effect > p.effect AND (q.company, q.srv_dis, q.srv_loc, q.vh_type, q.cd_plan)
    = (p.company, p.srv_dis, p.srv_loc, p.vh_type, p.cd_plan)) - 1, DATE '1998-06-30') AS valid_to FROM service_plan AS p)""",
    ),
    "leave_units": Query(
        "worker:long srv_plan:text n:long units:ratio", _leave_units, PAY_VIEWS,
        SALARY_SQL + ",\nresult AS (SELECT worker, srv_plan, count(*) AS n, sum(leave_cnt) AS units FROM unit GROUP BY worker, srv_plan)",
    ),
    "bonus": Query(
        "worker:long part:int bonus:int deduct:int total:int json_add:text json_sub:text rot_cnt:int rot_sal:int wax_cnt:int "
        "wax_sal:int json_rot:text json_wax:text",
        lambda t: bonus.calc_bonus(
            t.vehicle_service, t.vehicle, t.suspended_service, t.worker, MONTH, _config(t)
        ),
        ("vehicle_service", "vehicle", "suspended_service", "worker"), BONUS_SQL + BONUS_RESULT,
    ),
    "referral_counts": Query(
        "join_ix:int worker:long srv_plan:text kind:text cnt:long", _referral_counts,
        ("vehicle_service", "vehicle", "suspended_service", "worker"),
        BONUS_SQL + """,
result AS (SELECT join_ix, worker, srv_plan, t AS kind, count(DISTINCT cd_license) AS cnt FROM item GROUP BY ALL)""",
    ),
    "service_extras": Query(
        "worker:long rot_cnt:int wax_cnt:int",
        lambda t: bonus.extra_counts(bonus.extra_items(t.vehicle_service, MONTH)),
        ("vehicle_service", "vehicle", "suspended_service", "worker"),
        BONUS_SQL + ",\nresult AS (SELECT worker, rot_cnt, wax_cnt FROM srv)",
    ),
    "census_long": Query(
        LONG, lambda t: census.census_counts(census.census_rows(
            t.vehicle_service, t.suspended_service, t.vehicle, dt.date(1998, 1, 1), ED)),
        CENSUS_VIEWS,
        census_sql("1998-01-01", "1998-06-01") + """,
result AS (SELECT ix, company, srv_dis, srv_loc, """
        + ", ".join(f"sum(m_{m}) AS cnt_{m}" for m in census.METRICS)
        + " FROM marked GROUP BY ix, company, srv_dis, srv_loc)",
    ),
    "census_wide": Query(
        WIDE, lambda t: census.location_census(
            t.vehicle_service, t.suspended_service, t.vehicle, t.service_location, SD, ED),
        CENSUS_VIEWS, census_wide_sql("1998-06-01", "1998-06-01"),
    ),
    "census_detail": Query(
        "ix:int company:text srv_dis:text srv_loc:int kind:text cd_license:text copies:long",
        lambda t: census.census_items(census.census_rows(t.vehicle_service, t.suspended_service, t.vehicle, SD, ED)).groupBy(
            "ix", "company", "srv_dis", "srv_loc", "kind", F.col("text").alias("cd_license")).agg(F.count(F.lit(1)).alias("copies")),
        CENSUS_VIEWS, census_sql("1998-06-01", "1998-06-01") + """,
result AS (
  SELECT ix, company, srv_dis, srv_loc, substr(kind, 3) AS kind, cd_license, sum(marks) AS copies
  FROM (UNPIVOT (SELECT ix, company, srv_dis, srv_loc, cd_license, COLUMNS('^m_.*')::INT FROM marked) ON COLUMNS('^m_.*') INTO NAME kind VALUE marks)
  WHERE marks = 1 GROUP BY ALL)""",
    ),
    "census_terminations": Query(
        "ix:int cd_license:text company:text srv_dis:text srv_loc:int reason_id:int n:long",
        lambda t: census.terminations_in_period(t.vehicle_service, t.suspended_service, dt.date(1998, 1, 1), ED),
        CENSUS_VIEWS,
        census_sql("1998-01-01", "1998-06-01") + """,
result AS (SELECT ix, cd_license, company, srv_dis, srv_loc, reason_id, count(*) AS n FROM stopped GROUP BY ALL)""",
    ),
}
