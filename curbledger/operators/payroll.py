"""Pay per worker and location, with leave deduction, pension share and detail text."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbledger.functions import lists
from curbledger.functions.calendar import weekday_hits
from curbledger.functions.text import CRLF, json_quoted
from curbledger.session import durable

PLANS = ("A", "B", "C")
PLACE = ["worker", "srv_dis", "srv_loc"]
NOTICE_DAYS = 30


def plan_validity(service_plan: DataFrame, ed: dt.date) -> DataFrame:
    """Price rows with the last day they hold: the day before the next one, else `ed`.

    The window partition is one price series, bounded by its effective dates.
    """
    series = Window.partitionBy("srv_dis", "srv_loc", "company", "cd_plan", "vh_type").orderBy("effect")
    return service_plan.withColumn(
        "valid_to", F.coalesce(F.date_sub(F.lead("effect").over(series), 1), F.lit(ed))
    )


def tasks(services: DataFrame, sd: dt.date, ed: dt.date, worker: int | None = None) -> DataFrame:
    """Services in the period, clipped to it."""
    served = services.filter(
        (F.col("start_dtm") <= F.lit(ed)) & (F.col("end_dtm").isNull() | (F.col("end_dtm") >= F.lit(sd)))
    )
    if worker is not None:
        served = served.filter(F.col("worker") == worker)
    return served.select(
        "company", "owner_id", "worker", "srv_dis", "srv_loc", "cd_license", "vh_type", "srv_plan",
        "srv_floor", "srv_psn", "weekday1", "weekday2", "weekday3", "waxing",
        F.greatest(F.lit(sd), "start_dtm").alias("task_start"),
        F.least(F.lit(ed), F.coalesce("end_dtm", F.lit(ed))).alias("task_end"),
    )


def leave_calendar(leave: DataFrame, sd: dt.date, ed: dt.date) -> DataFrame:
    """Unpaid share per leave day as one array per worker (at most one entry per day)."""
    days = (
        leave.filter(F.col("leave_dtm").between(F.lit(sd), F.lit(ed)))
        .groupBy(F.col("uid").alias("worker"), "leave_dtm")
        .agg(F.sum(1 - F.col("pay_ratio")).cast("decimal(17,4)").alias("unpaid"))
    )
    return days.groupBy("worker").agg(F.collect_list(F.struct("leave_dtm", "unpaid")).alias("leaves"))


def _leave_units() -> Column:
    """Unpaid days in the task; plan C counts only its weekday and is NULL without any."""
    in_task = lambda d: (d["leave_dtm"] >= F.col("task_start")) & (d["leave_dtm"] <= F.col("task_end"))
    total = lambda days: F.aggregate(
        days, F.lit(0).cast("decimal(17,4)"), lambda acc, d: (acc + d["unpaid"]).cast("decimal(17,4)")
    )
    every = F.filter("leaves", in_task)
    on_day = F.filter("leaves", lambda d: in_task(d) & (F.weekday(d["leave_dtm"]) + 1 == F.col("weekday1")))
    plan = F.col("srv_plan")
    return (
        F.when(plan.isin("A", "B"), F.coalesce(total(every), F.lit(0)))
        .when(plan == "C", F.when(F.size(on_day) > 0, total(on_day)))
        .otherwise(F.lit(1))
        .cast("decimal(17,4)")
    )


def leave_units(task: DataFrame, leave: DataFrame, sd: dt.date, ed: dt.date) -> DataFrame:
    """Tasks with their unpaid leave units."""
    sized = task.join(leave_calendar(leave, sd, ed), "worker", "left")
    return sized.withColumn("leave_cnt", _leave_units()).drop("leaves")


def _base_salary() -> Column:
    """Worker's own rate, else the price list, else the default; whole units only."""
    plan = F.col("srv_plan")
    own = F.when(plan == "A", F.col("salary_a")).when(plan == "B", F.col("salary_b")).when(plan == "C", F.col("salary_c"))
    return F.coalesce(own.cast("int"), F.col("plan_salary").cast("int"), F.col("default_salary").cast("int"))


def rated_tasks(
    task: DataFrame, worker_table: DataFrame, service_plan: DataFrame, config: DataFrame, ed: dt.date
) -> DataFrame:
    """Tasks with a base salary; plans without a default rate drop out.

    The price must hold for the whole task; a task across a price change gets the default.
    """
    own = worker_table.select(F.col("uid").alias("worker"), "salary_a", "salary_b", "salary_c")
    prices = plan_validity(service_plan, ed).select(
        "company", "srv_dis", "srv_loc", "vh_type", F.col("cd_plan").alias("srv_plan"),
        "effect", "valid_to", F.col("salary").alias("plan_salary"),
    )
    default = config.filter((F.col("dict_key") == "DATA") & (F.col("grp_key") == "SALARY")).select(
        F.col("c_value1").alias("_rate"), F.col("c_value2").cast("decimal(15,2)").alias("default_salary")
    )
    holds = (F.col("effect") <= F.col("task_start")) & (F.col("valid_to") >= F.col("task_end"))
    keys = ["company", "srv_dis", "srv_loc", "vh_type", "srv_plan"]
    t, p = task.alias("t"), prices.alias("p")
    on = [F.col(f"t.{k}") == F.col(f"p.{k}") for k in keys] + [holds]
    priced = t.join(p, on, "left").select("t.*", "plan_salary")
    return (
        priced.join(own, "worker", "left")
        .join(default, F.concat("srv_plan", F.col("vh_type").cast("string")) == F.col("_rate"))
        .withColumn("base_salary", _base_salary())
        .drop("_rate", "salary_a", "salary_b", "salary_c", "plan_salary", "default_salary")
    )


def paid_lines(rated: DataFrame, sd: dt.date, ed: dt.date) -> DataFrame:
    """Salary and leave deduction per service, in cents."""
    plan = F.col("srv_plan")
    days = F.datediff("task_end", "task_start") + 1
    hits = weekday_hits(F.col("weekday1"), F.col("task_start"), F.col("task_end"))
    all_hits = weekday_hits(F.col("weekday1"), F.lit(sd), F.lit(ed))
    units = F.when(plan.isin("A", "B"), days).when(plan == "C", hits).otherwise(1)
    whole = F.when(plan.isin("A", "B"), F.lit(ed.day)).when(plan == "C", all_hits).otherwise(1)
    share = lambda n: F.when(F.col("_whole") == 0, F.lit(0)).otherwise(
        F.round(F.col("base_salary").cast("decimal(15,0)") * n / F.col("_whole"), 2)
    ).cast("decimal(15,2)")
    return (
        rated.withColumn("_whole", whole)
        .withColumn("salary", share(units))
        .withColumn("leave_deduct", share(F.col("leave_cnt")))
        .drop("_whole")
    )


def _task_text() -> Column:
    psn = F.when(F.coalesce(F.rtrim("srv_psn"), F.lit("")) != "", F.concat(F.lit(" "), "srv_psn")).otherwise(F.lit(""))
    return F.concat(
        F.lit('{"p":"'), "srv_plan", F.lit('","s":"'), F.date_format("task_start", "yyyy-MM-dd"),
        F.lit('","e":"'), F.date_format("task_end", "yyyy-MM-dd"), F.lit('","psn":'),
        json_quoted(F.trim(F.concat("srv_floor", psn))), F.lit(',"d1":'), F.col("weekday1").cast("string"),
        F.lit(',"d2":'), F.col("weekday2").cast("string"), F.lit(',"d3":'), F.col("weekday3").cast("string"),
        F.lit(',"wx":'), F.when(F.col("waxing"), "true").otherwise("false"), F.lit("}"),
    )


def next_terminations(suspended: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Earliest termination per license that is at most 30 days old."""
    since = as_of - dt.timedelta(days=NOTICE_DAYS)
    recent = suspended.filter(F.col("is_terminate") & (F.col("end_dtm").cast("timestamp_ntz") >= F.lit(since).cast("timestamp_ntz")))
    return recent.groupBy("cd_license").agg(F.min("end_dtm").alias("fs_end"))


def place_counts(task: DataFrame) -> DataFrame:
    """Distinct licenses per plan and the time span, per worker and location.

    Licenses are merged first, so the distinct counts need no row expansion.
    """
    has = lambda p: F.max(F.col("srv_plan") == p)
    per_license = task.groupBy(*PLACE, "cd_license").agg(
        *[has(p).alias(f"_{p}") for p in PLANS],
        F.min("task_start").alias("task_start"), F.max("task_end").alias("task_end"),
    )
    return per_license.groupBy(*PLACE).agg(
        *[F.count(F.when(F.col(f"_{p}"), 1)).cast("int").alias(f"count_{i}") for i, p in enumerate(PLANS, 1)],
        F.min("task_start").alias("task_start"), F.max("task_end").alias("task_end"),
    )


def place_pay(lines: DataFrame) -> DataFrame:
    """Salary and deduction per plan, per worker and location."""
    zero = F.lit(0).cast("decimal(15,2)")
    sums = [
        F.coalesce(F.sum(F.when(F.col("srv_plan") == p, F.col(c))), zero).cast("decimal(15,2)").alias(f"{c}_{i}")
        for c in ("salary", "leave_deduct") for i, p in enumerate(PLANS, 1)
    ]
    return lines.groupBy(*PLACE).agg(*sums)


def place_detail(lines: DataFrame, terminations: DataFrame, limit: int | None = lists.PART_BYTES) -> DataFrame:
    """Detail text per worker and location: license -> ranges, remarks, coming end.

    Ranges and licenses are sorted.  A license is one entry; a location with more than `limit` bytes of
    entries goes on in further parts.
    """
    blank = F.lit("")
    remarks = F.trim(F.concat(
        F.coalesce(F.min("user_remarks"), blank), F.lit(CRLF), F.coalesce(F.min("car_remarks"), blank)
    ))
    per_license = lines.groupBy(*PLACE, "cd_license").agg(
        F.array_join(F.array_sort(F.collect_list("task_text")), ",").alias("ranges"), remarks.alias("remarks")
    ).join(terminations, "cd_license", "left")
    end = F.coalesce(F.concat(F.lit('"'), F.date_format("fs_end", "yyyy-MM-dd"), F.lit('"')), F.lit("null"))
    entry = F.concat(
        F.lit('"'), F.col("cd_license"), F.lit('":{"range":['), F.col("ranges"), F.lit('],"remarks":'),
        json_quoted(F.col("remarks")), F.lit(',"fs_end":'), end, F.lit("}"),
    )
    spots = lists.place(per_license.select(*PLACE, "cd_license", entry.alias("entry")), PLACE, ["cd_license"], "entry", limit)
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("cd_license", "entry"))), lambda e: e["entry"])
    return spots.groupBy(*PLACE, "part").agg(F.concat(F.lit("{"), F.array_join(in_order, ","), F.lit("}")).alias("srv_detail"))


def salary_lines(
    services: DataFrame, worker_table: DataFrame, service_plan: DataFrame, leave: DataFrame, config: DataFrame, account: DataFrame, vehicle: DataFrame,
    sd: dt.date, ed: dt.date, worker: int | None = None,
) -> DataFrame:
    """One row for each task and vehicle that is paid: the detail behind `calc_salary`, of a fixed shape."""
    owner = account.select(F.col("id").alias("owner_id"), F.col("remarks").alias("user_remarks"))
    car = vehicle.select("owner_id", "cd_license", F.col("remarks").alias("car_remarks"))
    rated = rated_tasks(leave_units(tasks(services, sd, ed, worker), leave, sd, ed), worker_table, service_plan, config, ed)
    lines = paid_lines(rated, sd, ed).join(owner, "owner_id").join(car, ["owner_id", "cd_license"])
    return lines.select(
        *PLACE, "cd_license", "owner_id", "srv_plan", "salary", "leave_deduct",
        _task_text().alias("task_text"), "user_remarks", "car_remarks",
    )


def calc_salary(
    services: DataFrame,
    worker_table: DataFrame,
    service_plan: DataFrame,
    leave: DataFrame,
    config: DataFrame,
    account: DataFrame,
    vehicle: DataFrame,
    suspended: DataFrame,
    location: DataFrame,
    sd: dt.date,
    ed: dt.date,
    as_of: dt.datetime,
    worker: int | None = None,
    limit: int | None = lists.PART_BYTES,
) -> DataFrame:
    """Pay per worker and location; reversed dates are swapped."""
    sd, ed = min(sd, ed), max(sd, ed)
    task = tasks(services, sd, ed, worker)
    # read twice below (amounts and detail text), so the joins run once
    lines = durable(salary_lines(services, worker_table, service_plan, leave, config, account, vehicle, sd, ed, worker))
    total = sum((F.col(f"salary_{i}") - F.col(f"leave_deduct_{i}") for i in (1, 2, 3)), F.lit(0))
    place = location.select(
        "srv_dis", "srv_loc", "mpf",
        F.rtrim(F.concat(F.coalesce("name_zh", F.lit("")), F.lit(" "), F.coalesce("name_en", F.lit("")))).alias("loc_name"),
    )
    pension = F.when(F.col("mpf"), F.round(total * F.lit(0.05).cast("decimal(3,2)"), 2)).otherwise(F.lit(0))
    numbers = (
        place_pay(lines).join(place_counts(task), PLACE, "left").join(place, ["srv_dis", "srv_loc"])
        .withColumn("mpf", pension.cast("decimal(15,2)"))
    )
    detail = place_detail(lines, next_terminations(suspended, as_of), limit)
    measure = lambda c: F.when(F.col("part") == 0, F.col(c)).alias(c)
    return numbers.join(detail, PLACE).select(
        *PLACE, "part", "loc_name", measure("task_start"), measure("task_end"),
        *[measure(f"{c}_{i}") for c in ("count", "salary", "leave_deduct") for i in (1, 2, 3)],
        measure("mpf"), "srv_detail",
    )
