"""Location census: licenses per month, location and company, by how they came and went."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import lists
from curbledger.functions.calendar import month_first, month_last, yrmo
from curbledger.operators.billing import service_months
from curbledger.session import durable

COMPANIES = ("TK", "KY", "PF")  # fixed values: company codes of the wide report
FLEET_SOURCE = 0
COMPLAINT_REASON = 4
CELL = ["ix", "company", "srv_dis", "srv_loc"]

# metric in the long form -> its name in the wide report
METRICS = {
    "total": "Total", "new_flt": "FltNew", "new_oth": "OthNew",
    "reu": "Reunion", "term_cmp": "CmpTerm", "term_nrm": "NrmTerm",
}


def terminations_in_period(
    services: DataFrame, suspended: DataFrame, sd: dt.date, ed: dt.date
) -> DataFrame:
    """Terminations matched to the services of the license (any company) running then.

    The last day of a month counts for the next month.  Rows are merged with a weight
    `n`, so a license with many services does not multiply.
    """
    # from the last day of the month before to the last day but one: plain bounds, which reach both scans
    since, until = month_first(sd) - dt.timedelta(days=1), month_last(ed)
    ended = suspended.filter(
        F.col("is_terminate") & (F.col("end_dtm") >= F.lit(since)) & (F.col("end_dtm") < F.lit(until))
    ).select("cd_license", yrmo(F.date_add("end_dtm", 1)).alias("ix"), F.col("end_dtm").alias("_gone"), "reason_id")
    running = services.filter((F.col("end_dtm") >= F.lit(since)) & (F.col("start_dtm") < F.lit(until))).select(
        "company", "cd_license", "srv_dis", "srv_loc", "start_dtm", "end_dtm"
    )
    hits = running.join(ended, "cd_license").filter(
        (F.col("start_dtm") <= F.col("_gone")) & (F.col("end_dtm") >= F.col("_gone"))
    )
    return hits.groupBy("ix", "cd_license", "company", "srv_dis", "srv_loc", "reason_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def active_licenses(services: DataFrame, suspended: DataFrame, sd: dt.date, ed: dt.date) -> DataFrame:
    """Active licenses per month, company and location with their nearest terminations.

    The terminations of a license are one array of distinct dates, so looking them up
    joins one row and multiplies nothing.
    """
    months = service_months(
        services.select("company", "cd_license", "srv_dis", "srv_loc", "reg_dtm", "start_dtm", "end_dtm"),
        F.lit(month_first(sd)), F.lit(month_first(ed)),
    )
    present = months.groupBy(
        F.col("ix_yrmo").alias("ix"), "company", "cd_license", "srv_dis", "srv_loc"
    ).agg(
        F.min("reg_dtm").alias("reg_dtm"), F.max("start_dtm").alias("start_dtm"),
        F.min("start_dtm").alias("first_start"), F.max("batch_end").alias("month_end"),
    )
    ends = suspended.filter("is_terminate").groupBy("company", "cd_license").agg(
        F.collect_set(F.struct("end_dtm", "reason_id")).alias("ends")
    )
    day = lambda e: e["end_dtm"]
    dates = lambda keep: F.transform(F.filter("ends", keep), day)
    last_term = F.array_max(dates(
        lambda e: (day(e) < F.col("start_dtm")) & (day(e) > F.add_months(F.col("reg_dtm"), -12))
    ))
    next_term = F.array_min(dates(
        lambda e: (day(e) > F.col("start_dtm")) & (day(e) < F.add_months(F.col("first_start"), 3))
    ))
    reason = F.array_min(F.transform(
        F.filter("ends", lambda e: (day(e) < F.col("month_end")) & (day(e) >= F.date_sub(F.col("start_dtm"), 1))),
        lambda e: e["reason_id"],
    ))
    return present.join(ends, ["company", "cd_license"], "left").select(
        "ix", "company", "cd_license", "srv_dis", "srv_loc", "reg_dtm", "start_dtm",
        last_term.alias("last_term"), next_term.alias("next_term"), reason.alias("reason_id"),
    )


def classified(active: DataFrame, ended: DataFrame, vehicle: DataFrame) -> DataFrame:
    """Active and terminated licenses together, each row with 0/1 marks and a weight `n`.

    Active rows meet terminations by month and license; terminations without an active
    license keep their own company and place.  Every vehicle of the plate counts.
    """
    met = ended.groupBy("ix", "cd_license", F.col("reason_id").alias("_reason")).agg(F.sum("n").alias("_n"))
    on = ["ix", "cd_license"]
    there = active.join(met, on, "left").select(
        *CELL, "cd_license", F.lit(1).alias("is_total"), "reg_dtm", "start_dtm", "last_term", "next_term",
        F.coalesce("reason_id", "_reason").alias("reason_id"), F.coalesce("_n", F.lit(1)).alias("n"),
    )
    alone = ended.join(active.select(*on).distinct(), on, "left_anti").select(
        *CELL, "cd_license", F.lit(0).alias("is_total"),
        *[F.lit(None).cast("date").alias(c) for c in ("reg_dtm", "start_dtm", "last_term", "next_term")],
        "reason_id", "n",
    )
    cars = vehicle.groupBy("cd_license", "source").agg(F.count(F.lit(1)).alias("_cars"))
    rows = there.unionByName(alone).join(cars, "cd_license", "left").withColumn(
        "n", F.col("n") * F.coalesce("_cars", F.lit(1))
    )
    mark = lambda c: F.when(c, 1).otherwise(0)
    fresh = F.col("last_term").isNull() & F.col("next_term").isNull() & (F.col("ix") == yrmo(F.col("reg_dtm")))
    back = F.col("last_term").isNotNull() & F.col("next_term").isNull() & (F.col("ix") == yrmo(F.col("start_dtm")))
    return rows.select(
        *CELL, "cd_license", "n", "is_total",
        mark((F.col("source") == FLEET_SOURCE) & fresh).alias("is_new_flt"),
        mark((F.col("source") != FLEET_SOURCE) & fresh).alias("is_new_oth"),
        mark(back).alias("is_reu"),
        mark(F.col("reason_id") == COMPLAINT_REASON).alias("is_term_cmp"),
        mark(F.col("reason_id") != COMPLAINT_REASON).alias("is_term_nrm"),
    )


def census_rows(
    services: DataFrame, suspended: DataFrame, vehicle: DataFrame, sd: dt.date, ed: dt.date
) -> DataFrame:
    return classified(
        active_licenses(services, suspended, sd, ed),
        terminations_in_period(services, suspended, sd, ed), vehicle,
    )


def census_counts(rows: DataFrame) -> DataFrame:
    """Long form: six counts per month, company and location."""
    return rows.groupBy(*CELL).agg(
        *[F.sum(F.col(f"is_{m}") * F.col("n")).cast("long").alias(f"cnt_{m}") for m in METRICS]
    )


def census_items(rows: DataFrame) -> DataFrame:
    """One row per license, metric and repetition: the entries of the license lists."""
    marks = F.array(*[F.when(F.col(f"is_{m}") == 1, F.lit(m)) for m in METRICS])
    return (
        rows.select(*CELL, "cd_license", "n", F.explode(F.array_compact(marks)).alias("kind"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))))
        .select(*CELL, "kind", F.col("cd_license").alias("text"), "copy")
    )


def location_census(
    services: DataFrame,
    suspended: DataFrame,
    vehicle: DataFrame,
    location: DataFrame,
    sd: dt.date,
    ed: dt.date,
    companies: Sequence[str] = COMPANIES,
    limit: int | None = lists.PART_BYTES,
) -> DataFrame:
    """Wide report: counts and license lists per company, one row per month and location.

    A list of more than `limit` bytes goes on in rows with part > 0, whose counts are NULL.
    """
    rows = durable(census_rows(services, suspended, vehicle, sd, ed))
    place = ["ix", "srv_dis", "srv_loc"]
    long_counts = census_counts(rows)
    zero = F.lit(0).cast("long")

    def cell(company: str, metric: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("company") == company, F.col(f"cnt_{metric}"))), zero)

    counts = long_counts.groupBy(*place).agg(
        *[cell(c, m).alias(f"{c}_{label}") for c in companies for m, label in METRICS.items()]
    )
    items = census_items(rows).filter(F.col("company").isin(*companies)).withColumn(
        "kind", F.concat("company", F.lit("_"), "kind")
    ).drop("company")
    names = {f"{c}_{m}": f"json_{c}_{label}" for c in companies for m, label in METRICS.items()}
    texts = lists.packed(items, place, names, '","', '["', '"]', limit)
    where = location.select("srv_dis", "srv_loc", "mgt_dis", "cd_fleet", F.trim("name_zh").alias("loc_name"))
    part = F.coalesce("part", F.lit(0))
    return (
        counts.join(texts, place, "left").join(where, ["srv_dis", "srv_loc"], "left")
        .select(
            *place, part.alias("part"), "mgt_dis", "cd_fleet", "loc_name",
            *[F.when(part == 0, F.col(f"{c}_{label}")).alias(f"{c}_{label}") for c in companies for label in METRICS.values()],
            *names.values(),
        )
    )
