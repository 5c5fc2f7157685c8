"""Worker schedule: one row per visit day of a service."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions.calendar import iso_weekday
from curbledger.functions.text import CRLF


def visit_days() -> Column:
    """Whether `l_date` is a visit day: A not on Saturday, B on three weekdays, C on one."""
    day = iso_weekday(F.col("l_date"))
    plan = F.col("srv_plan")
    return (
        ((plan == "A") & (day != 6))
        | ((plan == "B") & ((day == F.col("weekday1")) | (day == F.col("weekday2")) | (day == F.col("weekday3"))))
        | ((plan == "C") & (day == F.col("weekday1")))
    )


def worker_schedule(
    services: DataFrame,
    account: DataFrame,
    vehicle: DataFrame,
    location: DataFrame,
    sd: dt.date,
    ed: dt.date,
    worker: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Visits of one active worker (or of all) from `sd` to `ed`.

    All joins run per service; days are exploded last, in the same stage.
    """
    if ed < sd:
        raise ValueError("a schedule covers one day at least")
    served = services.filter(
        F.col("srv_plan").isin("A", "B", "C")
        & (F.col("start_dtm") <= F.lit(ed))
        & (F.col("end_dtm").isNull() | (F.col("end_dtm") >= F.lit(sd)))
    )
    if worker is not None:
        served = served.filter(F.col("worker") == worker)
    active = account.filter("active").select(F.col("id").alias("worker"))
    owner = account.select(F.col("id").alias("owner_id"), F.col("remarks").alias("_u"))
    car = vehicle.select("owner_id", "cd_license", F.col("remarks").alias("_v"))
    place = location.select(
        "srv_dis", "srv_loc", F.trim(F.concat_ws(" ", F.coalesce("name_zh", F.lit("")), F.coalesce("name_en", F.lit("")))).alias("loc_name")
    )
    has_note = F.col("_u").isNotNull() & (F.rtrim("_u") != "")
    note = F.concat(
        F.coalesce("_u", F.lit("")),
        F.when(has_note, F.concat(F.lit(";" + CRLF), F.col("_v"))).otherwise(F.lit("")),
    )
    joined = (
        served.join(active, "worker", "left_semi")
        .join(place, ["srv_dis", "srv_loc"])
        .join(owner, "owner_id")
        .join(car, ["owner_id", "cd_license"])
        .filter(F.coalesce("end_dtm", F.lit(ed)) >= F.col("start_dtm"))
    )
    days = joined.withColumn(
        "l_date",
        F.explode(F.sequence(
            F.greatest("start_dtm", F.lit(sd)), F.least(F.coalesce("end_dtm", F.lit(ed)), F.lit(ed))
        )),
    )
    out = days.filter(visit_days()).select(
        "l_date", "company", "cd_license", "srv_plan", "srv_dis", "srv_loc", "srv_floor", "srv_psn",
        "loc_name", "waxing", F.trim(note).alias("remarks"), "worker",
    )
    return out.orderBy("l_date", "srv_dis", "srv_loc", "srv_floor", "srv_psn") if ordered else out
