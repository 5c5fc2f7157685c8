"""Referral bonus, claw-back, and rotation / waxing pay per worker."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import lists, text
from curbledger.functions.calendar import month_first, month_gap, month_key, month_last, shift_month, yrmo
from curbledger.functions.text import json_quoted

REFERRED = 2  # vehicle source: brought in by a worker
GRACE_MONTHS = 3


def referrals(services: DataFrame, vehicle: DataFrame, since: dt.date, worker: int | None = None) -> DataFrame:
    """First service per registration month and license of referred vehicles."""
    recent = services.filter(F.col("reg_dtm") >= F.lit(since))
    if worker is not None:
        recent = recent.filter(F.col("worker") == worker)
    cars = vehicle.filter(F.col("source") == REFERRED).select("owner_id", "cd_license")
    first = (
        recent.join(cars, ["owner_id", "cd_license"], "left_semi")
        .groupBy(yrmo(F.col("reg_dtm")).alias("join_ix"), "cd_license")
        .agg(F.min(F.struct("start_dtm", "reg_dtm", "worker", "srv_plan")).alias("s"))
    )
    return first.select("join_ix", "cd_license", "s.reg_dtm", "s.worker", "s.srv_plan")


def defaulters(suspended: DataFrame, since: dt.date, until: dt.date) -> DataFrame:
    """Distinct terminations in the window."""
    ended = suspended.filter(
        F.col("is_terminate") & (F.col("end_dtm") >= F.lit(since)) & (F.col("end_dtm") <= F.lit(until))
    )
    return ended.select(
        F.col("ix_yrmo").alias("deft_ix"), "cd_license", F.col("srv_plan").alias("_plan"), "end_dtm", "worker"
    ).distinct()


def matched_referrals(new: DataFrame, gone: DataFrame) -> DataFrame:
    """Referrals with the terminations of the same license and worker."""
    return new.join(gone, ["cd_license", "worker"], "left").withColumn(
        "diff", month_gap(F.col("reg_dtm"), F.col("end_dtm"))
    )


def kinds(facts: DataFrame, ix: int) -> DataFrame:
    """Rows by kind: `add` (joined this month) or `base` (earlier), and `sub` (left again)."""
    left_again = (F.col("deft_ix") == ix) & (F.col("diff") < GRACE_MONTHS)
    stays = F.when(F.col("join_ix") == ix, F.lit("add")).otherwise(F.lit("base"))
    return (
        facts.withColumn(
            "kind",
            F.explode(
                F.when(F.col("deft_ix").isNull(), F.array(stays))
                .when(left_again, F.array(stays, F.lit("sub")))
                .otherwise(F.array().cast("array<string>"))
            ),
        )
    )


def _by_plan(count: Column) -> Column:
    plan = F.col("srv_plan")
    rate = F.when(plan == "A", F.col("bonus_a")).when(plan == "B", F.col("bonus_b")).when(plan == "C", F.col("bonus_c"))
    return count * rate


def month_bonus(rows: DataFrame, worker_table: DataFrame) -> DataFrame:
    """Bonus and deduction per joining month and worker."""
    per_plan = (
        rows.select("join_ix", "worker", "srv_plan", "kind", "cd_license").distinct()
        .groupBy("join_ix", "worker", "srv_plan")
        .agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("add", "base", "sub")])
    )
    rates = worker_table.select(F.col("uid").alias("worker"), "bonus_a", "bonus_b", "bonus_c", "bonus_extra")
    base, sub = F.sum("base"), F.sum("sub")
    extra = F.when(base < 4, F.lit(0)).otherwise(F.least(base - 3, sub))
    return (
        per_plan.join(rates, "worker").groupBy("join_ix", "worker")
        .agg(
            F.sum(_by_plan(F.col("add"))).alias("bonus"),
            (F.min("bonus_extra") * extra + F.sum(_by_plan(F.col("sub")))).alias("deduct"),
        )
    )


def worker_bonus(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy("worker").agg(
        F.sum("bonus").alias("bonus"), F.sum("deduct").alias("deduct"),
        (F.sum("bonus") - F.sum("deduct")).alias("total"),
    )


def extra_items(services: DataFrame, month: dt.date, worker: int | None = None) -> DataFrame:
    """One row per worker and license with rotation and/or waxing in the month."""
    active = services.filter(
        (F.col("start_dtm") <= F.lit(month_last(month)))
        & (F.col("end_dtm").isNull() | (F.col("end_dtm") >= F.lit(month_first(month))))
    )
    if worker is not None:
        active = active.filter(F.col("worker") == worker)
    return active.groupBy("worker", "cd_license").agg(
        F.max("rotation").alias("rotation"),
        F.max(F.coalesce(F.trim("rotation") != "", F.lit(False))).alias("has_rot"),
        F.max("waxing").alias("has_wax"),
    ).filter(F.col("has_rot") | F.col("has_wax"))


def extra_counts(items: DataFrame) -> DataFrame:
    """Rotation and waxing counts per worker; NULL where a worker has none of one kind."""
    some = lambda c: F.nullif(F.count(F.when(F.col(c), 1)), F.lit(0))
    return items.groupBy("worker").agg(some("has_rot").alias("rot_cnt"), some("has_wax").alias("wax_cnt"))


def _bonus_text() -> Column:
    return F.concat(
        F.lit('{"l":'), json_quoted(F.col("cd_license")), F.lit(',"p":"'), F.col("srv_plan"), F.lit('"}')
    )


def default_rate(config: DataFrame, name: str) -> Column:
    """The whole part of a configured extra rate (NULL if there is none), as a scalar subquery."""
    same = lambda c, value: text.match_key(F.col(c)) == value
    rows = config.filter(same("dict_key", "DATA") & same("grp_key", "SALARY_EX") & same("c_value1", name))
    return rows.agg(F.max(F.col("c_value2").cast("double").cast("int"))).scalar()


def calc_bonus(
    services: DataFrame,
    vehicle: DataFrame,
    suspended: DataFrame,
    worker_table: DataFrame,
    month: dt.date,
    config: DataFrame,
    worker: int | None = None,
    limit: int | None = lists.PART_BYTES,
) -> DataFrame:
    """Bonus per worker with the license lists as JSON text.

    The personal rotation and waxing rates count only for workers with referrals; the default
    rates come from `config` and are whole numbers, without their fraction.  A list of more than `limit` bytes goes on in
    rows with part > 0, whose amounts are NULL.
    """
    ix = month_key(month)
    since = shift_month(month, -GRACE_MONTHS)
    facts = matched_referrals(
        referrals(services, vehicle, since, worker), defaulters(suspended, since, month_last(month))
    )
    rows = kinds(facts, ix)
    final = worker_bonus(month_bonus(rows, worker_table))
    extras = extra_items(services, month, worker)

    rates = worker_table.select(F.col("uid").alias("worker"), "sal_rot", "sal_wax")
    have = final.join(rates, "worker", "left").join(
        extra_counts(extras).withColumnRenamed("worker", "_w"), F.col("worker") == F.col("_w"), "full"
    )
    none = (
        (F.col("bonus") == 0) & (F.col("deduct") == 0) & (F.col("rot_cnt") == 0) & (F.col("wax_cnt") == 0)
    )
    count = lambda c: F.coalesce(c, F.lit(0))
    pay = lambda cnt, rate, default: (
        count(cnt) * F.coalesce(F.col(rate).cast("double"), default)
    ).cast("int")
    numbers = have.filter(~none).select(
        F.coalesce("worker", "_w").alias("worker"),
        count("bonus").cast("int").alias("bonus"), count("deduct").cast("int").alias("deduct"),
        count("total").cast("int").alias("total"),
        count("rot_cnt").cast("int").alias("rot_cnt"), pay("rot_cnt", "sal_rot", default_rate(config, "ROTATION")).alias("rot_sal"),
        count("wax_cnt").cast("int").alias("wax_cnt"), pay("wax_cnt", "sal_wax", default_rate(config, "WAXING")).alias("wax_sal"),
    )

    joined = rows.filter(F.col("kind") != "base").select(
        "worker", "kind", _bonus_text().alias("text"), F.concat_ws("/", "join_ix", "deft_ix", "end_dtm", "_plan").alias("copy")
    )
    rotation = extras.filter("has_rot").select(
        "worker", F.lit("rot").alias("kind"),
        F.concat(F.lit('"'), "cd_license", F.lit(" / "), "rotation", F.lit('"')).alias("text"), F.lit("").alias("copy"),
    )
    waxing = extras.filter("has_wax").select(
        "worker", F.lit("wax").alias("kind"), F.concat(F.lit('"'), "cd_license", F.lit('"')).alias("text"),
        F.lit("").alias("copy"),
    )
    texts = lists.packed(
        joined.unionByName(rotation).unionByName(waxing), ["worker"],
        {"add": "json_add", "sub": "json_sub", "rot": "json_rot", "wax": "json_wax"}, limit=limit,
    )
    part = F.coalesce("part", F.lit(0))
    measure = lambda c: F.when(part == 0, F.col(c)).alias(c)
    return numbers.join(texts, "worker", "left").select(
        "worker", part.alias("part"), measure("bonus"), measure("deduct"), measure("total"),
        "json_add", "json_sub", measure("rot_cnt"), measure("rot_sal"), measure("wax_cnt"), measure("wax_sal"),
        "json_rot", "json_wax",
    )
