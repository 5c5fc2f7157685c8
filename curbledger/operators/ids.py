"""Ids that stay: a registry from login keys to ids, grown from its high-water mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.functions import ordered, text


def login_key() -> Column:
    """The key of an account: its login as the collation compares it, else its display name."""
    return F.coalesce(text.match_key(F.col("login_name")), F.concat(F.lit("#"), F.col("display_name")))


def assigned(accounts: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts with their id, and the registry rows (login_key, id) that are new.

    Known keys keep their id.  New ones are numbered in key order after the largest id given so far, so
    a second run gives the same ids, and later stages go on behind earlier ones.  Accounts of one key
    share an id.
    """
    keyed = accounts.withColumn("login_key", login_key())
    unknown = keyed.select("login_key").distinct().join(registry.select("login_key"), "login_key", "left_anti")
    high = registry.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long")).first()[0]
    new = ordered.row_number(unknown, [], ["login_key"], "_no").select("login_key", (F.col("_no") + high).cast("int").alias("id"))
    ids = registry.select("login_key", "id").unionByName(new)
    return keyed.join(ids, "login_key").drop("login_key"), new
