"""Column names of legacy extracts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

# Table prefixes of the legacy columns.
PREFIXES = ("CAR_", "SCR_", "HNP_", "WKR_", "SRV_", "USR_")


def snake_name(name: str) -> str:
    """CAR_ChangeItemDate -> change_item_date; receipts keep their prefix (pay_rec_amount)."""
    if name == "WKR_ServicePrice":  # the price list has both SRV_ServicePrice and this one
        return "worker_service_price"
    bare = next((name[len(p):] for p in PREFIXES if name.startswith(p)), name)
    if bare == "PAY_CarNumber":
        return "car_number"
    if bare == "PAY_CompanyCode":
        return "company_code"
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", bare)
    return re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", words).lower()


def snake_columns(extract: DataFrame) -> DataFrame:
    return extract.toDF(*[snake_name(c) for c in extract.columns])
