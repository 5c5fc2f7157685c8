"""All registered queries."""

from __future__ import annotations

from curbledger.plans import loading, monthly, payments, reports
from curbledger.plans.catalog import Query

REGISTRY: dict[str, Query] = {**monthly.QUERIES, **payments.QUERIES, **reports.QUERIES, **loading.QUERIES}
