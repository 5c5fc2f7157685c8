"""A registered query: how Spark builds it and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbledger.session import tuned
from curbledger.sources.fixtures import domain_table, domain_tables, duckdb_ctes

S = TypeVar("S")

_TYPES = {
    "int": ("int", "INTEGER"), "long": ("long", "BIGINT"), "text": ("string", "VARCHAR"),
    "money": ("decimal(15,2)", "DECIMAL(15,2)"), "ratio": ("decimal(17,4)", "DECIMAL(17,4)"),
    "date": ("date", "DATE"), "bool": ("boolean", "BOOLEAN"),
}


class Tables:
    """Domain tables of one data folder, made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = domain_table(self.spark, self.sf_dir, name)
        setattr(self, name, table)
        return table

    def run(self, stages: type[S]) -> S:
        """The one run of a multi-stage job over this data that its queries share."""
        runs = domain_tables(self.spark, self.sf_dir).runs
        if stages not in runs:
            runs[stages] = stages(self)
        return runs[stages]


@dataclass(frozen=True)
class Query:
    """`columns` is "name:type ..."; both engines cast to it."""

    columns: str
    build: Callable[[Tables], DataFrame]
    views: tuple[str, ...] = ()
    sql: str | None = None

    def spec(self) -> list[tuple[str, str]]:
        return [tuple(item.split(":")) for item in self.columns.split()]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(Tables(tuned(spark), sf_dir))
        return out.select(*[F.col(name).cast(_TYPES[kind][0]).alias(name) for name, kind in self.spec()])

    def oracle(self) -> str | None:
        """`sql` is a list of CTEs, the last of them `result`."""
        if self.sql is None:
            return None
        ctes = ",\n".join(part for part in (duckdb_ctes(*self.views), self.sql.strip()) if part)
        columns = ", ".join(f'CAST("{name}" AS {_TYPES[kind][1]}) AS "{name}"' for name, kind in self.spec())
        return f"WITH RECURSIVE {ctes}\nSELECT {columns} FROM result"
