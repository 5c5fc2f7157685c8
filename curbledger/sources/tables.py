"""Read and write the tables of the data model as Parquet, part by part.

A table lies in parts: the months of a table with `ix_yrmo`, buckets of ids, or the one part 0.  A
publication writes the new content of the parts it changes to folders of its own, and then one manifest
file that names the version of each of them, for all its tables at once.  Readers follow the
manifests, so they see a publication whole or not at all, a failed job leaves the old state in place,
and parts that a job does not change keep their files.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from curbledger.sources.schemas import NOW, Table, tables

MANIFEST = "_published"
_ENTRY = "table_name string, part int, version string, added boolean, seq long"


@dataclass(frozen=True)
class Change:
    """New rows of some parts of a table: their whole content, or rows that join it (`added`)."""

    rows: DataFrame
    parts: tuple[int, ...] | None = None  # None: of the whole table
    added: bool = False


def conform(df: DataFrame, table: Table, now: dt.datetime) -> DataFrame:
    """Rows with the table's columns, types and defaults; text loses its padding."""
    have = set(df.columns)
    out = []
    for name, kind in table.columns.items():
        value = F.col(name) if name in have else F.lit(None)
        if name in table.defaults:
            default = table.defaults[name]
            value = F.coalesce(value, F.lit(now if default is NOW else default))
        kind = kind.rstrip("?")
        value = value.cast(kind)
        out.append((F.rtrim(value) if kind == "string" else value).alias(name))
    return df.select(*out)


def with_computed(df: DataFrame, table: Table) -> DataFrame:
    return df.withColumns(dict(table.computed)) if table.computed else df


def _folder(root: str, name: str, version: str) -> str:
    return f"{root}/{name}/version={version}"


class Snapshot:
    """All tables as the manifests say at one moment."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.live: dict[str, dict[int, list[str]]] = {}
        try:
            manifests = spark.read.schema(_ENTRY).json(f"{root}/{MANIFEST}")
        except AnalysisException:
            return
        for e in sorted(manifests.collect(), key=lambda e: (e.seq, e.part is not None)):  # a row for each part of a publication
            parts = self.live.setdefault(e.table_name, {})
            if e.part is None:  # the whole table begins anew
                parts.clear()
            elif e.version is None:
                parts.pop(e.part, None)
            elif e.added:
                parts.setdefault(e.part, []).append(e.version)
            else:
                parts[e.part] = [e.version]

    def read(self, name: str, parts: Iterable[int] | None = None) -> DataFrame:
        """A table, or some parts of it, with its computed columns."""
        table = tables()[name]
        live = self.live.get(name, {})
        chosen = live if parts is None else {p: live[p] for p in set(parts) if p in live}
        paths = sorted(f"{_folder(self.root, name, v)}/{table.part_name}={p}" for p, versions in chosen.items() for v in versions)
        if not paths:
            return with_computed(self.spark.createDataFrame([], table.schema()), table)
        schema = table.schema().add("version", T.StringType())
        if table.part_name not in table.columns:
            schema = schema.add(table.part_name, T.IntegerType())
        stored = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(*paths)
        return with_computed(stored.select(*table.columns), table)


def publish(changes: Mapping[str, DataFrame | Change], root: str, version: str, now: dt.datetime) -> None:
    """Write all changes under one version, then the manifest that makes them visible."""
    known, entries = tables(), []
    seq = int(now.timestamp() * 1_000_000)
    spark = None
    for name, change in changes.items():
        change = change if isinstance(change, Change) else Change(change)
        table, spark = known[name], change.rows.sparkSession
        rows = conform(change.rows, table, now)
        if table.part_name not in table.columns:
            rows = rows.withColumn(table.part_name, table.part())
        if change.parts is not None and not change.added:
            rows = rows.filter(F.col(table.part_name).isin(*change.parts) if change.parts else F.lit(False))
        folder = _folder(root, name, version)
        # parts as evenly large tasks: a large part is split, small ones share a task
        rows.hint("rebalance", table.part_name).write.mode("errorifexists").partitionBy(table.part_name).parquet(folder)
        written = _written(spark, folder, table)
        if change.parts is None and not change.added:
            entries.append((name, None, None, False, seq))
        gone = set(change.parts or ()) - written if not change.added else set()
        entries += [(name, p, version, change.added, seq) for p in sorted(written)] + [(name, p, None, False, seq) for p in sorted(gone)]
    if spark:
        _write_manifest(spark, entries, root)


def _written(spark: SparkSession, folder: str, table: Table) -> set[int]:
    """Parts that a version has, by the names of their folders."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return {int(n.split("=")[1]) for n in names if n.startswith(f"{table.part_name}=")}


def _write_manifest(spark: SparkSession, entries: list[tuple], root: str) -> None:
    """One file: it is there whole or not at all."""
    spark.createDataFrame(entries, _ENTRY).coalesce(1).write.mode("append").json(f"{root}/{MANIFEST}")


def compact(spark: SparkSession, root: str, name: str, parts: Iterable[int], version: str, now: dt.datetime) -> None:
    """Parts that were added to again and again become one version each."""
    parts = tuple(parts)
    publish({name: Change(Snapshot(spark, root).read(name, parts), parts)}, root, version, now)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The published state of a table, with its computed columns."""
    return Snapshot(spark, root).read(name)


def error_rows(spark: SparkSession, member: str, messages: list[str], now: dt.datetime) -> DataFrame:
    return spark.createDataFrame([(now, "SPARK_JOB", member, m) for m in messages],
                                 "create_dtm timestamp_ntz, caller_class string, caller_member string, msg string")


def append_error(spark: SparkSession, root: str, member: str, message: str, now: dt.datetime) -> None:
    """One row in the error log."""
    rows = error_rows(spark, member, [message], now)
    publish({"audit_error": Change(rows, added=True)}, root, f"error-{uuid.uuid4().hex}", now)


def read_errors(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "audit_error")
