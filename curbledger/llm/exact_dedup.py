"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a text's bytes is the polynomial sum(byte[i] * 256 ** (n - 1 - i)) modulo a
120-bit prime.  It composes: f(xy) = f(x) * 256 ** len(y) + f(y).  So a huge text is cut into
chunks that many tasks hash, and the chunk hashes are combined; shorter texts run through the
same arithmetic in one call.  Texts of equal fingerprint and length are then compared with the
first of their group chunk by chunk, as sorted streams with one chunk in memory, and texts that
differ after all are set apart.  A large group is spread: each thousand members meet a copy of
the first member's chunks in a place of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.session import stored

MODULUS = 677341626522418261505179345600585243  # a prime of 120 bits, drawn at random
CHUNK = 1 << 16         # characters
HUGE = 1 << 20          # characters; longer texts are hashed by many tasks
MEMBERS = 1000          # of one group that are compared in one place
NO_ID = -(1 << 63)      # stands for a NULL document id: before all others
BLANKS = "[\\x20\\x09-\\x0D]+"


def fingerprint(data: bytes, modulus: int = MODULUS) -> int:
    return int.from_bytes(data, "big") % modulus


def combine(left: int, right: int, right_length: int, modulus: int = MODULUS) -> int:
    """The fingerprint of two byte strings, one after the other."""
    return (left * pow(256, right_length, modulus) + right) % modulus


def of_chunks(hashes: list[int], lengths: list[int], modulus: int = MODULUS) -> int:
    out = 0
    for value, n in zip(hashes, lengths):
        out = combine(out, value, n, modulus)
    return out


def _hash_texts(modulus: int):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            data = text.encode()
            parts = [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]
            return of_chunks([fingerprint(p, modulus) for p in parts], [len(p) for p in parts], modulus).to_bytes(16, "big")
        return texts.map(one)

    return run


def _hash_chunks(modulus: int):
    @F.pandas_udf("binary")
    def run(hashes: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([of_chunks([int.from_bytes(h, "big") for h in hs], [int(n) for n in ns], modulus).to_bytes(16, "big")
                          for hs, ns in zip(hashes, lengths)])

    return run


def _chunks(text, size: int):
    """Pieces of `size` characters; an empty text has one empty piece."""
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / F.lit(size)).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def fingerprints(docs: DataFrame, modulus: int = MODULUS, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """doc (NO_ID for NULL), sha (binary, of the normalised text), n_bytes, print: one row per row."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    clean = lambda df: df.select("doc", F.regexp_replace("text", BLANKS, " ").alias("text"))
    short = clean(rows.filter(F.length("text") <= huge)).select(
        "doc", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"),
        _hash_texts(modulus)("text").alias("print"))
    long_rows = clean(rows.filter(F.length("text") > huge)).select(
        "doc", F.unhex(F.sha2("text", 256)).alias("sha"), "text")
    parts = long_rows.select("doc", "sha", F.posexplode(_chunks(F.col("text"), chunk)).alias("at", "part"))
    hashed = parts.repartition("doc", "sha", "at").select(
        "doc", "sha", "at", F.octet_length("part").alias("n"), _hash_texts(modulus)("part").alias("h"))
    # a repeated row gives the same chunks again: once is enough, and `copies` has the number of rows
    once = hashed.groupBy("doc", "sha", "at", "n", "h").agg(F.count(F.lit(1)).alias("copies"))
    long = once.groupBy("doc", "sha").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "h"))).alias("c"), F.max("copies").alias("copies")).select(
        "doc", "sha", F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x.n).alias("n_bytes"),
        _hash_chunks(modulus)(F.col("c.h"), F.col("c.n")).alias("print"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")
    return short.unionByName(long)


def _differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted chunks, the rows whose chunk is not that of their group's first text."""
    key = first = None
    for batch in batches:
        doc, sha = [], []
        columns = [batch.column(c).to_pylist() for c in ("print", "n_bytes", "salt", "at", "lead", "doc", "sha")]
        part = batch.column("part")
        for i, (p, n, salt, at, lead, d, s) in enumerate(zip(*columns)):
            if lead:
                key, first = (p, n, salt, at), part[i].as_py()
            elif key != (p, n, salt, at) or part[i].as_py() != first:
                doc.append(d)
                sha.append(s)
        if doc:
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(sha, pa.binary())], ["doc", "sha"])


def unequal(docs: DataFrame, members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc, sha) of texts that share fingerprint and length with their group's first, but differ.

    `members` has the rows of groups of two or more: doc, sha, print, n_bytes, lead, size.
    """
    once = members.distinct()
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("_text"))
    places = (F.col("size") / MEMBERS).cast("int")
    chosen = texts.join(once, "doc").withColumn("text", F.regexp_replace("_text", BLANKS, " ")).drop("_text")
    salted = chosen.withColumn("salt", F.explode(
        F.when(F.col("lead"), F.sequence(F.lit(0), places))
        .otherwise(F.array(F.pmod(F.xxhash64("doc", "sha"), places + 1).cast("int")))))
    parts = salted.filter(F.unhex(F.sha2("text", 256)) == F.col("sha")).select(  # else another text of this id
        "doc", "sha", "print", "n_bytes", "salt", "lead", F.posexplode(_chunks(F.col("text"), chunk)).alias("at", "part"))
    order = ["print", "n_bytes", "salt", "at"]
    return (parts.repartition(*order).sortWithinPartitions(*order, F.desc("lead"), "doc")
            .mapInArrow(_differing, "doc long, sha binary").distinct())


def exact_groups(docs: DataFrame, modulus: int = MODULUS, huge: int = HUGE, chunk: int = CHUNK) -> DataFrame:
    """One row per row of `docs`: doc, sha, keep (the group's first doc), group_size, kept.

    A NULL text is an empty one; a NULL doc_id comes before all others.  Of rows that have even their
    id in common, one stays.  Other columns of `docs` are not read.
    """
    base = stored(fingerprints(docs, modulus, huge, chunk).withColumn("row", F.monotonically_increasing_id()))
    first = base.groupBy("print", "n_bytes").agg(F.min(F.struct("doc", "sha")).alias("lead"), F.count(F.lit(1)).alias("size"))
    members = base.join(first.filter("size > 1"), ["print", "n_bytes"]).select(
        "doc", "sha", "print", "n_bytes", (F.struct("doc", "sha") == F.col("lead")).alias("lead"), "size")
    apart = stored(unequal(docs, members, chunk)).withColumn("apart", F.lit(True))
    classed = base.join(apart, ["doc", "sha"], "left").withColumn(
        "other", F.when(F.col("apart"), F.col("sha")).otherwise(F.lit(b""))).drop("apart")
    groups = classed.groupBy("print", "n_bytes", "other").agg(
        F.min(F.struct("doc", "row")).alias("least"), F.count(F.lit(1)).alias("group_size"))
    return classed.join(groups, ["print", "n_bytes", "other"]).select(
        "doc", "sha", F.col("least.doc").alias("keep"), "group_size", (F.col("row") == F.col("least.row")).alias("kept"))


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name))


def op2_exact_dedup(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select(
        _id("doc").alias("doc_id"), _id("keep").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"))


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever these are called."""
    stay = exact_groups(docs).groupBy("doc", "sha").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("rows")).filter("kept")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"),
                        F.unhex(F.sha2(text, 256)).alias("sha"))
    mine = keyed.join(stay.select("doc", "sha", "rows"), ["doc", "sha"])
    single = mine.filter("rows = 1").select("row")
    repeated = mine.filter("rows > 1").dropDuplicates(["doc", "sha"]).select("row")
    return single.unionByName(repeated).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


OP2_SQL = r"""
WITH clean AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), hashed AS (SELECT doc_id, t, sha256(t) AS text_sha256 FROM clean)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY t)
"""
