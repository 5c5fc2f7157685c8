"""Prefix trie of conversations from padded turn-id matrices.

A turn's id is the first 16 bytes of the SHA-256 of its role and text; a conversation is the row of its
turns' ids.  Rows are range-sharded on (ids, conversation), so the conversations below a node are
neighbours and a hot one spreads over many shards.  Inside a shard:

* ids become dense codes, rows a matrix padded with 0, and one `lexsort` orders them (columns in blocks
  of `WIDTH`; rows that go on past a block are ordered again by the next one inside their group);
* column change masks, OR-accumulated from left to right, mark in column d where nodes of depth d + 1 begin;
* `reduceat` over the rows between starts aggregates every depth, from the deepest to the root, on whose
  way up leaves and saved characters of closed nodes are summed below each node.

A node that holds a shard's first or last row may go on in the next shard: it is open.  Only the two
edge paths of a shard are open; `_recombined` walks these paths in shard order, one row a node, merges
what belongs together, and tells the merged nodes' smallest members back to the shards.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.session import near, stored

NO_ID = -(1 << 63)       # stands for a NULL conversation id: before all others
ID_BYTES = 16
WIDTH = 64               # columns of the matrix that are sorted at once
SHARD_TURNS = 1_000_000  # turns in a shard, about
BASE, HEADS = 100, 6     # conversations of one base share up to HEADS - 1 first turns
NOTHING = hashlib.sha256(b"").hexdigest()

_FIELDS = [
    ("shard", pa.int32()), ("side", pa.int32()), ("depth", pa.int64()), ("open", pa.bool_()), ("conv", pa.int64()),
    ("parent", pa.int64()), ("parent_shard", pa.int32()), ("parent_side", pa.int32()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
    ("id", pa.binary()), ("chars", pa.int64()), ("more", pa.bool_()),
]
_SCHEMA = pa.schema(_FIELDS)
_DDL = ("shard int, side int, depth long, open boolean, conv long, parent long, parent_shard int, parent_side int, n_convs long, "
        "n_children long, n_leaves long, saved long, ends string, id binary, chars long, more boolean")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv, ids (binary, 16 bytes a turn), chars (code points of each text): one row a conversation."""
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.select(conv.alias("conv"), "turn", F.left(digest, F.lit(2 * ID_BYTES)).alias("id"), F.length(text).alias("chars"))
    own = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("own"))
    decimal = F.when(F.col("conv") == NO_ID, "").otherwise(F.col("conv").cast("string"))
    keyed = own.withColumn("h", (F.crc32(decimal) % HEADS).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % BASE)
    heads = own.filter(F.col("conv") % BASE == 0).select(F.col("conv").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    kind = own.schema["own"].dataType
    joined = keyed.join(heads, "base", "left").withColumn("head", F.coalesce("head", F.array().cast(kind)))
    seq = F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.size("own")))
    return joined.select("conv", seq.alias("seq")).select(
        "conv", F.unhex(F.array_join(F.col("seq.id"), "")).alias("ids"), F.col("seq.chars").alias("chars"))


def _codes(ids: np.ndarray) -> np.ndarray:
    """Dense numbers from 1 on of 16-byte ids, in their byte order."""
    high, low = ids[:, 0], ids[:, 1]
    order = np.lexsort((low, high))
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    out = np.empty(len(ids), np.int32)
    out[order] = np.cumsum(fresh)
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


def _sorted_nodes(conv: np.ndarray, codes: np.ndarray, lens: np.ndarray, first: np.ndarray, width: int):
    """The rows in order, and for each depth the row ranges (starts, ends) of its nodes."""
    n = len(conv)
    order, group = np.arange(n), np.zeros(n, np.int64)
    nodes = [(np.zeros(1, np.int64), np.full(1, n, np.int64))]
    block, active = 0, np.arange(n)
    while len(active):
        rows = order[active]
        left = lens[rows] - block * width
        columns = int(min(width, left.max()))
        inside = np.arange(columns) < left[:, None]
        matrix = np.zeros((len(rows), columns), np.int32)
        matrix[inside] = codes[(first[rows][:, None] + block * width + np.arange(columns))[inside]]
        place = np.lexsort((conv[rows], left > width, *matrix.T[::-1], group[active]))
        order[active], matrix, left = rows[place], matrix[place], left[place]
        change = np.ones((len(rows), columns + 1), bool)
        change[1:, 0] = group[active][1:] != group[active][:-1]
        change[1:, 1:] = matrix[1:] != matrix[:-1]
        new = np.logical_or.accumulate(change, axis=1)[:, 1:]
        for j in range(columns):
            starts = np.flatnonzero(new[:, j])
            ends = np.append(starts[1:], len(rows))
            real = matrix[starts, j] > 0
            if real.any():
                nodes.append((active[starts[real]], active[ends[real] - 1] + 1))
        on = left > width
        if on.any():
            group[active] = np.cumsum(new[:, -1])
        active, block = active[on], block + 1
    return order, nodes


def _joined(ids: np.ndarray) -> str:
    return ",".join("" if c == NO_ID else str(c) for c in ids.tolist())


def shard_nodes(shard: int, conv: np.ndarray, data: bytes, chars: np.ndarray, lens: np.ndarray, width: int = WIDTH) -> pa.RecordBatch:
    """All nodes of a shard's conversations: closed ones as they are, open ones as far as this shard knows."""
    n = len(conv)
    ids = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 2)
    first = np.cumsum(lens) - lens
    order, nodes = _sorted_nodes(conv, _codes(ids), lens, first, width)
    conv, lens, first = conv[order], lens[order], first[order]

    at_run = np.sort(np.concatenate([s[lens[s] == d] for d, (s, _) in enumerate(nodes)]))
    run_end = np.append(at_run[1:], n)
    leaf_sum, saved_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = [np.minimum.reduceat(conv[_ranges(s, e - s)], np.cumsum(e - s) - (e - s)) for s, e in nodes]
    out, below = [], np.zeros(0, np.int64)  # below: starts of closed nodes one level deeper
    for d in range(len(nodes) - 1, -1, -1):
        s, e = nodes[d]
        is_open = (s == 0) | (e == n)
        closed = ~is_open
        more = lens[e - 1] > d
        last = first[s] + d - 1
        size = chars[last] if d else np.zeros(1, np.int64)
        leaf_sum[s[closed & ~more]] += 1
        saved_sum[s[closed]] += ((e - s - 1) * size)[closed]
        covered, begin = _ranges(s, e - s), np.cumsum(e - s) - (e - s)
        if d:
            up_s, up_e = nodes[d - 1]
            up = np.searchsorted(up_s, s, "right") - 1
            up_open = (up_s[up] == 0) | (up_e[up] == n)
            up_side = np.where(up_s[up] == 0, 0, 1)
        else:
            up, up_open, up_side = np.zeros(1, np.int64), np.zeros(1, bool), np.zeros(1, np.int64)
        run = np.minimum(np.searchsorted(at_run, s), len(at_run) - 1)
        ends = []
        for k, (ended, r, o) in enumerate(zip((lens[s] == d).tolist(), run.tolist(), is_open.tolist())):
            text = _joined(conv[at_run[r]:run_end[r]]) if ended else None
            ends.append(text if o else NOTHING if text is None else hashlib.sha256(text.encode()).hexdigest())
        known = np.zeros(len(s), bool) if not d else ~up_open
        asked = np.zeros(len(s), bool) if not d else up_open
        turn = ids[last] if d else np.zeros((1, 2), np.uint64)
        out.append([
            pa.array(np.full(len(s), shard), pa.int32()), pa.array(np.where(s == 0, 0, 1), pa.int32()), pa.array(np.full(len(s), d), pa.int64()),
            pa.array(is_open), pa.array(least[d], pa.int64()),
            pa.array(least[d - 1][up] if d else least[0], pa.int64(), mask=~known),
            pa.array(np.full(len(s), shard), pa.int32(), mask=~asked), pa.array(up_side, pa.int32(), mask=~asked),
            pa.array(e - s, pa.int64()), pa.array(np.searchsorted(below, e) - np.searchsorted(below, s), pa.int64()),
            pa.array(np.add.reduceat(leaf_sum[covered], begin), pa.int64()), pa.array(np.add.reduceat(saved_sum[covered], begin), pa.int64()),
            pa.array(ends, pa.string()), pa.array([t.astype(">u8").tobytes() if o else None for t, o in zip(turn, is_open.tolist())], pa.binary()),
            pa.array(size, pa.int64()), pa.array(more),
        ])
        below = s[closed]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], schema=_SCHEMA)


def _shards(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, conv, data, chars, lens = 0, [], [], [], []
        for batch in batches:
            if batch.num_rows:
                shard = batch.column("shard")[0].as_py()
                conv.append(batch.column("conv").to_numpy())
                data.extend(batch.column("ids").to_pylist())
                chars.append(batch.column("chars").flatten().to_numpy().astype(np.int64))
                lens.append(batch.column("chars").value_lengths().to_numpy().astype(np.int64))
        if conv:
            yield shard_nodes(shard, np.concatenate(conv), b"".join(data), np.concatenate(chars), np.concatenate(lens), width)

    return run


class _Node:
    """An open node while its shards go by."""

    def __init__(self, row: dict):
        self.id, self.depth, self.chars = row["id"], row["depth"], row["chars"]
        self.name, self.aliases = (row["shard"], row["side"]), []
        self.conv, self.more = row["conv"], False
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.hash, self.ended = hashlib.sha256(), False
        self.open_leaves = self.open_saved = 0  # of open nodes below: shards have counted the closed ones at every depth

    def add(self, row: dict) -> None:
        self.aliases.append((row["shard"], row["side"]))
        self.conv, self.more = min(self.conv, row["conv"]), self.more or row["more"]
        for k in ("n_convs", "n_children", "n_leaves", "saved"):
            setattr(self, k, getattr(self, k) + row[k])
        if row["ends"] is not None:
            self.hash.update(("," * self.ended + row["ends"]).encode())
            self.ended = True

    def close(self, parent: _Node | None) -> list[dict]:
        """The merged node, and its smallest member for each shard that knows a part of it (`n_convs` NULL)."""
        self.open_saved += (self.n_convs - 1) * self.chars
        self.open_leaves += not self.more
        if parent:
            parent.open_leaves, parent.open_saved = parent.open_leaves + self.open_leaves, parent.open_saved + self.open_saved
            parent.n_children += 1
        self.n_leaves, self.saved = self.n_leaves + self.open_leaves, self.saved + self.open_saved
        node = {"shard": self.name[0], "side": self.name[1], "depth": self.depth, "open": False, "conv": self.conv, "ends": self.hash.hexdigest(),
                "parent_shard": parent and parent.name[0], "parent_side": parent and parent.name[1],
                **{k: getattr(self, k) for k in ("n_convs", "n_children", "n_leaves", "saved")}}
        return [node] + [{"shard": a, "side": b, "depth": self.depth, "open": True, "conv": self.conv} for a, b in self.aliases]


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of open rows by (shard, side, depth): merged nodes, and what their parts are called."""
    path: list[_Node] = []
    out: list[dict] = []
    shard, same = None, True
    as_batch = lambda rows: pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
    for batch in batches:
        for at in range(0, batch.num_rows, 100):  # a row can hold the ids of a shard
            for row in batch.slice(at, 100).to_pylist():
                if row["shard"] != shard:
                    shard, same = row["shard"], True
                d = row["depth"]
                same = same and not row["side"] and len(path) > d and path[d].id == row["id"]
                if not same:
                    while len(path) > d:
                        node = path.pop()
                        out += node.close(path[-1] if path else None)
                    path.append(_Node(row))
                path[d].add(row)
            if len(out) > 10_000:
                yield as_batch(out)
                out = []
    while path:
        node = path.pop()
        out += node.close(path[-1] if path else None)
    if out:
        yield as_batch(out)


def prefix_trie(sequences: DataFrame, shards: int | None = None, width: int = WIDTH) -> DataFrame:
    """Nodes of the trie over `conv`, `ids`, `chars` (as `rebuilt` gives them), with conv NO_ID for NULL ids.

    conv, depth, parent (NULL at the root), n_convs, n_children, n_leaves, saved, ends.  No rows, no nodes.
    A conversation is one row of its shard's matrix: 20 bytes a turn.
    """
    spark = sequences.sparkSession
    rows = stored(sequences)
    turns = rows.agg(F.sum(F.size("chars"))).first()[0] or 0
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(turns / SHARD_TURNS))
    dealt = rows.repartitionByRange(shards, "ids", "conv").select(F.spark_partition_id().alias("shard"), "conv", "ids", "chars")
    parts = stored(dealt.mapInArrow(_shards(width), _DDL))
    paths = parts.filter("open").repartition(1).sortWithinPartitions("shard", "side", "depth")
    merged = stored(paths.mapInArrow(_recombined, _DDL))
    names = merged.filter("open").select(
        F.col("shard").alias("parent_shard"), F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("conv").alias("merged"))
    done = parts.filter("not open").unionByName(merged.filter("not open"))
    return done.join(near(names, names.count()), ["parent_shard", "parent_side", "depth"], "left").select(
        "conv", "depth", F.coalesce("parent", "merged").alias("parent"), "n_convs", "n_children", "n_leaves", "saved", "ends")


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every conversation, rebuilt, in one trie.

    Turns are ordered by turn (NULL first), then by id (ties); repeated rows are turns of their own.  A NULL
    role or text is empty.  Rows with a NULL conv_id are one conversation of their own, before all others and
    with no digits; its conv_id comes back as NULL.  `%` takes the sign of the id.  Other columns are not read.
    """
    known = lambda name: F.when(F.col(name) != NO_ID, F.col(name))
    return prefix_trie(rebuilt(conversations)).select(
        known("conv").alias("conv_id"), "depth", known("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


#: The CRC runs over the bits of the decimal id; a node is the list of its turns.
OP11_SQL = r"""
WITH turns AS (
  SELECT coalesce(conv_id, -9223372036854775808) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), own AS (
  SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS s,
    CASE WHEN c = -9223372036854775808 THEN '' ELSE CAST(c AS VARCHAR) END AS digits
  FROM turns GROUP BY c
), headed AS (
  SELECT c, s, digits, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(digits, ''),
      lambda x: CASE WHEN x = '' THEN [] ELSE [(ascii(x) >> k) & 1 FOR k IN range(8)] END))),
      lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h
  FROM own
), seqs AS (
  SELECT a.c, a.digits, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS s FROM headed a LEFT JOIN own b ON b.c = a.c - a.c % 100
), prefixes AS (
  SELECT c, digits, s, d, s[1:d] AS node FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT node, d, min(c) AS c, count(*) AS n, max(len(s)) = d AS leaf, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node[d].text) END AS saved,
    sha256(coalesce(string_agg(digits, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends
  FROM prefixes GROUP BY node, d
), below AS (
  SELECT node[1:u] AS top, d, u, leaf, saved FROM (SELECT *, unnest(range(d + 1)) AS u FROM nodes)
), sums AS (
  SELECT top, u, count(*) FILTER (d = u + 1) AS children, count(*) FILTER (leaf) AS leaves, sum(saved) AS saved FROM below GROUP BY top, u
)
SELECT nullif(n.c, -9223372036854775808) AS conv_id, CAST(n.d AS BIGINT) AS depth, nullif(p.c, -9223372036854775808) AS parent_conv_id,
  n.n AS n_convs, s.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node AND s.u = n.d LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""
