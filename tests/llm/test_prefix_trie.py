"""The conversation trie against dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from curbledger.llm import prefix_trie as T


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = role or "", text or ""
        tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        convs[T.NO_ID if c is None else c].append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}
    digits = lambda c: "" if c == T.NO_ID else str(c)
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(digits(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, s in sorted(full.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    known = lambda c: None if c == T.NO_ID else c
    return sorted([(known(who[0]), len(node), known(members[node[:-1]][0]) if node else None, len(who), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(digits(c) for c in who if full[c] == node).encode()).hexdigest())
                   for node, who in members.items()], key=repr)


def random_rows(seed, convs=160, longest=7, words=2):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-250, 450), convs) + [None]:
        n = rng.choice([0, 1, 2, 3, longest])
        if rng.random() < 0.3:  # copies of one conversation
            rows += [(c, t, "user", "same é\U0001f600") for t in range(3)]
            continue
        for t in range(n):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice([None, "", *("w" * k for k in range(words))])))
    return rows + rows[:10]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed, longest, shards, width", [(1, 7, None, 64), (2, 7, 23, 2), (3, 40, 7, 8), (4, 40, 60, 3), (5, 9, 1, 1), (6, 300, 5, 64)])
def test_same_as_prefix_dictionary(spark, seed, longest, shards, width):
    rows = random_rows(seed, longest=longest)
    frame = spark.createDataFrame([(*r, 1, b"x", "p") for r in rows], SCHEMA + ", depth int, ids binary, parent string").repartition(3)
    known = lambda c: None if c == T.NO_ID else c
    got = [(known(r.conv), r.depth, known(r.parent), *r[3:]) for r in T.prefix_trie(T.rebuilt(frame), shards, width).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_one_conversation_in_very_many_copies_spreads_over_shards(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 1500, 1) for t in range(6)]
    got = T.prefix_trie(T.rebuilt(spark.createDataFrame(rows, SCHEMA)), 40).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(rows)


def test_query_and_sql_on_odd_rows(spark):
    rows = random_rows(9, convs=60)
    got = T.op11_prefix_trie(spark.createDataFrame(rows, SCHEMA))
    con = duckdb.connect()
    conversations = spark.createDataFrame(rows, SCHEMA).toArrow()  # noqa: F841  the SQL reads it by name
    theirs = con.execute(T.OP11_SQL)
    assert got.columns == [c[0] for c in theirs.description]
    ours = sorted(map(tuple, got.collect()), key=repr)
    assert ours == brute(rows) == sorted(theirs.fetchall(), key=repr)


def test_query_is_its_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    theirs = duckdb.connect().execute(T.OP11_SQL.replace("FROM conversations", f"FROM '{path}'")).fetchall()
    assert sorted(map(tuple, T.op11_prefix_trie(spark.read.parquet(path)).collect()), key=repr) == sorted(theirs, key=repr)


def test_empty_tables(spark):
    assert T.op11_prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    one = T.op11_prefix_trie(spark.createDataFrame([(7, None, None, None)], SCHEMA)).collect()
    assert sorted(map(tuple, one), key=repr) == brute([(7, None, None, None)])
