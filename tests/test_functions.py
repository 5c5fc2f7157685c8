import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curbledger.functions import calendar, lists, ordered, text


def test_weekday_hits_against_counting(spark):
    start = dt.date(1998, 5, 28)
    rows = [
        (w, start + dt.timedelta(days=a), start + dt.timedelta(days=a + n))
        for w in range(1, 8) for a in range(9) for n in range(-1, 40)
    ]
    df = spark.createDataFrame(rows, "w int, a date, b date")
    got = df.select("w", "a", "b", calendar.weekday_hits(F.col("w"), F.col("a"), F.col("b")).alias("n")).collect()
    for row in got:
        days = (row.b - row.a).days + 1
        assert row.n == sum((row.a + dt.timedelta(days=i)).isoweekday() == row.w for i in range(days))


@given(st.dates(dt.date(1990, 1, 1), dt.date(2030, 1, 1)), st.integers(0, 400))
@settings(max_examples=200, deadline=None)
def test_billing_span_follows_the_month_loop(sd, days):
    ed = sd + dt.timedelta(days=days)
    months = [calendar.month_first(sd)]
    while calendar.shift_month(months[-1], 1) < ed:
        months.append(calendar.shift_month(months[-1], 1))
    assert calendar.billing_span(sd, ed) == (months[0], months[-1])


def test_month_gap_counts_boundaries(spark):
    df = spark.createDataFrame([(dt.date(1998, 1, 31), dt.date(1998, 2, 1), 1), (dt.date(1998, 2, 1), dt.date(1998, 1, 31), -1),
                                (dt.date(1997, 12, 1), dt.date(1998, 1, 31), 1)], "a date, b date, n int")
    assert df.filter(calendar.month_gap(F.col("a"), F.col("b")) != F.col("n")).count() == 0


def _worker_pieces(value):
    """The text-peeling rule, piece by piece."""
    import re

    out, rest = [], value
    while not out or re.search("[0-9]{8}", rest):
        found = re.search("[0-9]", rest)
        piece = rest[found.start():found.start() + 8] if found else rest[:7]
        out.append(piece)
        rest = rest.replace(piece, "") if piece else rest
    return out


def _customer_pieces(value):
    import re

    out, rest = [], value
    while not out or re.search("[0-9]{8}", rest):
        found = re.search("[0-9]{8}", rest)
        if found:
            stop = re.search("[^0-9 ]", rest[found.start() + 1:])
            piece = rest[found.start():found.start() + 1 + stop.start()]
        else:
            piece = rest[:re.search("[^0-9 ]", rest).start()]
        out.append(piece)
        rest = rest.replace(piece, "") if piece else rest
    return out


PHONES = [
    "Tel 91234567/61234567", "91234567 91234567 x 41230000", "no number", "1234", "12a34512345678", "1a2345167189",
    "", "9123 4567/12345678", "12345678123456789", "  12345678  ", "1 2 3 4 5 6 7 8 9",
]


def test_phone_pieces(spark):
    rng = random.Random(5)
    samples = PHONES + ["".join(rng.choice("0123456789 /a") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select("s", text.worker_phones(F.col("s")).alias("w"), text.customer_phones(F.concat("s", F.lit("#"))).alias("c")).collect()
    for row in got:
        assert row.w == _worker_pieces(row.s), row.s
        assert row.c == _customer_pieces(row.s + "#"), row.s


def test_plate_and_json_text(spark):
    df = spark.createDataFrame([("ａＢ １２", 'a/"b"\r\n')], "p string, j string")
    row = df.select(text.plate(F.col("p")).alias("p"), text.json_quoted(F.col("j")).alias("j")).first()
    assert row.p == "AB12"
    assert row.j == '"a\\/\\"b\\"\\r\\n"'


@pytest.fixture(scope="module")
def hot(spark):
    """One group holds most rows, so it spreads over several blocks."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 40}", i, rng.randrange(-5, 50)) for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, i int, v long").repartition(6)


def test_running_sum_over_blocks(hot):
    rows, df = hot
    got = {(r.g, r.i): r.s for r in ordered.running_sum(df, ["g"], ["i"], "v", "s").collect()}
    total = {}
    for g, i, v in sorted(rows):
        total[g] = total.get(g, 0) + v
        assert got[g, i] == total[g]
    assert len(got) == len(rows)


def test_blocks_split_the_hot_group(hot):
    _, df = hot
    blocks = ordered.in_blocks(df, ["g", "i"]).filter("g = 'hot'").select(ordered.BLOCK).distinct().count()
    assert blocks > 1


def test_row_number_over_blocks(hot):
    rows, df = hot
    got = {(r.g, r.i): r.n for r in ordered.row_number(df, ["g"], ["i"], "n").collect()}
    seen = {}
    for g, i, _ in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[g, i] == seen[g]
    every = sorted((r.n, r.g, r.i) for r in ordered.row_number(df, [], ["g", "i"], "n").collect())
    assert [(g, i) for _, g, i in every] == sorted((g, i) for g, i, _ in rows)
    assert [n for n, _, _ in every] == list(range(1, len(rows) + 1))


def test_next_value_over_blocks(hot):
    rows, df = hot
    got = {(r.g, r.i): r.n for r in ordered.with_next(df, ["g"], "i", "n").collect()}
    order = sorted((g, i) for g, i, _ in rows)
    for (g, i), after in zip(order, [*order[1:], (None, None)]):
        assert got[g, i] == (after[1] if after[0] == g else None)


@pytest.mark.parametrize("limit", [1, 7, 100, lists.PART_BYTES, None])
def test_parts_of_a_list_are_runs_of_it(spark, limit):
    rows = [("big", "x", f"{i:05d}", "") for i in range(700)] + [("big", "y", "same", f"{i}") for i in range(40)] + [
        ("small", "x", f"{i}", "") for i in range(9)] + [("small", "y", "1", ""), (None, "x", "é" * 9, ""), (None, "x", None, "")]
    df = spark.createDataFrame(rows, "k string, kind string, text string, copy string").repartition(6)
    out = sorted(lists.packed(df, ["k"], {"x": "xs", "y": "ys"}, limit=limit).collect(), key=lambda r: r.part)
    for k in ("big", "small", None):
        for kind, name in (("x", "xs"), ("y", "ys")):
            parts = [r[name].strip("[]").split(",") for r in out if r.k == k and r[name]]
            assert [x for p in parts for x in p] == sorted(r[2] for r in rows if r[0] == k and r[1] == kind and r[2] is not None)
            for p in parts:
                assert limit is None or len(",".join(p[:-1]).encode()) <= limit
    assert all(any(r.k == k and r.part == 0 for r in out) for k in ("big", "small", None))
    assert limit is not None or {r.part for r in out} == {0}

