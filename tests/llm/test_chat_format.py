"""Chat formatting: digests against the source, and texts made of control strings."""

import hashlib
import random

from pyspark.sql import functions as F

from curbledger.llm import chat_format as C

PARTS = ["<", ">", "\\", "s", "/", "[", "]", "INST", "</s>", "<s>", "<s\\>", "[INST]", "[/INST]", "<\\/s>", "[\\INST]", "é", "\n", " ", "日"]
rng = random.Random(6)


def noise():
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(9)))


ROWS = [(c, t, rng.choice(["user", "assistant", "system", "assistant", noise()]), noise()) for c in range(150) for t in range(rng.randrange(1, 6))] + [
    (500, 1, None, None), (500, None, "assistant", None), (501, 3, "assistant", ""), (None, 1, "assistant", "x"), (None, 2, "user", "y"),
    (502, 1, "assistant", "tie b"), (502, 1, "assistant", "tie a"), (502, 1, "assistant", "tie a"), (503, 0, "assistant", "long </s> " * 20_000)]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest(),
                 len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return out


def test_round_trip(spark):
    frame = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id long, turn long, role string, text string, s int, formatted string")
    got = C.op6_chat_format(frame.repartition(3)).collect()
    probe = [(-7, 0, "user", C.PROBE), (-7, 1, "assistant", C.PROBE)]
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(ROWS + probe)
    assert len(got) == len({r[0] for r in ROWS}) + 1


def test_only_conflicting_turns_are_escaped(spark):
    frame = spark.createDataFrame([(1, 1, "user", "plain [INST]"), (1, 2, "assistant", "a </s> b")], "conv_id long, turn long, role string, text string")
    row = C.formatted(frame).first()
    assert row.formatted == "<s>user[INST]plain [INST][/INST]</s><s\\>assistant[INST]a <\\/s> b[/INST]</s>"
    assert [row.formatted[s.start:s.start + s.length] for s in row.loss_spans] == ["a <\\/s> b"]


def test_no_rows_and_no_python(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = C.op6_chat_format(frame)
    assert [r.conv_id for r in out.collect()] == [-7]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_escape_is_reversible(spark):
    texts = spark.createDataFrame([(noise(),) for _ in range(3000)], "t string")
    e = C.escape(F.col("t"))
    assert texts.filter((C.unescape(e) != F.col("t")) | F.contains(e, F.lit("</s>")) | F.contains(e, F.lit("[INST]"))).count() == 0
