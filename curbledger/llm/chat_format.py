"""Chat formatting with a grammar round trip, in DataFrame functions only.

    conversation := turn*
    turn         := ("<s>" | "<s\\>") role "[INST]" text "[/INST]" "</s>"

The parser is deterministic: turns end at "</s>", the role ends at the first "[INST]", the text is what
remains before the closing "[/INST]".  Every conversation is rendered as it is and parsed again.
Turns that do not come back equal to their source are escaped: a backslash goes behind the bracket
of each control string, before any backslashes that stand there already, and "<s\\>" says so.  The
result is parsed again and must equal the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ESCAPED, MIDDLE, CLOSE, END = "<s>", "<s\\>", "[INST]", "[/INST]", "</s>"
_CORE = r"(/?s\\?>|/?INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CORE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CORE, "$1$2$3")


def render(turn: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE + END))
    safe = F.concat(F.lit(ESCAPED), escape(turn["role"]), F.lit(MIDDLE), escape(turn["text"]), F.lit(CLOSE + END))
    return F.when(escaped, safe).otherwise(plain)


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    def one(part: Column) -> Column:
        escaped = F.startswith(part, F.lit(ESCAPED))
        body = F.substring(part, F.when(escaped, len(ESCAPED) + 1).otherwise(len(OPEN) + 1), F.length(part))
        at = F.instr(body, MIDDLE)
        role = F.substring(body, F.lit(1), at - 1)
        text = F.substring(body, at + len(MIDDLE), F.greatest(F.length(body) - at - (len(MIDDLE) + len(CLOSE) - 1), F.lit(0)))
        return F.struct(F.when(escaped, unescape(role)).otherwise(role).alias("role"),
                        F.when(escaped, unescape(text)).otherwise(text).alias("text"))

    parts = F.split(formatted, END)
    return F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def _loss_spans(pieces: Column, turns: Column) -> Column:
    """(start, length) in the formatted text, from 0, of every assistant text as it stands there."""
    spans = F.lit(None).cast("array<struct<start:int,length:int,escaped:boolean>>")

    def step(state: Column, item: Column) -> Column:
        piece, role = item["piece"], item["turn"]["role"]
        escaped = F.startswith(piece, F.lit(ESCAPED))
        head = F.when(escaped, len(ESCAPED) + F.length(escape(role))).otherwise(len(OPEN) + F.length(role)) + len(MIDDLE)
        span = F.struct((state["at"] + head).alias("start"), (F.length(piece) - head - len(CLOSE + END)).alias("length"), escaped.alias("escaped"))
        return F.struct((state["at"] + F.length(piece)).alias("at"),
                        F.when(role == LOSS_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.coalesce(spans, F.array().cast("array<struct<start:int,length:int,escaped:boolean>>")).alias("spans"))
    items = F.transform(F.arrays_zip(pieces.alias("piece"), turns.alias("turn")), lambda x: x)
    return F.aggregate(items, start, step)["spans"]


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, source (turns), formatted, loss_spans (start, length, escaped); one row a conversation.

    Turns are ordered by turn, then role and text (ties); NULL turns come first, a NULL role or text is
    empty, a NULL conv_id is one conversation.  Other columns are not read.  A conversation is one row of
    the result, so its turns meet in one place.  The query fails if a round trip does.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    turns = grouped.select("conv_id", F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    raw = F.array_join(F.transform("source", lambda t: render(t, F.lit(False))), "")

    def conflicting(t: Column) -> Column:
        return parse(render(t, F.lit(False))) != F.array(t)

    pieces = F.when(parse(raw) == F.col("source"), F.transform("source", lambda t: render(t, F.lit(False)))).otherwise(
        F.transform("source", lambda t: render(t, conflicting(t))))
    done = turns.withColumn("pieces", pieces).withColumn("formatted", F.array_join("pieces", ""))
    checked = done.withColumn("formatted", F.when(parse(F.col("formatted")) == F.col("source"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation did not survive its round trip")).cast("string")))
    return checked.select("conv_id", "source", "formatted", _loss_spans(F.col("pieces"), F.col("source")).alias("loss_spans"))


def read_back(frame: DataFrame) -> DataFrame:
    """Digest columns, from `formatted` and `loss_spans` alone."""
    def loss(span: Column) -> Column:
        text = F.substring(F.col("formatted"), span["start"] + 1, span["length"])
        return F.when(span["escaped"], unescape(text)).otherwise(text)

    turns = frame.select("conv_id", "formatted", parse(F.col("formatted")).alias("t"), F.array_join(F.transform("loss_spans", loss), "").alias("loss"))
    return turns.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


PROBE = "</s>[INST] ok [/INST]"


def op6_chat_format(conversations: DataFrame) -> DataFrame:
    """All conversations and number -7, whose texts are control strings."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(PROBE).alias("text"))
    return read_back(formatted(conversations.select("conv_id", "turn", "role", "text").unionByName(probe)))


OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, CASE WHEN contains(text, '</s>') OR contains(role, '</s>') OR contains(role, '[INST]')
    THEN 21 + length(role) + length(text)
      + len(regexp_extract_all(role, '[<\[]\\*(/?s\\?>|/?INST\])')) + len(regexp_extract_all(text, '[<\[]\\*(/?s\\?>|/?INST\])'))
    ELSE 20 + length(role) + length(text) END AS size
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
