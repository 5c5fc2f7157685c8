"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document; a human label, where there is one, is one
more labeller.  Expectation-maximisation over the counts of all vote patterns (at most 3 ** 9, one
aggregation) estimates each labeller's accuracy on good and on bad documents and the share of
good ones, without knowing the truth.  Documents of a bounded sample, labelled with their posterior,
train a hashed linear scorer, which then decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.llm import linear, text_stats
from curbledger.llm import words as W

FIT_ROWS = 6000     # documents that train the scorer, about
THRESHOLD = 0.5
NAMES = ("length", "symbols", "capitals", "word_length", "repetition", "sentence_ends", "repeated_lines", "letters", "human")
HUMAN = len(NAMES) - 1
# Accuracies are looked for within these bounds.  A heuristic fires on one kind of bad documents, so it is
# precise (few votes against good ones) rather than complete, and its good vote on a bad document says
# little; people are right nearly always.
LOW = np.array([[0.9, 0.05]] * HUMAN + [[0.97, 0.97]])
HIGH = np.array([[0.999, 0.5]] * HUMAN + [[0.999, 0.999]])
NO_ID = -(1 << 63)  # stands for a NULL document id
_SPOTS = 1 << 30


def votes(texts: pa.Array, w: W.Words) -> np.ndarray:
    """A row for each text, a column for each labeller but the human: 1 good, 0 bad, 2 nothing."""
    n = w.counts()
    words = np.maximum(n, 1)
    chars = text_stats.word_chars(w)
    n_lines, twice = text_stats.lines(w)
    letters = text_stats.letters(w)
    ended = np.zeros(len(n), np.int64)
    last = w.data[w.ends - 1] if len(w) else np.zeros(0, np.uint8)
    ended += W.per_text(np.isin(last, np.frombuffer(b".!?", np.uint8)).astype(np.int64), w.first)

    def vote(value: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, 2))

    symbol = text_stats.symbols(w) / words
    capital = text_stats.upper_letters(w) / np.maximum(letters, 1)
    mean = chars / words
    repeat = text_stats.repeated_words(w, w.hashes()) / words
    ends = ended / words
    lines = twice / np.maximum(n_lines, 1)
    letter = letters / np.maximum(chars, 1)
    out = np.stack([
        vote(n, n >= 20, n < 5),
        vote(symbol, symbol < 0.05, symbol > 0.3),
        vote(capital, capital < 0.15, capital > 0.5),
        vote(mean, (mean > 3) & (mean < 9), (mean < 2) | (mean > 14)),
        vote(repeat, repeat < 0.05, repeat > 0.3),
        vote(ends, (ends > 0.02) & (ends < 0.3), (n >= 20) & (ends < 0.005)),
        vote(lines, lines < 0.05, lines > 0.3),
        vote(letter, letter > 0.8, letter < 0.6),
    ], axis=1)
    out[n == 0] = 2
    out[n == 0, 0] = 0
    return out


def pattern_of(out: np.ndarray) -> np.ndarray:
    """The votes of a row as one number in base 3."""
    return (out * 3 ** np.arange(out.shape[1])).sum(axis=1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, n_labellers: int = len(NAMES), steps: int = 200):
    """Share of good documents, accuracies (labeller x [on good, on bad]), and each pattern's posterior.

    Labellers are taken as independent given the truth; the bounds of their accuracies say which of the
    two classes is the good one.  With fewer labellers the last bounds are used.
    """
    digits = patterns[:, None] // 3 ** np.arange(n_labellers) % 3
    good, bad = digits == 1, digits == 0
    low, high = LOW[-n_labellers:], HIGH[-n_labellers:]
    share, right = 0.8, (low + high) / 2
    counts = counts.astype(np.float64)
    posterior = np.full(len(patterns), share)
    for _ in range(steps):
        on_good = np.log(share) + good @ np.log(right[:, 0]) + bad @ np.log(1 - right[:, 0])
        on_bad = np.log(1 - share) + bad @ np.log(right[:, 1]) + good @ np.log(1 - right[:, 1])
        new = 1 / (1 + np.exp(np.clip(on_bad - on_good, -500, 500)))
        done = np.abs(new - posterior).max(initial=0.0) < 1e-9
        posterior = new
        if done:
            break
        a, b = counts * posterior, counts * (1 - posterior)
        share = float(np.clip((a.sum() + 8) / (counts.sum() + 10), 0.01, 0.99))
        # a weak prior of ten votes in the middle of the bounds
        middle = 5 * (low + high)
        right = np.stack([(a @ good + middle[:, 0]) / (a @ (good | bad) + 10), (b @ bad + middle[:, 1]) / (b @ (good | bad) + 10)], axis=1)
        right = np.clip(right, low, high)
    return share, right, posterior


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    W.release()
    for part in W.slices(batches, "text"):
        out = votes(part.column("text"), W.split(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(pattern_of(out))], ["doc", "heuristic"])


def _scored(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = linear.Model.of_bytes(model)
        for part in W.slices(batches, "text"):
            w, lowered = W.split(part.column("text")), W.split(part.column("text"), lower=True)
            p = scorer.probability(w, lowered)
            yield pa.RecordBatch.from_arrays([part.column("rest"), part.column("text"), pa.array(p)], ["rest", "text", "score"])

    return run


def _human(labels: DataFrame) -> DataFrame:
    """One vote for each labelled id: the majority of its labels, nothing for a tie."""
    mean = F.avg("quality")
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("doc")).agg(
        F.when(mean > 0.5, 1).when(mean < 0.5, 0).otherwise(2).alias("human"))


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (NO_ID for NULL) and pattern of every row; only ids and numbers are shuffled."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text").mapInArrow(_voted, "doc long, heuristic long")
    return rows.join(_human(labels), "doc", "left").select(
        "doc", (F.col("heuristic") + 3 ** HUMAN * F.coalesce("human", F.lit(2))).cast("long").alias("pattern"))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> linear.Model:
    """EM over all documents, then the scorer on about `rows` of them, chosen by a hash of the id."""
    known = patterns(docs, labels)
    table = known.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()  # at most 3 ** 9 rows
    if not table:
        return linear.fit([], np.zeros(0), np.zeros(0))
    pattern, count = np.array([r.pattern for r in table]), np.array([r.n for r in table])
    _, _, posterior = expectation_maximisation(pattern, count)
    spot = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(_SPOTS)) < int(_SPOTS * min(1.0, rows / count.sum()))
    some = docs.select("doc_id", "text").filter(spot).groupBy("doc_id").agg(F.min("text").alias("text"))
    soft = docs.sparkSession.createDataFrame([(int(p), float(q)) for p, q in zip(pattern, posterior)], "pattern long, label double")
    sample = patterns(some, labels).join(F.broadcast(soft), "pattern").select("doc", "label").dropDuplicates(["doc"])
    texts = some.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    return linear.trained(texts.join(sample, "doc").withColumn("importance", F.lit(1.0)))


def scored(docs: DataFrame, model: linear.Model) -> DataFrame:
    """rest (a struct of all columns but text), text, score (probability of a good document)."""
    rest = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), "text")
    kind = rest.schema["rest"].dataType.simpleString()
    return rest.mapInArrow(_scored(model.to_bytes()), f"rest {kind}, text string, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that the scorer accepts, with all their columns.  A NULL text is scored as empty."""
    kept = scored(docs, train(docs, labels)).filter(F.col("score") >= threshold)
    return kept.select(*[(F.col("text") if c == "text" else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def op9_weak_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, kept; one row for each document."""
    few = docs.select("doc_id", "text")
    return scored(few, train(few, labels)).select("rest.doc_id", "score", (F.col("score") >= THRESHOLD).alias("kept"))
