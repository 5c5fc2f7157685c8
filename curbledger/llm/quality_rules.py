"""Quality rules: fixed base rules, and a calibrated hashed n-gram logistic regression.

The regression is trained on labelled documents (`labels.quality`), at most about `FIT_ROWS` of each
class, chosen by a hash of the id; weights restore the classes' true shares.  Every document is then
scored in Arrow batches, and stays if it passes the base rules and its probability of being good
reaches `THRESHOLD`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbledger.llm import linear, text_stats
from curbledger.llm import words as W

FIT_ROWS = 3000     # labelled documents of each class, about
THRESHOLD = 0.5     # least probability of a good document
MIN_WORDS = 10
MAX_REPEATED = 20   # percent of words in repeated windows
_SPOTS = 1 << 30


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """doc, text, label, importance: about `rows` documents of each class.

    Several labels of a document count by their mean; NULL ids and labels are left out; a repeated id
    counts once.  The chosen ids are few, so they are sent to the texts.
    """
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("int").alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [
        known.filter((F.col("label") == label) & (F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(_SPOTS)) < int(_SPOTS * min(1.0, rows / n))))
        .withColumn("importance", F.lit(max(1.0, n / rows)))
        for label, n in sorted(counts.items())
    ]
    if not picked:
        return docs.select(F.col("doc_id").alias("doc"), "text", F.lit(1).alias("label"), F.lit(1.0).alias("importance")).limit(0)
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy(F.col("doc_id").alias("doc")).agg(
        F.min("text").alias("text"), F.first("label").alias("label"), F.first("importance").alias("importance"))


def _judge(model: bytes, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = linear.Model.of_bytes(model)
        for part in W.slices(batches, "text"):
            w, lowered = W.split(part.column("text")), W.split(part.column("text"), lower=True)
            n, repeated = w.counts(), text_stats.repeated_words(w, w.hashes())
            _, twice = text_stats.lines(w)
            failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)
            p = scorer.probability(w, lowered)
            columns = {
                "doc_id": part.column("doc_id"), "n_words": n, "word_chars": text_stats.word_chars(w), "n_symbols": text_stats.symbols(w),
                "n_dup_lines": twice, "n_repeat_words": repeated, "base_failed": failed, "kept": ~failed & (p >= threshold), "probability": p,
            }
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    return run


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base rules and verdict of every document; other columns are not read.

    Without labels, or with one class alone, the base rules decide.  A NULL text has no words and fails.
    """
    model = linear.trained(sample(docs, labels)).to_bytes()
    return docs.select("doc_id", "text").mapInArrow(
        _judge(model, threshold), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                  "base_failed boolean, kept boolean, probability double")


def op10_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels)
