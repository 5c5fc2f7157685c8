"""Fill-in-middle transformation at line bounds, looked up in a learned rank index.

A text's units are its lines, and `bounds[k]` is the number of code points in the first k of them.
The index over all bounds of a text is piecewise linear: a segment (rank, offset, slope) predicts
`offset + round(slope * (k - rank))` for the ranks from its own to the next segment's.  Segments grow
greedily while one slope stays within `error` code points of every bound, so that each bound's
residual fits one byte; prediction plus residual is exact.  A text of even lines needs few segments,
however long it is.  Both cuts of a document are taken from the index.

    psm := "<P>" prefix "<S>" suffix "<M>" middle
    spm := "<S>" suffix "<P>" prefix "<M>" middle

A text that holds one of the three marks stays plain, so the marks of an output are its own and
`restored` rebuilds the text from output and form alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbledger.llm import words as W

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 60  # code points that a prediction may be off by; a residual is one signed byte

Index = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]

_OUT = pa.schema([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("output", pa.string()),
    ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
    ("segments", pa.list_(pa.struct([("rank", pa.int64()), ("offset", pa.int64()), ("slope", pa.float64())]))),
    ("residuals", pa.binary()),
])
_OUT_DDL = ("doc_id long, n long, form string, output string, prefix_chars long, middle_chars long, "
            "segments array<struct<rank:long,offset:long,slope:double>>, residuals binary")


def line_bounds(text: str) -> np.ndarray:
    """Code points before and after every line; n + 1 values, the first 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 10) + 1
    rest = [len(points)] if len(points) and (not len(ends) or ends[-1] != len(points)) else []
    return np.concatenate([[0], ends, rest]).astype(np.int64)


def fit(bounds: np.ndarray, error: int = ERROR) -> Index:
    """ranks, offsets and slopes of the segments, and one residual for each bound."""
    ranks, slopes = [], []
    at, n = 0, len(bounds)
    while at < n:
        low, high, to, step = -np.inf, np.inf, at + 1, 64
        while to < n:  # the slopes that suit all bounds so far, over blocks of growing size
            run = np.arange(to, min(n, to + step))
            rise = bounds[run] - bounds[at]
            lows = np.maximum(np.maximum.accumulate((rise - error) / (run - at)), low)
            highs = np.minimum(np.minimum.accumulate((rise + error) / (run - at)), high)
            wrong = np.flatnonzero(lows > highs)
            good = int(wrong[0]) if len(wrong) else len(run)
            if good:
                low, high = lows[good - 1], highs[good - 1]
            to += good
            step *= 2
            if len(wrong):
                break
        ranks.append(at)
        slopes.append((low + high) / 2 if to > at + 1 else 0.0)
        at = to
    ranks = np.array(ranks, np.int64)
    model = ranks, bounds[ranks], np.array(slopes, np.float64)
    residuals = bounds - predicted(model, np.arange(n))
    return *model, residuals.astype(np.int8)


def predicted(model: tuple[np.ndarray, np.ndarray, np.ndarray], ranks: np.ndarray) -> np.ndarray:
    """The bounds at `ranks` as the segments alone tell them."""
    first, offsets, slopes = model[:3]
    s = np.searchsorted(first, ranks, "right") - 1
    return offsets[s] + np.rint(slopes[s] * (ranks - first[s])).astype(np.int64)


def bound(index: Index, rank: int) -> int:
    """The exact bound: prediction, then the stored residual."""
    return int(predicted(index[:3], np.array([rank]))[0]) + int(index[3][rank])


def draws(doc_id: int | None, seed: int) -> list[int]:
    name = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def _transform(rate: int, spm: int, seed: int, error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                index = fit(line_bounds(text), error)
                n = len(index[3]) - 1
                h1, h2, h3, h4 = draws(doc_id, seed)
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                form, output, sizes = "plain", text, (None, None)
                if text and not any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) and h3 % 100 < rate:
                    a, b = bound(index, low), bound(index, high)
                    sizes = a, b - a
                    if h4 % 100 < spm:
                        form, output = "spm", f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
                    else:
                        form, output = "psm", f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                segments = [{"rank": r, "offset": o, "slope": s} for r, o, s in zip(*(x.tolist() for x in index[:3]))]
                rows.append((doc_id, n, form, output, *sizes, segments, index[3].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)

    return run


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7, error: int = ERROR) -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars, and the index: segments, residuals.

    One row per row of `docs`, repeated rows too; each row is worked on alone.  `rate` percent of the
    documents are transformed, `spm` percent of these with the suffix first; the draws follow from `seed`
    and doc_id (a NULL id draws as an empty one).  A NULL text is an empty one, and an empty text stays
    plain with n = 0.  Columns other than doc_id and text are not read.  `error` is at most 120.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_transform(rate, spm, seed, min(error, 120)), _OUT_DDL)


def restored(form: Column, output: Column) -> Column:
    """The text, from output and form."""
    def between(left: str, right: str | None) -> Column:
        start = F.instr(output, left) + len(left)
        return F.substring(output, start, F.length(output) if right is None else F.instr(output, right) - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_middle(documents: DataFrame) -> DataFrame:
    done = fill_in_middle(documents)
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, h, string_split(t, chr(10)) AS parts,
    length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND right(t, 1) <> chr(10) THEN 1 ELSE 0 END AS n
  FROM hashed
), drawn AS (
  SELECT doc_id, t, parts, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 100
      THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), cut AS (
  SELECT doc_id, t, n, form,
    CASE WHEN least(a, b) = n THEN t WHEN least(a, b) = 0 THEN '' ELSE array_to_string(parts[1:least(a, b)], chr(10)) || chr(10) END AS prefix,
    CASE WHEN greatest(a, b) = n THEN t WHEN greatest(a, b) = 0 THEN '' ELSE array_to_string(parts[1:greatest(a, b)], chr(10)) || chr(10) END AS head
  FROM drawn
), pieces AS (
  SELECT doc_id, t, n, form, prefix, substr(head, length(prefix) + 1) AS middle, substr(t, length(head) + 1) AS suffix FROM cut
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
