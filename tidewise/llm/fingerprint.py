"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

A paragraph ends at a line feed, behind a sentence mark before a blank, or at a
blank that the bytes before it pick; its outer blanks do not count. Its hash is a wide vector: ``LANES`` signs, drawn from its
content, times a weight that grows with the square root of its length. A
fingerprint is the sum of the vectors of a text's paragraphs, lane by lane, modulo
2**32. So it does not depend on their order, equal texts have equal
fingerprints, and paragraphs can be added to or taken from it without the
text (``insert``, ``delete``). As the signs are balanced, the normalised inner product
of two fingerprints estimates which part of the two texts (by length) is common
(``likeness``, with an error of about 1 / sqrt(LANES)).

``edited_fingerprints`` brings each document together with its successor by id: ids
are cut into ranges of about equal size, every range is sorted in one shuffle, and the
first document of a range is also sent to the range before. No text is sent more
than twice.

Defined results: null texts count as empty; the empty text, and one of blanks
only, has the fingerprint of nothing; two empty fingerprints have likeness
1, an empty and another one 0; a single document is its own successor; of repeated
ids the rows follow each other in the order of their texts; rows with a null id come
first, as Spark sorts them. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H

LANES = 256
RANGE_ROWS = 1000   # documents in a range of ids, about
MAX_RANGES = 4096   # beyond, ranges grow: they are sorted and streamed, not held
REACH = 8           # bytes before a blank that decide whether it ends a paragraph
LONG_CUT = 16       # one blank in so many does, so that texts without marks have parts
BLOCK = 4096        # paragraphs summed at a time
U = np.uint64
_MARK = np.isin(np.arange(256), list(b".!?"))
_SEEDS = H.mix64(np.arange(1, LANES // 64 + 1, dtype=U) * U(0xD1B54A32D192ED03))


def paragraph_ends(data: np.ndarray) -> np.ndarray:
    """Ends of a text's paragraphs (exclusive; the last is the text's end)."""
    ends = data == 10
    if len(data) > 1:
        ends[:-1] |= _MARK[data[:-1]] & (data[1:] == 32)
    if len(data) > REACH:
        blanks = np.flatnonzero(data[REACH:] == 32)
        before = np.lib.stride_tricks.sliding_window_view(data, REACH)[blanks]
        ends[blanks[H.mix64(before.view(U).ravel()) % U(LONG_CUT) == 0] + REACH] = True
    at = np.flatnonzero(ends) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data)) if len(data) else at


def paragraph_vectors(data: np.ndarray, at: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, sign bits as rows of 64-bit words, weights) of a text's paragraphs from
    ``at`` on, the end of one of them."""
    lead = min(at, REACH)  # the bytes before decide on the first ends
    data = data[at - lead:]
    ends = paragraph_ends(data)
    ends = ends[ends > lead]
    starts = np.concatenate([[lead], ends[:-1]]).astype(np.int64) if len(ends) else ends
    full = np.flatnonzero(~H.SEPARATORS[data])
    first, last = np.searchsorted(full, starts), np.searchsorted(full, ends) - 1
    some = last >= first
    a, b = starts.copy(), starts.copy()
    a[some], b[some] = full[first[some]], full[last[some]] + 1
    hashes = H.span_hashes(data, a, b)
    return ends + (at - lead), H.mix64(hashes[:, None] ^ _SEEDS), np.ceil(np.sqrt(b - a))


def _sum(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Signed sum modulo 2**32; whole numbers in double precision stay exact."""
    total = np.zeros(LANES)
    for i in range(0, len(words), BLOCK):
        w = weights[i:i + BLOCK]
        bits = np.unpackbits(words[i:i + BLOCK].view(np.uint8).reshape(len(w), -1), axis=1)
        total += 2 * (w @ bits.astype(np.float64)) - w.sum()
    return np.mod(total, 2.0 ** 32).astype(np.uint32)


def fingerprint(text: bytes, at: int = 0) -> np.ndarray:
    """Of the paragraphs from ``at`` on."""
    return _sum(*paragraph_vectors(np.frombuffer(text, np.uint8), at)[1:])


def insert(own: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    """The fingerprint with the paragraphs of another one added."""
    return own + paragraphs


def delete(own: np.ndarray, paragraphs: np.ndarray) -> np.ndarray:
    """The fingerprint without the paragraphs of another one."""
    return own - paragraphs


def encoded(own: np.ndarray) -> str:
    return base64.b64encode(own.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a.view(np.int32).astype(float), b.view(np.int32).astype(float)
    xx, yy = float(x @ x), float(y @ y)
    if not xx or not yy:
        return float(xx == yy)
    return min(1.0, max(0.0, float(x @ y) / float(np.sqrt(xx * yy)))) if not np.array_equal(a, b) else 1.0


def edited_text(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _edited(text: str, own: np.ndarray, vectors, following: str) -> tuple[str, np.ndarray]:
    """The edited text and its fingerprint, by taking out the paragraphs behind the cut
    and putting in those of the new end."""
    ends, words, weights = vectors
    new = edited_text(text, following)
    cut = len(text[:len(text) - len(text) // 2].encode())
    # a paragraph that ends before the cut ends there in the edited text too
    kept = int(np.searchsorted(ends, cut - 1, side="right"))
    at = int(ends[kept - 1]) if kept else 0
    gone = _sum(words[kept:], weights[kept:])
    return new, insert(delete(own, gone), fingerprint(new.encode(), at))


def _paired(batches):
    """One output row for each own row of a range, whose successor follows it; lent
    rows, the successors of the ranges' last rows, come at the ranges' ends."""
    waiting, out = None, {k: [] for k in _TYPES}
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("range", "id", "text", "lent")]
        for part, doc, text, lent in zip(*columns):
            text = text or ""
            vectors = paragraph_vectors(np.frombuffer(text.encode(), np.uint8))
            own = _sum(*vectors[1:])
            if waiting is not None and waiting[0] == part:
                _, w_doc, w_text, w_own, w_vectors = waiting
                new, changed = _edited(w_text, w_own, w_vectors, text)
                row = (w_doc, len(w_text), hashlib.sha256(new.encode()).hexdigest(), encoded(w_own),
                       encoded(changed), likeness(w_own, changed), likeness(w_own, own))
                for k, v in zip(_TYPES, row):
                    out[k].append(v)
            waiting = None if lent else (part, doc, text, own, vectors)
            if len(out["id"]) >= 500:
                yield _batch(out)
                out = {k: [] for k in _TYPES}
    yield _batch(out)


_TYPES = {"id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
          "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = ("id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in _TYPES.items()], names=list(_TYPES))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next) of every row; see the module's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark, cuts = rows.sparkSession, np.array(_cuts(rows, range_rows), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right").astype(np.int32))

    rows = rows.withColumn("range", range_of(F.coalesce("id", F.lit(-2 ** 63))))
    # the first id of each range that has rows: at most MAX_RANGES rows
    least = F.min(F.struct(F.col("id").isNotNull().alias("named"), F.col("id"))).alias("least")
    firsts = sorted((r["range"], r["least"]["id"]) for r in
                    rows.select("id", "range").groupBy("range").agg(least).collect())
    lend = spark.createDataFrame([(k, first, firsts[i - 1][0]) for i, (k, first) in enumerate(firsts)],
                                 "r int, first long, before int")
    here = F.struct("range", F.lit(False).alias("lent"))
    there = F.struct(F.col("before").alias("range"), F.lit(True).alias("lent"))
    sent = (rows.join(F.broadcast(lend), F.col("id").eqNullSafe(F.col("first")) & (F.col("range") == F.col("r")),
                      "left")
            .select("id", "text", F.inline(F.when(F.col("r").isNull(), F.array(here))
                                           .otherwise(F.array(here, there)))))
    placed = (sent.repartition("range")
              .sortWithinPartitions("range", "lent", F.col("id").asc_nulls_first(), "text"))
    return placed.select("range", "id", "text", "lent").mapInArrow(_paired, _SCHEMA)


def _cuts(rows: DataFrame, range_rows: int) -> list[int]:
    """Ids that cut the rows into ranges of about equal size."""
    ranges = min(MAX_RANGES, -(-rows.count() // range_rows))
    if ranges < 2:
        return []
    shares = [i / ranges for i in range(1, ranges)]
    cuts = rows.agg(F.percentile_approx("id", shares, 10 * ranges).alias("q")).first()["q"]
    return sorted(set(cuts or []))
