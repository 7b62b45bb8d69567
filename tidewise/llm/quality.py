"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from whole texts only; labels, ids, sources and languages
never enter a score. The trees are fitted on at most ``sample`` labelled rows
(those of the smallest hash of their id), whose ids are broadcast, being bounded
by that parameter; every row is then scored where it is read, without a shuffle.

Defined results: null and empty texts have the statistics of an empty text and
are scored; repeated rows are scored alike; a null id is never held out; rows
without labels are scored; labels that are null, or of ids without a document,
are not used; without usable labels of both kinds every row gets the prior
share of label 1 (0.5 without labels). Other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm import boosting
from tidewise.llm import hashing as H

SAMPLE = 20_000   # labelled rows to fit on, at most
FOLDS = 5         # fold 0 by crc32 of the id is held out
CUT = 0.3         # score from which a document is predicted good
SYMBOLS = (b".", b",", b"!?", b"|", b"%&$*#@^~", b"\"'()[]{}<>", b"-_=+/\\", b":;")
_CLASSES = [np.isin(np.arange(256), list(range(48, 58))),        # digits
            np.isin(np.arange(256), list(range(65, 91))),        # capitals
            np.isin(np.arange(256), list(range(97, 123))),       # small letters
            np.arange(256) >= 0xC0,                              # other characters
            np.isin(np.arange(256), list(b" \t"))]
_CLASSES += [np.isin(np.arange(256), list(s)) for s in SYMBOLS]
N_FEATURES = len(_CLASSES) + 14


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def _distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each document: the number of distinct values, and the largest count of one."""
    distinct, most = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        if b > a:
            s = np.sort(hashes[a:b])
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            distinct[i] = len(first)
            most[i] = np.diff(np.append(first, b - a)).max()
    return distinct, most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(document, feature) matrix for UTF-8 texts laid end to end."""
    size = np.diff(offsets).astype(float)
    some = np.maximum(size, 1)
    out = [_sums(c[data], offsets) / some for c in _CLASSES]
    words, at = H.word_hashes(data, offsets)
    n_words = np.diff(at).astype(float)
    some_words = np.maximum(n_words, 1)
    distinct, most = _distinct(words, at)
    same = np.zeros(len(words))
    same[1:] = words[1:] == words[:-1]
    same[at[:-1][n_words > 0]] = 0
    shingles, shingles_at = H.shingle_sets(data, offsets)
    ends = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], ends + 1]))
    starts = starts[starts < len(data)]
    stops = np.minimum(np.append(starts[1:], len(data)), len(data))
    lines = H.span_hashes(data, starts, stops)
    lines_at = np.searchsorted(starts, offsets)
    n_lines = np.maximum(np.diff(lines_at), 1)
    distinct_lines, most_lines = _distinct(lines, lines_at)
    letters = _sums(_CLASSES[1][data] | _CLASSES[2][data] | _CLASSES[3][data], offsets)
    gaps = _sums(H.SEPARATORS[data], offsets)
    out += [np.log1p(size), np.log1p(n_words), (size - gaps) / some_words, distinct / some_words,
            most / some_words, _sums(same, at) / some_words,
            np.diff(shingles_at) / np.maximum(n_words - 4, 1),
            np.log1p(n_lines), n_words / n_lines, distinct_lines / n_lines, most_lines / n_lines,
            letters / some, _sums(_CLASSES[1][data], offsets) / np.maximum(letters, 1),
            distinct / np.sqrt(some_words)]
    return np.stack(out, axis=1)


def _per_chunk(batch: pa.RecordBatch, text_col: str):
    data, offsets = H.utf8(batch.column(text_col))
    for a, b in H.chunks(offsets):
        yield a, b, statistics(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", sample: int = SAMPLE) -> boosting.Trees:
    """Trees fitted on at most ``sample`` labelled rows outside the held-out fold."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")))
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(sample)

    def run(batches):
        for batch in batches:
            for a, b, x in _per_chunk(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[a:b], batch.column("label")[a:b],
                     pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = (texts.join(F.broadcast(known), "id").mapInArrow(run, "id long, label int, x binary")
            .orderBy(F.xxhash64("id"), "id", "label", "x").limit(sample).select("label", "x").collect())
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), N_FEATURES)
    return boosting.fit(x, np.array([r.label for r in rows], float))


def with_quality(docs: DataFrame, trees: boosting.Trees, text_col: str = "text",
                 score_col: str = "score") -> DataFrame:
    """``docs`` with a score column; nothing is shuffled."""
    schema = T.StructType(docs.schema.fields + [T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            for a, b, x in _per_chunk(batch, text_col):
                columns = batch.slice(a, b - a).columns + [pa.array(trees.score(x))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE,
                   cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``docs``."""
    trees = fit_quality(docs, labels, id_col, text_col, label_col, sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_quality(texts, trees).select(
        "id", held_out("id").alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"))
