"""Alignment of two tokenizers' tokens over the same texts.

Both sides' tokens tile the same bytes, " " and the text. Within a batch, keyed by
document, each token start of one side finds the other side's covering token by
``pandas.merge_asof``; both directions together give all overlapping pairs. Pairs that end
together are links; their ends cut the tokens of both sides into groups.

``link_counts`` counts the links of each pair of ids over all documents, and says which are
a B id's most frequent; ``with_link_scores`` brings the counts back to the documents. Pairs that
hold at least one of ``HOT`` equal parts of all links, so ``HOT`` pairs at most, are sent to all
tasks and scored where the links are read; the others are joined, none of them
frequent enough to load one task.

Defined results: null and empty texts have no tokens, nor have texts whose tokens' bytes,
joined, are not " " and the text on both sides (a U+2581 in the text, say): all
numbers are 0 and the groups' text is empty. Special tokens' strings are plain text.
Repeated rows and null ids are aligned like others; texts of any length are aligned
whole. Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H
from tidewise.llm.scratch import saved
from tidewise.llm.token_count import PIECES, _byte_symbols

HOT = 1 << 19          # parts of all links; a pair with one of them or more is sent to all tasks
CHECKED_TEXTS = 2      # of a worker's first texts, compared with the library that owns the file
FLUSH_PAIRS = 1 << 20  # links that are counted at once
COMMA, BAR, SEMICOLON, NOTHING = range(4)
MARKS = (",", "|", ";", "")


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of large binary or text without nulls, and the rows' offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:][:len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


class ByteSide:
    """A byte-level BPE vocabulary (.json). Its ids follow its merges, so they are ranks."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer is wanted")
        byte = {s: b for b, s in enumerate(_byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(map(byte.__getitem__, piece)): i for piece, i in spec["model"]["vocab"].items()
                 if piece not in special}
        self.pieces = [b""] * (1 + max(ranks.values()))
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.path, self.checked, self._library = path, False, None
        self.fast = tiktoken.Encoding(path, pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})

    @property
    def library(self):
        if self._library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
            self._library.encode_special_tokens = True
            self._library.no_padding()
            self._library.no_truncation()
        return self._library

    def _plain(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _encode(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # its pattern engine gives up on some texts
            return self._plain(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = [self._encode(" " + t) for t in texts]
        if not self.checked:
            for t, ids in list(zip(texts, out))[:CHECKED_TEXTS]:
                if self._plain(" " + t) != ids:
                    raise ValueError(f"the ids of {self.path} do not follow its merges")
            self.checked, self._library = True, None  # its memory is freed
        return out


class PieceSide:
    """A sentencepiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.pieces = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in ((i, self.library.id_to_piece(i)) for i in range(n))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Tokens:
    """The tokens of some texts on one side, laid end to end."""

    def __init__(self, lists: list[list[int]], bytes_of: pa.Array, length_of: np.ndarray):
        self.at = np.cumsum([0, *map(len, lists)])
        self.ids = pa.array(lists, pa.large_list(pa.int32())).flatten().to_numpy().astype(np.int64)
        self.length = length_of[self.ids]
        self._bytes_of = bytes_of

    def equal(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text's token bytes are the given ones."""
        got, at = _bytes(self._bytes_of.take(pa.array(self.ids)))
        at = at[self.at]
        same = np.diff(at) == np.diff(offsets)
        if same.all() and np.array_equal(got, data):
            return same
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(got[at[i]:at[i + 1]], data[offsets[i]:offsets[i + 1]])
        return same

    def keep(self, texts: np.ndarray) -> None:
        """Drops the tokens of the other texts."""
        sizes = np.diff(self.at)
        stay = np.repeat(texts, sizes)
        self.ids, self.length = self.ids[stay], self.length[stay]
        self.at = np.concatenate([[0], np.cumsum(np.where(texts, sizes, 0))])

    def frame(self, name: str) -> pd.DataFrame:
        """start, doc, and the token's number, by start; starts go on from text to text."""
        end = np.cumsum(self.length)
        return pd.DataFrame({"start": end - self.length, "doc": np.repeat(np.arange(len(self.at) - 1), np.diff(self.at)),
                             name: np.arange(len(self.ids))})


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all overlapping A and B tokens, each pair once."""
    left, right = a.frame("a"), b.frame("b")
    covering_b = pd.merge_asof(left, right, on="start", by="doc")
    covering_a = pd.merge_asof(right, left, on="start", by="doc")
    i, j = covering_b["a"].to_numpy(), covering_b["b"].to_numpy()
    # pairs that start together are found from both sides
    k, m = covering_a["a"].to_numpy(), covering_a["b"].to_numpy()
    other = left["start"].to_numpy()[k] != right["start"].to_numpy()[m]
    return np.concatenate([i, k[other]]).astype(np.int64), np.concatenate([j, m[other]]).astype(np.int64)


class Aligner:
    """Two sides, and the tables that both need."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteSide(a_path), PieceSide(b_path)
        self.tables = [(pa.array(s.pieces, pa.large_binary()), np.array(list(map(len, s.pieces)), np.int64))
                       for s in (self.a, self.b)]
        largest = max(len(self.a.pieces), len(self.b.pieces))
        self.shown = pa.array([f"{i}{m}" for i in range(largest) for m in MARKS], pa.large_string())

    def aligned(self, texts: list[str]):
        """Of texts that are not empty: A tokens, B tokens, the numbers of the linked pairs
        (in the order of the text), and the group of each A and B token."""
        raw = [b" " + t.encode() for t in texts]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        a, b = (Tokens(s.encode(texts), *t) for s, t in zip((self.a, self.b), self.tables))
        good = a.equal(data, offsets) & b.equal(data, offsets)
        a.keep(good)
        b.keep(good)
        i, j = overlaps(a, b)
        a_end, b_end = np.cumsum(a.length), np.cumsum(b.length)
        together = a_end[i] == b_end[j]
        i, j = np.sort(i[together]), np.sort(j[together])
        cuts = a_end[i]
        return a, b, i, j, np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)

    def groups_text(self, a: Tokens, b: Tokens, i, j, in_a, in_b) -> tuple[memoryview, np.ndarray]:
        """``a1,a2|b1;a3|b2,b3`` of all texts end to end, and each text's bounds."""
        mark_a, mark_b = np.full(len(a.ids), COMMA), np.full(len(b.ids), COMMA)
        mark_a[i], mark_b[j] = BAR, SEMICOLON
        mark_b[b.at[1:][np.diff(b.at) > 0] - 1] = NOTHING
        out = np.empty(len(a.ids) + len(b.ids), np.int64)
        # before an A token stand the B tokens of earlier groups, before a B token the A
        # tokens of its own group as well
        out[np.arange(len(a.ids)) + np.searchsorted(in_b, in_a)] = a.ids * len(MARKS) + mark_a
        out[np.arange(len(b.ids)) + np.searchsorted(in_a, in_b, side="right")] = b.ids * len(MARKS) + mark_b
        text, at = _bytes(self.shown.take(pa.array(out)))
        return memoryview(text), at[a.at + b.at]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner a worker process and pair of files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


PAIR = 32  # bits of a B id in a pair's code


def _texts(batch: pa.RecordBatch):
    """(first row, row after the last, numbers of the rows with a text, their texts)."""
    _, offsets = H.utf8(batch.column("text"))
    for first, last in H.chunks(offsets):
        texts = batch.column("text")[first:last].to_pylist()
        full = np.flatnonzero(np.array([bool(t) for t in texts], bool))
        yield first, last, full, [texts[k] for k in full.tolist()]


def _spread(values, full: np.ndarray, rows: int) -> np.ndarray:
    out = np.zeros(rows, np.int64)
    out[full] = values
    return out


def alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
               ) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, links) of every row: numbers of tokens and groups,
    the digest of the groups' text ("" without tokens), and each link's A id and B id in the
    text's order, as the bytes of 32-bit integers."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for first, last, full, texts in _texts(batch):
                rows = last - first
                a, b, i, j, in_a, in_b = own.aligned(texts)
                shown, at = own.groups_text(a, b, i, j, in_a, in_b)
                digests, links = [""] * rows, [b""] * rows
                pairs = np.stack([a.ids[i], b.ids[j]], axis=1).astype(np.int32)
                of = np.searchsorted(i, a.at)  # each text's first link
                for k, row in enumerate(full.tolist()):
                    if a.at[k + 1] > a.at[k]:
                        digests[row] = hashlib.sha256(shown[at[k]:at[k + 1]]).hexdigest()
                        links[row] = pairs[of[k]:of[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[first:last],
                     *(pa.array(_spread(np.diff(x), full, rows)) for x in (a.at, b.at, of)),
                     pa.array(digests, pa.string()), pa.array(links, pa.binary())],
                    names=["id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary")


def overlapping_tokens(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text"
                       ) -> DataFrame:
    """(id, a, b, a_id, b_id, start, end, linked) of all overlapping tokens: their numbers in
    the text, ids, the bytes they share (of " " and the text), and whether they end
    together."""
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        own = aligner(a_path, b_path)
        for batch in batches:
            for first, last, full, texts in _texts(batch):
                a, b, *_ = own.aligned(texts)
                i, j = overlaps(a, b)
                order = np.lexsort((j, i))
                i, j = i[order], j[order]
                a_end, b_end = np.cumsum(a.length), np.cumsum(b.length)
                doc = np.searchsorted(a.at, i, side="right") - 1
                base = np.concatenate([[0], a_end])[a.at[doc]]
                begin = np.maximum((a_end - a.length)[i], (b_end - b.length)[j]) - base
                end = np.minimum(a_end[i], b_end[j]) - base
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id")[first:last].take(pa.array(full[doc])), pa.array(i - a.at[doc]),
                     pa.array(j - b.at[doc]), pa.array(a.ids[i]), pa.array(b.ids[j]), pa.array(begin), pa.array(end),
                     pa.array(a_end[i] == b_end[j])],
                    names=["id", "a", "b", "a_id", "b_id", "start", "end", "linked"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, a long, b long, a_id long, b_id long, start long, end long, linked boolean")


def _codes(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One number for each link of a column, and the offsets of each row's links."""
    data, offsets = _bytes(links.cast(pa.large_binary()))
    pair = data.view(np.int32).reshape(-1, 2).astype(np.int64)
    return pair[:, 0] << PAIR | pair[:, 1], offsets // 8


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best) of every linked pair of ids: its links in all documents, and whether no
    pair of the same B id has more."""
    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            waiting.append(_codes(batch.column("links"))[0])
            size += len(waiting[-1])
            if size >= FLUSH_PAIRS:
                yield _counted(waiting)
                waiting, size = [], 0
        if size:
            yield _counted(waiting)

    n = (aligned.select("links").mapInArrow(run, "pair long, n long")
         .groupBy("pair").agg(F.sum("n").alias("n")))
    n = saved(n.withColumn("b", F.col("pair").bitwiseAND((1 << PAIR) - 1)), "pair-counts")
    most = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _counted(waiting: list[np.ndarray]) -> pa.RecordBatch:
    pair, n = np.unique(np.concatenate(waiting), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])


def with_link_scores(aligned: DataFrame, counts: DataFrame, hot: int = HOT) -> DataFrame:
    """``aligned`` with ``n_best`` (links whose pair is its B id's most frequent) and ``count_sum``
    (the counts of its links, summed) in place of ``links``."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    table = counts.filter(F.col("n") >= total / hot).toArrow()  # ``hot`` rows at most
    pair, n, best = (table.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    pair, n, best = pair[order], n[order], best[order].astype(np.int64)
    names = [c for c in aligned.columns if c != "links"]
    keyed = aligned.withColumn("row", F.monotonically_increasing_id())

    def run(batches):
        for batch in batches:
            codes, at = _codes(batch.column("links"))
            place = np.minimum(np.searchsorted(pair, codes), max(0, len(pair) - 1))
            known = pair[place] == codes if len(pair) else np.zeros(len(codes), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(at))
            sums = []
            for values in (best, n):
                each = np.zeros(len(codes), np.int64)
                each[known] = values[place[known]]
                sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(each)])[at])))
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=batch.num_rows))])
            rare = pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(codes[~known]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), batch.column("row"), *sums, rare],
                                             names=[*names, "row", "n_best", "count_sum", "rare"])

    kinds = [f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in names]
    known = saved(keyed.mapInArrow(run, ", ".join(
        [*kinds, "row long, n_best long, count_sum long, rare array<long>"])), "link-scores")
    rare = (known.select("row", F.explode("rare").alias("pair")).join(counts, "pair").groupBy("row")
            .agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more_sum")))
    return known.drop("rare").join(rare, "row", "left").select(
        *names, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"))


def scored_alignments(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text",
                      hot: int = HOT) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum) of every row."""
    aligned = saved(alignments(docs, a_path, b_path, id_col, text_col), "alignments")
    counts = saved(link_counts(aligned), "link-counts")
    n_links = (F.octet_length("links") / 8).cast("long")
    return with_link_scores(aligned.withColumn("n_links", n_links), counts, hot)
