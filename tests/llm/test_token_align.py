import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewise.llm import token_align as T
from tidewise.llm.queries import QUERIES
from tidewise.llm.token_count import _byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ROWS = [(1, "Hello world, hello <|endoftext|> and <s>."), (2, None), (3, ""), (4, " "), (5, "   two  blanks \n\n"),
        (6, "déjà vu 日本語 🙂🙂 \x00\x07"), (7, "a▁b"), (8, "Hello world, hello"), (8, "Hello world, hello"),
        (None, "no id"), (9, "x" * 5000), (10, "word " * 3000), (11, "\t\r\n"), (12, "A"), (13, "▁"), (14, "ﬁ ½ é")]


def library_tokens(text):
    """(A ids, B ids, A bytes, B bytes) by the two libraries."""
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {s: b for b, s in enumerate(_byte_symbols())}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode()

    def of(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        return a, b, [bytes(byte[c] for c in t.id_to_token(i)) for i in a], [piece(i) for i in b]
    return of(text) if text is not None else of


def brute(rows):
    of, out, links = library_tokens(None), [], []
    for doc_id, text in rows:
        a, b, x, y = of(text) if text else ([], [], [], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(x) != whole or b"".join(y) != whole:
            a, b, x, y = [], [], [], []
        end_a, end_b = ends(x), ends(y)
        at_b = {e: k for k, e in enumerate(end_b)}
        pairs = [(a[i], b[at_b[e]]) for i, e in enumerate(end_a) if e in at_b]
        groups, i, j = [], 0, 0
        for k, e in enumerate(end_a):
            if e in at_b:
                groups.append(",".join(map(str, a[i:k + 1])) + "|" + ",".join(map(str, b[j:at_b[e] + 1])))
                i, j = k + 1, at_b[e] + 1
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append([doc_id, len(a), len(b), len(groups), len(pairs), sha])
        links.append(pairs)
    count = Counter(p for pairs in links for p in pairs)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*row[:5], sum(count[p] == best[p[1]] for p in pairs), sum(count[p] for p in pairs), row[5])
            for row, pairs in zip(out, links)]


def ends(pieces):
    out, at = [], 0
    for p in pieces:
        at += len(p)
        out.append(at)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                               "groups_sha256").collect()), key=str)


def test_query_matches_brute_force(spark, frame, tmp_path):
    docs = frame(ROWS, "doc_id long, text string").withColumn("id", F.lit(0)).withColumn("links", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = rows_of(QUERIES["op12_cross_tokenizer"](spark, str(tmp_path)))
    assert got == sorted(brute(ROWS), key=str)
    by_id = {r[0]: r for r in got}
    assert by_id[7][1:] == by_id[2][1:] == (0, 0, 0, 0, 0, 0, "") and by_id[6][1] > 0 and by_id[4][1] > 0


@pytest.mark.parametrize("hot", [1, 40])  # none or few of the pairs are scored where they are read
def test_rare_pairs_are_joined(frame, hot):
    rng = random.Random(2)
    words = "the of Unbelievable tokenisation naïve don't 1234 antidisestablishment e-mail".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(60)]
    got = T.scored_alignments(frame(rows, "doc_id long, text string"), A, B, hot=hot)
    assert rows_of(got.withColumnRenamed("id", "doc_id")) == sorted(brute(rows), key=str)


def test_overlaps_match_brute_force(frame):
    docs = frame(ROWS, "doc_id long, text string").filter("doc_id is null or doc_id != 8")
    got = sorted(T.overlapping_tokens(docs, A, B).collect(), key=lambda r: (str(r.id), r.a, r.b))
    want = []
    of = library_tokens(None)
    for doc_id, text in ROWS:
        if not text or doc_id in (7, 8, 13):
            continue
        a, b, x, y = of(text)
        ea, eb = ends(x), ends(y)
        j = 0
        for i in range(len(a)):
            begin = ea[i] - len(x[i])
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(b) and eb[k] - len(y[k]) < ea[i]:
                want.append((doc_id, i, k, a[i], b[k], max(begin, eb[k] - len(y[k])), min(ea[i], eb[k]), ea[i] == eb[k]))
                k += 1
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: (str(r[0]), r[1], r[2]))


def test_library_takes_over(monkeypatch):
    side = T.ByteSide(A)
    want = side.encode(["some text"])

    class Broken:
        def encode_ordinary(self, text):
            raise ValueError("stack")
    side.fast = Broken()
    assert side.encode(["some text"]) == want
    side.checked, side.fast = False, type("F", (), {"encode_ordinary": lambda self, t: [1]})()
    with pytest.raises(ValueError, match="merges"):
        side.encode(["some text"])


def test_empty_table(frame):
    assert T.scored_alignments(frame([], "doc_id long, text string"), A, B).collect() == []
    assert T.scored_alignments(frame([(1, None)], "doc_id long, text string"), A, B).count() == 1
