"""Secret scans, token counts, encoding, fingerprints, LM scores."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidewise.llm import bpe, fingerprint, hashing, lm_score, secret_scan, token_count
from tidewise.llm.automaton import compile_rules

from . import brute

ODD = ["the", "And", " ", "  ", "\n", "\t", "é", "e", "́", "Σ", "ß", "<|endoftext|>", "<|endof", "text|>", "'s",
       "'LL", "12", "½", "%%", "中文", " ", " ", "\x1c", "\x85", "😀", "a" * 70]
SECRET = ["token", "Token", "secret", "PASSWORD", "api_key", "apikey", "=", ":", " ", '"', "'", "12345678", "AKIA",
          "ABCDEFGH", "\n", "é", "ſecret", "0123456789abcdef", "-", "_", "%"]


def random_texts(parts, n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, size))) for _ in range(n)]


def frame(spark, texts):
    """Rows with a null text, an empty one, a repeated row, a null id and other columns."""
    rows = [(i, t, "x", [1]) for i, t in enumerate(texts)]
    rows += [(900_001, None, None, None), (900_002, "", "x", [1]), rows[0], (None, texts[1], "x", [1])]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, spans array<int>"), rows


def test_secret_spans(spark):
    df, rows = frame(spark, random_texts(SECRET, 400, 50) + ["token=" + "f" * 9000, "x" * 3000 + " AKIA" + "A" * 12])
    got = sorted((str(r.id), [tuple(s) for s in r.spans]) for r in secret_scan.secret_spans(df).collect())
    base = {r.kind for r in secret_scan.BASE_RULES}
    got = [(i, [s for s in spans if s[2] in base]) for i, spans in got]
    assert got == sorted((str(i), brute.base_spans(t)) for i, t, *_ in rows)
    assert sum(len(s) for _, s in got) > 100


def test_redacted_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a token = abcdefgh1 b", 21, "t"), (2, None, None, "t"), (3, "clean", 5, None)],
                               "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in secret_scan.redacted(df).collect()}
    assert out[1].text == "a [assign] b" and out[1].n_chars == 12 and out[1].spans == "t"
    assert tuple(out[2]) == (2, None, None, "t") and tuple(out[3]) == (3, "clean", 5, None)
    assert secret_scan.redacted(df.limit(0)).collect() == []


def test_automaton_is_minimal():
    a = compile_rules([("abc", False), ("xbc", False)], False)
    # start, after a or x is told apart by the rule, ends, dead
    assert len(a.accepts) == 8 and a.dead >= 0
    assert len(compile_rules([("(a|b)*abb", False)], False).accepts) == 5


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    df, rows = frame(spark, random_texts(ODD, 300, 60) + ["ab" * 40_000])
    got = sorted((str(r.id), r.n_bytes, r.n_tokens, r.over_limit)
                 for r in token_count.token_counts(df, path).collect())
    want = []
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((str(i), len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [512, 16])
def test_encoding_is_the_librarys(monkeypatch, chunk):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = random_texts(ODD, 200, 600, seed=chunk) + ["", " ", "b" * 30_000]
    texts += texts[:20]
    data, offsets = hashing.utf8(pa.array(texts))
    for text, ids in zip(texts, own.encode(data, offsets)):
        ids, want = np.frombuffer(ids, np.int32), library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_encoded_frame(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df, rows = frame(spark, random_texts(ODD, 40, 80))
    got = sorted((str(r.doc_id), list(r.ids), r.decoded) for r in bpe.encoded(df, path).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encoded(df.limit(0), path).collect() == []


def test_chunks_depend_on_content_only():
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    cut = []
    for lead in ("", "x" * 333):
        raw = np.frombuffer((lead + passage).encode(), np.uint8)
        at = bpe.chunk_starts(raw, np.array([0, len(raw)]))
        cut.append({int(c) - len(lead) for c in at if c - len(lead) > 100})
    assert cut[0] == cut[1] and len(cut[0]) > 5


def test_fingerprints(spark):
    texts = [". ".join(f"Part {random.Random(i * 31 + j).random()} of it" for j in range(i % 9)) for i in range(60)]
    texts += ["é" * 7, "no marks at all " * 300]
    rows = [(10 * i, t) for i, t in enumerate(texts)] + [(10_000, None), (10_001, ""), (10_000, None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, range int")
    for size in (5, 1000):
        got = sorted((tuple(r) for r in fingerprint.edited_fingerprints(df, range_rows=size).collect()),
                     key=lambda r: r[0])
        ordered = sorted((i, t or "") for i, t in rows)
        assert [r[0] for r in got] == [i for i, _ in ordered]
        for k, (i, t) in enumerate(ordered):
            follow = ordered[(k + 1) % len(ordered)][1]
            n, new = len(t), t[:len(t) - len(t) // 2] + follow[:len(t) // 2]
            _, n_chars, sha, own, changed, near_edited, near_next = got[k]
            f = [fingerprint.fingerprint(x.encode()) for x in (t, new, follow)]
            assert (n_chars, sha) == (n, hashlib.sha256(new.encode()).hexdigest())
            assert (own, changed) == (fingerprint.encoded(f[0]), fingerprint.encoded(f[1]))
            assert near_edited == fingerprint.likeness(f[0], f[1])
            assert near_next == fingerprint.likeness(f[0], f[2])
    assert fingerprint.edited_fingerprints(df.limit(0)).collect() == []


def test_fingerprint_is_homomorphic():
    parts = [f"Sentence {i} {'x' * i}.\n" for i in range(30)]
    whole = fingerprint.fingerprint("".join(parts).encode())
    random.Random(1).shuffle(parts)
    assert np.array_equal(whole, fingerprint.fingerprint("".join(parts).encode()))
    one = fingerprint.fingerprint(parts[0].encode())
    rest = fingerprint.fingerprint("".join(parts[1:]).encode())
    assert np.array_equal(fingerprint.insert(rest, one), whole)
    assert np.array_equal(fingerprint.delete(whole, one), rest)
    assert fingerprint.likeness(whole, whole) == 1.0 and fingerprint.likeness(whole, rest) > 0.8


@pytest.mark.parametrize("tokens", [300, 1 << 21])
def test_backoff_scores(spark, corpus, monkeypatch, tokens):
    monkeypatch.setattr(lm_score, "BUCKET_TOKENS", tokens)
    df = spark.createDataFrame([(i, t, 1) for i, t in corpus] + [(None, "alone here", 1)],
                               "doc_id long, text string, words int")
    got = {r.id: r for r in lm_score.backoff_scores(df).collect()}
    want = brute.backoff([t for _, t in corpus] + ["alone here"])
    for i, (n, missed, score) in zip([*[i for i, _ in corpus], None], want):
        r = got[i]
        assert (r.n_words, r.n_backoffs) == (n, missed)
        assert math.isclose(r.log_score, score, rel_tol=1e-9, abs_tol=1e-9)
        assert (r.mean_log_score is None) == (n == 0)


def test_backoff_scores_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in lm_score.backoff_scores(df).collect()}
    assert got[1].n_words == 4 and math.isclose(got[1].mean_log_score, 0.0, abs_tol=1e-12)
    assert (got[2].n_words, got[2].log_score, got[2].mean_log_score) == (0, 0.0, None)
    assert lm_score.backoff_scores(df.limit(0)).collect() == []


def test_texts_are_decoded_together():
    own = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for texts in (["", "The cat, the hat!", "", "x", "naïve 你好 <|endoftext|>", ""], ["", ""], []):
        ids = [np.array(own.library.encode(t, add_special_tokens=False).ids, np.int32) for t in texts]
        bounds = np.array([0, *map(len, ids)]).cumsum()
        got = own.decode_all(np.concatenate([np.zeros(0, np.int32), *ids]), bounds)
        got.validate(full=True)
        assert got.to_pylist() == [own.library.decode(i.tolist(), skip_special_tokens=False) for i in ids]
