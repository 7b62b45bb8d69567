"""Raking, embeddings, quality, WARC."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewise.llm import boosting, embed_dedup, quality, raking, warc

from . import brute


# --- raking -------------------------------------------------------------------------

def ipf(cells, power, keep, sweeps):
    """Raked weight of each (category values) -> tokens."""
    total, weight = sum(cells.values()), dict(cells)
    for _ in range(sweeps):
        for k in range(len(next(iter(cells)))):
            own = Counter()
            for c, n in cells.items():
                own[c[k]] += n
            target = {v: n ** power for v, n in own.items()}
            scale = sum(target.values())
            got = Counter()
            for c, w in weight.items():
                got[c[k]] += w
            weight = {c: w * target[c[k]] / scale * total / got[c[k]] for c, w in weight.items()}
        weight = {c: min(w, cells[c] / keep) for c, w in weight.items()}
    return weight


@pytest.mark.parametrize("keep", [0.3, 0.9])
def test_mixture_against_brute_force(spark, keep):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["s0", "s0", "s1", None][i % 4], "de" if i % 7 else "en", 1)
            for i in range(600)] + [(None, None, "s9", "en", 1), (3, "a b", "s1", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens int")
    got = raking.mixture(df, {"source": F.col("source"), "lang": F.col("lang")}, power=0.5,
                         keep=keep, sweeps=8).collect()
    cells = Counter()
    for _, t, s, lang, _ in rows:
        cells[s or raking.NULL_NAME, lang] += len((t or "").split())
    cells = {c: n for c, n in cells.items() if n}
    weight = ipf(cells, 0.5, keep, 8)
    assert len(got) == len(rows)
    for r in got:
        cell = (r.source or raking.NULL_NAME, r.lang)
        p = weight[cell] * keep / cells[cell] if cell in cells else 1.0
        u = int(hashlib.md5(f"{raking.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        assert math.isclose(r.mix_probability, p, rel_tol=1e-9)
        assert r.mix_kept == (u / 2 ** 32 < r.mix_probability)
        assert r.mix_probability <= 1
    if keep > 0.5:
        return  # more than the scarce cells have
    # calibrated: expected tokens have the target shares of each category
    expected = Counter()
    for r in got:
        expected[r.source or raking.NULL_NAME] += r.mix_tokens * r.mix_probability
    tokens = Counter()
    for (s, _), n in cells.items():
        tokens[s] += n ** 1
    target = {s: n ** 0.5 for s, n in tokens.items()}
    for s in tokens:
        assert math.isclose(expected[s] / sum(expected.values()), target[s] / sum(target.values()), rel_tol=1e-3)


def test_mixture_empty_and_clash(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert raking.mixture(df, {"source": F.col("source")}).collect() == []
    with pytest.raises(ValueError):
        raking.mixture(df.withColumn("mix_kept", F.lit(1)), {"source": F.col("source")})
    other = raking.mixture(df.withColumn("mix_kept", F.lit(1)), {"source": F.col("source")}, prefix="own_")
    assert "own_kept" in other.columns and "own_copies" in other.columns


def test_mixture_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")
    plan = raking.mixture(df, {"source": F.col("source")})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- embeddings ---------------------------------------------------------------------

def cosine_rows(ids, vectors):
    def ok(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = [(i, j) for i in range(len(ids)) for j in range(i)
             if ok(vectors[i]) and ok(vectors[j]) and len(vectors[i]) == len(vectors[j])
             and np.dot(vectors[i], vectors[j]) / np.linalg.norm(vectors[i]) / np.linalg.norm(vectors[j]) >= 0.9]
    degree = Counter(x for pair in links for x in pair)
    roots = brute.groups(len(ids), links)
    least = {}
    for i, r in zip(ids, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [(i, degree[k], least.get(r, i), i == least.get(r, i)) for k, (i, r) in enumerate(zip(ids, roots))]


@pytest.mark.parametrize("block", [512, 6])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "CELL_ROWS", 50)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    close = base[:10].repeat(6, axis=0) + rng.standard_normal((60, 16)) * 0.15
    hub = rng.standard_normal(16) + rng.standard_normal((50, 16)) * 0.2
    vectors = [v.tolist() for v in np.concatenate([base, close, hub])]
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[0]], None, [], [0.0] * 16, [float("nan")] * 16,
                                    [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [-0.0, 1.0], [0.0, 1.0]]
    ids = list(range(len(vectors)))
    ids[-1] = 5   # a repeated id
    rows = [(i, v, 0, 1) for i, v in zip(ids, vectors)] + [(None, vectors[1], 0, 1), (None, None, 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, id int")
    got = [tuple(r) for r in embed_dedup.near_vectors(df).collect()]
    want = cosine_rows([r[0] for r in rows], [r[1] for r in rows])
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    same = len(set(map(key, got)) & set(map(key, want)))
    assert same >= 0.95 * len(set(map(key, want))) and len(got) == len(want)
    # what is found is never below the threshold
    most = Counter()
    for r in want:
        most[r[0]] = max(most[r[0]], r[1])
    assert all(r[1] <= most[r[0]] for r in got)


def test_vectors_of_extreme_size(spark):
    """Components from 1e-300 to 1e300: the angles of the same vectors at a plain size."""
    rng = np.random.default_rng(3)
    plain = rng.standard_normal((20, 8))
    plain = np.concatenate([plain, plain + 0.05 * rng.standard_normal((20, 8))])
    rows, want = [], []
    for k in range(3):
        for i, v in enumerate(plain):
            rows.append((len(rows), (v * 10.0 ** rng.integers(-300, 300)).tolist()))
            want.append(v)
    unit = np.array(want) / np.linalg.norm(want, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(unit), dtype=bool)
    assert near.sum() > 100
    rows += [(900, [1e-200, 0.0]), (901, [0.5, 0.866]), (902, [1e200, 0.0]), (903, [2e200, 0.0]), (904, [5e-324, 0.0]),
             (905, [1.7e308] * 3), (906, [-1.7e308] * 3)]
    got = {r.id: r.n_links for r in embed_dedup.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(want))] == near.sum(axis=1).tolist()
    assert [got[i] for i in range(900, 907)] == [3, 0, 3, 3, 3, 0, 0]


def test_vectors_recall_and_empty(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((3000, 32))
    # partners at a cosine of about 0.9, the hardest ones
    b = a + rng.standard_normal(a.shape) * 0.47
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.id: r.n_links for r in embed_dedup.near_vectors(df).collect()}
    x = np.concatenate([a, b]).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum() - len(x)
    assert 0.95 * want <= sum(got.values()) <= want
    assert embed_dedup.near_vectors(df.limit(0)).collect() == []


# --- quality ------------------------------------------------------------------------

def test_boosting_learns_and_flat_trees_agree():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000], trees=60)
    assert ((trees.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9

    def walk(row):
        total = trees.base
        for f, t, v in zip(trees.feature, trees.threshold, trees.value):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        return total
    assert np.allclose([walk(r) for r in x[:50]], trees.margin(x[:50]))


def test_boosting_without_labels():
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (boosting.fit(np.zeros((9, 3)), np.ones(9)).score(np.zeros((2, 3))) > 0.9).all()


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(d + "/documents.parquet"), spark.read.parquet(d + "/labels.parquet")
    got = {r.id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect()
            if r.doc_id in got and got[r.doc_id].held_out and r.quality is not None]
    assert sum(p == q for p, q in held) >= 0.95 * len(held)


def test_quality_ignores_everything_but_text(spark):
    texts = ["some good words here. " * 5, "x | y | z %%% $$$ " * 9, "", None]
    docs = spark.createDataFrame([(i, texts[i % 4], "s", i) for i in range(60)] + [(None, "a", "s", 1)] * 2,
                                 "doc_id long, text string, score string, label int")
    labels = spark.createDataFrame([(i, 1 - i % 2, i) for i in range(0, 50)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)],
                                   "doc_id long, quality int, x int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 62 and len({r.score for r in got if r.id is not None and r.id % 4 == 2}) == 1
    assert {r.score for r in got if r.id is not None and r.id % 4 == 2} == {
        r.score for r in got if r.id is not None and r.id % 4 == 3}  # null scores as empty
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []


# --- WARC ---------------------------------------------------------------------------

def warc_rows(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            b = (h or "").encode()
            first[b] = min(i, first.get(b, i))
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.get(b)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if f == i else "revisit", None if f == i else f))
    return out


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("segment", [8192, 100])
def test_warc_round_trip(spark, tmp_path, segment):
    pages = [(1, "u", "é" * 9000), (2, None, None), (3, "x\r\ny", ""), (4, "u", "é" * 9000), (7, "u", "\x00\r\n\r\n"),
             (5, "u", "a" * 8000 + "\r\n\r\nWARC/1.1\r\n"), (1, "u", "é" * 9000), (9, "ü", "0\r\n\r\n"), (None, "u", "q"),
             (None, "u", ""), (8, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(df, str(tmp_path / "w"), segment_bytes=segment).collect()
    assert sorted(map(key, got)) == sorted(map(key, warc_rows(pages)))
    assert warc.round_trip(df.limit(0), str(tmp_path / "empty")).collect() == []


def test_warc_small_payloads_are_kept(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")],
                               "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(df, str(tmp_path / "w"), least=5).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}


def test_warc_damage_is_an_error():
    with pytest.raises(ValueError):
        warc.reassembled([{"segment": 1, "total": None, "block": b"ab"}, {"segment": 3, "total": 4, "block": b"cd"}])
    with pytest.raises(ValueError):
        warc.reassembled([{"segment": 1, "total": None, "block": b"ab"}, {"segment": 2, "total": 5, "block": b"cd"}])
    with pytest.raises(ValueError):
        warc.unframed(b"4\r\nabcdX")
    assert warc.unframed(warc.framed(b"x" * 5000, 7)) == b"x" * 5000
