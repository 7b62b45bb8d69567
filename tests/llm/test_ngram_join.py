import numpy as np
import pytest

from tidewise.llm import ngram_join as nj
from tidewise.llm.components import components, merged
from tidewise.llm.partenum import Bands, signatures

from . import brute

SCHEMA = "doc_id long, text string, id string, node int, component_id int, a int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("small_list", [16, 3])
def test_against_brute_force(spark, corpus, monkeypatch, small_list):
    monkeypatch.setattr(nj, "SMALL_LIST", small_list)
    monkeypatch.setattr(nj, "BLOCK", 8)
    got = sorted(tuple(r) for r in nj.jaccard_components(rows_of(spark, corpus)).collect())
    ids, texts = zip(*corpus)
    assert got == sorted(brute.near_groups(ids, texts))


def test_repeated_rows_and_null_ids(spark):
    t = "a b c d e f g h"
    rows = [(5, t), (5, t), (None, t), (7, t + " i"), (None, "x y"), (None, None), (9, "q")]
    got = nj.jaccard_components(rows_of(spark, rows)).collect()
    assert sorted((r.id or -1, r.n_shingles, r.component_id or -1) for r in got) == sorted(
        [(5, 4, 5), (5, 4, 5), (-1, 4, 5), (7, 5, 5), (-1, 1, -1), (-1, 0, -1), (9, 1, 9)])


def test_empty_table(spark):
    assert nj.jaccard_components(rows_of(spark, [])).collect() == []


def test_similar_sets_share_a_signature():
    rng, bands = np.random.default_rng(1), Bands()
    sets, pairs = [], []
    for _ in range(4000):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 2 ** 63, n).astype(np.uint64)
        d = int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[int(rng.integers(0, d + 1)):],
                            rng.integers(0, 2 ** 63, int(rng.integers(0, d + 1))).astype(np.uint64)])
        common = len(np.intersect1d(a, b))
        if len(b) and 5 * common >= 4 * (len(a) + len(b) - common):
            pairs.append((len(sets), len(sets) + 1))
            sets += [a, b]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    items, owner = signatures(np.concatenate(sets), at, bands)
    own = [set() for _ in sets]
    for s, o in zip(items.tolist(), owner.tolist()):
        own[o].add(s)
    assert len(pairs) > 1000 and all(own[a] & own[b] for a, b in pairs)


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 160)] + [(None, 3), (200, 200)]
    got = {r.node: r.component for r in components(
        spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


def test_subsets_of_cells_are_enumerated():
    """Wherever two elements can differ, a signature is a subset of two or more cells of a part."""
    bands, shares = Bands(), []
    for size in range(1, 3000):
        for band, emitted in bands.of(size):
            enumerated = band.n2 > band.k2 + 1 >= 2
            assert enumerated or bands.differing(band.high, band.high) < 2
            shares.append((emitted, enumerated))
    assert sum(n for n, e in shares if e) > 0.999 * sum(n for n, _ in shares)


def test_links_are_merged_into_components(spark):
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 11), (30, 31), (31, 21), (40, 41), (5, 1), (11, 3)]

    def edges(x):
        return spark.createDataFrame(x, "a long, b long")
    got = {r.node: r.component for r in merged(components(edges(first)), edges(more)).collect()}
    assert got == {r.node: r.component for r in components(edges(first + more)).collect()} and len(got) == 12
    rows = merged(components(edges(first)), edges([])).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, components(edges(first)).collect()))
