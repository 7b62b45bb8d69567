import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline as cp
from tidewise.llm import quality, raking, secret_scan
from tidewise.llm.hashing import utf8

from . import brute

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on all that its predecessor kept, with odd rows and an extra column."""
    docs = spark.read.parquet(DIR + "/documents.parquet").selectExpr("*", "nullif('x', '') as mix_kept")
    some = docs.limit(1).selectExpr("doc_id", "text", "lang", "source", "n_chars", "mix_kept").collect()[0]
    odd = [(10_001, None, None, None, None, None), (10_002, "", "en", "s", 0, ""), tuple(some),
           (None, "one token = abcdefgh12 here", "en", "s", 27, "x"), (10_003, some.text + " end", "en", "s", None, "x")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).cache()
    out, before = [], docs
    for name, stage in cp.STAGES:
        df = stage(spark, before, DIR)
        out.append(df.cache())
        before = df
    assert [len(o.columns) for o in out[:-1]] == [len(docs.columns)] * 4
    rows = [[tuple(r) for r in o.select(*docs.columns).collect()] for o in out[:4]]
    key = lambda r: tuple(str(x) for x in r)

    # quality: a row stays when the trees score its own text so
    trees = quality.fit_quality(docs, spark.read.parquet(DIR + "/labels.parquet"))
    import pyarrow as pa
    all_rows = [tuple(r) for r in docs.collect()]
    kept = [r for r in all_rows if trees.score(quality.statistics(*utf8(pa.array([r[1]], pa.string()))))[0] >= 0.3]
    assert sorted(map(key, rows[0])) == sorted(map(key, kept)) and 0 < len(kept) < len(all_rows)

    # near duplicates: the least id of each group, equal rows once
    groups = brute.near_groups([r[0] for r in kept], [r[1] for r in kept])
    stay = {key(r) for r, (i, _, c) in zip(kept, groups) if i == c}
    assert sorted(map(key, rows[1])) == sorted(stay)

    # secrets: no base span is left, other texts are untouched
    for r in rows[2]:
        assert not brute.base_spans(r[1])
    clean = {key(r) for r in rows[1] if not secret_scan.scan(*utf8(pa.array([r[1]], pa.string())))}
    assert clean <= set(map(key, rows[2])) and len(rows[2]) == len(rows[1])

    # mixing: the rows whose draw is below their probability
    mixed = raking.mixture(out[2].drop("mix_kept"), {"source": out[2]["source"], "lang": out[2]["lang"],
                                                     "topic": raking.topic("text")}).collect()
    assert sorted(str(r.doc_id) for r in mixed if r.mix_kept) == sorted(str(r[0]) for r in rows[3])

    # encoding: as the library does
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted((str(r.doc_id), r.n_tokens, list(r.ids)) for r in out[4].collect())
    want = []
    for r in rows[3]:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((str(r[0]), len(ids), ids))
    assert got == sorted(want)


def test_run_and_registration(spark):
    df = cp.run(spark, DIR)
    assert df.columns[:4] == ["doc_id", "source", "lang", "n_tokens"] and df.count() > 0
    names = __spark_entry__.queries()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if re.match(r"op\d+_", n)} == set(range(1, 14))
    assert names["pipeline"] is cp.run and len(cp.STAGES) == 5
    assert np.all([callable(f) for _, f in cp.STAGES])


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(DIR + "/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.collect() == []
