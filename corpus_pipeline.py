"""Training-corpus pipeline: five stages over ``documents``, each a function of
(spark, docs, sf_dir). ``run`` writes every stage's result as Parquet in the shared
folder and reads it back as the next one's input. All stages but the last return
the columns of ``documents``.

Defined results: each stage treats null and empty texts, repeated rows, null
ids and extra columns as its operator says; rows with a null id
always pass the near-duplicate stage, as no group can be named by them; an id that
stands in several rows leaves if one of its texts does.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tidewise.llm.bitmap import bitmap
from tidewise.llm.bpe import encoded
from tidewise.llm.ngram_join import jaccard_components
from tidewise.llm.quality import CUT, fit_quality, with_quality
from tidewise.llm.raking import mixture, topic
from tidewise.llm.scratch import saved
from tidewise.llm.secret_scan import redacted
from tidewise.sources.tables import read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def fresh(docs: DataFrame, name: str) -> str:
    """A beginning that no column of ``docs`` has."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    return name


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    trees = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return with_quality(docs, trees, score_col=score).filter(F.col(score) >= CUT).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    groups = saved(jaccard_components(docs), "groups")
    leaves = ~F.col("id").eqNullSafe(F.col("component_id"))
    # texts whose id surely neither leaves nor repeats stay where they are read
    rows = groups.groupBy("id").agg(F.count("*").alias("rows"), F.max(leaves).alias("leaves"))
    looked = saved(rows.filter("id is not null and (rows > 1 or leaves)"), "looked")
    some = bitmap(looked, "id")

    @F.pandas_udf("boolean")
    def in_doubt(ids: pd.Series) -> pd.Series:
        return pd.Series(some.may_hold(ids.to_numpy(np.int64)))

    named = docs.filter("doc_id is not null")
    doubt = in_doubt(F.col("doc_id").cast("long"))
    sure, unsure = named.filter(~doubt), named.filter(doubt)
    stay = unsure.join(looked.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    # ids in several rows: equal texts count once
    again = looked.filter("not leaves").select(F.col("id").alias("doc_id"))
    once = unsure.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    nameless = docs.filter("doc_id is null")
    return sure.unionByName(stay).unionByName(once).unionByName(nameless).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by marks."""
    return redacted(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights meet the source, language and topic targets."""
    prefix = fresh(docs, "mix_")
    mixed = mixture(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic("text")},
                    prefix=prefix)
    return mixed.filter(F.col(prefix + "kept")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of their decoding."""
    done = encoded(docs, TOKENIZER, keep=("doc_id", "source", "lang"))
    return done.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_classifier", quality_stage), ("ngram_jaccard_join", near_duplicate_stage),
          ("secret_scans", secret_stage), ("mixing_to_target_weights", mixing_stage),
          ("bpe_encoding", encoding_stage)]

# A learned classifier and a tokenizer have no SQL form: tests/llm hold run()
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
