"""The pipeline's mixture meets its targets; a bounded one tells what it misses."""

from pyspark.sql import functions as F

from tidewise.llm import raking


def test_margins_of_the_production_parameters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    categories = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic("text")}

    # a value that is all but empty
    docs = docs.unionByName(docs.limit(1).withColumn("source", F.lit("rare")).withColumn("text", F.lit("a b")))

    def worst(**how):
        mixed = raking.mixture(docs, categories, **how).cache()
        assert mixed.agg(F.max("mix_probability")).first()[0] <= 1
        rows = raking.margins(mixed, tuple(categories)).collect()
        assert {r.category for r in rows} == set(categories)
        part = F.sum(F.col("mix_tokens") * F.col("mix_probability")) / F.sum("mix_tokens")
        return max(abs(r.share - r.target) for r in rows), mixed.agg(part).first()[0]

    missed, part = worst()
    assert missed <= raking.TOLERANCE + 1e-9 and part > 0.25


def shares(mixed, categories):
    """share / target of every value, and the drawn copies' share of all tokens."""
    rows = raking.margins(mixed, categories).collect()
    part = mixed.agg(F.sum(F.col("mix_tokens") * F.col("mix_copies")) / F.sum("mix_tokens")).first()[0]
    return {(r.category, r.value): r.share / r.target for r in rows}, part


def test_copies_meet_every_target(spark):
    """op3's parameters on its own table: every value within a hundredth of its target."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    categories = {"source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic("text")}
    mixed = raking.mixture(docs, categories, keep=raking.KEEP, copies=raking.COPIES).cache()
    found, part = shares(mixed, tuple(categories))
    assert len(found) > 10 and all(0.99 < x < 1.01 for x in found.values()), found
    assert abs(part - raking.KEEP) < 0.02
    assert mixed.agg(F.max("mix_copies")).first()[0] <= raking.COPIES
    # without copies the scarce values fall short
    once = raking.mixture(docs, categories, keep=raking.KEEP)
    assert min(shares(once, tuple(categories))[0].values()) < 0.7


def test_many_sources_meet_their_targets(spark):
    """8,000 sources, the largest 8,000 times the smallest."""
    rows = spark.range(8000).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"), (F.col("id") + 1).alias("source"))
    docs = rows.select(F.xxhash64("source", "k").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("en")), F.col("k")).alias("lang"),
                       F.repeat(F.lit("w "), (8000 / F.col("source")).cast("int") + F.col("k")).alias("text"))
    categories = {"source": F.col("source"), "lang": F.col("lang")}
    mixed = raking.mixture(docs, categories, keep=raking.KEEP, copies=raking.COPIES).cache()
    found, part = shares(mixed, tuple(categories))
    assert len(found) == 8002 and all(0.99 < x < 1.01 for x in found.values())
    assert abs(part - raking.KEEP) < 0.03
