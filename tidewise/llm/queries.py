"""Registered queries of the subpackage, each over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewise.llm.bpe import encoded
from tidewise.llm.embed_dedup import near_vectors
from tidewise.llm.fingerprint import edited_fingerprints
from tidewise.llm.lm_score import backoff_scores
from tidewise.llm.ngram_join import jaccard_components
from tidewise.llm import raking
from tidewise.llm.periodic import collapsed
from tidewise.llm.quality import quality_scores
from tidewise.llm.secret_scan import BASE_RULES, secret_spans
from tidewise.llm.token_align import scored_alignments
from tidewise.llm.token_count import token_counts
from tidewise.llm.url_filter import Rule, judged, site_rules
from tidewise.llm.warc import round_trip
from tidewise.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_ngram_jaccard_join")
def op1(spark, sf_dir):
    return (jaccard_components(read_table(spark, sf_dir, "documents"))
            .withColumnRenamed("id", "doc_id"))


@register("op8_quality_classifier")
def op8(spark, sf_dir):
    return (quality_scores(read_table(spark, sf_dir, "documents"),
                           read_table(spark, sf_dir, "labels"))
            .withColumnRenamed("id", "doc_id"))


def _joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op5_secret_scan")
def op5(spark, sf_dir):
    found = secret_spans(read_table(spark, sf_dir, "documents"))

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select(F.col("id").alias("doc_id"), of("assign"), of("access"), of("hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


@register("op9_bpe_round_trip")
def op9(spark, sf_dir):
    import public_tokenizers
    done = encoded(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return done.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _raking_sql() -> str:
    """The same cells, targets, sweeps and draws in SQL: one step for each category
    and sweep."""
    names = ("source", "lang", "topic")
    steps = []
    before = "targets"
    for i in range(raking.SWEEPS):
        for c in names:
            steps.append(f"""s{i}_{c} as (select source, lang, topic, tokens, t_source, t_lang, t_topic,
                weight * t_{c} / sum(weight) over (partition by {c}) as weight from {before})""")
            before = f"s{i}_{c}"
        steps.append(f"""s{i} as (select source, lang, topic, tokens, t_source, t_lang, t_topic,
            least(weight, {raking.COPIES} * tokens / {raking.KEEP}::double) as weight from {before})""")
        before = f"s{i}"
    shares = ", ".join(f"""sh_{c} as (select {c}, pow(sum(tokens), {raking.POWER}) as part
        from cells group by {c})""" for c in names)
    targets = ", ".join(f"sh_{c}.part / (select sum(part) from sh_{c}) * (select sum(tokens) from cells) as t_{c}" for c in names)
    joins = " ".join(f"join sh_{c} using ({c})" for c in names)
    return f"""with docs as (
      select doc_id, coalesce(source, '{raking.NULL_NAME}') as source, coalesce(lang, '{raking.NULL_NAME}') as lang,
        case when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '@') then 'contact'
             when contains(coalesce(text, ''), '!!') then 'loud'
             when regexp_matches(coalesce(text, ''), '[0-9]{{3}}') then 'figures' else 'prose' end as topic,
        cast(coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0) as bigint) as n_tokens from documents),
    cells as (select source, lang, topic, cast(sum(n_tokens) as double) as tokens from docs
      group by 1, 2, 3 having sum(n_tokens) > 0),
    {shares},
    targets as (select cells.*, {targets}, tokens as weight from cells {joins}),
    {", ".join(steps)},
    chances as (select source, lang, topic, weight * {raking.KEEP}::double / tokens as probability from {before}),
    drawn as (select doc_id, d.source, d.lang, d.topic, n_tokens, coalesce(probability, 1.0) as p,
      cast(concat('0x', substr(md5(concat('{raking.SEED}:', coalesce(cast(doc_id as varchar), 'null'))), 1, 8))
        as bigint) / 4294967296.0 as u
      from docs d left join chances c on c.source = d.source and c.lang = d.lang and c.topic = d.topic)
    select doc_id, source, lang, topic, n_tokens, round(p, 6) as expected_copies,
      cast(floor(p) as bigint) + cast(u < p - floor(p) as bigint) as copies from drawn"""


@register("op3_source_mixing", _raking_sql())
def op3(spark, sf_dir):
    mixed = raking.mixture(read_table(spark, sf_dir, "documents"), {
        "source": F.col("source"), "lang": F.col("lang"), "topic": raking.topic("text")},
        keep=raking.KEEP, copies=raking.COPIES)
    return mixed.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"),
        F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_probability", 6).alias("expected_copies"), F.col("mix_copies").alias("copies"))


@register("op4_document_fingerprint")
def op4(spark, sf_dir):
    return (edited_fingerprints(read_table(spark, sf_dir, "documents"))
            .withColumnRenamed("id", "doc_id"))


@register("op6_token_count")
def op6(spark, sf_dir):
    import public_tokenizers
    return (token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
            .withColumnRenamed("id", "doc_id"))


@register("op7_embedding_near_dedup")
def op7(spark, sf_dir):
    return (near_vectors(read_table(spark, sf_dir, "embeddings"))
            .withColumnRenamed("id", "vec_id"))


@register("op10_warc")
def op10(spark, sf_dir):
    return round_trip(read_table(spark, sf_dir, "pages"))


@register("op2_lm_scoring")
def op2(spark, sf_dir):
    return (backoff_scores(read_table(spark, sf_dir, "documents"), least=1, order=3)
            .withColumnRenamed("id", "doc_id"))


# The rules of the URL filter by site, and globs for all other URLs.
SITE_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
              ("allow", "com/fr/"), ("block", "com/de/")]
BLOCKED_GLOBS = ["*ads-track.*/*", "*casino*/*", "*cheap-pills*/*", "*-bets.*/*", "*spam-farm*/*", "adult-?.*/*",
                 "*.adult-?.*/*", "*/*.exe", "*/*/login*", "*/*/cart/*"]
URL_RULES = [r for verdict, site in SITE_RULES for r in site_rules(verdict, site)] + [
    Rule(glob, "block") for glob in BLOCKED_GLOBS]


def _url_sql() -> str:
    """Sites by suffix and prefix tests, globs as regular expressions."""
    fits = []
    for verdict, site in sorted(SITE_RULES, key=lambda r: -len(r[1])):
        host, path = site.split("/", 1)
        fits.append((f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '/{path}')", site, verdict))

    def regex(glob):
        return glob.replace(".", "[.]").replace("*", ".*").replace("?", ".")
    globs = " or ".join(f"regexp_full_match(host, '(?s){regex(h)}') and regexp_full_match(path, '(?s){regex('/' + p)}')"
                        for h, p in (g.split("/", 1) for g in BLOCKED_GLOBS))
    rule = " ".join(f"when {test} then '{site}'" for test, site, _ in fits)
    verdict = " ".join(f"when {test} then '{v}'" for test, _, v in fits)
    return f"""with rests as (select page_id,
      case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
    parts as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rests)
    select page_id, host, path, case {rule} end as rule,
      case {verdict} when {globs} then 'block' else 'allow' end as verdict from parts"""


@register("op11_url_filter", _url_sql())
def op11(spark, sf_dir):
    return (judged(read_table(spark, sf_dir, "pages"), URL_RULES).drop("glob")
            .withColumnRenamed("id", "page_id"))


@register("op13_periodic_runs")
def op13(spark, sf_dir):
    h = F.crc32(F.col("doc_id").cast("string"))
    found = collapsed(read_table(spark, sf_dir, "documents"),
                      plant=F.when(h % 10 == 0, F.floor(h / 10)))

    def ahead(a, b):
        """Greater length/period first, exactly; then the smaller start and period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(
            a["start"] > b["start"], 1).otherwise(F.sign(a["period"] - b["period"]).cast("int"))

    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    best = F.get(F.array_sort("runs", ahead), 0)
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), "collapsed_sha256")


@register("op12_cross_tokenizer")
def op12(spark, sf_dir):
    import public_tokenizers
    return (scored_alignments(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                              public_tokenizers.path("piece_bpe_32k.model"))
            .withColumnRenamed("id", "doc_id"))
