"""Column profiles: constant columns, numeric/categorical split, exact medians
and modes for imputation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tidewise.roles import Roles


def constant_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, n_values, has_null, constant), one row per column.

    A column is constant when it holds exactly one distinct value, null
    counting as a value: all null, or no null and min == max. One pass of
    min/max/count, combined map-side; no value is shuffled.
    """
    cols = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        aggs += [F.count(F.col(c)).alias(f"_n{i}"), F.min(F.col(c)).alias(f"_lo{i}"),
                 F.max(F.col(c)).alias(f"_hi{i}")]
    a = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        n, lo, hi, total = F.col(f"_n{i}"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col("_rows")
        has_null = n < total
        constant = (n == 0) | (~has_null & (lo == hi))
        rows.append(F.struct(F.lit(c).alias("column_name"), n.alias("n_values"),
                             has_null.alias("has_null"), constant.alias("constant")))
    return a.select(F.inline(F.array(*rows)))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Drop every constant column. The decision needs one small profile row
    per column on the driver (bounded by the column count, not the data)."""
    prof = constant_profile(df).filter("constant").select("column_name").collect()
    return df.drop(*[r[0] for r in prof])


def numeric_categorical(df: DataFrame, roles: Roles,
                        booleans: bool = True) -> tuple[list[str], list[str]]:
    """Feature columns by type: numbers vs strings; the role columns are never
    features, and other types are left out. Booleans count as numbers in the
    column report, but a model's number selector (``booleans=False``) drops them."""
    skip = set(roles.role_columns())
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, NumericType) or booleans and isinstance(f.dataType, BooleanType):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return num, cat


def number(column: str):
    """A column as double; NaN is a missing value like null."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _long_values(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    pairs = F.array(*[F.struct(
        F.lit(c).alias("column_name"),
        (number(c) if cast == "double" else F.col(c).cast(cast)).alias("value")) for c in cols])
    return df.select(F.inline(pairs))


# Fixed parameters of the exact median: the most distinct values one task may
# sort for the final pick, and how finely each narrowing round splits a range.
MEDIAN_TASK_VALUES = 1_000_000
MEDIAN_BUCKETS = 1000
MEDIAN_SKETCH_ACCURACY = 100_000

_STATE_SCHEMA = ("column_name string, which int, lo double, hi double, below long, k long")


def _in_range(lo: str = "lo", hi: str = "hi"):
    v = F.col("value")
    return ((F.col(lo).isNull() | (v > F.col(lo))) & (F.col(hi).isNull() | (v <= F.col(hi))))


def column_medians(df: DataFrame, cols: list[str], task_values: int = MEDIAN_TASK_VALUES,
                   buckets: int = MEDIAN_BUCKETS, materialize: bool = True) -> DataFrame:
    """(column_name, median): exact median of the non-null values, the mean of
    the two middle values for an even count (null for an all-null column).

    Values are counted per (column, value) with a map-side combine. The two
    middle ranks are then found by exact rank selection: while a column has
    more than ``task_values`` distinct values in its candidate range, an
    approximate-quantile sketch (and the middle of the range, so that it at least
    halves) cuts the range into pieces, exact bucket weights locate the piece holding
    the rank, and the range shrinks to it. The last pick sorts at most ``task_values`` values per (column, rank),
    so no task ever holds a whole column. Only per-bucket weights (bounded by
    columns x buckets) reach the driver between rounds.
    """
    from tidewise.session import checkpoint

    spark = df.sparkSession
    # the value counts are read by every round and the final pick: keep them
    # once in the shared checkpoint folder (distinct values, not rows), so the
    # input's lineage runs once
    counted = (_long_values(df, cols, "double")
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("w")))
    if materialize:  # callers with a persisted input pass False
        counted = checkpoint(counted)
    nonnull = F.col("value").isNotNull()
    totals = counted.groupBy("column_name").agg(
        F.sum(F.when(nonnull, F.col("w"))).alias("n"), F.count("value").alias("distinct"))
    stats = totals.collect()
    state = {}
    for r in stats:
        if r["n"]:
            n = int(r["n"])
            for which, k in ((0, (n - 1) // 2), (1, n // 2)):
                state[(r["column_name"], which)] = [None, None, 0, k]
    values = counted.filter(nonnull)
    widest = max([r["distinct"] for r in stats], default=0)
    while widest > task_values:
        st = spark.createDataFrame(
            [(c, w, lo, hi, below, k) for (c, w), (lo, hi, below, k) in state.items()],
            _STATE_SCHEMA)
        cand = values.join(F.broadcast(st), "column_name").filter(_in_range())
        fractions = [i / buckets for i in range(1, buckets)]
        middle = F.min("value") / 2 + F.max("value") / 2
        cuts = cand.groupBy("column_name", "which").agg(F.array_sort(F.array_append(
            F.percentile_approx("value", fractions, MEDIAN_SKETCH_ACCURACY), middle)).alias("cuts"))
        bucket = F.size(F.filter(F.col("cuts"), lambda c: c < F.col("value")))
        per_bucket = (cand.join(F.broadcast(cuts), ["column_name", "which"])
                      .groupBy("column_name", "which", bucket.alias("bucket"))
                      .agg(F.sum("w").alias("bw"), F.max("value").alias("vmax"),
                           F.count(F.lit(1)).alias("distinct"))
                      .collect())
        grouped: dict = {}
        for r in per_bucket:
            grouped.setdefault((r["column_name"], r["which"]), []).append(r)
        new_widest = 0
        for key, rows in grouped.items():
            lo, hi, below, k = state[key]
            cum, prev_max = below, lo
            for r in sorted(rows, key=lambda r: r["bucket"]):
                if cum + r["bw"] > k:
                    state[key] = [prev_max, r["vmax"], cum, k]
                    new_widest = max(new_widest, r["distinct"])
                    break
                cum += r["bw"]
                prev_max = r["vmax"]
        widest = new_widest
    st = spark.createDataFrame(
        [(c, w, lo, hi, below, k) for (c, w), (lo, hi, below, k) in state.items()],
        _STATE_SCHEMA)
    # left join: an all-null column has no rank to pick and keeps one row
    # (which = null) so that it still gets a (null) median
    src = counted if widest <= task_values else values.unionByName(
        counted.filter(~nonnull))
    cand = (src.join(F.broadcast(st), "column_name", "left")
            .filter(F.col("which").isNull() | (nonnull & _in_range())))
    w = (Window.partitionBy("column_name", "which").orderBy("value")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = cand.withColumn("_cum", F.col("below") + F.sum("w").over(w))
    hit = (F.col("_cum") - F.col("w") <= F.col("k")) & (F.col("k") < F.col("_cum"))
    picked = ranked.filter(F.col("which").isNull() | hit)
    return picked.groupBy("column_name").agg(
        F.avg(F.when(F.col("which").isNotNull(), F.col("value"))).alias("median"))


def column_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, mode): most frequent non-null value, the lowest on ties."""
    counted = (_long_values(df, cols, "string")
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    # a null ordering key is skipped, so nulls never win and an all-null
    # column gets a null mode
    order = F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))
    return counted.groupBy("column_name").agg(F.min_by(F.col("value"), order).alias("mode"))
