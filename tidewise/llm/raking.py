"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Documents are summed into cells, one for each combination of the categories (a
map-side aggregate, so a source with a third of all rows is no hot key). Token
weights of the cells are raked to the target shares of each category in turn; a
document is kept with its cell's raked weight per token, times the share of all
tokens that the sample shall have. As no document is kept more than ``copies`` times (once by
default), a cell's weight is bounded by that many times what the cell has; the bound is one
more step of each sweep, so that the other cells make up for scarce ones. With copies the
expected number of a document's copies takes the place of its probability: the whole part
is sure, the rest is drawn. Only DataFrame functions.

The sample is as large as the targets allow: the share of all tokens is the largest for which
no category value lacks more than half of ``TOLERANCE``, and sweeps go on until every
margin is within ``TOLERANCE`` of its target, both as parts of all tokens (so a value that is
all but empty does not make the sample all but empty). If the bounds of single cells
stand against that, the share is lowered. A share can be asked for instead (``keep``); then
``sweeps`` sweeps are made and the targets are missed where the bounds act. ``margins``
tells what any mixture misses.

Targets are given as a power: a category's target share is proportional to its
own share of tokens to that power (1 leaves it, 0 evens it out).

The table of cells is as large as the number of combinations that occur, not as the
documents. Its margins are sums by one category, joined back to the cells.

Defined results: null categories are a category of their own (``NULL_NAME``);
null and empty texts have no tokens, weigh nothing in the margins and are kept with
the probability of their cell (1 when no document of the cell has tokens);
repeated rows share one fate, as it depends on the id; a null id counts as the text
"null"; extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewise.llm.scratch import saved

SWEEPS = 6
POWER = 0.7
KEEP = 0.75  # share of all tokens in op3's sample
COPIES = 4   # of one document in op3's sample, at most
TOLERANCE = 5e-4  # of a margin, as a part of all tokens
MOST_SWEEPS = 100
PATIENCE = 15  # sweeps before the share is lowered
SEED = 20
NULL_NAME = "(none)"


def tokens(text: Column | str = "text") -> Column:
    """Words between blanks, tabs and line ends, as token weight."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def topic(text: Column | str = "text") -> Column:
    """Topic of a text by its surface: the first kind whose mark occurs in it."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return (F.when(t.contains(" | "), "table").when(t.contains("@"), "contact")
            .when(t.contains("!!"), "loud").when(t.rlike("[0-9]{3}"), "figures").otherwise("prose"))


def uniform(id_col: str = "doc_id", seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def raked(cells: DataFrame, categories: tuple[str, ...], power: float = POWER,
          keep: float | None = None, sweeps: int = SWEEPS, copies: int = 1) -> tuple[DataFrame, float]:
    """``cells`` (categories, tokens) with ``weight``: the raked number of tokens, of as
    many in all, and at most copies * tokens / keep; and ``keep``, the largest that meets the
    targets unless given."""
    total = Window.partitionBy()
    n = cells.agg(F.sum("tokens")).first()[0] or 0
    for c in categories:
        # the targets of one category: a small table, one row for each of its values
        share = cells.groupBy(c).agg((F.sum("tokens") ** power).alias("part"))
        target = F.col("part") / F.sum("part").over(total) * F.lit(float(n))
        share = share.select(c, target.alias(f"target_{c}"))
        cells = cells.join(share, c)
    cells = saved(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    fixed = keep is not None
    if not fixed:
        least = F.col("target") - F.lit(TOLERANCE / 2)
        keep = min(1.0, _margins(cells, categories, "tokens").filter(least > 0)
                   .agg(F.min(copies * F.col("got") / least)).first()[0] or 1.0)
    for i in range(sweeps if fixed else MOST_SWEEPS):
        for c in categories:
            factor = cells.groupBy(c).agg(F.sum("weight").alias("got"))
            cells = (cells.join(factor, c)
                     .withColumn("weight", F.col("weight") * F.col(f"target_{c}") / F.col("got")).drop("got"))
        cells = saved(cells.withColumn("weight", F.least("weight", copies * F.col("tokens") / F.lit(keep))), "cells")
        if fixed:
            continue
        missed = _margins(cells, categories, "weight").agg(F.max(F.abs(F.col("got") - F.col("target")))).first()[0]
        if (missed or 0.0) <= TOLERANCE:
            break
        if (i + 1) % PATIENCE == 0 and i + 1 < MOST_SWEEPS:
            keep *= 0.8
    else:
        if not fixed:
            warnings.warn(f"margins are missed by up to {missed:.2g} of all tokens after {MOST_SWEEPS} sweeps")
    return cells, keep


def _margins(cells: DataFrame, categories: tuple[str, ...], column: str) -> DataFrame:
    """(got, target) of each value of each category, as parts of their sums."""
    total = Window.partitionBy()
    return reduce(DataFrame.unionAll, [
        cells.groupBy(c).agg(F.sum(column).alias("got"), F.first(f"target_{c}").alias("target"))
        .select(*[(F.col(x) / F.sum(x).over(total)).alias(x) for x in ("got", "target")]) for c in categories])


def margins(mixed: DataFrame, categories: tuple[str, ...], power: float = POWER,
            prefix: str = "mix_") -> DataFrame:
    """(category, value, target, share) of a ``mixture``: the share of all tokens that each
    value shall have, and its share of the expected tokens of the sample."""
    total = Window.partitionBy()
    weigh = F.col(prefix + "tokens") * F.col(prefix + "probability")
    cells = mixed.filter(F.col(prefix + "tokens") > 0).groupBy(*(prefix + c for c in categories)).agg(
        F.sum(prefix + "tokens").alias("tokens"), F.sum(weigh).alias("expected"))
    parts = [cells.groupBy(F.col(prefix + c).alias("value"))
             .agg((F.sum("tokens") ** power).alias("part"), F.sum("expected").alias("expected"))
             .select(F.lit(c).alias("category"), "value",
                     (F.col("part") / F.sum("part").over(total)).alias("target"),
                     (F.col("expected") / F.sum("expected").over(total)).alias("share")) for c in categories]
    return reduce(DataFrame.unionAll, parts)


def mixture(docs: DataFrame, categories: dict[str, Column], id_col: str = "doc_id",
            text_col: str = "text", power: float = POWER, keep: float | None = None, sweeps: int = SWEEPS,
            seed: int = SEED, prefix: str = "mix_", copies: int = 1) -> DataFrame:
    """``docs`` with <prefix>tokens, the categories (<prefix>name), <prefix>probability (the expected
    copies), <prefix>copies and <prefix>kept (a copy or more). Without ``keep`` the sample is as
    large as the targets allow."""
    if any(c.lower().startswith(prefix) for c in docs.columns):
        raise ValueError(f"columns must not begin with {prefix!r}")
    names = tuple(prefix + c for c in categories)
    docs = docs.withColumns({prefix + c: F.coalesce(e.cast("string"), F.lit(NULL_NAME))
                             for c, e in categories.items()}
                            | {prefix + "tokens": tokens(F.col(text_col))})
    cells = docs.groupBy(*names).agg(F.sum(prefix + "tokens").alias("tokens"))
    full, keep = raked(saved(cells.filter("tokens > 0"), "cells"), names, power, keep, sweeps, copies)
    chance = F.least(F.lit(float(copies)), F.col("weight") * keep / F.col("tokens"))  # rounding
    chances = saved(full.select(*names, chance.alias(prefix + "probability")), "chances")
    p = F.col(prefix + "probability")
    drawn = (uniform(id_col, seed) < p - F.floor(p)).cast("long")
    return (docs.join(chances, list(names), "left")
            .withColumn(prefix + "probability", F.coalesce(prefix + "probability", F.lit(1.0)))
            .withColumn(prefix + "copies", F.floor(p) + drawn)
            .withColumn(prefix + "kept", F.col(prefix + "copies") > 0)
            .select(*docs.columns, prefix + "probability", prefix + "copies", prefix + "kept"))
