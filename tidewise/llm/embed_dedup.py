"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Equal vectors are one node. A node's signs against random hyperplanes give a code in
each of several tables; nodes with an equal code meet, and their cosines are
computed in double precision. The number of bits follows the number of nodes, so that a
bucket of unrelated vectors stays small, and the number of tables follows the bits, so
that a pair at the threshold meets in some table with probability ``RECALL``; pairs
of higher cosine meet more often.

A bucket with more than ``BLOCK`` nodes is cut into blocks, and every pair of blocks
is a step of its own. A pair that meets in several tables counts in the first only. A step
gives a row for each linked node, with the number of its links and the least node that it
reaches there, never all pairs.

Defined results: a vector that is null, empty or zero, or that holds a null or
non-finite component, links with nothing; vectors of different lengths do
not link; -0.0 equals 0.0; equal vectors link with each other; repeated rows
are vectors of their own, so they link with each other too; a null id never names
a component unless all ids of the component are null. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm.components import components
from tidewise.llm.scratch import saved

RECALL = 0.98
BUCKET = 128       # unrelated nodes in a bucket, about
BLOCK = 512
CELL_ROWS = 4000   # rows of one call, about
MAX_BITS = 20
SEED = 7


def _plan(n: int, threshold: float) -> tuple[int, int]:
    """(bits of a code, tables) for so many nodes."""
    bits = min(MAX_BITS, max(4, round(math.log2(max(1, n) / BUCKET)) if n else 4))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def _matrix(column, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, length)


def _balanced(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component between 1/2 and 1:
    cosines stay the same to the last bit, and no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def _with_codes(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, copies, vector as bytes, codes as bytes of 32-bit integers)."""
    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.values.to_numpy(zero_copy_only=False)
            at = vectors.offsets.to_numpy()
            codes: list = [None] * len(vectors)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                x = _balanced(np.stack([flat[at[i]:at[i] + length] for i in rows]))
                planes = np.random.default_rng(SEED).standard_normal((length, bits * tables))
                signs = (x @ planes > 0).reshape(len(rows), tables, bits)
                own = (signs << np.arange(bits)).sum(axis=2).astype(np.int32)
                for i, c in zip(rows.tolist(), own):
                    codes[i] = c.tobytes()
            raw = [flat[at[i]:at[i + 1]].tobytes() for i in range(len(vectors))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("copies"), pa.array(lengths, pa.int32()),
                 pa.array(raw, pa.binary()), pa.array(codes, pa.binary()),
                 pa.array([np.frombuffer(c, np.int32) for c in codes], pa.list_(pa.int32()))],
                names=["node", "copies", "length", "vector", "all_codes", "codes"])

    return nodes.mapInArrow(run, "node long, copies long, length int, vector binary, all_codes binary, "
                                 "codes array<int>")


def _linked(table: pa.Table, threshold: float):
    """Of the rows of one cell: (node, links, root) of each linked node and step."""
    keys = np.stack([table.column(c).to_numpy() for c in ("length", "table", "code", "i", "j")], axis=1)
    order = np.lexsort(keys.T[::-1])
    keys = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1), [True]]))
    node, copies, block = (table.column(c).to_numpy()[order] for c in ("node", "copies", "block"))
    vectors, codes = (table.column(c).take(pa.array(order)).to_pylist() for c in ("vector", "all_codes"))
    out = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a < 2:
            continue
        length, number, _, i, j = keys[a].tolist()
        x = _balanced(_matrix(vectors[a:b], length))
        norms = np.sqrt((x * x).sum(axis=1))
        near = (x @ x.T) / np.outer(norms, norms) >= threshold
        if i != j:
            near &= block[a:b][:, None] != block[a:b]
        u, v = np.nonzero(np.triu(near, 1))
        if number and len(u):
            c = np.frombuffer(b"".join(codes[a:b]), np.int32).reshape(b - a, -1)[:, :number]
            fresh = np.ones(len(u), bool)
            for t in range(number):
                fresh &= c[u, t] != c[v, t]
            u, v = u[fresh], v[fresh]
        if not len(u):
            continue
        m = copies[a:b]
        links = np.bincount(u, m[v], b - a) + np.bincount(v, m[u], b - a)
        root = node[a:b].copy()
        while True:
            least = np.minimum(root[u], root[v])
            if (root[u] == least).all() and (root[v] == least).all():
                break
            np.minimum.at(root, u, least)
            np.minimum.at(root, v, least)
        some = links > 0
        out.append((node[a:b][some], links[some].astype(np.int64), root[some]))
    parts = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("node", "links", "root"), parts)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                 threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    vector = F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    usable = (F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
              & F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("vector")))
    nodes = saved(rows.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("least_id"), F.count("*").alias("copies"), F.first("vector").alias("vector")),
        "vectors")
    n = nodes.count()
    bits, tables = _plan(n, threshold)
    coded = _with_codes(nodes.select("node", "copies", "vector"), bits, tables)
    placed = coded.select("node", "copies", "length", "vector", "all_codes",
                          F.posexplode("codes").alias("table", "code"))
    sizes = _with_codes(nodes.select("node", "copies", "vector"), bits, tables).select(
        "length", F.posexplode("codes").alias("table", "code"))
    large = (sizes.groupBy("length", "table", "code").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
             .select("length", "table", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    placed = (placed.join(large, ["length", "table", "code"], "left")
              .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
              .withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")))
    cells = max(1, -(-n * tables // CELL_ROWS))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("length", "table", "code", "i", "j"), F.lit(cells)))
    found = saved(placed.drop("other", "blocks").groupBy("cell").applyInArrow(
        lambda t: _linked(t, threshold), "node long, links long, root long"), "near")
    comps = components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (nodes.select("node", "least_id", "copies").join(comps, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = (named.join(least, "component").join(counts, "node", "left")
               .select("node", "component_id",
                       (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    component = F.coalesce("component_id", "id")
    return rows.drop("vector").join(classes, "node", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
