"""N-gram Jaccard join: documents whose sets of word n-grams are similar.

Method: PartEnum signatures (``partenum.py``) find candidate pairs without
missing any pair at or above the threshold; exact Jaccard verification follows.

Equal sets are one node of the link graph, named by a 64-bit hash of the set, so
copies cost one entry each and are never paired. Signatures travel
packed (``packed.py``). Texts that share a signature form a list; lists of up to
``SMALL_LIST`` nodes give all their pairs, longer ones only pairs with one of their
nodes, a hub. After those links are verified and joined into components, only nodes of
a long list that lie outside the list's main component are still compared, block
by block, with the list's other components (``_open_pairs``): first each such node
with the likeliest node of a component, then what is still apart with all nodes that
may link. So no pair between different components goes unseen, and no group is ever
expanded into all pairs.
Before sets are fetched, pairs pass an exact filter: the parity bitmaps of two
sets differ in no more bits than the sets differ in elements.

Defined results: null and empty texts (and texts of separators alone) have no
shingles, link with nothing and are their own component; a text shorter than the
n-gram has its whole word sequence as its only shingle; repeated rows are
nodes like any other and each row is returned; a null id is returned with
its counts, and names no component unless all ids of that component are null.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewise.llm import hashing as H
from tidewise.llm import packed as P
from tidewise.llm.bitmap import bitmap
from tidewise.llm.components import components, merged
from tidewise.llm.partenum import Bands, signatures
from tidewise.llm.scratch import saved

WIDTH = 5
SMALL_LIST = 16   # longer lists are linked through their least node first
BLOCK = 512       # nodes of a long list in one row
PARITY_BITS = (64, 8192)
U = np.uint64


def _texts(batch: pa.RecordBatch, name: str):
    data, offsets = H.utf8(batch.column(name))
    for a, b in H.chunks(offsets):
        yield a, b, data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _parity(elements: np.ndarray) -> bytes:
    low, high = PARITY_BITS
    bits = min(high, max(low, 1 << (len(elements) - 1).bit_length()))
    odd = np.bincount((elements & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def shingle_profiles(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, node, parity) of each row: the size of its shingle set, a
    64-bit hash of the set and its parity bitmap; both are null for empty sets."""
    def run(batches):
        for batch in batches:
            for a, b, data, offsets in _texts(batch, "text"):
                sets, at = H.shingle_sets(data, offsets, width)
                sizes, empty = np.diff(at), np.diff(at) == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("id")[a:b], pa.array(sizes),
                    pa.array(H.set_fingerprints(sets, at), mask=empty),
                    pa.array([_parity(sets[x:y]) if y > x else None
                              for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())],
                    names=["id", "n_shingles", "node", "parity"])

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "id long, n_shingles long, node long, parity binary")


def _signature_blocks(docs: DataFrame, text_col: str, width: int, bands: Bands, bits: int):
    def run(batches):
        hashes, nodes, seen, waiting = [], [], set(), 0

        def flush():
            bucket, rest = P.split_hash(H.mix64(np.concatenate(hashes)), bits)
            return P.pack(bucket, [rest, np.concatenate(nodes)])

        for batch in batches:
            for _, _, data, offsets in _texts(batch, "text"):
                sets, at = H.shingle_sets(data, offsets, width)
                names = H.set_fingerprints(sets, at)
                fresh = np.array([x not in seen and not seen.add(x) for x in names.tolist()], bool)
                fresh &= np.diff(at) > 0
                found, owner = signatures(sets, at, bands)
                use = fresh[owner]
                hashes.append(found[use])
                nodes.append(names[owner[use]])
                waiting += len(hashes[-1])
                if waiting >= P.FLUSH_RECORDS:
                    yield flush()
                    hashes, nodes, seen, waiting = [], [], set(), 0
        if waiting:
            yield flush()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, P.packed_schema(2))


def _bucket_lists(table: pa.Table) -> pa.Table:
    """Of a bucket: candidate pairs (key null, a < b), and the long lists (key, a
    member in a, the list's length in b)."""
    rest, node = P.unpack(table.column("c0"), np.uint32), P.unpack(table.column("c1"), np.int64)
    order = np.lexsort((node, rest))
    rest, node = rest[order], node[order]
    new = np.concatenate([[True], (rest[1:] != rest[:-1]) | (node[1:] != node[:-1])]) \
        if len(rest) else np.zeros(0, bool)
    rest, node = rest[new], node[new]
    first = np.flatnonzero(np.concatenate([[True], rest[1:] != rest[:-1]])) \
        if len(rest) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(rest)))
    pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for m in range(2, SMALL_LIST + 1):
        members = node[first[length == m][:, None] + np.arange(m)]
        for i, j in zip(*np.triu_indices(m, 1)):
            pairs_a.append(members[:, i])
            pairs_b.append(members[:, j])
    keys, long_a, long_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    seen = set()
    for f, m in zip(first[length > SMALL_LIST].tolist(), length[length > SMALL_LIST].tolist()):
        members = node[f:f + m]
        with np.errstate(over="ignore"):
            key = int(np.sum(H.mix64(members.view(U)), dtype=U).view(np.int64))
        # another hub for each list, so that a node is compared with many
        hub = members[np.argmin(H.mix64(members.view(U) ^ U(f)))]
        others = members[members != hub]
        pairs_a.append(np.minimum(hub, others))
        pairs_b.append(np.maximum(hub, others))
        if key not in seen:  # an equal list under another signature adds nothing
            seen.add(key)
            keys.append(np.full(m, key))
            long_a.append(members)
            long_b.append(np.full(m, m))
    pairs = np.unique(np.stack([np.concatenate(pairs_a), np.concatenate(pairs_b)]), axis=1)
    keys, long_a, long_b = map(np.concatenate, (keys, long_a, long_b))
    return pa.table({
        "key": pa.array(np.concatenate([np.zeros(pairs.shape[1], np.int64), keys]),
                        mask=np.arange(pairs.shape[1] + len(keys)) < pairs.shape[1]),
        "a": np.concatenate([pairs[0], long_a]), "b": np.concatenate([pairs[1], long_b])})


def _folded(parity: bytes, size: int) -> np.ndarray:
    """A parity bitmap for fewer bits: halves combine by exclusive or."""
    x = np.frombuffer(parity, np.uint64)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def _may_link(n_a: int, parity_a: bytes, n_b: int, parity_b: bytes, bands: Bands) -> bool:
    if max(n_a, n_b) > bands.largest_partner(min(n_a, n_b)):
        return False
    size = min(len(parity_a), len(parity_b)) // 8
    differ = int(np.bitwise_count(_folded(parity_a, size) ^ _folded(parity_b, size)).sum())
    return differ <= bands.differing(n_a, n_b)


def _gathered(df: DataFrame) -> DataFrame:
    """No more tasks than the session's shuffle partitions: a join that was split for its skew may
    have many times as many small ones, each of which would start Python."""
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _filtered(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """Pairs whose sizes and parity bitmaps allow a link."""
    def run(batches):
        for batch in batches:
            c = [batch.column(i) for i in range(6)]
            keep = [_may_link(*x, bands) for x in zip(*(c[i].to_pylist() for i in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([c[0].filter(pa.array(keep, pa.bool_())),
                                              c[1].filter(pa.array(keep, pa.bool_()))], names=["a", "b"])

    def side(x):
        return nodes.select(F.col("node").alias(x), F.col("n_shingles").alias("n_" + x),
                            F.col("parity").alias("p_" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "p_a", "n_b", "p_b")
    return _gathered(both).mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, text_col: str, width: int, wanted: DataFrame) -> DataFrame:
    """(node, elements) of the wanted nodes. The sets are made anew from the texts; a
    bitmap of the wanted nodes keeps the others from being shuffled."""
    some = bitmap(wanted, "node")

    def run(batches):
        for batch in batches:
            for _, _, data, offsets in _texts(batch, "text"):
                sets, at = H.shingle_sets(data, offsets, width)
                names = H.set_fingerprints(sets, at)
                hits = np.flatnonzero(some.may_hold(names) & (np.diff(at) > 0))
                yield pa.RecordBatch.from_arrays([
                    pa.array(names[hits]),
                    pa.array([sets[at[i]:at[i + 1]].view(np.int64) for i in hits], pa.list_(pa.int64()))],
                    names=["node", "elements"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, elements array<long>")
    return got.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs whose sets are similar indeed. Sets are compared row by row in the JVM, so no
    batch of them is ever held."""
    def side(x):
        return sets.select(F.col("node").alias(x), F.col("elements").alias("e_" + x))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("e_a", "e_b"))
    union = F.size("e_a") + F.size("e_b") - common
    return both.filter(common * bands.den >= union * bands.num).select("a", "b")


def _open_pairs(lists: DataFrame, nodes: DataFrame, comps: DataFrame, bands: Bands,
                best: bool) -> DataFrame:
    """Pairs of long lists whose nodes lie in different components and may link; with
    ``best``, of a node and a component in a block only the likeliest.

    A list's main component is the one with most of its nodes. The list's nodes
    are bundled in blocks, those outside the main component ("left") in
    blocks of their own as well, which meet all blocks of the list. Pairs within the
    main component need no look; all others meet in exactly such block pairs."""
    members = (lists.join(comps.withColumnRenamed("node", "a"), "a", "left")
               .select("key", "a", F.coalesce("component", "a").alias("component"), "b"))
    counts = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = (counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("m"),
                                      F.count("*").alias("kinds"))
            .filter("kinds > 1").select("key", F.col("m.component").alias("main")))
    block = F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.ceil(F.col("b") / BLOCK))).cast("int")
    members = (members.join(main, "key")
               .join(nodes.select(F.col("node").alias("a"), "n_shingles", "parity"), "a")
               .withColumn("block", block).withColumn("left", F.col("component") != F.col("main")))
    node = F.struct("a", "component", "n_shingles", "parity")
    # a bundle is one block of a list: about BLOCK nodes in one row
    bundles = members.groupBy("key", "block").agg(F.collect_list(node).alias("right"))
    left = members.filter("left").groupBy("key", "block").agg(F.collect_list(node).alias("left"))
    met = bundles.join(left.select("key", "left"), "key").select("left", "right")

    def run(batches):
        for batch in batches:
            yield from _block_pairs(batch, bands, best)

    # the same pairs meet in many lists: they are made distinct by left node, as arrays
    found = _gathered(met).mapInArrow(run, "x long, ys array<long>").groupBy("x").agg(
        F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys"))
    pairs = found.select("x", F.explode("ys").alias("y"))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


class _Bundles:
    """A column of arrays of nodes, read in place."""

    def __init__(self, column: pa.ListArray):
        self.at = column.offsets.to_numpy()
        fields = column.values
        self.node, self.component, self.size = (fields.field(c).to_numpy() for c in ("a", "component", "n_shingles"))
        parity = fields.field("parity").cast(pa.large_binary())
        self.offsets = np.frombuffer(parity.buffers()[1], np.int64)[parity.offset:][:len(parity) + 1]
        self.data = memoryview(parity.buffers()[2] or b"")

    def parity(self, i: int) -> memoryview:
        return self.data[self.offsets[i]:self.offsets[i + 1]]

    def least_width(self, row: int) -> int:
        return int(np.diff(self.offsets)[self.at[row]:self.at[row + 1]].min())

    def folded(self, row: int, size: int) -> np.ndarray:
        return np.array([_folded(self.parity(i), size) for i in range(self.at[row], self.at[row + 1])])


def _block_pairs(batch: pa.RecordBatch, bands: Bands, best: bool):
    lefts, rights = _Bundles(batch.column("left")), _Bundles(batch.column("right"))
    for row in range(batch.num_rows):
        l0, l1, r0, r1 = lefts.at[row], lefts.at[row + 1], rights.at[row], rights.at[row + 1]
        n_l, c_l = lefts.size[l0:l1, None], lefts.component[l0:l1, None]
        n_r, c_r = rights.size[r0:r1], rights.component[r0:r1]
        may = (c_l != c_r) & (np.maximum(n_l, n_r) <= bands.largest_partner(np.minimum(n_l, n_r)))
        if not may.any():
            continue
        size = min(lefts.least_width(row), rights.least_width(row)) // 8
        p_l, p_r = lefts.folded(row, size), rights.folded(row, size)
        differ = np.zeros(may.shape, np.int64)
        for k in range(size):
            differ += np.bitwise_count(p_l[:, k, None] ^ p_r[:, k])
        may &= differ <= bands.differing(n_l, n_r)
        i, j = np.nonzero(may)
        if best:  # the least different of each (node, component)
            order = np.lexsort((differ[i, j], c_r[j], i))
            i, j = i[order], j[order]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (c_r[j][1:] != c_r[j][:-1])
            i, j = i[first], j[first]
        keep = np.array([_may_link(int(lefts.size[p]), lefts.parity(p), int(rights.size[q]), rights.parity(q), bands)
                         for p, q in zip((i + l0).tolist(), (j + r0).tolist())], bool)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(lefts.node[l0 + i[first]]),
             pa.ListArray.from_arrays(pa.array(np.append(first, len(i)), pa.int32()), pa.array(rights.node[r0 + j]))],
            names=["x", "ys"])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = WIDTH, num: int = 4, den: int = 5) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``. Two rows link when
    den * |intersection| >= num * |union| of their sets of ``width``-word
    shingles; the component is the smallest id reachable by links."""
    bands = Bands(num, den)
    profiles = saved(shingle_profiles(docs, id_col, text_col, width), "shingle-profiles")
    nodes = (profiles.filter("node is not null").groupBy("node")
             .agg(F.min("id").alias("id"), F.max("n_shingles").alias("n_shingles"),
                  F.max("parity").alias("parity")))
    links = _links(docs, text_col, width, bands, profiles, nodes)
    named = (links.withColumnRenamed("component", "root")
             .join(nodes.select("node", "id"), "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    linked = named.join(least, "root").select("node", "component_id")
    own = nodes.select("node", F.col("id").alias("own_id"))
    joined = (profiles.drop("parity").join(own, "node", "left").join(linked, "node", "left"))
    return joined.select(
        F.col("id"), F.col("n_shingles"),
        F.coalesce("component_id", "own_id", "id").alias("component_id"))


def _links(docs, text_col, width, bands, profiles, nodes) -> DataFrame:
    """(node, component) of all linked nodes."""
    total = profiles.agg(F.sum("n_shingles")).first()[0] or 0
    bits = P.bucket_bits(total // 2)
    blocks = _signature_blocks(docs, text_col, width, bands, bits)
    found = saved(blocks.groupBy("bucket").applyInArrow(_bucket_lists, "key long, a long, b long"),
                  "candidates")
    lists = found.filter("key is not null").distinct()
    pairs = saved(_filtered(found.filter("key is null").select("a", "b").distinct(), nodes, bands),
                  "pairs")
    # the sets of all nodes that a comparison may need, fetched once
    needed = (pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
              .union(lists.select("a")).distinct())
    sets = saved(_sets_of(docs, text_col, width, saved(needed, "needed")), "sets")
    links = saved(_verified(pairs, sets, bands), "links")
    comps = components(links)
    if lists.isEmpty():
        return comps
    lists = saved(lists, "lists")
    for best in (True, False):
        more = saved(_verified(_open_pairs(lists, nodes, comps, bands, best), sets, bands), "links")
        if not more.isEmpty():
            comps = merged(comps, more)
    return comps
