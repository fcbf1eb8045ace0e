"""Near-duplicates by the Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands find pairs, exact sets decide.

A text is the set of its 5-word shingles. Texts of one set are one node from the start. Each node has the SimHash
fingerprint of ``simhash``, and fingerprints within its radius meet as there, by ball hashing. Of texts of
similarity 0.8 few are so close: for those each node has BANDS keys, each made of ROWS minimal hashes under
functions of their own, and nodes that share a key meet.
Two texts of similarity s share a key with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9996 at 0.8.

In a group of few nodes every pair is looked at. Nodes of larger groups are paired with a few leaders of each
group first, and linked ones become clusters. What leaders leave is then found exactly, by prefixes: with all shingles
in one order, the rare ones first, two sets of similarity ``least`` share one that stands among the first of both, and
such a shingle joins nodes of different clusters. So no pair is lost to the size of a group, and pairs within
what is linked already are not made. Every pair's similarity is taken from the two whole sets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import cut, in_batches, mix, space_table, span_hashes, text_bytes, word_spans
from cueflow.llm.simhash import components, fingerprint, links

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes of a group in which every pair is looked at, and leaders of a larger one besides its smallest node.
SMALL, LEADERS = 8, 3
#: Slots in which shingles are counted, only to put them in order: any order finds all pairs, the rare ones first make few.
SLOTS = 1 << 18
#: Shingles of the nodes that are compared with others at once.
PACK = 1 << 13

_SPACE = space_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text of an Arrow column.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a shingle are one shingle,
    a text without words has none.
    """
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    starts, ends = word_spans(data, offsets, _SPACE)
    words, at = span_hashes(data, starts, ends), np.searchsorted(starts, offsets)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        w, width = words[lo:hi], min(shingle, hi - lo)
        n = len(w) - width + 1 if width else 0
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h = mix(h * _STEP + w[k : k + n])
        out.append(np.unique(h))
    return out


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of the whole set; 0 for an empty one."""
    return int(mix(shingles).sum(dtype=np.uint64).astype(np.int64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS signed longs."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for lo in range(0, len(shingles), 1 << 12):
        some = shingles[lo : lo + (1 << 12)]
        for i, factor in enumerate(_FACTORS):
            least[i] = min(least[i], (some * factor).min())
    key = np.arange(BANDS, dtype=np.uint64)
    for r in least.reshape(BANDS, ROWS).T:
        key = mix(key * _STEP + r)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded): distinct pairs (a, b), a < b, of nodes in small groups and of nodes and leaders in large ones, and
    the nodes of large groups; ``nodes`` has node and keys."""
    members = cut(nodes.select("node", F.explode("keys").alias("key")), "members")
    orders = [F.min_by("node", F.xxhash64("node", "key", F.lit(i))).alias(f"lead{i}") for i in range(LEADERS)]
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), *orders).filter("n > 1")
    met = cut(members.join(groups.withColumnRenamed("key", "of"), F.col("key") == F.col("of")), "met")
    large = met.filter(F.col("n") > SMALL)
    led = large.select(F.col("node").alias("x"), F.explode(F.array("lead", *[f"lead{i}" for i in range(LEADERS)])).alias("y"))
    small = met.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_list("node").alias("all"))
    small = small.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    pairs = led.unionAll(small).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs, large.select("node").distinct()


def close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes whose fingerprints are within the radius of ``simhash``; ``nodes`` has node and fp.

    Nodes of one fingerprint are paired with the smallest of them, which stands for all where the fingerprint is linked to another.
    """
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head")), "prints")
    head = lambda x: heads.select(F.col("fp").alias(f"fp_{x}"), F.col("head").alias(f"head_{x}"))
    same = nodes.join(head("of"), F.col("fp") == F.col("fp_of")).select(F.col("node").alias("x"), F.col("head_of").alias("y"))
    near = links(heads.select("fp")).join(head("a"), F.col("a") == F.col("fp_a")).join(head("b"), F.col("b") == F.col("fp_b")).select(F.col("head_a").alias("x"), F.col("head_b").alias("y"))
    return same.unionAll(near).filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def prefix_sizes(size: int, least: float) -> tuple[int, int]:
    """How many of a set's first shingles hold one of every set of similarity ``least``: of sets no smaller, and of any."""
    up = lambda x: math.ceil(x - 1e-9)
    return size - up(2 * least / (1 + least) * size) + 1, size - up(least * size) + 1


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each of SLOTS slots."""
    def run(batches):
        import pyarrow as pa

        found = np.zeros(SLOTS, np.int64)
        for b in batches:
            for x in b.column(0):
                found += np.bincount(_slots(np.frombuffer(x.as_buffer(), np.uint64)), minlength=SLOTS)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(found[some])], ["slot", "n"])

    out = np.zeros(SLOTS, np.int64)
    found = in_batches(sets.select("shingles"), run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return out


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) % np.uint64(SLOTS)).astype(np.int64)


def _prefixes(sets: DataFrame, least: float) -> DataFrame:
    """token, node, size, pos (its place in the node's order) and short (among those that also meet larger sets)."""
    shared = sets.sparkSession.sparkContext.broadcast(_counts(sets))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            parts = []
            for node, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                if not len(own):
                    continue
                short, whole = prefix_sizes(len(own), least)
                first = own[np.lexsort((own, shared.value[_slots(own)]))[:whole]]
                parts.append((first.view(np.int64), np.full(len(first), node), np.full(len(first), len(own)), np.arange(len(first)), np.arange(len(first)) < short))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["token", "node", "size", "pos", "short"])

    return in_batches(sets.select("node", "shingles"), run, "token bigint, node bigint, size bigint, pos bigint, short boolean")


def _packs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """big and pack (an array of node and shingles) of ``nodes`` (big, node, size): packs of about PACK shingles each."""
    parts = nodes.groupBy("big").agg(F.ceil(F.sum("size") / PACK).alias("parts")).withColumnRenamed("big", "of")
    dealt = nodes.join(parts, F.col("big") == F.col("of")).select("big", "node", F.pmod(F.xxhash64("node"), "parts").alias("part"))
    held = sets.select(F.col("node").alias("own"), "shingles")
    return dealt.join(held, F.col("node") == F.col("own")).groupBy("big", "part").agg(F.collect_list(F.struct("node", "shingles")).alias("pack")).select("big", "pack")


def _linked(one: DataFrame, two: DataFrame, least: float) -> DataFrame:
    """The links (a, b) between the packs of ``one`` and of ``two`` that have the same ``big``."""
    both = one.withColumnRenamed("pack", "first").join(two.select(F.col("big").alias("of"), F.col("pack").alias("second")), F.col("big") == F.col("of")).select("first", "second")

    def unpacked(pack):
        nodes, sets = pack.values.field(0).to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in pack.values.field(1)]
        return nodes, sets, np.array([len(x) for x in sets], np.int64)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = []
            for i in range(b.num_rows):
                nodes, sets, size = unpacked(b.column(0)[i])
                joined, at = np.concatenate(sets), np.cumsum(size) - size
                for node, own, n in zip(*unpacked(b.column(1)[i]), strict=True):
                    place = np.searchsorted(own, joined)
                    place[place == n] = 0
                    common = np.add.reduceat(own[place] == joined, at, dtype=np.int64)
                    found += [(int(min(node, x)), int(max(node, x))) for x in nodes[common >= least * (size + n - common)]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return in_batches(both, run, "a bigint, b bigint")


def across(sets: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """All links (a, b), a < b, between nodes of different clusters that are of similarity ``least`` or more.

    ``sets`` has node and shingles, ``clusters`` node and root; a node without a row there is a cluster by itself. Two clusters
    that share first shingles meet in packs of nodes, or by each shingle's nodes, whichever makes fewer pairs; either finds all.
    """
    tokens = _prefixes(sets, least).join(clusters.select(F.col("node").alias("of"), "root"), F.col("node") == F.col("of"), "left")
    tokens = cut(tokens.select("token", "node", "size", "pos", "short", F.coalesce("root", "node").alias("root")), "prefixes")
    # Shingles of one cluster alone join nothing.
    mixed = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.bool_or("short").alias("some")).filter("lo < hi AND some").select("token")
    kept = cut(tokens.join(mixed, "token", "left_semi"), "mixed")
    side = lambda df, x: df.select(*[F.col(c).alias(f"{c}{x}") for c in df.columns])
    roots = kept.groupBy("token", "root").agg(F.count_if("short").alias("short"), F.count(F.lit(1)).alias("n"))
    apart = (F.col("token1") == F.col("token2")) & (F.col("root1") != F.col("root2"))
    facing = cut(side(roots.filter("short > 0"), 1).join(side(roots, 2), apart).select(F.col("token1").alias("token"), F.col("root1").alias("r1"), F.col("root2").alias("r2"), (F.col("short1") * F.col("n2")).alias("rows")), "facing")
    heads = kept.groupBy("node", "root", "size").agg(F.lit(1).alias("one")).drop("one")
    many = heads.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
    costs = facing.groupBy("r1", "r2").agg(F.sum("rows").alias("rows"))
    costs = costs.join(side(many, 1), F.col("r1") == F.col("root1")).join(side(many, 2), F.col("r2") == F.col("root2"))
    larger = (F.col("many1") > F.col("many2")) | ((F.col("many1") == F.col("many2")) & (F.col("r1") > F.col("r2")))
    of = lambda x, y: F.when(larger, F.col(x)).otherwise(F.col(y))
    whole = cut(costs.filter(F.col("many1") * F.col("many2") <= F.col("rows")).select("r1", "r2", of("r1", "r2").alias("big"), of("r2", "r1").alias("little")), "whole")
    bigs = whole.select("big").distinct()
    inside = heads.join(bigs, F.col("root") == F.col("big")).select("big", "node", "size")
    beside = whole.select("big", "little").distinct().join(heads, F.col("little") == F.col("root")).select("big", "node", "size")
    packed = _linked(_packs(inside, sets), _packs(beside, sets), least)
    size1, size2 = F.col("size1"), F.col("size2")
    smaller = (size1 < size2) | ((size1 == size2) & (F.col("node1") < F.col("node2")))
    rest = facing.join(whole.select(F.col("r1").alias("w1"), F.col("r2").alias("w2")), (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2")), "left_anti")
    one = rest.join(side(kept.filter("short"), 1), (F.col("token") == F.col("token1")) & (F.col("r1") == F.col("root1")))
    fits = smaller & (size1 >= least * size2 - 1e-6) & (F.least(size1 - F.col("pos1"), size2 - F.col("pos2")) >= least / (1 + least) * (size1 + size2) - 1e-6)
    by_token = one.join(side(kept, 2), (F.col("token") == F.col("token2")) & (F.col("r2") == F.col("root2")) & fits)
    pairs = by_token.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()
    return packed.unionAll(similar(pairs, sets, least)).distinct()


def _with_nodes(docs: DataFrame, keys: bool) -> DataFrame:
    """doc_id, row (a hash of id and text), node, and the node's keys and fingerprint or the text, of every row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = shingle_sets(b.column(2))
            node = pa.array([node_of(s) for s in sets], pa.int64())
            if keys:
                bands = pa.array([band_keys(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))
                prints = np.array([fingerprint(t.as_py(), SHINGLE) for t in b.column(2)], np.uint64).astype(np.int64)
                last = {"keys": bands, "fp": pa.array(prints)}
            else:
                last = {"text": b.column(2)}
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), node, *last.values()], ["doc_id", "row", "node", *last])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _row().alias("row"), "text")
    return in_batches(slim, run, f"doc_id bigint, row bigint, node bigint, {'keys array<bigint>, fp bigint' if keys else 'text string'}")


def _row():
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and shingles (the sorted hashes, as bytes) of each wanted node (column ``want``)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = shingle_sets(b.column(0))
            node = pa.array([node_of(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([node, pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    # Rows whose node is not wanted drop out before anything is shuffled but the wanted nodes.
    texts = _with_nodes(docs, False).join(wanted, F.col("node") == F.col("want"), "left_semi")
    # Texts of one node have one set; any of them stands for it.
    return in_batches(texts.dropDuplicates(["node"]).select("text"), run, "node bigint, shingles binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets' similarity is at least ``least``."""
    one, two = (sets.select(F.col("node").alias(f"of_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = pairs.join(one, F.col("a") == F.col("of_a")).join(two, F.col("b") == F.col("of_b")).select("a", "b", "set_a", "set_b")

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            read = lambda i: (np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(i))  # noqa: B023, E731
            mask = pa.array([similarity(x, y) >= least for x, y in zip(read(2), read(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([pc.filter(b.column(i), mask) for i in (0, 1)], ["a", "b"])

    return in_batches(both, run, "a bigint, b bigint")


def clusters_of(docs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """node and root of every node that is linked: root is the smallest node that chains of links of similarity ``least`` or more reach."""
    found, crowded = candidates(nodes)
    pairs, crowded = cut(found.unionAll(close_prints(nodes)).distinct(), "pairs"), cut(crowded, "crowded")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("want")).unionAll(crowded.select(F.col("node").alias("want"))).distinct()
    sets = cut(_sets(docs, wanted), "sets")
    clusters = components(similar(pairs, sets, least))
    many = cut(sets.join(crowded.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left_semi"), "crowded-sets")
    if many.isEmpty():
        return clusters
    more = cut(across(many, clusters, least), "more-links")
    if more.isEmpty():
        return clusters
    # Clusters that are linked after all are nodes of a smaller graph; a node of no cluster stands for itself.
    root = lambda x: clusters.select(F.col("node").alias(f"n{x}"), F.col("root").alias(f"r{x}"))
    met = more.join(root(1), F.col("a") == F.col("n1"), "left").join(root(2), F.col("b") == F.col("n2"), "left")
    above = components(met.select(F.coalesce("r1", "a").alias("a"), F.coalesce("r2", "b").alias("b"))).select(F.col("node").alias("over"), F.col("root").alias("top"))
    lower = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root")).unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).join(root(1), F.col("node") == F.col("n1"), "left_anti").select("node", F.col("node").alias("root"))).distinct()
    return lower.join(above, F.col("root") == F.col("over"), "left").select("node", F.coalesce("top", "root").alias("root")).distinct()


def _rooted(docs: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row, node), and (node, root) of every node."""
    prints = cut(_with_nodes(docs, True), "shingles")
    # Texts of one set may differ in how often they repeat a shingle, so in their fingerprints; the least stands for them.
    distinct = prints.groupBy("node").agg(F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    found = clusters_of(docs, distinct, least).withColumnRenamed("node", "of")
    rooted = prints.select("node").distinct().join(found, F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root"))
    return prints.select("doc_id", "row", "node"), rooted


def near_duplicates(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that chains of links reach) of every row.

    Null and empty texts are one component. A component whose ids are all null has a null id. Repeated
    rows stay repeated, texts of any length are read whole, an empty table gives none, columns besides
    doc_id and text are not read.
    """
    prints, rooted = _rooted(docs, least)
    first = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    known = rooted.join(first, "node")
    best = known.groupBy("root").agg(F.min("first").alias("component_id"))
    named = known.join(best, "root").select("node", "component_id")
    return prints.join(named, "node").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row of ``docs`` of each component: that of the smallest doc_id, and of the smallest hash among such.

    Rows without doc_id come last, repeated rows are one. All columns stay as they are.
    """
    prints, rooted = _rooted(docs, least)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = prints.groupBy("node").agg(F.min(order).alias("best"))
    kept = best.join(rooted, "node").groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("__row"))
    packed = docs.select(_row().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__all"))
    # Repeated rows of a kept id meet by the key that they are joined by.
    return packed.join(kept, "__row", "left_semi").groupBy("__row").agg(F.first("__all").alias("__all")).select("__all.*")
