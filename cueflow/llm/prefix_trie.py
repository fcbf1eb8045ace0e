"""Prefix trie of conversations by leaf-peeling message passing.

Conversations are rebuilt and every turn gets two hashes of its place, role and text. The exclusive or of
a conversation's first d pairs of hashes names its prefix of d turns, so equal prefixes meet in one aggregation and no
text is moved. A node belongs to its smallest member; the nodes of one owner are a run down one branch, and
(owner, depth) is the node's key from there on.

Peeling works on runs: each holds the sum of its own nodes and a counter of the runs below it that have
not finished. Runs whose counter is 0 finish and send their totals to the runs that they hang on, whose
counters fall; rounds end when the root's run is through. There are as many rounds as runs lie above one another, and a
chain of turns that one conversation goes on with alone takes a single round, however long it is. Sums from the end of each
run, to which what hangs on it is added, then give the subtree of every node.

A key that holds a large share of all rows is split: turns of one conversation lie in slices along their
order, children of a node with very many meet it by a broadcast of the few such nodes, and the ids of a node's
ends are joined in pieces, which one task hashes as they pass.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueflow.llm.runtime import Cut, cut, in_batches
from cueflow.operators.ordered import SLICE, running, sliced
from cueflow.sources.staging import shared_folder

#: Conversations that share a start: c takes turns of c - c % GROUP; the number of turns is the checksum of c modulo HEADS.
GROUP, HEADS = 5, 9
#: Turns of a slice of one conversation, ids of a piece, and the share of all nodes (1 in so many) from which a node's children count as many.
SLICE_TURNS, PIECE, SHARE = 4096, 4096, 1024


def _head(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEADS).cast("bigint")


def _donor(conv: Column) -> Column:
    return conv - conv % GROUP


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after rebuilding: turns have conv, pos (from 0), a, b (hashes of role and text),
    bytes and last; conversations have conv and length.

    Turns go by turn, null first, equal ones by a hash of role and text. Rows without conv_id are no conversation's.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), text, role).alias("b"), F.octet_length(text).cast("bigint").alias("bytes")
    )
    turns = running(sliced(slim, ["conv"], ["turn", "a", "b"], "turns"), ["conv"], ["turn", "a", "b"], {"nth": F.lit(1)})
    turns = cut(turns, "numbered")
    slices = turns.groupBy("conv", SLICE).agg(F.count(F.lit(1)).alias("n"))
    own = slices.groupBy("conv").agg(F.sum("n").alias("own"))
    given = own.select(F.col("conv").alias("donor"), F.col("own").alias("theirs"))
    head = F.least(_head(F.col("conv")), F.coalesce("theirs", F.lit(0)))
    convs = own.withColumn("donor", _donor(F.col("conv"))).join(given, "donor", "left")
    convs = convs.select("conv", head.alias("head"), (head + F.greatest(F.lit(0), F.col("own") - _head(F.col("conv")))).alias("length"))
    convs = cut(convs, "conversations")
    # A conversation has one row for each of its slices here, and a slice no more turns than a task holds.
    known = slices.select("conv", SLICE).join(convs, "conv")
    kept = turns.filter(F.col("nth") >= _head(F.col("conv"))).join(known, ["conv", SLICE]).withColumn("pos", F.col("nth") - _head(F.col("conv")) + F.col("head"))
    near = F.explode(F.transform(F.sequence(F.lit(1 - GROUP), F.lit(GROUP - 1)), lambda i: F.col("conv") + i))
    lent = turns.filter((F.col("nth") < HEADS - 1) & (F.col("conv") % GROUP == 0)).select(F.col("conv").alias("donor"), near.alias("conv"), F.col("nth").alias("pos"), "a", "b", "bytes")
    lent = lent.filter((_donor(F.col("conv")) == F.col("donor")) & (F.col("pos") < _head(F.col("conv")))).join(convs, "conv")
    columns = ["conv", "pos", "a", "b", "bytes", (F.col("pos") + 1 == F.col("length")).alias("last")]
    return kept.select(*columns).unionAll(lent.select(*columns)), convs.select("conv", "length")


def _nodes(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes have name (h1, h2) and that of their parent (p1, p2), owner, depth, n_convs, bytes;
    ends have the node's name and a conversation that it is the end of."""
    g1, g2 = F.xxhash64("pos", "a", "b"), F.xxhash64(F.lit(2), "b", "a", "pos")
    rows = turns.withColumns({"g1": g1, "g2": g2, "part": F.floor(F.col("pos") / SLICE_TURNS)})
    rows = running(cut(rows, "rebuilt"), ["conv"], ["pos"], xors={"p1": F.col("g1"), "p2": F.col("g2")}, by="part")
    rows = cut(rows.withColumns({"h1": F.col("p1").bitwiseXOR(F.col("g1")), "h2": F.col("p2").bitwiseXOR(F.col("g2"))}), "prefixes")
    same = [F.min(c).alias(c) for c in ("p1", "p2", "bytes")]
    nodes = rows.groupBy("h1", "h2").agg(F.min("conv").alias("owner"), (F.min("pos") + 1).alias("depth"), F.count(F.lit(1)).alias("n_convs"), *same)
    none = F.lit(None).cast("bigint")
    root = convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("bigint")
    root = root.select(zero.alias("h1"), zero.alias("h2"), "owner", zero.alias("depth"), "n_convs", none.alias("p1"), none.alias("p2"), zero.alias("bytes"))
    ends = rows.filter("last").select("h1", "h2", "conv").unionAll(convs.filter("length = 0").select(zero.alias("h1"), zero.alias("h2"), "conv"))
    return nodes.unionByName(root), ends


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_children and ``up``, the owner of the parent (null for the root)."""
    counts = nodes.filter("p1 IS NOT NULL").groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = cut(nodes.join(counts, ["h1", "h2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    most = counted.count() // SHARE
    parents = counted.filter("n_children > 0").select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("owner").alias("up"), "n_children")
    # Fewer than SHARE nodes have more than 1 in SHARE of all nodes as their children.
    large, small = parents.filter(F.col("n_children") > most).drop("n_children"), parents.filter(F.col("n_children") <= most).drop("n_children")
    below = counted.filter("p1 IS NOT NULL").join(F.broadcast(large.withColumnRenamed("up", "high")), ["p1", "p2"], "left")
    met = below.filter("high IS NOT NULL").withColumn("up", F.col("high"))
    cold = below.filter("high IS NULL").join(small, ["p1", "p2"])
    keep = ["owner", "depth", "up", "n_convs", "n_children", "bytes", "h1", "h2"]
    top = counted.filter("p1 IS NULL").withColumn("up", F.lit(None).cast("bigint"))
    return met.select(*keep).unionAll(cold.select(*keep)).unionAll(top.select(*keep))


def _peeled(nodes: DataFrame) -> DataFrame:
    """up, at (the depth of the node that it hangs on), n_leaves and saved of every run but the root's: its whole subtree."""
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0), (F.col("n_convs") - 1) * F.col("bytes")
    # A run's first node is the only one whose parent another run owns.
    starts = F.col("up").isNull() | (F.col("up") != F.col("owner"))
    runs = nodes.groupBy("owner").agg(F.max(F.when(starts, F.col("up"))).alias("up"), (F.min("depth") - 1).alias("at"), F.sum(leaf).alias("n_leaves"), F.sum(saved).alias("saved"))
    waiting = runs.filter("up IS NOT NULL").groupBy(F.col("up").alias("owner")).agg(F.count(F.lit(1)).alias("left"))
    state = Cut(runs.join(waiting, "owner", "left").withColumn("left", F.coalesce("left", F.lit(0))), "runs")
    folder, n = f"{shared_folder(nodes.sparkSession)}/peeled-{uuid.uuid4().hex}", 0
    while True:
        done = state.df.filter("left = 0")
        done.select("up", "at", "n_leaves", "saved").write.parquet(f"{folder}/round={n}")
        n += 1
        sent = done.filter("up IS NOT NULL").groupBy(F.col("up").alias("owner")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        add = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).alias(c)
        rest = state.df.filter("left > 0").join(sent, "owner", "left")
        after = Cut(rest.select("owner", "up", "at", add("n_leaves", "l"), add("saved", "s"), (F.col("left") - F.coalesce("n", F.lit(0))).alias("left")), "runs")
        state.drop()
        state = after
        if state.df.isEmpty():
            return nodes.sparkSession.read.schema("up bigint, at bigint, n_leaves bigint, saved bigint").parquet(*[f"{folder}/round={i}" for i in range(n)]).filter("up IS NOT NULL")


def _ends_hashed(ends: DataFrame) -> DataFrame:
    """h1, h2 and ends_sha256 of every node that is an end: of its conversations' ids in order, with commas between."""
    pieces = ends.groupBy("h1", "h2", F.floor(F.col("conv") / PIECE).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = pieces.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "piece")

    def run(batches):
        import pyarrow as pa

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["h1", "h2", "ends_sha256"])

        node, digest = None, None
        for b in batches:
            rows = []
            for h1, h2, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (h1, h2) == node:
                    digest.update(b"," + ids.encode())
                else:
                    if node:
                        rows.append((*node, digest.hexdigest()))
                    node, digest = (h1, h2), hashlib.sha256(ids.encode())
            yield out(rows)
        if node:
            yield out([(*node, digest.hexdigest())])

    return in_batches(pieces.select("h1", "h2", "ids"), run, "h1 bigint, h2 bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty. Turns go by ``turn``, null first; turns that tie, repeated rows among them, are all kept, in the order of a
    hash. Rows without conv_id belong to no conversation and make no node. An empty table gives no rows, not even the root.
    Texts of any length count whole; columns besides conv_id, turn, role and text are not read.
    """
    turns, convs = rebuilt(conversations)
    found, ends = _nodes(turns, convs)
    nodes = cut(_with_parents(found), "nodes")
    hung = _peeled(nodes).groupBy(F.col("up").alias("owner"), F.col("at").alias("depth")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    rows = nodes.join(hung, ["owner", "depth"], "left").join(_ends_hashed(ends), ["h1", "h2"], "left")
    leaves = F.coalesce("l", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0)
    saved = F.coalesce("s", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")
    # Counted from the end of the run: what lies before a node in this order is below it.
    rows = rows.withColumns({"leaves": leaves, "saves": saved, "from_end": -F.col("depth")}).drop("l", "s")
    rows = cut(rows.withColumn("part", F.floor(F.col("from_end") / SLICE_TURNS)), "own")
    rows = running(rows, ["owner"], ["from_end"], {"more_leaves": F.col("leaves"), "more_saves": F.col("saves")}, by="part")
    return rows.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("up").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saves") + F.col("more_saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
