"""Connected components over an edge table, and spanning forests of similarity graphs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Edges of one node that a task looks at; more are dealt over several, so that at most ``HUBS`` nodes are dealt.
HUB, HUBS = 10_000, 100_000
#: Edges up to which one task joins them all.
FEW = 200_000
#: Members of a block and their weight: two blocks are compared in one task.
BLOCK, WEIGHT = 1024, 1_000_000
#: Members that speak for a part of a block.
SPEAKERS = 8


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is its smallest node.

    Up to ``FEW`` edges (their number is checked) are joined in one task. More take alternating large-star and small-star steps: each round links every node to the smallest
    node it can see, and the number of rounds grows with the logarithm of the longest path.
    The edges of hubs are dealt over tasks, in proportion to their number; the list of hubs
    that is broadcast holds at most 2 * ``HUBS`` nodes. Nothing but two numbers per round
    reaches the driver.
    """
    star = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = checkpointed(star)
    seen = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    if seen[0] <= FEW:
        return star.coalesce(1).mapInArrow(_joined, "node long, component long")
    while True:
        share = max(HUB, seen[0] // HUBS)
        both = star.select("u", "v").unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.floor(F.count("*") / share).cast("int").alias("parts")).select("u", F.least("u", "m").alias("m"), "parts")
        hubs = low.filter("parts > 0").select("u", "parts")
        # A hub's edges are dealt over several tasks, each with its own copy of the hub's one row.
        low = low.withColumn("part", F.explode(F.sequence(F.lit(0), "parts"))).drop("parts")
        dealt = both.filter("v > u").join(F.broadcast(hubs), "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), F.col("parts") + 1).cast("int"), F.lit(0)))
        large = dealt.join(low, ["u", "part"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        star = checkpointed(small.distinct())
        now = star.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    roots = star.select(F.col("v").alias("u")).distinct().select(F.col("u").alias("node"), F.col("u").alias("component"))
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined(batches):
    """(node, component) of all edges at once."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    nodes, edges = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1), return_inverse=True)
    u, v = edges.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for end in (label[u], label[v]):
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "component"])


def segments(*columns: np.ndarray):
    """Row numbers of each run of equal values, after sorting."""
    if not len(columns[0]):
        return
    order = np.lexsort(columns)
    new = np.zeros(len(order), bool)
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    yield from np.split(order, np.flatnonzero(new))


def in_blocks(members: DataFrame, key: str, item: str, blocks: str) -> DataFrame:
    """Each row once for every pair of blocks it belongs to.

    ``blocks`` is the number of blocks of the row's group. Rows get ``lo`` and ``hi``, the pair;
    any two rows of a group meet in at least one pair, and no pair holds more than two blocks.
    """
    own = F.pmod(F.xxhash64(item), F.col(blocks)).cast("int")
    return (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .drop("own", "other")
    )


def spanning_forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph in which ``near(i, others)`` tells which others i is linked with.

    Each item is compared with those no tree holds yet, so a group of mutual copies takes one
    pass instead of all its pairs, and no component is split.
    """
    left = np.arange(n)
    edges = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(int(i), left)
            if hit.any():
                found = left[hit]
                edges.extend((int(i), int(j)) for j in found)
                queue.extend(found)
                left = left[~hit]
    return edges


_EDGES = "a long, b long"
#: ``near(i, others)`` for the rows of a table of members, from its ``payload``.
Near = Callable[[pa.Table, np.ndarray], Callable[[int, np.ndarray], np.ndarray]]


def _forests(near: Near):
    """Spanning forests of each (key, lo): edges (a, b), and for members of ``large`` groups (key, cls, root)."""

    def run(t):
        cls, key, large = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "key", "large"))
        out: dict[str, list] = {"key": [], "cls": [], "root": [], "a": [], "b": []}
        for rows in segments(t.column("lo").to_numpy(), key):
            root = cls[rows].copy()
            for i, j in spanning_forest(len(rows), near(t, rows)) if len(rows) > 1 else ():
                root[j] = root[i]  # i is reached before j
                out["a"].append(cls[rows[i]])
                out["b"].append(cls[rows[j]])
            if large[rows[0]]:
                out["key"] += key[rows].tolist()
                out["cls"] += cls[rows].tolist()
                out["root"] += root.tolist()
        return _two_kinds(out, ("key", "cls", "root"), ("a", "b"))

    return run


def _two_kinds(out: dict, first: tuple, second: tuple) -> pa.Table:
    """One table of two kinds of rows; each has nulls in the other's columns."""
    n, m = len(out[first[0]]), len(out[second[0]])
    return pa.table({c: pa.array(out[c] + [None] * m, pa.int64()) for c in first} | {c: pa.array([None] * n + out[c], pa.int64()) for c in second})


def _speak(near: Near):
    """In each (key, lo) of speakers: edges (a, b), and (key, root, label), the smallest root that each tree is now joined with."""

    def run(t):
        cls, key, root = (t.column(c).to_numpy() for c in ("cls", "key", "root"))
        out: dict[str, list] = {"key": [], "root": [], "label": [], "a": [], "b": []}
        for rows in segments(t.column("lo").to_numpy(), key):
            label = {r: r for r in root[rows].tolist()}

            def find(x):
                while label[x] != x:
                    x = label[x]
                return x

            for i, j in spanning_forest(len(rows), near(t, rows)) if len(rows) > 1 else ():
                x, y = find(int(root[rows[i]])), find(int(root[rows[j]]))
                if x != y:
                    label[max(x, y)] = min(x, y)
                    out["a"].append(cls[rows[i]])
                    out["b"].append(cls[rows[j]])
            out["key"] += [key[rows[0]]] * len(label)
            out["root"] += list(label)
            out["label"] += [find(r) for r in label]
        return _two_kinds(out, ("key", "root", "label"), ("a", "b"))

    return run


def _across(near: Near):
    """In each (key, lo, hi), edges from rows that are ``left`` to members of other labels, one a label."""

    def run(t):
        cls, left, label = (t.column(c).to_numpy(zero_copy_only=False) for c in ("cls", "left", "label"))
        a, b = [], []
        for rows in segments(t.column("hi").to_numpy(), t.column("lo").to_numpy(), t.column("key").to_numpy()):
            test = near(t, rows)
            asking, others = np.flatnonzero(left[rows]), np.flatnonzero(~left[rows])
            for i in asking.tolist():
                other = others[label[rows[others]] != label[rows[i]]]
                hit = other[test(i, other)] if len(other) else other
                for j in hit[np.unique(label[rows[hit]], return_index=True)[1]]:
                    a.append(cls[rows[i]])
                    b.append(cls[rows[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _shard(n: int, *cols: str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int").alias("shard")


def _blocks() -> Column:
    return F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("weight") / WEIGHT)).cast("int")


def grouped_links(members: DataFrame, near: Near, n: int) -> DataFrame:
    """Edges (a, b) that connect the members of every group as far as the links among them do.

    ``members`` has key, cls, weight (long) and payload. Groups of a block's size are one
    task's. Larger ones are dealt into blocks: a spanning forest of each block, then one of the
    ``SPEAKERS`` of each of its trees; what is still apart from a group's largest tree is
    compared with all the group, in pairs of blocks. So a group of mutual copies costs its
    members, and no link between trees is lost whatever the group looks like.
    """
    members = checkpointed(members)
    size = members.groupBy("key").agg(_blocks().alias("blocks"))
    placed = members.join(size, "key").withColumn("lo", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("large", F.col("blocks") > 1)
    grown = checkpointed(placed.select(_shard(n, "key", "lo"), "key", "lo", "cls", "large", "payload").groupBy("shard").applyInArrow(_forests(near), "key long, cls long, root long, a long, b long"))
    edges = grown.filter("a IS NOT NULL").select("a", "b")
    if not grown.filter("key IS NOT NULL").limit(1).count():
        return edges
    rooted = grown.filter("key IS NOT NULL").select("key", "cls", "root")
    turn = F.row_number().over(Window.partitionBy("key", "root").orderBy(F.xxhash64("cls", F.lit(1))))
    speakers = rooted.withColumn("turn", turn).filter(F.col("turn") <= SPEAKERS).drop("turn").join(members, ["key", "cls"])
    speakers = checkpointed(speakers.select("key", "cls", "root", "weight", "payload"))
    blocks = speakers.groupBy("key").agg(_blocks().alias("blocks"))
    speakers = speakers.join(blocks, "key").withColumn("lo", F.pmod(F.xxhash64("cls", F.lit(2)), F.col("blocks")).cast("int"))
    spoken = checkpointed(speakers.select(_shard(n, "key", "lo"), "key", "lo", "cls", "root", "payload").groupBy("shard").applyInArrow(_speak(near), "key long, root long, label long, a long, b long"))
    edges = edges.unionByName(spoken.filter("a IS NOT NULL").select("a", "b"))
    # A tree whose speakers stood in several blocks takes the smallest label.
    label = spoken.filter("key IS NOT NULL").groupBy("key", "root").agg(F.min("label").alias("label"))
    now = checkpointed(rooted.join(label, ["key", "root"]).select("key", "cls", "label"))
    trees = now.groupBy("key", "label").agg(F.count("*").alias("rows"))
    first = trees.groupBy("key").agg(F.max_by("label", F.struct("rows", "label")).alias("largest"), F.count("*").alias("trees"))
    apart = checkpointed(now.join(first.filter("trees > 1").drop("trees"), "key").filter("label != largest").drop("largest"))
    if not apart.limit(1).count():
        return edges
    apart = apart.join(members, ["key", "cls"])
    sizes = apart.groupBy("key").agg(_blocks().alias("asking")).join(size, "key")
    asking = apart.join(sizes, "key").withColumn("lo", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("asking")).cast("int"))
    asking = asking.withColumn("hi", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("left", F.lit(True))
    asked = now.join(sizes, "key").join(members, ["key", "cls"]).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("asking") - 1)))
    asked = asked.withColumn("hi", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("left", F.lit(False))
    rows = asking.unionByName(asked).select(_shard(n, "key", "lo", "hi"), "key", "lo", "hi", "cls", "label", "left", "payload")
    return edges.unionByName(rows.groupBy("shard").applyInArrow(_across(near), _EDGES))
