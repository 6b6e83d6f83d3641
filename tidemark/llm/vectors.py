"""Near-duplicate vectors over a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, partitions
from tidemark.llm.components import connected_components, in_blocks, segments

#: Vectors of a block; larger shards and components are worked on in pairs of blocks.
BLOCK = 4096
#: Vectors that cluster centres are fitted on, at most, and centres at most: of the table, and of each shard that is split again.
SAMPLE, CENTRES = 8192, 1024
#: Vectors a shard should hold; one with ``SPLIT`` times as many is split again.
SHARD, SPLIT = 1000, 4
#: Vectors that are placed in one task when a shard is split.
PLACED = 50_000


def unit(rows: list) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.array(rows, float)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def robust_prune(x: np.ndarray, degree: int, pool: int, alpha: float) -> np.ndarray:
    """Neighbours of each vector of a shard: of its ``pool`` nearest, nearest first, those that no kept one is nearer to by ``alpha``. -1 fills up."""
    m = len(x)
    pool = min(pool, m - 1)
    out = np.full((m, degree), -1, np.int64)
    if pool < 1:
        return out
    near = np.empty((m, pool), np.int64)
    for i in range(0, m, 512):
        s = x[i : i + 512] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        part = np.argpartition(-s, pool - 1, axis=1)[:, :pool]
        near[i : i + 512] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    for i in range(0, m, 256):
        n = near[i : i + 256]
        v = x[n]
        own = 2 - 2 * np.einsum("qpd,qd->qp", v, x[i : i + 256])
        between = 2 - 2 * v @ v.transpose(0, 2, 1)
        alive = np.ones(n.shape, bool)
        rows = np.arange(len(n))
        for d in range(degree):
            first = alive.argmax(1)
            some = alive[rows, first]
            out[i + rows[some], d] = n[rows[some], first[some]]
            alive &= ~(alpha * between[rows, first] <= own)
            alive[rows, first] = False
    return out


def range_search(x: np.ndarray, links: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) with cosine >= ``radius`` that a greedy search meets.

    Each query starts at the entries and at its own links and always expands the nearest open
    vector. In-range ones are all expanded, however many; the search ends when ``beam`` others
    have been as well.
    """
    m = len(x)
    found_q, found_v = [], []
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        score = np.full((len(q), m + 1), -3.0)  # of what has been seen; the last column takes what is no vector
        open_ = np.zeros((len(q), m + 1), bool)
        rows = np.arange(len(q))

        def see(r, nodes):
            fresh = (nodes < m) & (np.take_along_axis(score[r], nodes, 1) < -2)
            k, v = np.repeat(r, nodes.shape[1])[fresh.ravel()], nodes[fresh]
            for i in range(0, len(k), 1 << 16):
                part = slice(i, i + (1 << 16))
                score[k[part], v[part]] = np.einsum("nd,nd->n", x[v[part]], x[q[k[part]]])
            open_[k, v] = True

        see(rows, np.broadcast_to(entries, (len(q), len(entries))).copy())
        see(rows, links[q])
        score[rows, q], open_[rows, q] = -1.5, False
        left = np.full(len(q), beam)
        live = rows
        while len(live):
            waiting = np.where(open_[live], score[live], -3.0)
            pick = waiting.argmax(1)
            best = waiting[np.arange(len(live)), pick]
            inside = best >= radius
            go = (best > -2) & (inside | (left[live] > 0))
            live, pick, inside = live[go], pick[go], inside[go]
            left[live[~inside]] -= 1
            open_[live, pick] = False
            if len(live):
                see(live, links[pick])
        r, c = np.nonzero(score[:, :m] >= radius)
        found_q.append(q[r])
        found_v.append(c)
    return (np.concatenate(found_q), np.concatenate(found_v)) if found_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _build(degree: int, pool: int, alpha: float):
    """The links of each vector of a shard, or of two of its blocks."""

    def run(t):
        dim, shard, lo, hi, cls = (t.column(c).to_numpy() for c in ("dim", "shard", "lo", "hi", "cls"))
        vectors = t.column("embedding").to_pylist()
        src, dst = [], []
        for rows in segments(hi, lo, shard, dim):
            if len(rows) > 1:
                for r, n in zip(rows, robust_prune(unit([vectors[r] for r in rows]), degree, pool, alpha)):
                    src.append(int(cls[r]))
                    dst.append(cls[rows[n[n >= 0]]].tolist())
        return pa.table({"cls": pa.array(src, pa.int64()), "links": pa.array(dst, pa.list_(pa.int64()))})

    return run


def _table(cls: np.ndarray, links: list) -> np.ndarray:
    """Local numbers of each vector's neighbours, every link in both directions; one past the last fills up."""
    number = {c: i for i, c in enumerate(cls.tolist())}
    near: list[dict] = [{} for _ in number]
    for i, n in enumerate(links):
        for c in n or ():
            j = number.get(c)
            if j is not None and j != i:
                near[i][j] = near[j][i] = None
    out = np.full((len(near) + 1, max(1, max(map(len, near)))), len(near), np.int64)
    for i, n in enumerate(near):
        out[i, : len(n)] = list(n)
    return out


def _search(threshold: float, beam: int):
    """Edges that connect what the search of a shard has found."""

    def run(t):
        dim, shard, lo, hi, cls = (t.column(c).to_numpy() for c in ("dim", "shard", "lo", "hi", "cls"))
        vectors, links = (t.column(c).to_pylist() for c in ("embedding", "links"))
        a, b = [], []
        for rows in segments(hi, lo, shard, dim):
            m = len(rows)
            if m < 2:
                continue
            x = unit([vectors[r] for r in rows])
            mean = x.mean(0)
            medoids = np.unique([int((x @ mean).argmax()), *(int((x @ v).argmax()) for v in x[:: max(1, m // 8)])])
            q, v = range_search(x, _table(cls[rows], [links[r] for r in rows]), medoids, np.arange(m), beam, threshold)
            root = list(range(m))
            for i, j in zip(q.tolist(), v.tolist()):
                while root[i] != i:
                    root[i] = i = root[root[i]]
                while root[j] != j:
                    root[j] = j = root[root[j]]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    a.append(int(cls[rows[i]]))
                    b.append(int(cls[rows[j]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verify(threshold: float):
    """(cls, n): the links of each member of a component, or of two of its blocks, by comparing all its pairs in double precision."""

    def run(t):
        component, lo, hi, cls, copies, own = (t.column(c).to_numpy() for c in ("component", "lo", "hi", "cls", "copies", "own"))
        vectors = t.column("embedding").to_pylist()
        out_cls, out_n = [], []
        for rows in segments(hi, lo, component):
            x, mult, half = unit([vectors[r] for r in rows]), copies[rows], own[rows]
            for i in range(0, len(rows), 512):
                near = x[i : i + 512] @ x.T >= threshold
                near[np.arange(len(near)), np.arange(i, i + len(near))] = False
                if lo[rows[0]] != hi[rows[0]]:  # pairs within a block count there
                    near &= half[i : i + 512][:, None] != half
                out_cls.append(cls[rows[i : i + 512]])
                out_n.append(near @ mult)
        empty = np.zeros(0, np.int64)
        return pa.table({"cls": np.concatenate([empty, *out_cls]), "n": np.concatenate([empty, *out_n])})

    return run


def usable(embedding: str) -> Column:
    """Whether a vector has a direction: not null, empty or zero, and all its components finite numbers."""
    c = F.col(embedding)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return whole & F.exists(c, lambda x: x != 0)


def _nearest(x: np.ndarray, c: np.ndarray, most: int) -> list:
    return np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :most].tolist()


def _split(spread: DataFrame, n: int) -> DataFrame:
    """``spread`` (dim, shard, cls, embedding) with shards that are too large split around centres of their own."""
    count = spread.groupBy("dim", "shard").agg(F.count("*").alias("members")).filter(F.col("members") > SPLIT * SHARD)
    large = checkpointed(count)  # a row a shard
    if not large.limit(1).count():
        return spread
    inside = spread.join(large, ["dim", "shard"])
    rate = F.lit(float(SAMPLE)) / F.col("members")
    sample = inside.filter(F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(1 << 30)) < rate * (1 << 30))

    def fit(t):
        x = unit(t.column("embedding").to_pylist())
        k = max(2, min(CENTRES, len(x), round(t.column("members")[0].as_py() / SHARD)))
        c = centres(x, k) if len(x) > 1 else x
        return pa.table({"dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "members": t.column("members")[:1], "centres": pa.array([c.ravel().tolist()], pa.list_(pa.float64()))})

    schema = "dim int, shard long, members long, centres array<double>"
    fitted = sample.select("dim", "shard", "members", "embedding").groupBy("dim", "shard").applyInArrow(fit, schema)
    parts = F.ceil(F.col("members") / PLACED).cast("int")
    fitted = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    inside = inside.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(5)), parts))

    def place(t, f):
        if not len(t):
            return pa.table({"dim": [], "shard": [], "cls": [], "embedding": []}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("cls", pa.int64()), ("embedding", pa.list_(pa.float64()))]))
        x = unit(t.column("embedding").to_pylist())
        home = np.zeros(len(x), np.int64)
        if len(f):
            home = np.array(_nearest(x, np.array(f.column("centres")[0].as_py()).reshape(-1, x.shape[1]), 1))[:, 0]
        named = (t.column("shard").to_numpy() + 1) * CENTRES + home
        return pa.table({"dim": t.column("dim"), "shard": named, "cls": t.column("cls"), "embedding": t.column("embedding")})

    by = ["dim", "shard", "part"]
    placed = inside.select(*by, "cls", "embedding").groupBy(*by).cogroup(fitted.groupBy(*by)).applyInArrow(place, "dim int, shard long, cls long, embedding array<double>")
    return spread.join(large, ["dim", "shard"], "left_anti").unionByName(placed)


def vector_duplicates(vectors: DataFrame, threshold: float = 0.95, overlap: int = 3, degree: int = 24, pool: int = 64, alpha: float = 1.2, beam: int = 16) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding).

    Links are pairs with cosine >= ``threshold`` in double precision. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths or without an id (their component_id is null and kept true). Equal vectors
    are one class with a count, so copies cost nothing; each repeated row counts as a further vector.

    1. Centres are fitted on at most ``SAMPLE`` vectors; every class goes to its ``overlap``
       nearest shards. Shards that have grown too large are split again in the same way, so
       their size does not grow with the table; above ``BLOCK`` they go in pairs of blocks.
    2. Robust pruning gives each vector up to ``degree`` of its ``pool`` nearest of the shard;
       the lists of all its shards are united.
    3. In each shard every vector searches the flat graph greedily from the medoids and its own
       links, and goes on as long as it meets vectors in range. What it finds is linked.
    4. The links' components are verified: all pairs within a component are compared, in blocks,
       so n_links counts also what no search has met.

    Two linked vectors are missed only if no chain of found links joins them; equally near ones
    are taken in the order of their numbers. ``recall`` audits the result.
    """
    n = max(partitions(vectors, 2.0), 64)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    whole = usable("embedding") & F.col("vec_id").isNotNull()
    good = rows.filter(whole)
    # -0.0 equals 0.0 in a group's key.
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = checkpointed(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("embedding")))
    total = classes.count()
    picked = classes.select("key", "embedding").orderBy("key").limit(SAMPLE).toArrow().column("embedding").to_pylist()
    by_dim: dict[int, list] = {}
    for v in picked:
        by_dim.setdefault(len(v), []).append(v)
    fitted = {}
    for d, vs in by_dim.items():
        x = unit(vs)
        fitted[d] = centres(x, max(1, min(CENTRES, len(x), round(total * len(vs) / len(picked) / SHARD))))

    def place(batches):
        for b in batches:
            vs = b.column("embedding").to_pylist()
            homes = [[0]] * len(vs)
            for d in {len(v) for v in vs} & set(fitted):
                at = [i for i, v in enumerate(vs) if len(v) == d]
                for i, h in zip(at, _nearest(unit([vs[i] for i in at]), fitted[d], overlap)):
                    homes[i] = h
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(homes, pa.list_(pa.int64()))], [*b.schema.names, "homes"])

    placed = classes.select("embedding", "cls").mapInArrow(place, "embedding array<double>, cls long, homes array<long>")
    spread = placed.select(F.size("embedding").alias("dim"), F.explode("homes").alias("shard"), "cls", "embedding")
    spread = checkpointed(_split(checkpointed(spread), n))
    blocks = spread.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shards = in_blocks(spread.join(blocks, ["dim", "shard"]), "shard", "cls", "blocks").drop("blocks")
    task = F.pmod(F.xxhash64("dim", "shard", "lo", "hi"), F.lit(n)).alias("task")
    built = shards.select(task, "dim", "shard", "lo", "hi", "cls", "embedding").groupBy("task").applyInArrow(_build(degree, pool, alpha), "cls long, links array<long>")
    links = checkpointed(built.groupBy("cls").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("links")))
    shards = shards.join(links, "cls", "left").select(task, "dim", "shard", "lo", "hi", "cls", "embedding", "links")
    found = shards.groupBy("task").applyInArrow(_search(threshold, beam), "a long, b long")
    component = checkpointed(connected_components(found).select(F.col("node").alias("cls"), "component"))
    blocks = component.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = in_blocks(component.join(blocks, "component").join(classes.select("cls", "copies", "embedding"), "cls"), "component", "cls", "blocks")
    members = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    task = F.pmod(F.xxhash64("component", "lo", "hi"), F.lit(n)).alias("task")
    counts = members.select(task, "component", "lo", "hi", "own", "cls", "copies", "embedding").groupBy("task").applyInArrow(_verify(threshold), "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    final = classes.select("embedding", "cls", "id", "copies").join(counts, "cls", "left").join(component, "cls", "left")
    final = final.select("embedding", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component"))
    least = final.groupBy("component").agg(F.min("id").alias("component_id"))
    final = checkpointed(final.join(least, "component").select("embedding", "n_links", "component_id"))
    rest = rows.filter(~F.coalesce(whole, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = good.join(final, "embedding").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(vectors: DataFrame, found: DataFrame, threshold: float = 0.95, every: int = 20) -> float:
    """Share of the links of the vectors whose id is divisible by ``every`` that ``found`` counts, by brute force.

    Blocks of those vectors are held against blocks of all vectors of their length; unusable
    vectors count nothing. One row of two sums reaches the driver.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(usable("embedding") & F.col("vec_id").isNotNull())
    rows = checkpointed(rows.withColumn("dim", F.size("embedding")).withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(F.col("vec_id") % every == 0)
    many, few = (max(1, -(-x.count() // size)) for x, size in ((rows, PLACED), (asked, BLOCK)))
    part = lambda k: F.pmod(F.xxhash64("row", F.lit(3)), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asked.withColumn("a", part(few)).withColumn("b", each(many))
    right = rows.withColumn("b", part(many)).withColumn("a", each(few))

    def count(q, t):
        n = np.zeros(len(q), np.int64)
        if len(q) and len(t):
            x, ids = unit(q.column("embedding").to_pylist()), q.column("row").to_numpy()
            for i in range(0, len(t), BLOCK):
                some = t.slice(i, BLOCK)
                near = x @ unit(some.column("embedding").to_pylist()).T >= threshold
                n += (near & (ids[:, None] != some.column("row").to_numpy())).sum(1)
        return pa.table({"row": q.column("row"), "vec_id": q.column("vec_id"), "true": n})

    by = ["dim", "a", "b"]
    true = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(count, "row long, vec_id long, true long").groupBy("vec_id", "row").agg(F.sum("true").alias("true"))
    x = true.groupBy("vec_id").agg(F.max("true").alias("true")).join(found.groupBy("vec_id").agg(F.max("n_links").alias("n_links")), "vec_id").agg(F.sum(F.least("true", "n_links")), F.sum("true")).first()
    return 1.0 if not x[1] else float(x[0] or 0) / float(x[1])
