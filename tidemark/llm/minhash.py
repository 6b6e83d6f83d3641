"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, Words, checkpointed, mix64, partitions, rows_of, spare, window_hash
from tidemark.llm.components import connected_components, grouped_links
from tidemark.llm.exchange import unpacked


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, row after row, and where each row's begin.

    A-Z are lower-cased; a text with fewer words has its whole sequence as one shingle.
    """
    w = Words(texts, lower=True)
    n = len(w.first) - 1
    h = window_hash(w.hash, size)
    doc = w.doc[: len(h)]
    whole = w.doc[size - 1 :] == doc
    h, doc = h[whole], doc[whole]
    count = np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for m in range(1, size):
            of = few[count[few] == m]
            if len(of):
                at = w.first[of]
                x = np.full(len(of), m, np.uint64)
                for i in range(m):
                    x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + i])
                short[count[few] == m] = x
        h, doc = np.concatenate([h, short]), np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


class CirculantMinHash:
    """Signatures from two permutations of the 32-bit circle.

    The first scatters shingles over the circle; coordinate k is the smallest image, under the
    second, of their places shifted by k steps. Both are bijections (odd multiplications and
    xor-shifts), so no table is kept.
    """

    def __init__(self, bands: int = 32, rows: int = 6, seed: int = 1):
        self.bands, self.rows = bands, rows
        self.seed = mix64(np.array([seed], np.uint64))[0]

    def scatter(self, h: np.ndarray) -> np.ndarray:
        return (mix64(h ^ self.seed) >> np.uint64(32)).astype(np.uint32)

    def signatures(self, h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """A row of bands * rows coordinates for each set; empty sets are not allowed."""
        n, k = len(cuts) - 1, self.bands * self.rows
        out = np.empty((n, k), np.uint32)
        place = self.scatter(h)
        i = 0
        while i < n:  # a few sets at a time stay in the processor's cache
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + 32768, "right")) - 1)
            x = place[cuts[i] : cuts[j]]
            at = cuts[i:j] - cuts[i]
            y, t = np.empty_like(x), np.empty_like(x)
            for c in range(k):
                np.add(x, np.uint32(c * 0x9E3779B1 & 0xFFFFFFFF), out=y)
                np.multiply(y, np.uint32(0x85EBCA6B), out=y)
                np.right_shift(y, np.uint32(15), out=t)
                np.bitwise_xor(y, t, out=y)
                np.multiply(y, np.uint32(0xC2B2AE35), out=y)
                out[i:j, c] = np.minimum.reduceat(y, at)
            i = j
        return out

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        n = len(signatures)
        parts = signatures.reshape(n, self.bands, self.rows).astype(np.uint64)
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), (n, self.bands)).copy()
        for r in range(self.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
        return key


def exact_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Like ``shingle_sets``, with numbers in place of hashes: two shingles of these texts have one number only if their words are the same.

    Words are numbered by a dictionary of their bytes, runs by the pair of their halves' numbers.
    """
    import pandas as pd  # here, as it takes much of the memory of workers that only sketch

    w = Words(texts, lower=True)
    count = np.diff(w.first)
    letters = np.ascontiguousarray(w.data[~SPACES[w.data]])
    offsets = np.concatenate([[0], np.cumsum(w.end - w.start)]).astype(np.int64)
    spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    word = spelled.dictionary_encode().indices.to_numpy().astype(np.int64)

    def pair(a, b):
        return pd.factorize(a * (int(b.max()) + 1 if len(b) else 1) + b)[0]

    n = len(word) - size + 1
    if n > 0:
        level, step, run, done = word, 1, None, 0
        while True:
            if size & step:
                run = level[:n] if run is None else pair(run, level[done : done + n])
                done += step
            if done == size:
                break
            level = pair(level[:-step], level[step:])
            step *= 2
        doc = w.doc[:n]
        whole = w.doc[size - 1 :] == doc
        run, doc = run[whole], doc[whole]
    else:
        run, doc = word[:0], w.doc[:0]
    few = np.flatnonzero((count > 0) & (count < size))  # shorter texts differ, else they were one class
    run, doc = np.concatenate([run, len(word) + few]), np.concatenate([doc, few])
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    run, doc = run[new], doc[new]
    return run, np.searchsorted(doc, np.arange(len(count) + 1))


def sketched(docs: DataFrame, size: int, method: CirculantMinHash) -> DataFrame:
    """doc_id, text_key (a hash of the text), n_shingles, the 128-bit digest (k1, k2) of the set, band keys and a sketch of one byte a coordinate."""

    def run(batches):
        for b in rows_of(batches):
            h, cuts = shingle_sets(b.column("text"), size)
            n = np.diff(cuts)
            some = np.flatnonzero(n)
            at = cuts[:-1][some]
            k = [np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)]
            bands, sketch = [None] * len(n), [None] * len(n)
            if len(some):
                for x, salt in zip(k, (0xA5A5, 0x5A5A5A)):
                    x[some] = mix64(np.add.reduceat(mix64(h ^ np.uint64(salt)), at))
                s = method.signatures(h, np.append(at, len(h)))
                keys = method.band_keys(s).astype(np.int64)
                low = (s & np.uint32(255)).astype(np.uint8)
                for r, i in enumerate(some.tolist()):
                    bands[i], sketch[i] = keys[r], low[r].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(n.astype(np.int64)), pa.array(k[0].astype(np.int64)), pa.array(k[1].astype(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")


def _alike(least: float):
    """Sketches that agree in ``least`` of their coordinates."""

    def of(t, rows):
        raw, cuts = unpacked(t.column("payload").take(pa.array(rows)), np.uint8)
        width = int(cuts[1])
        raw = raw.reshape(-1, width)
        return lambda i, others: (raw[others] == raw[i]).sum(1) >= least * width

    return of


def _similar(percent: int, size: int):
    """Texts with 100 * |intersection| >= percent * |union| of their shingle sets."""

    def of(t, rows):
        texts = t.column("payload").take(pa.array(rows)).combine_chunks()
        token, at = exact_sets(pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts, size)
        many = np.diff(at)
        mark = np.zeros(int(token.max(initial=0)) + 1, bool)

        def near(i, others):
            mine = token[at[i] : at[i + 1]]
            mark[mine] = True
            fits = (100 * many[others] >= percent * many[i]) & (100 * many[i] >= percent * many[others])
            both = np.zeros(len(others), np.int64)
            for k in np.flatnonzero(fits).tolist():
                j = others[k]
                both[k] = np.count_nonzero(mark[token[at[j] : at[j + 1]]])
            mark[mine] = False
            return fits & (100 * both >= percent * (many[i] + many[others] - both))

        return near

    return of


def _repeated(rows: DataFrame) -> bool:
    """Whether a text stands twice with one id."""
    return rows.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count() > 0


def _components(docs: DataFrame, percent: int, size: int, bands: int, rows: int, slack: float) -> DataFrame:
    """doc_id, text_key, n_shingles, component (a number of its own; null without shingles), component_id for every row; see ``near_duplicates``."""
    method = CirculantMinHash(bands, rows)
    n = partitions(docs)
    sig = checkpointed(sketched(docs, size, method))
    named = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("n_shingles").alias("weight"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = checkpointed(classes.select("k1", "k2", F.col("one.doc_id").alias("doc_id"), F.col("one.text_key").alias("text_key"), "weight", "bands", "sketch").withColumn("cls", F.monotonically_increasing_id()))
    banded = classes.select("cls", F.explode("bands").alias("key"))
    buckets = (
        banded.groupBy("key")
        .agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"))
        .filter("members > 1")
        .groupBy("members", "x", "y")
        .agg(F.min("key").alias("key"))
        .select("key")
    )
    met = banded.join(buckets, "key").join(classes.select("cls", F.lit(0).cast("long").alias("weight"), F.col("sketch").alias("payload")), "cls")
    candidate = grouped_links(met, _alike(percent / 100 - slack), n)
    cluster = checkpointed(connected_components(candidate).select(F.col("node").alias("cls"), F.col("component").alias("key")))
    wanted = classes.select("doc_id", "text_key", "cls", "weight").join(cluster, "cls")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").alias("payload"))
    texts = texts.join(wanted, ["doc_id", "text_key"]).select("key", "cls", "weight", "payload")
    if _repeated(named):
        texts = texts.dropDuplicates(["cls"])
    component = connected_components(grouped_links(texts, _similar(percent, size), n)).select(F.col("node").alias("cls"), "component")
    # A component is named by the smallest id of its classes.
    labels = classes.select("k1", "k2", "cls", "doc_id").join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = labels.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = checkpointed(labels.join(least, "component").select("k1", "k2", "component", "component_id"))
    # Texts without shingles match no class; their keys spread them.
    spread = sig.select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("k1")).otherwise(F.xxhash64("doc_id")).alias("k1"), "k2")
    found = spread.join(final, ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return found.select("doc_id", "text_key", "n_shingles", "component", own.alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = 5, bands: int = 32, rows: int = 6, slack: float = 0.15) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of ``size``
    lower-cased word shingles (fewer words: the whole sequence); component_id is the smallest
    doc_id reachable and kept marks it. Null and empty texts have no shingles and are linked
    with nothing. Rows that repeat an id are compared like any others. Rows without an id
    are linked with nothing: component_id is null, kept true. Very long texts are whole; one
    text is held by one task at a time.

    1. Equal sets become one class, whatever their number.
    2. Circulant signatures in ``bands`` x ``rows``: at the threshold a pair shares no band with
       probability (1 - t**rows)**bands, 3e-7 for 0.85.
    3. Each bucket (buckets of equal members once) connects the classes whose sketches agree in
       threshold - ``slack`` of the coordinates (six standard deviations); the components are
       the clusters.
    4. Each class sends its text to its cluster once; links are confirmed on the words of the
       full sets, and their components are the result.

    Pairs are never listed (``components.grouped_links``): a group of copies costs its members.
    """
    found = _components(docs, percent, size, bands, rows, slack).drop("text_key", "component")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = 32, rows: int = 5, slack: float = 0.15) -> DataFrame:
    """The rows of ``docs`` that near-duplicate groups keep: the smallest id of each, once. All columns stay.

    Of several texts of a group with that id, one stays; a text that shares its id with a
    dropped one, but no group, stays too. Repeated rows (id and text) of a kept text stay once,
    texts without a word included. Rows without an id all stay.
    """
    (mark, id_, odd) = spare(docs, "text_key", "text_key_id", "text_key_row")
    found = checkpointed(_components(docs.select("doc_id", "text"), percent, size, bands, rows, slack).filter("doc_id IS NOT NULL"))
    some = found.filter("n_shingles > 0")
    first = some.filter("doc_id = component_id").groupBy("component").agg(F.min("text_key").alias("first_key"))
    gone = some.join(first, "component").filter("doc_id != component_id OR text_key != first_key").select(F.col("doc_id").alias(id_), F.col("text_key").alias(mark)).distinct()
    left = docs.withColumn(odd, F.xxhash64("text"))
    left = left.join(gone, (F.col("doc_id") == F.col(id_)) & (F.col(odd) == F.col(mark)), "left_anti")
    if _repeated(found):  # rows without an id are told apart by their place
        left = left.withColumn(mark, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())).dropDuplicates(["doc_id", odd, mark])
    return left.select(*docs.columns)
