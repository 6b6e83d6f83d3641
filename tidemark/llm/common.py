"""Pieces that several corpus operators share: folds, partition sizing, Arrow slicing, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are separated by these six characters and nothing else.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids stay null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether a row is in the held-out fold; rows without an id are not."""
    return F.coalesce(fold(doc_id, modulus) == F.lit(remainder), F.lit(False))


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and tables between stages, which all executors share.

    The session's ``spark.checkpoint.dir``; only where none is set and Spark runs in one
    process (tests) a temporary folder is made, once a session.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written below the shared folder.

    Unlike a checkpoint's, its columns are pruned and its size is known to the optimizer, whose
    estimates would otherwise multiply from round to round.
    """
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of fixed-size rows is broadcast.
SMALL = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table, cut off from its lineage, with a broadcast hint if it has at most ``SMALL`` rows; for rows of a few numbers."""
    df = checkpointed(df)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def partitions(df: DataFrame, mb: float = 8.0) -> int:
    """How many groups to deal ``df`` into, from the size the optimizer knows for its files.

    At least the session's shuffle partitions; one more for every ``mb`` of input. Sources
    without a known size get four times the shuffle partitions.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        return 4 * least
    return max(least, int(size / (mb * 1e6)) + 1)


def spare(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of ``df`` has it (whatever the letters' case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dealt(df: DataFrame, n: int, *cols: str) -> Column:
    """A group number below ``n`` by the hash of ``cols``, so that nulls and repeats spread by the rest."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(n)).cast("int")


def text_slices(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most`` bytes of text, one row at least."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    at = 0
    while at < len(texts):
        to = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        to = min(max(to, at + 1), len(texts))
        yield at, to
        at = to


def rows_of(batches) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds about a quarter of a megabyte of ``text``; freed memory goes back after each batch."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for i, j in text_slices(batch.column(at)):
            yield batch.slice(i, j - i)
        del batch
        pa.default_memory_pool().release_unused()


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


_ODD = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
class Words:
    """The words of a slice of texts, hashed without a Python loop.

    ``hash`` holds one 64-bit hash a word, ``doc`` the row in the slice, ``start`` and
    ``end`` its bytes in ``data``; ``first[i] : first[i + 1]`` are the words of row i.
    Nulls have no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        ends = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        base, top = (int(ends[0]), int(ends[-1])) if n else (0, 0)
        data = np.frombuffer(texts.buffers()[2], np.uint8, top) if top else np.zeros(0, np.uint8)
        data = data[base:top]
        ends = ends - base
        if lower:
            data = _LOWER[data]
        self.data = data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~SPACES[data]
        edge = inside[1:] != inside[:-1]
        cut = ends[1:-1]  # a word also ends where its text does
        cut = cut[(cut > 0) & (cut < len(data))]
        cut = cut[inside[cut] & inside[cut + 1]]
        at = np.flatnonzero(edge)
        if len(cut):
            at = np.sort(np.concatenate([at, np.repeat(np.unique(cut), 2)]))
        self.start, self.end = at[0::2], at[1::2]
        self.doc = (np.searchsorted(ends, self.start, "right") - 1).astype(np.int64)
        self.first = np.searchsorted(self.start, ends)
        self.hash = self.hashed(0)

    def hashed(self, salt: int) -> np.ndarray:
        """64-bit hashes of the words, independent for each ``salt``.

        Eight bytes at a time go through a finalizer keyed by their place and the salt; a word
        is the mixed sum of its parts and its length. No sum of powers is involved, so there is
        no family of strings that collides whatever the key; words of up to eight bytes collide
        with none of their length.
        """
        size = self.end - self.start
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, np.uint64, padded, 0, (1,))
        seed = mix64(np.array([2 * salt + 1], np.uint64))[0]

        def part(at, left, place):
            x = eight[at]
            few = np.minimum(left, 8).astype(np.uint64)
            x &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - few * np.uint64(8))
            return mix64(x ^ place)

        h = part(self.start, size, mix64(np.array([seed], np.uint64))[0])
        long_ = np.flatnonzero(size > 8)
        if len(long_):
            parts = (size[long_] - 1) >> 3  # those after the first
            cut = np.concatenate([[0], np.cumsum(parts)])
            k = np.arange(1, cut[-1] + 1) - np.repeat(cut[:-1], parts)
            of = np.repeat(long_, parts)
            more = part(self.start[of] + 8 * k, size[of] - 8 * k, mix64(k.astype(np.uint64) * _ODD + seed))
            h[long_] += np.add.reduceat(more, cut[:-1])
        return mix64(h ^ mix64(size.astype(np.uint64) * _MIX[0] + seed))

    def __len__(self) -> int:
        return len(self.hash)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _ODD + b)


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words; ``out[i]`` starts at word i (document ends are the caller's).

    Neighbouring runs are paired through the finalizer, doubling their length, as in a hash tree.
    """
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level, step, out, done = words, 1, None, 0
    while True:
        if size & step:
            out = level[:n] if out is None else _pair(out, level[done : done + n])
            done += step
        if done == size:
            return mix64(out + np.uint64(size))
        level = _pair(level[:-step], level[step:])
        step *= 2
