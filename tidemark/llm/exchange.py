"""Corpus-wide look-ups as two packed shuffles.

Documents are dealt into groups by a hash. A group sends its distinct 64-bit keys, with
what it counted for each, to the shard of the key, a blob for each (group, shard); the
shard sums up and answers in the order of the question, so an answer can be as short as a
bit a key. A key that every document holds reaches its shard once per group, never once
per document, and no shard or group needs more memory than its share of the keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A question: shard, asking group, keys (uint64) and one value array, as bytes.
ASKED = "shard int, pid int, keys binary, vals binary"
#: An answer, in the order of the question.
TOLD = "pid int, shard int, tag int, vals binary"


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts ascending keys by shard, and where each shard begins in it."""
    shard = keys % np.uint64(shards)
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.uint64)  # the former are sorted by radix
    order = np.argsort(shard, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(shard.astype(np.int64), minlength=shards))]).astype(np.int64)


def short_keys(keys: np.ndarray, shards: int, size: int = 5) -> np.ndarray:
    """The low ``size`` bytes of keys divided by the number of shards, as rows of bytes: with its shard, a key keeps 8 * size + log2(shards) bits."""
    return np.ascontiguousarray((keys // np.uint64(shards)).view(np.uint8).reshape(-1, 8)[:, :size])


def long_keys(raw: np.ndarray, size: int = 5) -> np.ndarray:
    """Short keys of one shard as numbers."""
    out = np.zeros((len(raw) // size, 8), np.uint8)
    out[:, :size] = raw.reshape(-1, size)
    return out.view(np.uint64).ravel()


def blobs(x: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary array whose i-th value is ``x[cuts[i]:cuts[i + 1]]``."""
    x = np.ascontiguousarray(x)
    offsets = (cuts * x.dtype.itemsize).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(x.view(np.uint8))]).cast(pa.binary())


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a blob column as one array, and where each row's begin."""
    parts = column.to_pylist()
    size = np.dtype(dtype).itemsize
    cuts = np.concatenate([[0], np.cumsum([len(p) // size for p in parts], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(parts), dtype), cuts


def question(pid: int, keys: np.ndarray, vals: np.ndarray, shards: int, short: bool = False) -> pa.Table:
    """Rows of ``ASKED`` for ascending keys; ``short`` sends five bytes a key."""
    order, cuts = by_shard(keys, shards)
    there = np.flatnonzero(np.diff(cuts))
    cut = np.append(cuts[there], cuts[-1])
    sent = keys[order]
    sent = short_keys(sent, shards).view("V5").ravel() if short else sent
    return pa.table({"shard": pa.array(there, pa.int32()), "pid": pa.array(np.full(len(there), pid), pa.int32()), "keys": blobs(sent, cut), "vals": blobs(vals[order], cut)})


def answered(asked: DataFrame, answer: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype, tag: int, bits: int = 0, short: bool = False) -> DataFrame:
    """Rows of ``TOLD``. ``answer`` gets a shard's keys and values and returns a value for each key asked, or ``bits`` rows of booleans."""

    def run(t):
        if short:
            raw, cuts = unpacked(t.column("keys"), np.uint8)
            keys, cuts = long_keys(raw), cuts // 5
        else:
            keys, cuts = unpacked(t.column("keys"), np.uint64)
        vals, _ = unpacked(t.column("vals"), dtype)
        out = answer(keys, vals)
        pid = t.column("pid").combine_chunks()
        shard = t.column("shard").combine_chunks()
        if bits:
            packed = pa.array([np.packbits(out[:, i:j], axis=1).tobytes() for i, j in zip(cuts[:-1], cuts[1:])], pa.binary())
        else:
            packed = blobs(out, cuts)
        return pa.table({"pid": pid, "shard": shard, "tag": pa.array(np.full(len(pid), tag), pa.int32()), "vals": packed})

    return asked.groupBy("shard").applyInArrow(run, TOLD)


def told_bits(told: pa.Table, tag: int, keys: np.ndarray, shards: int, bits: int = 1) -> np.ndarray:
    """The ``bits`` rows of booleans that were answered for the ascending keys a group asked."""
    out = np.zeros((bits, len(keys)), bool)
    if not len(keys):
        return out
    order, cuts = by_shard(keys, shards)
    for shard, t, vals in zip(*(told.column(c).to_pylist() for c in ("shard", "tag", "vals"))):
        if t == tag:
            i, j = cuts[shard], cuts[shard + 1]
            out[:, order[i:j]] = np.unpackbits(np.frombuffer(vals, np.uint8).reshape(bits, -1), axis=1, count=j - i)
    return out


def told_values(told: pa.Table, tag: int, keys: np.ndarray, shards: int, dtype) -> np.ndarray:
    """The value that was answered for each of the ascending keys a group asked."""
    out = np.zeros(len(keys), dtype)
    if not len(keys):
        return out
    order, cuts = by_shard(keys, shards)
    for shard, t, vals in zip(*(told.column(c).to_pylist() for c in ("shard", "tag", "vals"))):
        if t == tag:
            out[order[cuts[shard] : cuts[shard + 1]]] = np.frombuffer(vals, dtype)
    return out


def joined(parts: Iterable[np.ndarray], dtype) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
