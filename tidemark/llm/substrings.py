"""Removal of repeated runs of words, by fixed-block anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Words, dealt, partitions, text_slices, window_hash
from tidemark.llm.exchange import ASKED, answered, joined, question, told_bits


def runs(w: Words, block: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of every run of ``block`` words, and which of them are reference blocks.

    Runs are rolling, within texts that have ``window`` words at least; reference blocks are
    those that tile a text from its first word.
    """
    h = window_hash(w.hash, block)
    doc = w.doc[: len(h)]
    starts = np.flatnonzero((w.doc[block - 1 :] == doc) & (np.diff(w.first)[doc] >= window))
    return starts, h[starts], (starts - w.first[w.doc[starts]]) % block == 0


def _slices(table: pa.Table):
    texts = table.column("text").combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    for i, j in text_slices(texts):
        yield i, j, texts.slice(i, j - i)


def _group_runs(table: pa.Table, block: int, window: int):
    """The words of a group's slices with their runs; the distinct keys of all runs, each run's number, and which are reference blocks."""
    found = []
    for _, _, texts in _slices(table):
        w = Words(texts)
        found.append((w, *runs(w, block, window)))
    keys, back, places = np.unique(joined((f[2] for f in found), np.uint64), return_inverse=True, return_counts=True)
    return found, keys, back, places


def _group_windows(table: pa.Table, told: pa.Table, shards: int, block: int, window: int):
    """The group's words, and the windows that may stand elsewhere too: starts, keys and checks for each slice.

    A hit is a reference block that a run at another place meets. It is extended to both
    sides as long as the rolling runs, too, stand at another place; windows within what it
    has then grown to go on.
    """
    found, keys, back, _ = _group_runs(table, block, window)
    again, indexed = told_bits(told, 0, keys, shards, 2)
    again, hit = again[back], (again & indexed)[back]
    at, out = 0, []
    for w, starts, _, _ in found:
        mine = slice(at, at + len(starts))
        at += len(starts)
        n = len(w) - window + 1
        if n <= 0 or not hit[mine].any():
            out.append((w, starts[:0], np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
            continue
        sums = np.zeros((2, len(w) + 1), np.int64)
        sums[0, starts[again[mine]] + 1] = 1
        sums[1, starts[hit[mine]] + 1] = 1
        sums = np.cumsum(sums, axis=1)
        wide = window - block + 1  # runs of a window
        grown = sums[:, wide : wide + n] - sums[:, :n]
        of = np.flatnonzero((grown[0] == wide) & (grown[1] > 0) & (w.doc[window - 1 :] == w.doc[:n]))
        out.append((w, of, window_hash(w.hash, window)[of], window_hash(w.hashed(1), window)[of]) if len(of) else (w, of, np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    return out


def _distinct_windows(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows (key and check), ascending, whether they stand at more than one place, and each window's number."""
    check = check & ~np.uint64(1)
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(new) - 1
    more = np.bincount(number, minlength=int(new.sum())) > 1
    return k[new], c[new] | more.astype(np.uint64), number


def repeated_passages(docs: DataFrame, window: int = 35, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text for every row of ``docs`` (doc_id, text).

    A word is removed if a run of ``window`` words that covers it starts at another place of
    the corpus too, in the same text or another; runs are judged on the input. Repeated rows
    are places of their own. Null and empty texts have no words; kept_sha256 is then the hash
    of nothing. Texts shorter than ``window`` words are kept. Rows without an id, or that share one,
    go by their own text; very long texts are whole.

    1. Non-overlapping reference blocks of ``(window + 1) // 2`` words tile each text, so every
       window holds one; every rolling run of that length probes them.
    2. A hit is extended word by word to both sides as long as the runs still stand at another
       place, which gives the longest stretches that can repeat.
    3. Their windows are compared over the whole corpus by two independent hashes (over 100
       bits together), so that what is removed is exactly the maximal repeats.

    Steps 1 and 3 are packed exchanges: linear in the input, whatever the number of copies, and
    a run or window that many texts share reaches its shard once a group of texts.
    """
    if window < 2:
        raise ValueError("window must be at least 2 words")
    block = (window + 1) // 2
    n = partitions(docs)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(dealt(docs, n, "doc_id", "text").alias("pid"), "doc_id", "text")

    def ask_runs(key, t):
        found, k, back, places = _group_runs(t, block, window)
        vals = np.minimum(places, 2).astype(np.uint8)
        vals[back[joined((f[3] for f in found), bool)]] |= 4
        return question(key[0].as_py(), k, vals, n, short=True)

    def meet(keys, vals):
        k, back = np.unique(keys, return_inverse=True)
        places = np.bincount(back, vals & 3, minlength=len(k))
        indexed = np.bincount(back, vals >> 2, minlength=len(k))
        return np.stack([(places >= 2)[back], (indexed >= 1)[back]])

    def windows_of(t, told):
        found = _group_windows(t, told, n, block, window)
        return found, *_distinct_windows(joined((f[2] for f in found), np.uint64), joined((f[3] for f in found), np.uint64))

    def ask_windows(key, t, told):
        _, k, vals, _ = windows_of(t, told)
        return question(key[0].as_py(), k, vals, n, short=True)

    def same(keys, vals):
        one = np.uint64(1)
        order = np.lexsort((vals, keys))
        k, c = keys[order], vals[order] & ~one
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        group = np.cumsum(new) - 1
        places = np.bincount(group, 1 + (vals[order] & one).astype(np.int64))
        out = np.empty((1, len(k)), bool)
        out[0, order] = places[group] >= 2
        return out

    def remove(key, t, told):
        found, k, _, back = windows_of(t, told)
        hit = told_bits(told, 1, k, n)[0][back]
        n_words, n_removed, digests, kept = [], [], [], []
        at = 0
        for (w, starts, _, _), (i, j, texts) in zip(found, _slices(t)):
            cover = np.zeros(len(w) + 1, np.int64)
            mine = starts[hit[at : at + len(starts)]]
            at += len(starts)
            np.add.at(cover, mine, 1)
            np.add.at(cover, mine + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            lost = np.concatenate([[0], np.cumsum(gone)])
            lost = lost[w.first[1:]] - lost[w.first[:-1]]
            for r, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
                words = (text or b"").split()
                if lost[r]:
                    words = [x for x, y in zip(words, gone[w.first[r] : w.first[r + 1]]) if not y]
                out = b" ".join(words)
                digests.append(hashlib.sha256(out).hexdigest())
                if with_text:
                    kept.append(out.decode())
            n_words.append(np.diff(w.first))
            n_removed.append(lost)
        out = {"doc_id": t.column("doc_id"), "n_words": joined(n_words, np.int64).astype(np.int64), "n_removed": joined(n_removed, np.int64).astype(np.int64), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({"kept_text": pa.array(kept, pa.string())} if with_text else {}))

    groups = rows.groupBy("pid")
    met = answered(groups.applyInArrow(ask_runs, ASKED), meet, np.uint8, 0, bits=2, short=True)
    windows = answered(groups.cogroup(met.groupBy("pid")).applyInArrow(ask_windows, ASKED), same, np.uint64, 1, bits=1, short=True)
    told = met.unionByName(windows)
    return groups.cogroup(told.groupBy("pid")).applyInArrow(remove, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def removal_report(docs: DataFrame, window: int = 35) -> DataFrame:
    return repeated_passages(docs, window, with_text=False)
