"""A quality score learned from preference pairs (Bradley-Terry) over whole-text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Words, in_fold, rows_of, window_hash

_KINDS = ("upper", "lower", "digit", "blank", "line", "stop", "bang", "bar", "symbol", "mark", "other")
FEATURES = (
    *(f"share_{k}" for k in _KINDS),
    "log_words",
    "word_bytes",
    "distinct_words",
    "distinct_threes",
    "distinct_eights",
    "words_in_capitals",
    "words_ending_in_symbol",
    "words_of_one_byte",
    "longest_word",
    "log_bytes",
)
_KIND = np.full(256, 10, np.uint8)
for _i, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t", b"\n\r", b".,;:", b"!?", b"|", b"*#$%&@^~=+_<>\\/", b"'\"()-[]{}`")):
    _KIND[list(_chars)] = _i


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` a text; null and empty texts give zeros."""
    n = len(texts)
    w = Words(texts)
    raw = texts.cast(pa.large_binary())
    size = np.diff(np.frombuffer(raw.buffers()[1], np.int64, n + 1, raw.offset * 8)).astype(float)
    doc_of_byte = np.repeat(np.arange(n), size.astype(np.int64))
    kind = _KIND[w.data]
    k = len(_KINDS)
    share = np.bincount(doc_of_byte * k + kind, minlength=n * k)[: n * k].reshape(n, k) / np.maximum(size, 1)[:, None]
    words = np.bincount(w.doc, minlength=n).astype(float)
    some = np.maximum(words, 1)
    length = w.end - w.start
    out = np.zeros((n, len(FEATURES)))
    out[:, :k] = share
    upper = np.concatenate([[0], np.cumsum(kind == 0)])
    lower = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 10))])
    caps = (upper[w.end] - upper[w.start] >= 2) & (lower[w.end] == lower[w.start])
    last = kind[w.end - 1] if len(w) else kind[:0]
    mean = lambda x: np.bincount(w.doc, x, minlength=n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, w.doc, length)
    cols = [np.log1p(words), mean(length), _distinct(w, 1, n), _distinct(w, 3, n), _distinct(w, 8, n), mean(caps), mean((last == 6) | (last == 8)), mean(length == 1), np.log1p(longest), np.log1p(size)]
    out[:, k:] = np.stack(cols, 1)
    return out


def _distinct(w: Words, size: int, n: int) -> np.ndarray:
    """Distinct share of the runs of ``size`` words of each row; 1 where there are none."""
    h = w.hash if size == 1 else window_hash(w.hash, size)
    doc = w.doc[: len(h)]
    if size > 1:
        keep = w.doc[size - 1 :] == doc
        h, doc = h[keep], doc[keep]
    total = np.bincount(doc, minlength=n)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.where(total > 0, np.bincount(doc[new], minlength=n) / np.maximum(total, 1), 1.0)


@dataclass(frozen=True)
class QualityModel:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    sharpness: float
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the cut among the training scores lands on ``threshold``."""
        z = (self.raw(x) - self.cut) * self.sharpness + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, pairs: int = 200_000, decay: float = 1e-3, steps: int = 30, seed: int = 7) -> np.ndarray:
    """Weights that maximise the likelihood of "better beats worse" over sampled pairs (Newton steps on feature differences)."""
    rng = np.random.default_rng(seed)
    d = better[rng.integers(0, len(better), pairs)] - worse[rng.integers(0, len(worse), pairs)]
    weight = np.zeros(d.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ weight, -30, 30)))
        gradient = d.T @ p / pairs - decay * weight
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + decay * np.eye(len(weight))
        step = np.linalg.solve(curve, gradient)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    return weight


def fit(x: np.ndarray, y: np.ndarray, threshold: float = 0.7) -> QualityModel:
    """A model from statistics and 0/1 labels. With one class only, or no rows, every score is the same: 1 above the threshold if labels are 1 or absent, else below."""
    n = x.shape[1]
    if not (y == 1).any() or not (y == 0).any():
        return QualityModel(np.zeros(n), np.ones(n), np.zeros(n), -1.0 if not (y == 0).any() else 1.0, 1.0, threshold)
    center, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = np.clip((x - center) / scale, -8, 8)
    weight = bradley_terry(z[y == 1], z[y == 0])
    s = z @ weight
    # The score quantile that leaves as many rows below as have label 0, moved into the gap there.
    at = np.sort(s)
    k = int((y == 0).sum())
    cut = float((at[k - 1] + at[min(k, len(at) - 1)]) / 2)
    return QualityModel(center, scale, weight, cut, 1.0, threshold)


def labelled_statistics(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``sample`` labelled documents outside the held-out fold, chosen by the hash of their id.

    The bound holds for the rows that are broadcast and collected; ids whose labels disagree
    or are neither 0 nor 1 are left out, and of repeated ids one document is taken.
    """
    chosen = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .filter("quality = most")
        .select("doc_id", "quality")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in rows_of(batches):
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>").orderBy("doc_id").limit(sample).toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x, np.array(found.column("quality").to_pylist(), float)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    The model is fitted on at most ``sample`` labelled rows (a bound that input size does not
    change) whose crc32 fold modulo 4 is not 2; everything else covers all rows. Null and
    empty texts have the statistics of no text and get that score. Repeated rows each get
    their own equal result; rows without an id count as not held out. Very long texts are
    counted whole; equal scores are predicted alike.
    """
    model = fit(*labelled_statistics(docs, labels, sample), threshold)

    def run(batches):
        for b in rows_of(batches):
            s = model.score(statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
