"""Language by rank-order n-gram profiles (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, in_fold, rows_of, spare

#: Characters looked at together; texts of any length pass through in such pieces.
PIECE = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    import regex

    out = np.zeros(0x110000, bool)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in regex.finditer(r"\p{L}+", everything):
        i, j = (x if x < 0xD800 else x + 0x800 for x in m.span())
        out[i:j] = True
    return out


def grams(text: str, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (1 to ``longest`` letters, one blank around words) and their counts.

    An n-gram is a number: 21 bits for each character, in order.
    """
    keys, counts = [], []
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()
    blank = True  # the text begins at a word boundary
    tail = np.array([32], np.uint64)
    for at in range(0, max(len(codes), 1), PIECE):
        c = codes[at : at + PIECE]
        is_letter = letter[c]
        c = np.where(is_letter, c, 32).astype(np.uint64)
        before = np.concatenate([[blank], ~is_letter[:-1]])
        c = c[is_letter | ~before]
        if len(is_letter):
            blank = not is_letter[-1]
        if at + PIECE >= len(codes) and not blank:
            c = np.append(c, np.uint64(32))
        fresh = len(tail)
        c = np.concatenate([tail, c])
        g = c
        here = [g[fresh:][g[fresh:] != 32]]
        for n in range(2, longest + 1):
            g = (g[:-1] << np.uint64(21)) | c[n - 1 :]
            take = g[max(0, fresh - n + 1) :]
            here.append(take[(take & np.uint64(0x1FFFFF) != 32) | (take >> np.uint64(21) != 32)])
        tail = c[-(longest - 1) :] if longest > 1 else c[:0]
        k, n = np.unique(np.concatenate(here), return_counts=True)
        keys.append(k)
        counts.append(n)
    if len(keys) == 1:
        return keys[0], counts[0]
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` most frequent n-grams, most frequent first; ties by the n-gram's number."""
    if len(keys) > 4 * most:  # only counts at least as large as the last that can matter
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.lexsort((keys, -counts))[:most]]


class Profiles:
    """Ranked n-grams of each learned language."""

    def __init__(self, ranks: dict[str, np.ndarray], size: int):
        self.langs = sorted(ranks)
        self.size = size
        self.sorted, self.place = [], []
        for lang in self.langs:
            order = np.argsort(ranks[lang])
            self.sorted.append(ranks[lang][order])
            self.place.append(order)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and 1 minus its distance as a share of the largest possible; ties go to the first by name."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        k, n = grams(text)
        if not len(k):
            return UNKNOWN, 0.0
        return self.nearest(k, n)

    def nearest(self, k: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        mine = ranked(k, n, self.size)
        here = np.arange(len(mine))
        best, least = 0, None
        for i, (keys, place) in enumerate(zip(self.sorted, self.place)):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            far = np.where(keys[at] == mine, np.abs(place[at] - here), self.size).sum()
            if least is None or far < least:
                best, least = i, far
        return self.langs[best], float(1 - least / (self.size * len(mine)))


def learn_profiles(docs: DataFrame, size: int = 400, keep: int = 4096) -> Iterator[Profiles]:
    """Profiles from the texts of every row outside the held-out fold that has a language.

    N-grams are summed up within each task first. Only ``size`` rows a language reach the
    driver. Beyond ``keep`` languages the profiles come in several parts of about so many, so
    that no process holds more.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(F.col("doc_id"), 4, 2)).select("lang", "text")

    def run(batches):
        totals: dict[str, list] = {}
        held = 0

        def out():
            for lang, parts in totals.items():
                k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            totals.clear()

        for b in rows_of(batches):
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                part = grams(text)
                totals.setdefault(lang, []).append(part)
                held += len(part[0])
            if held > 1 << 21:
                for lang, parts in totals.items():
                    k, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    totals[lang] = [(k, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]
                held = 0
                if sum(len(p[0][0]) for p in totals.values()) > 1 << 22:
                    yield from out()
        yield from out()

    counted = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = checkpointed(counted.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place"))
    parts = -(-top.filter("place = 1").count() // keep) or 1
    for part in range(parts):
        mine = top.filter(F.pmod(F.xxhash64("lang"), F.lit(parts)) == part).toArrow()
        ranks: dict[str, list] = {}
        for lang, gram, at in zip(*(mine.column(c).to_pylist() for c in ("lang", "gram", "place"))):
            ranks.setdefault(lang, []).append((at, gram))
        yield Profiles({k: np.array([g for _, g in sorted(v)], np.uint64) for k, v in ranks.items()}, size)


def with_language(docs: DataFrame, profiles: Iterable[Profiles], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Every column of ``docs`` plus the predicted language and its score under two free names; the best over all parts of the profiles."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{names[0]}` string, `{names[1]}` double"
    columns = docs.columns
    for part, some in enumerate(profiles):

        def run(batches, some=some, part=part):
            for b in rows_of(batches):
                found = [some.predict(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                if part:
                    before = zip(b.column(len(columns)).to_pylist(), b.column(len(columns) + 1).to_pylist())
                    found = [y if x[0] == UNKNOWN or y[0] != UNKNOWN and (-y[1], y[0]) < (-x[1], x[0]) else x for x, y in zip(found, before)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], [*columns, *names])

        docs = docs.mapInArrow(run, schema)
    return docs


def accepted(docs: DataFrame, least: float = 0.1, size: int = 400) -> DataFrame:
    """The rows of ``docs`` in a language the profiles know: not ``und``, and a score of ``least`` or more. All columns stay.

    Null and empty texts, and those without a letter, go; repeated rows fare alike, rows without
    an id are judged like any others (and are learned from). Without a row to learn from, all
    go. Texts are judged whole, however long; ties between languages do not matter here.
    """
    pred, score = spare(docs, "lang_pred", "score")
    profiles = learn_profiles(docs.select("doc_id", "text", "lang"), size)
    return with_language(docs, profiles, (pred, score)).filter((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def language_id(docs: DataFrame, size: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    Profiles hold the ``size`` most frequent letter n-grams (1 to 3) of each language's
    training rows (crc32 fold modulo 4 not 2, lang not null). ``und`` with score 0 where the
    text is null or has no letter, or nothing was learned. Repeated rows each get their own
    equal result; rows without an id count as not held out. Very long texts are counted whole,
    a piece at a time; equally near languages go by name, equally frequent n-grams by number.
    """
    profiles = learn_profiles(docs, size)
    return with_language(docs.select("doc_id", "text"), profiles).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
