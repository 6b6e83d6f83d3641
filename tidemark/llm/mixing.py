"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import SPACE, checkpointed

#: Sources whose totals come to the driver; of more, sums of powers do.
SOURCES = 100_000
#: Sub-blocks of a permutation: a document's place is known from its sub-block, but for one in so many.
PARTS = 1024
STEPS = 40


@dataclass(frozen=True)
class Mix:
    """An exponent, the sum of the powers it normalises by, and the tokens of the whole mix."""

    exponent: float
    whole: float
    budget: int


def solve(tokens: dict, entropy: float, repeats: float, budget: int | None = None, steps: int = STEPS) -> Mix:
    """``bisected`` over the tokens of sources at hand."""
    sizes = sorted(n for n in tokens.values() if n > 0)
    total = sum(sizes)
    shares = [n / total for n in sizes]

    def moments(a: float) -> tuple[float, float]:
        power = [p**a for p in shares]
        return sum(power), sum(x * math.log(p) for x, p in zip(power, shares))

    return bisected(len(sizes), sizes[0] if sizes else 0, sizes[-1] if sizes else 0, total, moments, entropy, repeats, budget, steps)


def bisected(many: int, least: int, most: int, total: int, moments: Callable[[float], tuple[float, float]], entropy: float, repeats: float, budget: int | None = None, steps: int = STEPS) -> Mix:
    """Bisect the exponent of the sources' token shares.

    ``many`` sources have ``least`` to ``most`` tokens, ``total`` together; ``moments(a)`` are the
    sums of p**a and of p**a * ln(p) over their shares p. The exponent is the largest in [0, 1]
    (1: the sources' own shares, 0: all equal) whose weights have at least ``entropy`` times the
    largest possible entropy. If one source would then be repeated more than ``repeats`` times as
    often as the one repeated least, the smallest exponent that keeps to that limit is taken
    instead: the limit wins. Without a ``budget`` the mix is the smallest that holds every
    document of every source.
    """
    if not many:
        return Mix(1.0, 1.0, 0)
    largest, smallest = most / total, least / total

    def level(a: float) -> float:
        whole, logs = moments(a)
        return math.log(whole) - a * logs / whole

    def spread(a: float) -> float:
        """Times that the smallest source is repeated for once of the largest."""
        return (largest / smallest) ** (1 - a)

    def bisect(holds, low: float, high: float) -> float:
        """The point of [low, high] nearest to ``high`` up to which ``holds`` stays true."""
        if holds(high):
            return high
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    a = bisect(lambda x: level(x) >= entropy * math.log(many), 0.0, 1.0)
    if spread(a) > repeats:
        a = bisect(lambda x: spread(x) <= repeats, 1.0, a)
    whole = moments(a)[0]
    if budget is None:  # one token a source more, against rounding
        budget = math.ceil(most * whole / largest**a) + many
    return Mix(a, whole, budget)


def _solved(totals: DataFrame, entropy: float, repeats: float, budget: int | None) -> tuple[Mix, int, bool]:
    """The mix for a table of totals (source_, n), the tokens of all sources, and whether the sources are few."""
    x = totals.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("n") > 0, 1)).alias("many"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("least"), F.max("n").alias("most"), F.sum("n").alias("total")).first()
    total = int(x.total or 0)
    if x.rows <= SOURCES:
        return solve({r.source_: r.n for r in totals.collect()}, entropy, repeats, budget), total, True
    share = F.col("n") / F.lit(float(max(total, 1)))

    def moments(a: float) -> tuple[float, float]:
        power = F.pow(share, F.lit(a))
        return tuple(totals.filter("n > 0").agg(F.sum(power), F.sum(power * F.log(share))).first())

    return bisected(x.many or 0, x.least or 0, x.most or 0, total, moments, entropy, repeats, budget), total, False


def word_count(text: Column) -> Column:
    """Words between the six white-space characters; 0 for null."""
    return F.coalesce(F.size(F.array_remove(F.split(text, f"[{SPACE}]+"), "")), F.lit(0)).cast("long")


def placed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` plus n_tokens, source_ and place_, its place in the permutation that blocks of its source follow.

    A null source counts as the source "". The place is 40 bits of the md5 of seed and id;
    rows with one id share a place, so they are in a block together or not at all.
    """
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumns(
        {
            "n_tokens": word_count(F.col("text")),
            "source_": F.coalesce(F.col("source"), F.lit("")),
            "place_": F.conv(F.substring(code, 1, 10), 16, 10).cast("long"),
        }
    )


def mixed(docs: DataFrame, entropy: float = 0.97, repeats: float = 4.0, budget: int | None = None, seed: int = 17) -> DataFrame:
    """Every column of ``docs`` (doc_id, text, source among them) plus n_tokens, weight and n_copies, which replace any of those names.

    Source shares of tokens (words) are raised to an exponent bisected for ``entropy`` and
    ``repeats`` (see ``solve``) and normalised; weight is the source's. Each source's budget is
    laid out as blocks, each a permutation of its documents, the last cut where the budget
    ends: n_copies says in how many blocks the document stands. Without a ``budget`` no
    document is left out. Documents without a word stand in the whole blocks; a source without
    a word has weight 0 and its documents one copy.

    Null ids, sources and texts, and rows that share an id, are allowed: rows with one id and
    source share a place, so they are in a block together or not at all; rows of different
    sources follow their own. Very long texts are counted whole.

    Sums are made before they are shuffled. The totals of up to ``SOURCES`` sources reach the
    driver and are broadcast; of more, only two sums for each step of the bisection do, and
    joins are by shuffle. The cut of a source's last block is found from sums over ``PARTS`` sub-ranges of the
    permutation, and only the one sub-range that holds the cut is ordered.
    """
    rows = placed(docs.select(F.struct("*").alias("row_"), "doc_id", "text", "source"), seed)  # no name of docs can clash
    part = F.shiftright("place_", 30).cast("int")  # 1024 sub-ranges of 2**40 places
    sums = checkpointed(rows.groupBy("source_", part.alias("part_")).agg(F.sum("n_tokens").alias("n")))
    totals = checkpointed(sums.groupBy("source_").agg(F.sum("n").alias("n")))
    mix, total, few = _solved(totals, entropy, repeats, budget)
    hint = F.broadcast if few else lambda df: df  # one row a source
    some = F.col("n") > 0
    weight = F.when(some, F.pow(F.col("n") / F.lit(float(max(total, 1))), F.lit(mix.exponent)) / F.lit(mix.whole)).otherwise(0.0)
    share = F.floor(F.col("weight") * F.lit(float(mix.budget))).cast("long")
    plan = totals.withColumn("weight", weight)
    plan = plan.select("source_", "weight", F.when(some, F.floor(share / F.col("n"))).otherwise(1).cast("long").alias("blocks_"), F.when(some, share % F.col("n")).otherwise(0).alias("rest_"))
    # Where each source's last block ends: in which sub-range, and how many tokens it takes of that.
    before = F.sum("n").over(Window.partitionBy("source_").orderBy("part_")) - F.col("n")
    cut = (
        sums.withColumn("before", before)
        .join(hint(plan), "source_")
        .filter("before <= rest_ AND rest_ < before + n AND rest_ > 0")
        .select("source_", F.col("part_").alias("cut_"), (F.col("rest_") - F.col("before")).alias("left_"))
    )
    plan = plan.join(cut, "source_", "left")
    rows = rows.join(hint(plan), "source_").withColumn("part_", part)  # one row a source
    edge = rows.filter("part_ = cut_").select("source_", "place_", "n_tokens", "left_")
    edge = edge.groupBy("source_", "place_").agg(F.sum("n_tokens").alias("n"), F.first("left_").alias("left_"))
    upto = F.sum("n").over(Window.partitionBy("source_").orderBy("place_"))
    ends = edge.withColumn("upto", upto).filter("upto <= left_").groupBy("source_").agg(F.max("place_").alias("end_"))
    rows = rows.join(hint(ends), "source_", "left")
    again = F.when(F.col("part_") < F.col("cut_"), 1).when((F.col("part_") == F.col("cut_")) & (F.col("place_") <= F.col("end_")), 1).otherwise(0)
    made = {"n_tokens": F.col("n_tokens"), "weight": F.col("weight"), "n_copies": (F.col("blocks_") + again).cast("long")}
    return rows.select(*[F.col("row_")[c].alias(c) for c in docs.columns if c not in made], *[x.alias(c) for c, x in made.items()])


def realised(mix: DataFrame, seed: int = 17) -> DataFrame:
    """One row for every copy, with its ``block`` and its ``place``: ordered by both, each block of a source is a permutation of its own."""
    rows = mix.filter("n_copies > 0").withColumn("block", F.explode(F.sequence(F.lit(1), F.col("n_copies").cast("int"))))
    return rows.withColumn("place", F.xxhash64(F.lit(seed), F.col("block"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, n_tokens, weight, n_copies for every row of ``docs``."""
    return mixed(docs.select("doc_id", "text", "source"), **how).select("doc_id", "source", "n_tokens", F.round("weight", 9).alias("weight"), "n_copies")


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, coalesce(source, '') AS src, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS place
  FROM documents
), sizes AS (SELECT src, sum(n_tokens)::BIGINT AS n FROM docs GROUP BY src
), many AS (SELECT sum(n)::DOUBLE AS total, count(*) AS k, list(n ORDER BY n) AS ns FROM sizes WHERE n > 0
), shares AS (SELECT total, k, list_transform(ns, lambda x: x / total) AS ps, ns FROM many
), first AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, ps, k FROM shares
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, ps, k
  FROM (SELECT *, (low + high) / 2 AS mid,
      ln(list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2)))) - (low + high) / 2 * list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, (low + high) / 2))) >= {entropy} * ln(k) AS ok
    FROM first WHERE i < {steps})
), level AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= {entropy} * ln(k) THEN 1.0 ELSE low END AS a, ps FROM first WHERE i = {steps}
), second AS (
  SELECT 0 AS i, 1.0::DOUBLE AS low, a AS high, ps, a FROM level
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END, ps, a
  FROM (SELECT *, (low + high) / 2 AS mid, pow(ps[-1] / ps[1], 1 - (low + high) / 2) <= {repeats} AS ok FROM second WHERE i < {steps})
), solved AS (
  SELECT CASE WHEN pow(ps[-1] / ps[1], 1 - a) > {repeats} THEN low ELSE a END AS a FROM second WHERE i = {steps}
), whole AS (
  SELECT a, total, k, list_sum(list_transform(ps, lambda p: pow(p, a))) AS z, ns[-1] AS top, ps[-1] AS top_share FROM solved, shares
), plan AS (
  SELECT src, n, CASE WHEN n > 0 THEN pow(n / total, a) / z ELSE 0.0 END AS weight, ceil(top * z / pow(top_share, a))::BIGINT + k AS budget FROM sizes, whole
), laid AS (
  SELECT src, weight, CASE WHEN n > 0 THEN floor(weight * budget)::BIGINT // n ELSE 1 END AS blocks, CASE WHEN n > 0 THEN floor(weight * budget)::BIGINT % n ELSE 0 END AS rest FROM plan
)
SELECT d.doc_id, d.source, d.n_tokens, round(p.weight, 9) AS weight,
  (p.blocks + CASE WHEN p.rest > 0 AND sum(d.n_tokens) OVER (PARTITION BY d.src ORDER BY d.place) <= p.rest THEN 1 ELSE 0 END)::BIGINT AS n_copies
FROM docs d JOIN laid p USING (src)
"""


def oracle_sql(entropy: float = 0.97, repeats: float = 4.0, seed: int = 17) -> str:
    return ORACLE.format(entropy=entropy, repeats=repeats, seed=seed, steps=STEPS)
