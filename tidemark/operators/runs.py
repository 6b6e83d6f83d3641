"""Stateful segmentation: runs whose rule looks at the run's first row, its last row and its peak."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.signature import CHANGED_BY
from tidemark.operators.intervals import islands, numbered

#: For each mode the largest luma, edge and changed differences within a run, and whether the run may drift.
SAME = {"A": (8.0, 6.0, 0.10, False), "B": (3.0, 4.0, 0.06, False), "C": (6.0, 6.0, 0.20, True), "D": (4.0, 5.0, 0.06, True)}
INK_DROP, STEP, SHORTEST = 0.30, 0.5, 1.5


def _differences(pixels: np.ndarray, edges: np.ndarray, other_pixels: np.ndarray, other_edges: np.ndarray) -> np.ndarray:
    """Mean luma difference, mean edge difference and share of changed pixels of rows of pictures: three columns."""
    d = np.abs(pixels - other_pixels)
    return np.stack([d.mean(1), np.abs(edges - other_edges).mean(1), (d > CHANGED_BY).mean(1)], 1)


def run_numbers(t: np.ndarray, mode: list, pixels: np.ndarray, edges: np.ndarray, ink: np.ndarray) -> np.ndarray:
    """Run numbers of pictures in time order; see ``build_runs``."""
    n = len(t)
    limits = np.array([SAME.get(m, SAME["B"])[:3] for m in mode], float).reshape(n, 3)
    drift = np.array([SAME.get(m, SAME["B"])[3] for m in mode], bool)
    wiped = np.array([m == "C" for m in mode], bool)
    opens = np.ones(n, bool)
    opens[1:] = (_differences(pixels[1:], edges[1:], pixels[:-1], edges[:-1]) > limits[1:]).any(1)
    # Within an island of rows near the one before, what is left of it is held against the run's first row and peak of ink.
    for a, b in zip(np.flatnonzero(opens), np.append(np.flatnonzero(opens)[1:], n)):
        while a < b:
            away = (_differences(pixels[a:b], edges[a:b], pixels[a], edges[a]) > limits[a:b]).any(1) & ~drift[a:b]
            peak = np.concatenate([[0.0], np.maximum.accumulate(ink[a : b - 1])])
            away |= wiped[a:b] & (peak > 0) & (ink[a:b] < (1 - INK_DROP) * peak)
            away[0] = False
            a = a + int(away.argmax()) if away.any() else b
            if a < b:
                opens[a] = True
    first = np.flatnonzero(opens)
    last = np.append(first[1:], n) - 1
    stays = t[last] - t[first] + STEP >= SHORTEST
    stays[:1] = True  # there is no run before it to join
    number = np.zeros(n, np.int64)
    number[first] = stays
    return np.cumsum(number) - 1


def build_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` plus ``run`` for (keys, t, pos, mode, pixels, edges, ink).

    A picture stays in the run if its signature is near the last one's and, in modes that may
    not drift, near the first's; in mode C a fall of ink to under 70 % of the run's peak ends
    it. Afterwards a run shorter than ``SHORTEST`` joins the one before it, if there is one.
    Signatures of a key have one size. A key's rows are one task's, keys run in parallel.
    """
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",run:int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "pos"], kind="stable")
        pixels, edges = (np.array([list(x) for x in pdf[c]], float) for c in ("pixels", "edges"))
        return pdf.assign(run=run_numbers(pdf["t"].to_numpy(float), list(pdf["mode"]), pixels, edges, pdf["ink"].to_numpy(float)))

    return rows.groupBy(*keys).applyInPandas(fold, schema)


def drift_runs(rows: DataFrame, keys: list[str], value: str, most: float) -> DataFrame:
    """``rows`` plus ``run``: a new one where the value differs from the previous by more than ``most`` (drifting modes need no state)."""
    by = Window.partitionBy(*keys).orderBy("t", "pos")
    return islands(rows.withColumn("prev_", F.lag(value).over(by)), keys, ["t", "pos"], F.abs(F.col(value) - F.col("prev_")) <= most, "run").drop("prev_")


def anchor_runs(rows: DataFrame, keys: list[str], value: str, from_first: float, from_last: float) -> DataFrame:
    """(keys, run, start, end, n): a new run where the value is further than ``from_first`` from the run's first or ``from_last`` from the last; a native fold of each stretch without a jump of over ``from_last``."""
    run = "struct<start:double,end:double,n:bigint,a:double,l:double>"
    fresh = lambda x: F.array(F.struct(x["t"].alias("start"), x["t"].alias("end"), F.lit(1).cast("bigint").alias("n"), x["v"].alias("a"), x["v"].alias("l")))

    def step(acc: Column, x: Column) -> Column:
        r = F.try_element_at(acc, F.lit(-1))
        more = F.array(F.struct(r["start"].alias("start"), x["t"].alias("end"), (r["n"] + 1).alias("n"), r["a"].alias("a"), x["v"].alias("l")))
        same = (F.abs(x["v"] - r["a"]) <= from_first) & (F.abs(x["v"] - r["l"]) <= from_last)
        return F.when(F.size(acc) == 0, fresh(x)).when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), more)).otherwise(F.concat(acc, fresh(x)))

    by = Window.partitionBy(*keys).orderBy("t", "pos")
    near = islands(rows.withColumn("prev_", F.lag(value).over(by)), keys, ["t", "pos"], F.abs(F.col(value) - F.col("prev_")) <= from_last, "stretch_")
    items = F.array_sort(F.collect_list(F.struct("t", "pos", F.col(value).cast("double").alias("v"))))
    out = near.groupBy(*keys, "stretch_").agg(F.aggregate(items, F.array().cast(f"array<{run}>"), step).alias("runs"))
    return numbered(out.select(*keys, "stretch_", F.posexplode("runs").alias("at_", "r")), keys, "run").select(*keys, "run", "r.start", "r.end", "r.n")


def coarse_states(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of storyboard tiles: a new one if luma is over 25 from the run's first tile or the tile differs by over 18 from the one before."""
    run = "struct<start:double,end:double,n:bigint,a:double>"

    def step(acc: Column, x: Column) -> Column:
        r = F.try_element_at(acc, F.lit(-1))
        fresh = F.array(F.struct(x["t"].alias("start"), x["t"].alias("end"), F.lit(1).cast("bigint").alias("n"), x["luma"].alias("a")))
        more = F.array(F.struct(r["start"].alias("start"), x["t"].alias("end"), (r["n"] + 1).alias("n"), r["a"].alias("a")))
        split = (F.abs(x["luma"] - r["a"]) > 25) | (x["diff"] > 18)
        return F.when(F.size(acc) == 0, fresh).when(split, F.concat(acc, fresh)).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), more))

    items = F.array_sort(F.collect_list(F.struct("t", "pos", F.col("luma").cast("double").alias("luma"), F.coalesce(F.col("diff").cast("double"), F.lit(0.0)).alias("diff"))))
    near = islands(tiles, keys, ["t", "pos"], F.coalesce(F.col("diff").cast("double"), F.lit(0.0)) <= 18, "stretch_")  # a larger one always opens a run
    out = near.groupBy(*keys, "stretch_").agg(F.aggregate(items, F.array().cast(f"array<{run}>"), step).alias("runs"))
    return numbered(out.select(*keys, "stretch_", F.posexplode("runs").alias("at_", "r")), keys, "run").select(*keys, "run", "r.start", "r.end", "r.n")


def mode_guess(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, guess) of a storyboard state from the medians of its tiles' luma, edge density and difference to the tile before."""
    m = tiles.groupBy(*keys).agg(F.median("luma").alias("luma"), F.median("edge").alias("edge"), F.when(F.count("*") > 1, F.median("diff")).otherwise(0.0).alias("diff"))
    guess = (
        F.when((F.col("luma") < 90) & (F.col("edge") < 0.15), "talking_head_or_dark")
        .when((F.col("luma") < 120) & (F.col("edge") >= 0.15), "code_or_terminal")
        .when(F.col("diff") > 8, "dynamic_ui")
        .when(F.col("luma") > 190, "slide_or_canvas")
        .otherwise("unknown")
    )
    return m.select(*keys, guess.alias("guess"))


def clip_to_chapters(rows: DataFrame, keys: list[str], chapter: str, step: float = STEP) -> DataFrame:
    """(keys, run, chapter, start, end, n): runs cut where the chapter changes."""
    by = Window.partitionBy(*keys).orderBy("t", "pos")
    rows = rows.withColumn("r_", F.lag("run").over(by)).withColumn("c_", F.lag(chapter).over(by))
    rows = islands(rows, keys, ["t", "pos"], (F.col("run") == F.col("r_")) & F.col(chapter).eqNullSafe(F.col("c_")), "piece")
    return rows.groupBy(*keys, "piece", "run", chapter).agg(F.min("t").alias("start"), (F.max("t") + step).alias("end"), F.count("*").alias("n"))


def probe_verdict(states: DataFrame, scanned: DataFrame, keys: list[str], fps: float = 2.0, least: float = 90.0, share: float = 0.20) -> DataFrame:
    """(keys, backdrop, non_talk, verdict): whether still pictures besides the backdrop speak against "nothing but talk".

    States with 2 or more settled samples count settled / fps seconds for their family (or
    themselves); the family without builds that has most is the backdrop, the others' sum is
    non_talk: contradicts from min(``least``, ``share`` of what was scanned), else supports;
    unavailable where nothing was scanned or no state exists.
    """
    still = states.filter("settled_samples >= 2").withColumn("group", F.coalesce("family_id", "state_id"))
    g = still.groupBy(*keys, "group").agg((F.sum("settled_samples") / fps).alias("seconds"), F.max("is_build").alias("is_build"), F.min("pos").alias("pos"))
    best = g.groupBy(*keys).agg(
        F.max_by("group", F.when(~F.col("is_build"), F.struct("seconds", (-F.col("pos")).alias("p")))).alias("backdrop"),
        F.sum("seconds").alias("all"),
        F.coalesce(F.max(F.when(~F.col("is_build"), F.col("seconds"))), F.lit(0.0)).alias("own"),
    )
    any_state = states.select(*keys).distinct().withColumn("some", F.lit(True))
    out = scanned.join(any_state, keys, "left").join(best, keys, "left").withColumn("non_talk", F.coalesce(F.col("all") - F.col("own"), F.lit(0.0)))
    none = (F.coalesce("scanned", F.lit(0.0)) <= 0) | F.col("some").isNull()
    verdict = F.when(none, "unavailable").when(F.col("non_talk") >= F.least(F.lit(least), share * F.col("scanned")), "contradicts").otherwise("supports")
    return out.select(*keys, "backdrop", "non_talk", verdict.alias("verdict"))


def top_spans(states: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """The ``most`` states of each key with most settled samples, first come first."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("settled_samples"), "pos"))
    return states.withColumn("rn", rn).filter(F.col("rn") <= most)
