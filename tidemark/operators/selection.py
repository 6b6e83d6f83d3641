"""Budgeted selection: reservations, top-k, caps, greedy fill, paging and limits."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a point was sampled for, the first that applies is its main reason.
REASONS = ("target", "cue", "pin", "coverage", "state", "scene", "final")
#: Reasons whose frames duplicates may not drop from their chapter.
PROTECTED = ("target", "cue", "pin", "coverage")
#: Rank of a reason among points that are merged.
PRIORITY = {"target": 100, "cue": 90, "pin": 80, "coverage": 70, "state": 50, "scene": 40, "final": 20}


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key; Spark drops the others before the shuffle."""
    return rows.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn_") <= k).drop("rn_")


def uniform_index(n: Column, slots: Column) -> Column:
    """Distinct indexes, evenly spread over ``n`` rows: round(i * (n - 1) / max(slots - 1, 1)), halves to even."""
    one = lambda i: F.bround(i * (n - 1) / F.greatest(slots - 1, F.lit(1)), 0).cast("int")
    return F.when((n > 0) & (slots > 0), F.array_distinct(F.transform(F.sequence(F.lit(0), slots - 1), one))).otherwise(F.array().cast("array<int>"))


def uniform_pick(rows: DataFrame, keys: list[str], order: list, slots: int) -> DataFrame:
    """At most ``slots`` rows of each key, evenly spread by position."""
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("i_", F.row_number().over(by.orderBy(*order)) - 1).withColumn("n_", F.count("*").over(by).cast("int"))
    return rows.filter(F.array_contains(uniform_index(F.col("n_"), F.lit(slots)), F.col("i_"))).drop("i_", "n_")


def primary_reason(reasons: Column) -> Column:
    """The first reason of the fixed order that a row has, else scene."""
    out = F.lit("scene")
    for r in reversed(REASONS):
        out = F.when(F.array_contains(reasons, r), r).otherwise(out)
    return out


def priority(reasons: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(reasons, lambda r: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv]), r), F.lit(0)))), F.lit(0))


def frame_score(row: dict[str, Column]) -> Column:
    """A frame's score from priority, sharpness, contrast, scene_score, target_ids, people, text_chars, target_kinds, t and anchors (a map).

    Targets add 30 and people take 25. Frames of an action gain 1e-4 a second; others lose
    their distance to the nearest anchor.
    """
    z = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    score = z(row["priority"]) + F.least(z(row["sharpness"]), F.lit(50.0)) * 0.8 + F.least(z(row["contrast"]), F.lit(80.0)) * 0.2 + F.least(z(row["scene_score"]), F.lit(1.0)) * 20
    score = score + F.when(F.size(row["target_ids"]) > 0, 30.0).otherwise(0.0) - F.when(F.coalesce(row["people"], F.lit(False)), 25.0).otherwise(0.0)
    score = score + F.when(row["text_chars"].isNotNull(), F.least(row["text_chars"].cast("double"), F.lit(200.0)) / 200.0 * 15).otherwise(0.0)
    far = F.array_min(F.transform(F.map_values(row["anchors"]), lambda a: F.abs(row["t"] - a)))
    return score + F.when(F.array_contains(row["target_kinds"], "action_result"), row["t"] * 0.0001).otherwise(-F.coalesce(far, F.lit(0.0)))


def reserve_and_cap(rows: DataFrame, keys: list[str], k: int, cap: int, floor: int, hard: bool = False) -> DataFrame:
    """``rows`` plus ``reserved``, ``cap_eff`` and ``status`` (reserved, free or cap).

    Rows have id, t, pos, score, target_ids, chapter_id, needs_frames. The best ``k`` of each
    target are reserved, then the best row of each chapter that needs frames and has none. The
    cap is at least what is reserved plus ``floor`` unless ``hard``; reserved rows beyond it are
    lost by score. Rows that are left without a target compete for the free slots.
    """
    best = [F.desc("score"), F.asc("pos")]
    per_target = top_k(rows.withColumn("target_", F.explode("target_ids")), [*keys, "target_"], best, k).select(*keys, "id").distinct()
    marked = rows.join(per_target.withColumn("by_target", F.lit(True)), [*keys, "id"], "left").withColumn("by_target", F.coalesce("by_target", F.lit(False)))
    some = F.max("by_target").over(Window.partitionBy(*keys, "chapter_id"))
    first = F.row_number().over(Window.partitionBy(*keys, "chapter_id").orderBy(*best)) == 1
    marked = marked.withColumn("some", some).withColumn("first", first)
    marked = marked.withColumn("reserved", F.col("by_target") | (F.coalesce("needs_frames", F.lit(False)) & ~F.col("some") & F.col("first"))).drop("by_target", "some", "first")
    by = Window.partitionBy(*keys)
    marked = marked.withColumn("n_reserved", F.count_if("reserved").over(by))
    marked = marked.withColumn("cap_eff", F.lit(cap) if hard else F.greatest(F.lit(cap), F.col("n_reserved") + floor))
    rank = F.row_number().over(Window.partitionBy(*keys, "reserved").orderBy(*best))
    status = F.when(F.col("reserved"), F.when(rank <= F.col("cap_eff"), "reserved").otherwise("cap")).when(F.size("target_ids") == 0, "free").otherwise("cap")
    return marked.withColumn("status", status)


def greedy_fill(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key that are kept: reserved ones, then free ones while slots are left.

    Takes the output of ``reserve_and_cap`` with ``importance`` and a small ``signature``
    (array of numbers). Each step takes the free row with most .5 importance + .3 distance to
    what is kept + .2 gap in time (of a quarter of the span, at most 1); the first on ties.
    The choice depends on all choices before it, so a key is filled in one task, keys in parallel.
    """
    schema = rows.schema.simpleString()[len("struct<") : -1] + ",kept:boolean"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        kept = (pdf["status"] == "reserved").to_numpy()
        free = (pdf["status"] == "free").to_numpy()
        slots = int(pdf["cap_eff"].iloc[0]) - int(kept.sum())
        if free.sum() <= slots:
            return pdf.assign(kept=kept | free)
        t = pdf["t"].to_numpy(float)
        sig = np.array([np.asarray(s, float) for s in pdf["signature"]])
        shown = t[kept | free]
        span = max(shown.max() - shown.min(), 1.0)
        novelty, gap = np.ones(len(pdf)), np.ones(len(pdf))
        importance = pdf["importance"].to_numpy(float)

        def see(i: int) -> None:
            np.minimum(novelty, np.minimum(1.0, np.abs(sig[:, ::4] - sig[i, ::4]).mean(1) / 12), out=novelty)
            np.minimum(gap, np.minimum(1.0, np.abs(t - t[i]) / (span / 4)), out=gap)

        for i in np.flatnonzero(kept):
            see(i)
        for _ in range(max(0, slots)):
            score = np.where(free, 0.5 * importance + 0.3 * novelty + 0.2 * gap, -np.inf)
            i = int(score.argmax())
            kept[i], free[i] = True, False
            see(i)
        return pdf.assign(kept=kept)

    # Rows lost to the cap are neither kept nor seen by the choice.
    return rows.filter("status IN ('reserved', 'free')").groupBy(*keys).applyInPandas(fill, schema).filter("kept").drop("kept")


def coverage_status(chapters: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, status, candidate_ids) of each chapter: not-required, covered or unresolved, with the ids in time order."""
    ids = candidates.groupBy(*keys, "chapter_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"]).alias("candidate_ids"))
    out = chapters.join(ids, [*keys, "chapter_id"], "left")
    none = F.array().cast(f"array<{dict(candidates.dtypes)['id']}>")
    status = F.when(F.size(F.coalesce("candidate_ids", none)) > 0, "covered").when(F.col("needs_frames"), "unresolved").otherwise("not-required")
    return out.select(*keys, F.col("chapter_id").alias("id"), status.alias("status"), F.coalesce("candidate_ids", none).alias("candidate_ids"))


def reading_cost(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, images, tokens, mean, dimensions): what it costs to look at images of (width, height); dimensions maps WxH to a count."""
    from tidemark.functions.clock import image_tokens

    one = rows.withColumn("tokens", image_tokens(F.col("width"), F.col("height"))).withColumn("dim", F.concat_ws("x", "width", "height"))
    per = one.groupBy(*keys, "dim").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("images"), F.sum("tokens").alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("dim", "n")))).alias("dimensions"))
    return out.select(*keys, "images", "tokens", (F.col("tokens") / F.col("images")).alias("mean"), "dimensions")


def sheet_pages(rows: DataFrame, keys: list[str], tiles: int = 16, seed: int = 7) -> DataFrame:
    """``rows`` plus sheet, slot, sentinel (its slot) and sentinel_id: pages of ``tiles`` - 1 in time order with one sentinel, never first, that rows step over.

    Slot and number of the sentinels are drawn page after page by Python's generator with
    ``seed``, anew for each key: only the number of rows of a key goes there.
    """
    per = max(1, tiles - 1)
    kinds = dict(rows.dtypes)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("t", "pos")) - 1
    rows = rows.withColumn("sheet", F.floor(place / per).cast("int")).withColumn("at_", (place % per).cast("int"))

    def draw(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                rng = random.Random(seed)
                for sheet in range(-(-row[-1] // per)):
                    n = min(per, row[-1] - sheet * per)
                    slot = rng.randint(1, n) if n > 1 else 1
                    out.append((*row[:-1], sheet, slot, f"x_{sheet:02d}{rng.randint(10, 99)}"))
            yield pd.DataFrame(out, columns=[*keys, "sheet", "sentinel", "sentinel_id"])

    sizes = rows.groupBy(*keys).agg(F.count("*").cast("int").alias("n"))
    drawn = sizes.mapInPandas(draw, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sheet int, sentinel int, sentinel_id string")
    return rows.join(drawn, [*keys, "sheet"]).withColumn("slot", F.col("at_") + F.when(F.col("at_") >= F.col("sentinel"), 1).otherwise(0)).drop("at_")


def strip_groups(rows: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """The first ``most`` rows by time of each target, and of each chapter among rows without a target, as (keys, group, id, slot)."""
    groups = F.when(F.size("target_ids") > 0, F.transform("target_ids", lambda x: F.concat(F.lit("target:"), x))).otherwise(F.array(F.concat(F.lit("chapter:"), F.col("chapter_id").cast("string"))))
    one = rows.withColumn("group", F.explode(groups))
    slot = F.row_number().over(Window.partitionBy(*keys, "group").orderBy("t", "pos"))
    return one.withColumn("slot", slot).filter(F.col("slot") <= most).select(*keys, "group", "id", "slot")


def shortlist_check(wanted: DataFrame, pool: DataFrame, keys: list[str], most: int = 30) -> DataFrame:
    """(keys, n, unknown, verdict): ok, unknown ids or too many."""
    known = pool.select(*keys, "id").distinct().withColumn("known", F.lit(True))
    one = wanted.select(*keys, "id").distinct().join(known, [*keys, "id"], "left")
    out = one.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("id")))).alias("unknown"))
    return out.withColumn("verdict", F.when(F.size("unknown") > 0, "unknown ids").when(F.col("n") > most, "too many").otherwise("ok"))


def newest(rows: DataFrame, keys: list[str], at: str, most: int) -> DataFrame:
    return top_k(rows, keys, [F.desc(at), F.desc("pos")], most)


def random_times(windows: DataFrame, keys: list[str], budget: int, seed: int) -> DataFrame:
    """(keys, i, t): ``budget`` random times over each key's windows laid end to end, in the order Python's generator with ``seed`` draws them, to 3 places."""
    kinds = dict(windows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", i int, t double"

    def draw(key, pdf):
        pdf = pdf.sort_values(["start", "end"])
        starts, spans = pdf["start"].to_numpy(float), (pdf["end"] - pdf["start"]).to_numpy(float)
        upto = np.cumsum(spans)
        rng = random.Random(seed)
        times = []
        for _ in range(budget):
            x = rng.random() * upto[-1]
            w = min(int(np.searchsorted(upto, x, "left")), len(upto) - 1)
            times.append(round(float(starts[w] + x - (upto[w] - spans[w])), 3))
        return pd.DataFrame({**{k: [v] * len(times) for k, v in zip(keys, key)}, "i": range(len(times)), "t": times}, columns=[*keys, "i", "t"])

    return windows.select(*keys, "start", "end").groupBy(*keys).applyInPandas(draw, schema)
