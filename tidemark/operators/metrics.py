"""Retrieval metrics over annotated states, candidates, selections and drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import meet

#: Seconds before its start at which a state counts as shown.
LEAD = 1.0


def hits(states: DataFrame, times: DataFrame, keys: list[str], lead: float = LEAD, width: float | None = None) -> DataFrame:
    """States (state_id) with at least one time in [start - lead, end]; with a ``width``, met in buckets of that many seconds."""
    span = (F.col("start") - lead, F.col("end"))
    met = meet(states.select(*keys, "state_id", "start", "end"), times.select(*keys, F.col("t").alias("t_")), keys, span, (F.col("t_"), F.col("t_")), width)
    shown = met.filter(F.col("t_").between(*span)).select(*keys, "state_id").distinct()
    return states.join(shown, [*keys, "state_id"], "left_semi")


def recall(states: DataFrame, times: DataFrame, keys: list[str], lead: float = LEAD, width: float | None = None) -> DataFrame:
    """(keys, essential, hit, recall) over states of class essential; recall is NaN where there is none."""
    need = states.filter("class = 'essential'")
    got = hits(need, times, keys, lead, width).groupBy(*keys).agg(F.count("*").alias("hit"))
    out = states.select(*keys).distinct().join(need.groupBy(*keys).agg(F.count("*").alias("essential")), keys, "left").join(got, keys, "left")
    out = out.select(*keys, F.coalesce("essential", F.lit(0)).alias("essential"), F.coalesce("hit", F.lit(0)).alias("hit"))
    return out.withColumn("recall", F.when(F.col("essential") > 0, F.col("hit") / F.col("essential")).otherwise(F.lit(float("nan"))))


def state_of(times: DataFrame, states: DataFrame, keys: list[str], lead: float = LEAD, width: float | None = None) -> DataFrame:
    """``times`` (id, t) plus the state shown: the one that started last, the first on a tie; null without one."""
    s = states.select(*keys, "state_id", "pos", "start", "end", "class", "root")
    met = meet(times.select(*keys, "id", "t"), s, keys, (F.col("t"), F.col("t")), (F.col("start") - lead, F.col("end")), width).filter(F.col("t").between(F.col("start") - lead, F.col("end")))
    best = met.groupBy(*keys, "id").agg(F.max_by(F.struct("state_id", "class", "root"), F.struct("start", (-F.col("pos")).alias("p"))).alias("s"))
    return times.join(best.select(*keys, "id", "s.*"), [*keys, "id"], "left")


def score_selection(selected: DataFrame, states: DataFrame, keys: list[str], lead: float = LEAD) -> DataFrame:
    """(keys, selected, precision, redundancy, efficiency): share of useful rows, of rows whose group was shown before, and essential states shown per row.

    ``states`` has root, the end of its duplicate chain; rows without a state have no group.
    """
    shown = state_of(selected, states, keys, lead)
    rn = F.row_number().over(Window.partitionBy(*keys, "root").orderBy("t", "id"))
    shown = shown.withColumn("again", F.col("root").isNotNull() & (rn > 1))
    out = shown.groupBy(*keys).agg(
        F.count("*").alias("selected"),
        F.avg(F.when(F.col("class").isin("essential", "acceptable"), 1.0).otherwise(0.0)).alias("precision"),
        F.avg(F.when(F.col("again"), 1.0).otherwise(0.0)).alias("redundancy"),
    )
    got = recall(states, selected, keys, lead).select(*keys, "hit")
    return out.join(got, keys, "left").select(*keys, "selected", "precision", "redundancy", (F.coalesce("hit", F.lit(0)) / F.col("selected")).alias("efficiency"))


def alignment(selected: DataFrame, states: DataFrame, keys: list[str], lead: float = LEAD, width: float | None = None) -> DataFrame:
    """(keys, hits, aligned, alignment): of essential states shown that name what is said, the share for which a row shown cites some of it.

    ``selected`` has anchors, ``states`` spoken (arrays of segment ids).
    """
    s = states.filter("class = 'essential' AND size(spoken) > 0").select(*keys, "state_id", "start", "end", "spoken")
    met = meet(s, selected.select(*keys, "t", "anchors"), keys, (F.col("start") - lead, F.col("end")), (F.col("t"), F.col("t")), width).filter(F.col("t").between(F.col("start") - lead, F.col("end")))
    per = met.groupBy(*keys, "state_id").agg(F.max(F.arrays_overlap("anchors", "spoken")).alias("ok"))
    return per.groupBy(*keys).agg(F.count("*").alias("hits"), F.count_if("ok").alias("aligned")).withColumn("alignment", F.col("aligned") / F.col("hits"))


def losses(states: DataFrame, selected: DataFrame, pool: DataFrame, dropped: DataFrame, keys: list[str], lead: float = LEAD, width: float | None = None) -> DataFrame:
    """(keys, state_id, reason) for essential states no selected row shows: triage_rejected if the pool has a row for it, else the drop reason (dedup, cap, blank), else not_in_pool."""
    need = states.filter("class = 'essential'")
    missed = need.join(hits(need, selected, keys, lead, width).select(*keys, "state_id"), [*keys, "state_id"], "left_anti")
    in_pool = hits(missed, pool, keys, lead, width).select(*keys, "state_id", F.lit(0).alias("rank"))
    order = F.when(F.col("reason") == "dedup", 1).when(F.col("reason") == "cap", 2).when(F.col("reason") == "blank", 3)
    d = dropped.select(*keys, "t", order.alias("rank")).filter("rank IS NOT NULL")
    lost = meet(missed, d, keys, (F.col("start") - lead, F.col("end")), (F.col("t"), F.col("t")), width).filter(F.col("t").between(F.col("start") - lead, F.col("end"))).select(*keys, "state_id", "rank")
    best = in_pool.unionByName(lost).groupBy(*keys, "state_id").agg(F.min("rank").alias("rank"))
    reason = F.when(F.col("rank") == 0, "triage_rejected").when(F.col("rank") == 1, "dedup_dropped").when(F.col("rank") == 2, "cap_dropped").when(F.col("rank") == 3, "blank_dropped").otherwise("not_in_pool")
    return missed.select(*keys, "state_id").join(best, [*keys, "state_id"], "left").select(*keys, "state_id", reason.alias("reason"))


def against_random(own: DataFrame, baselines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ivr, random_mean, random_sd, por): a recall against the mean and population deviation of baseline recalls."""
    b = baselines.groupBy(*keys).agg(F.avg("recall").alias("random_mean"), F.coalesce(F.stddev_pop("recall"), F.lit(0.0)).alias("random_sd"))
    return own.join(b, keys).select(*keys, F.col("recall").alias("ivr"), "random_mean", "random_sd", F.try_divide("recall", "random_mean").alias("por"))


def token_density(images: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tokens, per_minute) of images (width, height) over recordings (duration in seconds)."""
    from tidemark.functions.clock import image_tokens

    t = images.groupBy(*keys).agg(F.sum(image_tokens(F.col("width"), F.col("height"))).alias("tokens"))
    return durations.join(t, keys, "left").select(*keys, F.coalesce("tokens", F.lit(0)).alias("tokens"), F.try_divide(F.coalesce("tokens", F.lit(0)), F.col("duration") / 60).alias("per_minute"))


def checklist_coverage(claims: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, covered, weight, coverage): weighted share of claims whose demands a block meets.

    A claim (claim_id, must ARRAY<ARRAY<STRING>>, seg_ids, weight) asks for one of each inner
    array. It is looked for in the blocks (text, seg_ids) that cite one of its segments, in
    all blocks of the key where none does.
    """
    met = claims.join(blocks.select(*keys, F.lower("text").alias("text_"), F.col("seg_ids").alias("cited")), keys, "left")
    met = met.withColumn("near", F.coalesce(F.arrays_overlap("seg_ids", "cited"), F.lit(False)))
    met = met.withColumn("any_near", F.max("near").over(Window.partitionBy(*keys, "claim_id"))).filter(F.col("near") | ~F.col("any_near"))
    text = met.groupBy(*keys, "claim_id", "weight", "must").agg(F.array_join(F.array_sort(F.collect_list("text_")), " ").alias("text_"))
    ok = F.forall("must", lambda group: F.exists(group, lambda x: F.contains(F.col("text_"), F.lower(x))))
    out = text.withColumn("ok", ok).groupBy(*keys).agg(F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0.0)).alias("covered"), F.sum("weight").alias("weight"))
    return out.withColumn("coverage", F.try_divide("covered", "weight"))
