"""Interval algebra: islands, coverage, gaps, and joins between points and intervals.

Every operator takes tables keyed by ``keys`` (one recording, user or other entity each) and
returns a DataFrame; joins are equi-joins on the keys with the interval predicate as their
residual, or on time buckets where a key is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_intervals(rows: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """(keys, start, end, n): intervals merged where one starts within ``gap`` of all before it; empty ones are left out."""
    rows = rows.filter("end > start").select(*keys, "start", "end")
    by = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col("start") > before + gap), 1).otherwise(0)
    island = F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("fresh", fresh).withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def sections(windows: DataFrame, keys: list[str], longer_than: float = 1200.0, pad: float = 5.0, gap: float = 10.0) -> DataFrame:
    """Padded, merged stretches of each recording longer than a limit (``windows`` has ``duration``), else the whole of it."""
    long_ = windows.filter(F.col("duration") > longer_than)
    padded = long_.select(*keys, F.greatest(F.lit(0.0), F.col("start") - pad).alias("start"), F.least(F.col("duration"), F.col("end") + pad).alias("end"))
    whole = windows.filter(F.col("duration") <= longer_than).select(*keys, F.lit(0.0).alias("start"), F.col("duration").alias("end")).distinct()
    return merge_intervals(padded, keys, gap).select(*keys, "start", "end").unionByName(whole)


def coverage(rows: DataFrame, keys: list[str], duration: str, long_gap: float = 30.0) -> DataFrame:
    """Per key: covered seconds, their ratio, the largest gap (head and tail too), long gaps, and order faults.

    ``rows`` has start, end, pos (input order) and the recording's ``duration`` in every row.
    """
    by = Window.partitionBy(*keys).orderBy("start", "end", "pos")
    before = F.coalesce(F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    order = Window.partitionBy(*keys).orderBy("pos")
    walked = rows.withColumn("before", before).withColumn("prev", F.lag("start").over(order))
    walked = walked.withColumn("new", F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", "before"))).withColumn("gap", F.greatest(F.lit(0.0), F.col("start") - F.col("before")))
    out = walked.groupBy(*keys).agg(
        F.count("*").alias("segments"),
        F.sum("new").alias("covered"),
        F.max("gap").alias("largest"),
        F.count_if(F.col("gap") > long_gap).alias("long_gaps"),
        F.max("end").alias("last"),
        F.max(duration).alias("duration"),
        F.count_if(F.col("start") < F.col("prev")).alias("out_of_order"),
        F.count_if(F.col("end") <= F.col("start")).alias("empty"),
        F.count_if((F.col(duration) > 0) & (F.col("start") > F.col(duration) + 2)).alias("beyond"),
    )
    tail = F.greatest(F.lit(0.0), F.col("duration") - F.col("last"))
    return out.withColumn("tail", tail).select(
        *keys,
        "segments",
        "covered",
        F.try_divide("covered", "duration").alias("ratio"),
        F.greatest("largest", "tail").alias("largest_gap"),
        (F.col("long_gaps") + F.when(F.col("tail") > long_gap, 1).otherwise(0)).alias("long_gaps"),
        "out_of_order",
        "empty",
        "beyond",
    )


def islands(rows: DataFrame, keys: list[str], order: list[str], same: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row opens a new one unless ``same`` (over the row and lag(...) columns) is true."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))


def numbered(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of stretches (stretch_, at_) numbered from 0 within the keys."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy("stretch_", "at_")) - 1).drop("stretch_", "at_")


def flagged_runs(rows: DataFrame, keys: list[str], order: list[str], flag: str, longer_than: float) -> DataFrame:
    """Runs of flagged rows (start, end, n): a run ends where the next row that breaks it starts, or with the last row; only longer ones."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = rows.withColumn("next_start", F.lead("start").over(by)).withColumn("was", F.lag(flag).over(by))
    rows = islands(rows, keys, order, F.col(flag) == F.col("was"))
    last = F.max_by(F.coalesce("next_start", "end"), F.struct(*order))
    runs = rows.filter(F.col(flag)).groupBy(*keys, "island").agg(F.min("start").alias("start"), last.alias("end"), F.count("*").alias("n"))
    return runs.filter(F.col("end") - F.col("start") > longer_than).drop("island")


def consecutive_runs(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, first, last, n) of runs of consecutive positions; repeated ones count once."""
    rows = rows.select(*keys, position).distinct()
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return rows.withColumn("run", F.col(position) - number).groupBy(*keys, "run").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("run")


def every_kth(rows: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Every k-th row of each key, the first included."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("rn_", number).filter(F.col("rn_") % max(1, k) == 0).drop("rn_")


def uniform_times(windows: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, i, t): midpoints of ``budget`` equal slices of each key's windows laid end to end."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    laid = windows.filter("end > start").withColumn("span", F.col("end") - F.col("start"))
    laid = laid.withColumn("upto", F.sum("span").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("from", F.col("upto") - F.col("span")).withColumn("total", F.sum("span").over(Window.partitionBy(*keys)))
    step = F.col("total") / budget
    # Slices whose midpoint (i + 0.5) * step falls into [from, upto).
    first = F.greatest(F.lit(0), F.ceil(F.col("from") / step - 0.5)).cast("int")
    last = F.least(F.lit(budget - 1), F.ceil(F.col("upto") / step - 0.5).cast("int") - 1)
    laid = laid.withColumn("i", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return laid.select(*keys, "i", (F.col("start") + (F.col("i") + 0.5) * step - F.col("from")).alias("t"))


def meet(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], width: float | None) -> DataFrame:
    """Pairs of rows of a key that may overlap; the caller filters by its own predicate.

    Without a ``width`` the join is on the keys alone: right for keys of ordinary size. With
    one, both sides are cut into buckets of that many seconds and meet on (keys, bucket), so a
    key with very many rows is spread over its buckets and only neighbours in time are
    compared. A pair is kept in the first bucket that both touch, so it comes once. The spans
    are closed and must cover the predicate.
    """
    if width is None:
        return left.join(right, keys)
    cut = lambda c: F.floor(c / width)
    a = left.withColumn("first_", cut(left_span[0])).withColumn("bucket_", F.explode(F.sequence(F.col("first_"), F.greatest(F.col("first_"), cut(left_span[1])))))
    b = right.withColumn("other_", cut(right_span[0])).withColumn("bucket_", F.explode(F.sequence(F.col("other_"), F.greatest(F.col("other_"), cut(right_span[1])))))
    return a.join(b, [*keys, "bucket_"]).filter(F.col("bucket_") == F.greatest("first_", "other_")).drop("first_", "other_", "bucket_")


def bucketed_join(points: DataFrame, spans: DataFrame, keys: list[str], width: float, pad: float = 0.0) -> DataFrame:
    """Points (t) with every span (start, end) of their key whose closed interval, widened by ``pad``, holds them; each pair once.

    Spans must not have columns that points have, but for the keys.
    """
    met = meet(points, spans, keys, (F.col("t"), F.col("t")), (F.col("start") - pad, F.col("end") + pad), width)
    return met.filter(F.col("t").between(F.col("start") - pad, F.col("end") + pad))


def containing_first(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, tolerance: float = 0.05, width: float | None = None) -> DataFrame:
    """Each point with the first span (by start) whose [start, end) holds it; the last span of a key also takes what lies within ``tolerance`` of its end.

    ``spans`` has span_id, start, end; points without a span keep nulls.
    """
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("start"), F.desc("span_id"))) == 1
    s = spans.select(*keys, "span_id", "start", "end").withColumn("is_last", last)
    hit = ((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))) | (F.col("is_last") & (F.abs(F.col("t") - F.col("end")) <= tolerance))
    met = meet(points.select(*keys, point_id, "t"), s, keys, (F.col("t"), F.col("t")), (F.col("start") - tolerance, F.col("end") + tolerance), width).filter(hit)
    first = met.groupBy(*keys, point_id).agg(F.min_by("span_id", F.struct("start", "span_id")).alias("span_id"))
    return points.join(first, [*keys, point_id], "left")


def containing_or_nearest(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, tolerance: float = 1.0, width: float | None = None) -> DataFrame:
    """(keys, point, span_ids): all spans that hold the point, else the one with the nearest edge within ``tolerance`` (first on a tie), else none."""
    met = meet(points.select(*keys, point_id, "t"), spans.select(*keys, "span_id", "pos", "start", "end"), keys, (F.col("t"), F.col("t")), (F.col("start") - tolerance, F.col("end") + tolerance), width)
    inside = (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))
    edge = F.least(F.abs(F.col("t") - F.col("start")), F.abs(F.col("t") - F.col("end")))
    met = met.filter(inside | (edge <= tolerance)).withColumn("inside", inside).withColumn("edge", edge)
    agg = met.groupBy(*keys, point_id).agg(
        F.array_sort(F.collect_list(F.when(F.col("inside"), F.struct("pos", "span_id")))).alias("holding"),
        F.min(F.when(~F.col("inside"), F.struct("edge", "pos", "span_id"))).alias("nearest"),
    )
    ids = F.when(F.size("holding") > 0, F.transform("holding", lambda x: x["span_id"])).otherwise(F.array("nearest.span_id"))
    return points.join(agg.select(*keys, point_id, ids.alias("span_ids")), [*keys, point_id], "left").withColumn("span_ids", F.coalesce("span_ids", F.array().cast(f"array<{dict(spans.dtypes)['span_id']}>")))


def nearest_centre(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, tolerance: float = 0.05, width: float | None = None) -> DataFrame:
    """Each point with the span that holds it (widened by ``tolerance``) and whose centre is nearest, first on a tie."""
    met = meet(points.select(*keys, point_id, "t"), spans.select(*keys, "span_id", "pos", "start", "end"), keys, (F.col("t"), F.col("t")), (F.col("start") - tolerance, F.col("end") + tolerance), width)
    met = met.filter(F.col("t").between(F.col("start") - tolerance, F.col("end") + tolerance))
    far = F.abs(F.col("t") - (F.col("start") + F.col("end")) / 2)
    return points.join(met.groupBy(*keys, point_id).agg(F.min_by("span_id", F.struct(far, "pos")).alias("span_id")), [*keys, point_id], "left")


def overlap_or_lead(states: DataFrame, spans: DataFrame, keys: list[str], lead: float = 3.0, width: float | None = None) -> DataFrame:
    """(keys, state_id, span_ids, by): spans that overlap the state, else those that end within ``lead`` seconds before it.

    ``states`` and ``spans`` have start and end; ids come in the spans' order.
    """
    s = spans.select(*keys, "span_id", "pos", F.col("start").alias("s"), F.col("end").alias("e"))
    met = meet(states.select(*keys, "state_id", "start", "end"), s, keys, (F.col("start") - lead, F.col("end")), (F.col("s"), F.col("e")), width)
    over = (F.col("s") < F.col("end")) & (F.col("e") > F.col("start"))
    ahead = (F.col("e") >= F.col("start") - lead) & (F.col("e") <= F.col("start"))
    met = met.filter(over | ahead).withColumn("rank", F.when(over, 1).otherwise(2))
    best = F.min("rank").over(Window.partitionBy(*keys, "state_id"))
    met = met.withColumn("best", best).filter("rank = best")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "span_id"))), lambda x: x["span_id"])
    out = met.groupBy(*keys, "state_id").agg(ids.alias("span_ids"), F.when(F.min("rank") == 1, "overlap").otherwise("lead").alias("by"))
    return states.join(out, [*keys, "state_id"], "left")


def fallback_attach(targets: DataFrame, states: DataFrame, keys: list[str], chapter: str, within: float = 6.0, width: float | None = None) -> DataFrame:
    """(keys, target_id, state_id, step): an action takes the first state of its chapter that starts within ``within`` seconds after its anchor (step 1); else, all states of the chapter that overlap its window (2); else the first state anywhere that holds the anchor (3).

    ``targets`` has target_id, kind, anchor, lo, hi; ``states`` has state_id, pos, start, end.
    """
    s = states.select(*keys, F.col(chapter).alias("c_"), "state_id", "pos", "start", "end")
    met = meet(targets.select(*keys, chapter, "target_id", "kind", "anchor", "lo", "hi"), s, keys, (F.least("lo", "anchor"), F.greatest(F.col("hi"), F.col("anchor") + within)), (F.col("start"), F.col("end")), width)
    own = F.col(chapter) == F.col("c_")
    action = own & (F.col("kind") == "action_result") & F.col("start").between(F.col("anchor"), F.col("anchor") + within)
    window = own & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo"))
    holds = (F.col("start") <= F.col("anchor")) & (F.col("anchor") < F.col("end"))
    met = met.withColumn("steps", F.array_compact(F.array(F.when(action, 1), F.when(window, 2), F.when(holds, 3)))).withColumn("step", F.explode("steps"))
    by = Window.partitionBy(*keys, "target_id")
    met = met.withColumn("best", F.min("step").over(by)).filter("step = best")
    met = met.withColumn("rn", F.row_number().over(by.orderBy("pos"))).filter("step = 2 OR rn = 1")
    return met.select(*keys, "target_id", "state_id", "step")


def overlap_mean(states: DataFrame, bins: DataFrame, keys: list[str], width: float | None = None) -> DataFrame:
    """``states`` plus ``mean``: the plain mean of the values of the bins each overlaps, 0 without one."""
    b = bins.select(*keys, F.col("start").alias("s"), F.col("end").alias("e"), "value")
    met = meet(states.select(*keys, "state_id", "start", "end"), b, keys, (F.col("start"), F.col("end")), (F.col("s"), F.col("e")), width).filter((F.col("s") < F.col("end")) & (F.col("e") > F.col("start")))
    return states.join(met.groupBy(*keys, "state_id").agg(F.avg("value").alias("mean")), [*keys, "state_id"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def latest_start(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str, early: float = 1.0, width: float | None = None) -> DataFrame:
    """Each point with the span that started last among those with start - ``early`` <= t <= end; first on a tie."""
    met = meet(points.select(*keys, point_id, "t"), spans.select(*keys, "span_id", "pos", "start", "end"), keys, (F.col("t"), F.col("t")), (F.col("start") - early, F.col("end")), width)
    met = met.filter(F.col("t").between(F.col("start") - early, F.col("end")))
    return points.join(met.groupBy(*keys, point_id).agg(F.max_by("span_id", F.struct("start", (-F.col("pos")).alias("p"))).alias("span_id")), [*keys, point_id], "left")


def asof_backward(points: DataFrame, quotes: DataFrame, keys: list[str], value: str, tolerance: float | None = None) -> DataFrame:
    """Each point with the last ``value`` at or before it, by one shuffle: both sides are united and the value carried forward.

    Points and quotes have t; at equal times quotes come first. With a ``tolerance`` older values count as none.
    """
    kind = dict(quotes.dtypes)[value]
    left = points.withColumn("side_", F.lit(1)).withColumn("quote_", F.lit(None).cast(f"struct<t:double,v:{kind}>"))
    right = quotes.select(*keys, "t", F.lit(0).alias("side_"), F.struct(F.col("t").alias("t"), F.col(value).alias("v")).alias("quote_"))
    both = left.unionByName(right, allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("t", "side_").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("last_", F.last("quote_", ignorenulls=True).over(by)).filter("side_ = 1")
    fits = F.lit(True) if tolerance is None else F.col("t") - F.col("last_.t") <= tolerance
    return found.withColumn(value, F.when(fits, F.col("last_.v"))).drop("side_", "quote_", "last_")
