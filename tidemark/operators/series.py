"""Sampled signals: robust thresholds, peaks, tumbling windows, settled stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import islands, meet


def robust_threshold(rows: DataFrame, keys: list[str], value: str, floor: float = 0.04, times: float = 8.0) -> DataFrame:
    """(keys, med, mad, threshold): threshold = max(floor, median + times * median absolute deviation), medians as means of the middles."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med"))
    mad = rows.join(med, keys).groupBy(*keys, "med").agg(F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"))
    return mad.select(*keys, "med", "mad", F.greatest(F.lit(floor), F.col("med") + times * F.col("mad")).alias("threshold"))


def upper_median(values: Column) -> Column:
    """The upper one of the two middles of an array, the middle where there is one."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def motion_threshold(rows: DataFrame, keys: list[str], value: str, floor: float = 0.12, most: float = 0.5, times: float = 4.0) -> DataFrame:
    """(keys, med, mad, threshold) with upper medians: max(floor, min(most, med + times * mad))."""
    one = rows.groupBy(*keys).agg(F.collect_list(value).alias("v")).withColumn("med", upper_median(F.col("v")))
    one = one.withColumn("mad", upper_median(F.transform("v", lambda x: F.abs(x - F.col("med")))))
    return one.select(*keys, "med", "mad", F.greatest(F.lit(floor), F.least(F.lit(most), F.col("med") + times * F.col("mad"))).alias("threshold"))


def local_maxima(rows: DataFrame, keys: list[str], order: list[str], value: str, floor: float = 0.04, times: float = 8.0) -> DataFrame:
    """Rows at least as high as both neighbours (a missing one counts -1) and as the key's robust threshold."""
    by = Window.partitionBy(*keys).orderBy(*order)
    seen = rows.withColumn("prev_", F.coalesce(F.lag(value).over(by), F.lit(-1.0))).withColumn("next_", F.coalesce(F.lead(value).over(by), F.lit(-1.0)))
    seen = seen.join(robust_threshold(rows, keys, value, floor, times).select(*keys, "threshold"), keys)
    high = (F.col(value) >= F.col("prev_")) & (F.col(value) >= F.col("next_")) & (F.col(value) >= F.col("threshold"))
    return seen.filter(high).drop("prev_", "next_")


def suppress(rows: DataFrame, keys: list[str], value: str, apart: float = 0.35) -> DataFrame:
    """(keys, t, value): peaks at least ``apart`` seconds from the last kept; a nearer, higher one replaces it and moves the reference.

    Rows have t. A peak at least ``apart`` from the one before it is kept whatever came before,
    so stretches between such gaps are folded on their own, without Python.
    """
    by = Window.partitionBy(*keys).orderBy("t", value)
    rows = islands(rows.withColumn("t_", F.lag("t").over(by)), keys, ["t", value], F.col("t") - F.col("t_") < apart, "stretch_")
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct("t", value))),
        F.array().cast("array<struct<t:double,v:double>>"),
        lambda acc, x: F.when(F.size(acc) == 0, F.array(F.struct(x["t"].alias("t"), x[value].alias("v"))))
        .when(x["t"] - F.element_at(acc, -1)["t"] >= apart, F.concat(acc, F.array(F.struct(x["t"].alias("t"), x[value].alias("v")))))
        .when(x[value] > F.element_at(acc, -1)["v"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(x["t"].alias("t"), x[value].alias("v")))))
        .otherwise(acc),
    )
    one = rows.groupBy(*keys, "stretch_").agg(kept.alias("kept"))
    return one.select(*keys, F.explode("kept").alias("p")).select(*keys, F.col("p.t").alias("t"), F.col("p.v").alias(value))


def windowed_peaks(rows: DataFrame, windows: DataFrame, keys: list[str], value: str, width: float | None = None) -> DataFrame:
    """Peaks within each window on its own: threshold, maxima and suppression per (keys, window_id); with a ``width``, rows meet windows in buckets of that many seconds."""
    w = windows.select(*keys, "window_id", F.col("start").alias("s"), F.col("end").alias("e"))
    met = meet(rows, w, keys, (F.col("t"), F.col("t")), (F.col("s"), F.col("e")), width)
    inside = met.filter((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).drop("s", "e")
    by = [*keys, "window_id"]
    return suppress(local_maxima(inside, by, ["t"], value), by, value)


def lag_features(rows: DataFrame, keys: list[str], part: str, order: list[str], value: str) -> DataFrame:
    """``rows`` plus ``delta`` = |value - previous value|, null at the first row of each part."""
    return rows.withColumn("delta", F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys, part).orderBy(*order))))


def anchored_windows(rows: DataFrame, keys: list[str], seconds: float, changed: str, moved: str, luma: str, edge: str, ink: str, least: int = 2) -> DataFrame:
    """(keys, window_no, start, end, mode, ...): tumbling windows from each key's first row; those of under ``least`` rows are left out.

    mode: A if over half of the rows move a lot (``moved`` > 0.25), B if under 15 % change
    (``changed`` > 0.02), C if bright (luma > 150) and plain (edge < 14), else D. The first row
    of a window counts for neither. ink_first and ink_last are means of its first and last quarter.
    """
    t0 = F.min("t").over(Window.partitionBy(*keys))
    rows = rows.withColumn("window_no", F.floor((F.col("t") - t0) / seconds))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys, "window_no").orderBy("t", "pos")))
    later = F.col("rn") > 1
    share = lambda x: F.avg(F.when(later, F.when(x, 1.0).otherwise(0.0)))
    quarter = F.greatest(F.lit(1), F.floor(F.col("n") / 4))
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "window_no")))
    out = rows.groupBy(*keys, "window_no").agg(
        F.count("*").alias("n"),
        F.min("t").alias("start"),
        (F.max("t") + 0.5).alias("end"),
        share(F.col(changed) > 0.02).alias("motion_freq"),
        share(F.col(moved) > 0.25).alias("big_motion"),
        F.avg(luma).alias("luma"),
        F.avg(edge).alias("edge"),
        F.avg(F.when(F.col("rn") <= quarter, F.col(ink))).alias("ink_first"),
        F.avg(F.when(F.col("rn") > F.col("n") - quarter, F.col(ink))).alias("ink_last"),
    )
    mode = F.when(F.col("big_motion") > 0.5, "A").when(F.col("motion_freq") < 0.15, "B").when((F.col("luma") > 150) & (F.col("edge") < 14), "C").otherwise("D")
    return out.filter(F.col("n") >= least).withColumn("mode", mode)


def smooth_modes(windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, window_no, mode): a mode between two equal others becomes theirs, left to right and in place, so a smoothed neighbour counts."""
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("window_no", "mode"))),
        F.array().cast("array<struct<window_no:bigint,mode:string>>"),
        lambda acc, x: F.concat(acc, F.array(F.struct(x["window_no"].cast("bigint").alias("window_no"), x["mode"].alias("mode")))),
    )
    listed = windows.groupBy(*keys).agg(folded.alias("w"))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.size("w")),
        F.array().cast("array<string>"),
        lambda acc, i: F.concat(
            acc,
            F.array(
                F.when((i > 1) & (i < F.size("w")) & (F.try_element_at(acc, i - 1) == F.try_element_at("w", i + 1)["mode"]), F.try_element_at(acc, i - 1)).otherwise(F.element_at("w", i)["mode"])
            ),
        ),
    )
    out = listed.withColumn("m", walked).select(*keys, F.explode(F.arrays_zip(F.col("w.window_no").alias("window_no"), F.col("m").alias("mode"))).alias("x"))
    return out.select(*keys, "x.window_no", "x.mode")


def mode_at(points: DataFrame, windows: DataFrame, keys: list[str], point_id: str, width: float | None = None) -> DataFrame:
    """Each point's mode: of the first window that holds it, the last window's after the end, else B; with a ``width``, points meet windows in buckets of that many seconds."""
    w = windows.select(*keys, "window_no", "start", "end", "mode")
    met = meet(points.select(*keys, point_id, "t"), w, keys, (F.col("t"), F.col("t")), (F.col("start"), F.col("end")), width)
    own = met.filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).groupBy(*keys, point_id).agg(F.min_by("mode", "window_no").alias("own_"))
    last = w.groupBy(*keys).agg(F.max("end").alias("over_"), F.max_by("mode", "window_no").alias("final_"))
    out = points.join(own, [*keys, point_id], "left").join(last, keys, "left")
    mode = F.coalesce("own_", F.when(F.col("t") >= F.col("over_"), F.col("final_")), F.lit("B"))
    return out.withColumn("mode", mode).drop("own_", "over_", "final_")


def build_record(rows: DataFrame, keys: list[str], ink: str, motion: str) -> DataFrame:
    """(keys, n, ink_first, ink_last, steps, pan, is_build): whether a picture is built up step by step.

    Of the steps a to b, those with b >= 0.98 a do not fall and those with a > 0, b > 1.05 a
    are build steps. A build does not fall in 80 % of its steps, starts above 0 and grows by 15 %.
    Runs of under 3 rows, and pans (over 20 % of the rows with ``motion`` above 0.03), are none.
    """
    by = Window.partitionBy(*keys).orderBy("t", "pos")
    s = rows.withColumn("a", F.lag(ink).over(by))
    place = F.struct("t", "pos")
    out = s.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min_by(ink, place).alias("ink_first"),
        F.max_by(ink, place).alias("ink_last"),
        F.avg(F.when(F.col("a").isNotNull(), F.when(F.col(ink) >= F.col("a") * 0.98, 1.0).otherwise(0.0))).alias("monotone"),
        F.count_if((F.col("a") > 0) & (F.col(ink) > F.col("a") * 1.05)).alias("steps"),
        (F.avg(F.when(F.col(motion) > 0.03, 1.0).otherwise(0.0)) > 1 - 0.80).alias("pan"),
    )
    real = (F.col("n") >= 3) & ~F.col("pan")
    grown = (F.col("monotone") >= 0.80) & (F.col("ink_first") > 0) & (F.col("ink_last") >= 1.15 * F.col("ink_first"))
    return out.select(*keys, "n", "ink_first", "ink_last", F.when(real, F.col("steps")).otherwise(0).alias("steps"), "pan", (real & grown).alias("is_build"))


def settled(rows: DataFrame, keys: list[str], change: str, most: float = 0.004) -> DataFrame:
    """``rows`` plus ``settled``: two consecutive changes of at most ``most``; in keys without any, one such change is enough."""
    by = Window.partitionBy(*keys).orderBy("t", "pos")
    small = F.coalesce(F.col(change) <= most, F.lit(False))
    rows = rows.withColumn("one_", small).withColumn("two_", small & F.coalesce(F.lag(small).over(by), F.lit(False)))
    any_two = F.max("two_").over(Window.partitionBy(*keys))
    return rows.withColumn("settled", F.when(any_two, F.col("two_")).otherwise(F.col("one_"))).drop("one_", "two_")


def representative(rows: DataFrame, keys: list[str], mode: str, ink: str) -> DataFrame:
    """(keys, t, first_settled, last_settled, max_ink): the last settled time, or in mode C the one with most ink among the settled rows of the last third (all settled rows, the last row, where there is none)."""
    by = Window.partitionBy(*keys)
    rows = rows.withColumn("i", F.row_number().over(by.orderBy("t", "pos")) - 1).withColumn("n", F.count("*").over(by))
    late = F.col("settled") & (F.col("i") >= F.floor(F.col("n") * 2 / 3))
    most = lambda x: F.max_by("t", F.when(x, F.struct(F.col(ink), (-F.col("i")).alias("i"))))
    out = rows.groupBy(*keys).agg(
        F.max(mode).alias("mode_"),
        F.coalesce(most(late), most(F.col("settled")), F.max_by("t", "i")).alias("inked"),
        F.coalesce(F.min_by("t", F.when(F.col("settled"), F.col("i"))), F.min_by("t", "i")).alias("first_settled"),
        F.coalesce(F.max_by("t", F.when(F.col("settled"), F.col("i"))), F.max_by("t", "i")).alias("last_settled"),
        most(F.lit(True)).alias("max_ink"),
    )
    return out.select(*keys, F.when(F.col("mode_") == "C", F.col("inked")).otherwise(F.col("last_settled")).alias("t"), "first_settled", "last_settled", "max_ink")


def stable_terminal(rows: DataFrame, anchors: DataFrame, keys: list[str], value: str, flip: float = 0.15, settle: float = 0.20) -> DataFrame:
    """(keys, terminal_t, run_start, stop, flipped, build_steps, events, step_tau): where a picture stops being built up.

    Scores from step_tau = max(0.015, median + 6 * MAD) are events; those from ``flip`` cut.
    The run that holds the anchor starts at the last cut at or before it (or lo) and stops at
    the next (or hi); the terminal is ``settle`` before that cut, else 0.25 before hi, kept
    within the run. ``anchors`` has one row a key with anchor, lo, hi. Times to 3 places.
    """
    tau = robust_threshold(rows, keys, value, 0.015, 6.0).select(*keys, F.col("threshold").alias("tau"))
    s = rows.select(*keys, "t", value).join(tau, keys).join(anchors.select(*keys, "anchor", "lo", "hi"), keys)
    cut = (F.col(value) >= F.col("tau")) & (F.col(value) >= flip)
    own = [*keys, "anchor", "lo", "hi", "tau"]
    e = s.groupBy(*own).agg(F.max(F.when(cut & (F.col("t") <= F.col("anchor")), F.col("t"))).alias("before"), F.min(F.when(cut & (F.col("t") > F.col("anchor")), F.col("t"))).alias("after"))
    start = F.greatest("lo", F.coalesce("before", "lo"))
    stop = F.coalesce("after", "hi")
    wanted = F.when(F.col("after").isNotNull(), F.col("after") - settle).otherwise(F.col("hi") - 0.25)
    e = e.withColumn("run_start", start).withColumn("stop", stop).withColumn("terminal", F.greatest("run_start", F.least(wanted, F.col("hi")))).withColumn("flipped", F.col("after").isNotNull())
    event = F.col(value) >= F.col("tau")
    step = event & (F.col(value) < flip) & (F.col("t") >= F.col("run_start")) & (F.col("t") < F.col("stop"))
    met = s.join(e.drop("before", "after"), own)
    return met.groupBy(*keys, F.round("terminal", 3).alias("terminal_t"), F.round("run_start", 3).alias("run_start"), F.round("stop", 3).alias("stop"), "flipped", F.round("tau", 4).alias("step_tau")).agg(
        F.count_if(step).alias("build_steps"), F.count_if(event).alias("events")
    )


def sharpest_near(rows: DataFrame, keys: list[str], t0: str, blur: str, eligible: Column, better: float = 0.10) -> DataFrame:
    """(keys, t, moved): the sharpest row of the eligible stretch around the row nearest to ``t0``.

    A row counts if ``eligible`` and its blur is finite and positive. The choice moves only if
    it is ``better`` as a share; the nearest row stays otherwise, and where it is not eligible.
    """
    by = Window.partitionBy(*keys).orderBy("t")
    ok = eligible & ~F.isnan(blur) & (F.col(blur) > 0) & (F.col(blur) < float("inf"))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("far", F.abs(F.col("t") - F.col(t0)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.min(F.struct("far", "t", "run", "ok", F.col(blur).alias("b"))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("near", near)
    mine = rows.filter(F.col("ok") & F.col("near.ok") & (F.col("run") == F.col("near.run")))
    best = mine.groupBy(*keys).agg(F.min(F.struct(F.col(blur).alias("b"), "far", "t")).alias("best"))
    base = rows.groupBy(*keys).agg(F.first("near").alias("near"))
    moved = F.coalesce(F.col("best.b") <= F.col("near.b") * (1 - better), F.lit(False))
    return base.join(best, keys, "left").select(*keys, F.when(moved, F.col("best.t")).otherwise(F.col("near.t")).alias("t"), moved.alias("moved"))
