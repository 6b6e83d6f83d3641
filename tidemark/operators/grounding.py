"""Audits of a whole summary: ownership, shares of chapters and transcripts, length, glossary, captions; and what an audit is bound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import format_clock, image_tokens
from tidemark.operators.audit import finding
from tidemark.operators.runs import mode_guess

#: Seconds a citation may lie outside its chapter; words a minute; least share of a transcript.
TOLERANCE, WORDS_A_MINUTE, LEAST_SHARE = 5.0, (50, 200), 0.15
#: Chapters of so many segments must have so large a share of them cited.
CHAPTER_SEGMENTS, CHAPTER_SHARE = 8, 0.20


def _cited(blocks: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    c = blocks.select(*keys, "chapter_id", "block_no", F.explode("seg_ids").alias("seg_id")).distinct()
    return c.join(segments.select(*keys, "seg_id", F.col("start").alias("s_"), F.col("end").alias("e_")), [*keys, "seg_id"])


def ownership_rules(blocks: DataFrame, segments: DataFrame, chapters: DataFrame, keys: list[str], tolerance: float = TOLERANCE) -> DataFrame:
    """Blocks (chapter_id, block_no, seg_ids) that cite a segment more than ``tolerance`` seconds outside their chapter: one finding a block, with how many.

    Blocks of unknown chapters and citations of unknown segments have none.
    """
    c = _cited(blocks, segments, keys).join(chapters.select(*keys, "chapter_id", "start", "end"), [*keys, "chapter_id"])
    outside = (F.col("e_") < F.col("start") - tolerance) | (F.col("s_") > F.col("end") + tolerance)
    bad = c.filter(outside).groupBy(*keys, "chapter_id", "block_no").agg(F.count("*").alias("n"))
    where = F.concat_ws("/", "chapter_id", F.col("block_no").cast("string"))
    return finding(bad, keys, F.lit(True), "errors", "ownership", where, F.concat(F.col("n").cast("string"), F.lit(" segments lie outside the chapter")))


def chapter_shares(blocks: DataFrame, placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chapter_id, inside, own): a chapter's segments and how many of them its own blocks cite; ``placed`` has chapter_id and seg_id."""
    own = blocks.select(*keys, "chapter_id", F.explode("seg_ids").alias("seg_id")).distinct().withColumn("own_", F.lit(1))
    p = placed.select(*keys, "chapter_id", "seg_id").distinct().join(own, [*keys, "chapter_id", "seg_id"], "left")
    return p.groupBy(*keys, "chapter_id").agg(F.count("*").alias("inside"), F.count("own_").alias("own"))


def chapter_share_rules(shares: DataFrame, keys: list[str], least: int = CHAPTER_SEGMENTS, share: float = CHAPTER_SHARE) -> DataFrame:
    thin = (F.col("inside") >= least) & (F.col("own") / F.col("inside") < share)
    return finding(shares, keys, thin, "reviews", "chapter-coverage", F.col("chapter_id"), F.concat(F.col("own").cast("string"), F.lit(" of "), F.col("inside").cast("string"), F.lit(" segments cited")))


def summary_statistics(blocks: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segments, cited_segments, coverage, words, hebrew_ratio) for every key with segments.

    coverage: the share of segments that any block cites, to 3 places; words: of all blocks,
    parted by blanks; hebrew_ratio: Hebrew letters among Hebrew and Latin ones, to 3 places.
    """
    count = lambda p: F.sum(F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p)))
    known = segments.select(*keys, "seg_id").distinct()
    cited = blocks.select(*keys, F.explode("seg_ids").alias("seg_id")).distinct().withColumn("c_", F.lit(1))
    n = known.join(cited, [*keys, "seg_id"], "left").groupBy(*keys).agg(F.count("*").alias("segments"), F.count("c_").alias("cited_segments"))
    w = blocks.groupBy(*keys).agg(count(r"\S+").alias("w_"), count("[א-ת]").alias("he_"), count("[A-Za-z]").alias("la_"))
    n = n.join(w, keys, "left").fillna(0, ["w_", "he_", "la_"])
    ratio = F.col("he_") / F.greatest(F.lit(1), F.col("he_") + F.col("la_"))
    return n.select(*keys, "segments", "cited_segments", F.round(F.col("cited_segments") / F.col("segments"), 3).alias("coverage"), F.col("w_").alias("words"), F.round(ratio, 3).alias("hebrew_ratio"))


def length_rules(statistics: DataFrame, keys: list[str], wpm: tuple[float, float] = WORDS_A_MINUTE, least: float = LEAST_SHARE) -> DataFrame:
    """Statistics with the recording's ``duration`` (0 or null: unknown): words a minute out of range, too few segments cited."""
    rate = F.try_divide(F.col("words") * 60, F.col("duration"))
    odd = finding(statistics, keys, (F.col("duration") > 0) & ~rate.between(*wpm), "warnings", "length", F.lit("summary"), F.concat(F.round(rate, 0).cast("bigint").cast("string"), F.lit(" words a minute")))
    few = finding(statistics, keys, F.col("coverage") < least, "reviews", "coverage", F.lit("summary"), F.lit("few segments are cited"))
    return odd.unionByName(few)


def glossary_rules(texts: DataFrame, glossary: DataFrame, keys: list[str]) -> DataFrame:
    """Terms (term, form) of a glossary that stand as words of their own in any text although their form is another one, in Hebrew. One finding a term."""
    g = glossary.filter((F.col("term") != F.col("form")) & F.col("form").rlike("[א-ת]")).select(*keys, "term", "form")
    alone = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(F.col("term"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    used = texts.select(*keys, "text").join(g, keys).filter(F.contains("text", F.col("term")) & F.regexp_like("text", alone)).select(*keys, "term", "form").distinct()
    return finding(used, keys, F.lit(True), "warnings", "glossary", F.lit("summary"), F.concat(F.col("term"), F.lit(" is used for "), F.col("form")))


def caption_rules(captions: DataFrame, keys: list[str], lang: str) -> DataFrame:
    """Captions (id, text) of a Hebrew summary without a Hebrew letter; blank ones have no finding."""
    bare = (F.trim(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce("text", F.lit("")).rlike("[א-ת]")
    return finding(captions, keys, bare & F.lit(lang == "he"), "errors", "caption", F.col("id"), F.lit("not in Hebrew"))


def audit_bindings(files: DataFrame, keys: list[str], langs: DataFrame) -> DataFrame:
    """(keys, inputs): what an audit has judged, as a map of the five tables' hashes and the language; null where there is none.

    ``files`` has name (summary, selections, transcript, chapters, candidates) and sha256; of a repeated name the greatest hash counts.
    """
    names = ("summary", "selections", "transcript", "chapters", "candidates")
    one = files.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("sha256"))).alias(n) for n in names])
    x = langs.select(*keys, "lang").join(one, keys, "left")
    pairs = [v for n in names for v in (F.lit(f"{n}_sha256"), F.col(n))]
    return x.select(*keys, F.create_map(*pairs, F.lit("lang"), F.col("lang")).alias("inputs"))


def normalised_chapters(chapters: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters (chapter_id, pos, needs_frames, visual_targets, cues) with defaults: ids ch01, ch02, ... by place, needs_frames false where it is not true, and older ``cues`` (kind null: state) as targets where there are none."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    own = F.when(F.coalesce("chapter_id", F.lit("")) != "", F.col("chapter_id")).otherwise(F.format_string("ch%02d", place))
    old = F.transform(F.coalesce("cues", F.col("visual_targets"), F.array().cast(dict(chapters.dtypes)["cues"])), lambda c: c.withField("kind", F.coalesce(c["kind"], F.lit("state"))))
    targets = F.when(F.coalesce(F.size("visual_targets"), F.lit(0)) > 0, F.col("visual_targets")).otherwise(old)
    return chapters.withColumn("chapter_id", own).withColumn("needs_frames", F.coalesce("needs_frames", F.lit(False))).withColumn("visual_targets", targets).drop("cues")


def probe_refusal(spans: Column, reason: Column) -> Column:
    """What is said when a probe contradicts the decision that nothing is shown: its spans (else its reason), and the reason."""
    shown = F.when(F.coalesce(spans, F.lit("")) != "", spans).otherwise(reason)
    return F.concat(F.lit("the probe contradicts the decision against pictures: "), F.coalesce(shown, F.lit("")), F.lit("; "), F.coalesce(reason, F.lit("")))


def spans_with_chapters(spans: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """(keys, text): the first spans (start, end, chapter_ids) as "mm:ss-mm:ss (c1, c2)", joined by ", "; the number is part of the message."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end"))
    named = F.when(F.size("chapter_ids") > 0, F.concat(F.lit(" ("), F.array_join("chapter_ids", ", "), F.lit(")"))).otherwise("")
    one = spans.withColumn("rn", rn).filter(F.col("rn") <= most).withColumn("x", F.concat(format_clock(F.col("start")), F.lit("-"), format_clock(F.col("end")), named))
    return one.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "x"))), lambda r: r["x"]), ", ").alias("text"))


def shortlist_receipt(asked: DataFrame, keys: list[str], near: Column) -> DataFrame:
    """(keys, written, failures, image_tokens) of a shortlist whose pictures were decoded again (id, pos, width, height).

    Where ``near`` is not true the picture is another one than the candidate's: such ids are failures.
    """
    same = F.coalesce(near, F.lit(False))
    one = asked.select(*keys, "id", "pos", same.alias("same"), F.when(same, image_tokens(F.col("width"), F.col("height"))).alias("cost"))
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("pos", "id")))), lambda r: r["id"])
    return one.groupBy(*keys).agg(listed(F.col("same")).alias("written"), listed(~F.col("same")).alias("failures"), F.coalesce(F.sum("cost"), F.lit(0)).alias("image_tokens"))


def selection_failures(selected: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Selections (pos, id, chapter_id) whose id no candidate has, or that name another chapter than their candidate's."""
    x = selected.select(*keys, "pos", "id", "chapter_id").join(candidates.select(*keys, "id", F.col("chapter_id").alias("own_"), F.lit(True).alias("known_")), [*keys, "id"], "left")
    moved = (F.coalesce("chapter_id", F.lit("")) != "") & ~F.col("chapter_id").eqNullSafe(F.col("own_"))
    unknown = finding(x, keys, F.col("known_").isNull(), "errors", "candidate", F.col("pos"), F.concat(F.lit("unknown "), F.col("id").cast("string")))
    return unknown.unionByName(finding(x, keys, F.col("known_") & moved, "errors", "chapter", F.col("pos"), F.concat(F.lit("belongs to "), F.coalesce("own_", F.lit("no chapter")))))


def annotation_draft(states: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, state_id, start, end, class, kind, spoken, tiles) of a draft: states (pos, start, end, tiles) to be reviewed, with a guess from their tiles (index, t, luma, edge, diff).

    A state's end is moved by the step between the first two tiles, as its last tile stands for the time up to the next.
    """
    step = tiles.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", "t"))).alias("a")).select(*keys, F.coalesce(F.get("a", 1)["t"] - F.get("a", 0)["t"], F.lit(0.0)).alias("step"))
    members = states.select(*keys, "pos", F.explode("tiles").alias("index")).join(tiles.select(*keys, "index", "luma", "edge", "diff"), [*keys, "index"])
    kind = mode_guess(members, [*keys, "pos"]).withColumnRenamed("guess", "kind")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    s = states.withColumn("state_id", F.format_string("s%02d", place)).join(step, keys, "left").join(kind, [*keys, "pos"], "left")
    return s.select(*keys, "state_id", "start", F.round(F.col("end") + F.coalesce("step", F.lit(0.0)), 3).alias("end"), F.lit("unreviewed").alias("class"), "kind", F.array().cast("array<string>").alias("spoken"), "tiles")
