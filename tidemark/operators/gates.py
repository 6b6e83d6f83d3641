"""Gates: what each evidence table must satisfy before the next step, as findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.clock import format_clock
from tidemark.operators.audit import duplicate_ids, finding, union, unknown_references


def transcript_rules(transcripts: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Transcripts (status, source) and their segments (seg_id, pos, start, end, text): status, presence, ids, times, order, text."""
    by = Window.partitionBy(*keys).orderBy("pos")
    s = segments.withColumn("before", F.lag("start").over(by))
    n = transcripts.join(segments.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left")
    at, say = F.col("seg_id"), F.lit
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return union(
        [
            finding(n, keys, ~F.coalesce(F.col("status").isin("ok", "thin", "partial"), F.lit(False)), "errors", "status", say("transcript"), F.concat(say("status is "), F.coalesce("status", say("missing")))),
            finding(n, keys, F.coalesce("n", F.lit(0)) == 0, "errors", "empty", say("transcript"), say("no segments")),
            duplicate_ids(segments, keys, "seg_id"),
            finding(s, keys, F.col("seg_id").isNull(), "errors", "id", F.col("pos"), say("no id")),
            finding(s, keys, ~(finite("start") & finite("end")), "errors", "time", at, say("times must be numbers")),
            finding(s, keys, F.col("end") <= F.col("start"), "warnings", "empty", at, say("end must be after start")),
            finding(s, keys, F.col("start") < F.col("before"), "errors", "order", at, say("not in chronological order")),
            finding(s, keys, F.trim(F.coalesce("text", say(""))) == "", "warnings", "text", at, say("no text")),
        ]
    )


def candidate_rules(pools: DataFrame, coverage: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Pools (bound and current hashes, decided_by) with their coverage (id, status) and probe verdict: stale input, unresolved chapters, a decision against pictures that the probe contradicts.

    A contradiction is an error if a model decided, a warning if a person did.
    """
    p = pools.join(verdicts.select(*keys, "verdict"), keys, "left")
    against = (F.col("verdict") == "contradicts") & ~F.col("any_frames")
    say = F.lit
    return union(
        [
            finding(p, keys, ~F.col("bound_sha256").eqNullSafe(F.col("current_sha256")), "errors", "stale", say("candidates"), say("made from other inputs")),
            finding(coverage, keys, F.col("status") == "unresolved", "errors", "coverage", F.col("id"), say("needs pictures and has none")),
            finding(p, keys, against & (F.col("decided_by") != "user"), "errors", "probe", say("chapters"), say("the probe saw still pictures")),
            finding(p, keys, against & (F.col("decided_by") == "user"), "warnings", "probe", say("chapters"), say("the probe saw still pictures")),
        ]
    )


def summary_rules(summary: DataFrame, chapters: DataFrame, blocks: DataFrame, keys: list[str], languages: tuple[str, ...] = ("en", "he")) -> DataFrame:
    """Summaries (lang, overview), their chapters and blocks (chapter_id, block_no, text, kind, seg_ids): language, presence, kinds, citations."""
    missing = chapters.select(*keys, "chapter_id").join(blocks.select(*keys, "chapter_id").distinct(), [*keys, "chapter_id"], "left_anti")
    foreign = blocks.select(*keys, "chapter_id").distinct().join(chapters.select(*keys, "chapter_id"), [*keys, "chapter_id"], "left_anti")
    at, say = F.concat_ws("/", "chapter_id", F.col("block_no").cast("string")), F.lit
    return union(
        [
            finding(summary, keys, ~F.coalesce(F.col("lang").isin(*languages), F.lit(False)), "errors", "language", say("summary"), say("unknown language")),
            finding(summary, keys, F.trim(F.coalesce("overview", say(""))) == "", "warnings", "overview", say("summary"), say("no overview")),
            finding(missing, keys, F.lit(True), "errors", "chapter-coverage", F.col("chapter_id"), say("no blocks")),
            finding(foreign, keys, F.lit(True), "errors", "reference", F.col("chapter_id"), say("unknown chapter")),
            finding(blocks, keys, F.trim(F.coalesce("text", say(""))) == "", "errors", "text", at, say("no text")),
            finding(blocks, keys, ~F.coalesce("kind", say("prose")).isin("prose", "code", "quote"), "errors", "kind", at, say("unknown kind")),
            finding(blocks, keys, F.coalesce(F.size("seg_ids"), F.lit(0)) <= 0, "errors", "citation", at, say("cites nothing")),
        ]
    )


def brief_rules(items: DataFrame, segments: DataFrame, keys: list[str]) -> DataFrame:
    """Brief items (section, pos, text, seg_ids): one synthesis, text, citations that exist and come in the recording's order."""
    where = F.concat_ws("/", "section", F.col("pos").cast("string"))
    i = items.withColumn("at", where)
    one = items.groupBy(*keys).agg(F.count_if(F.col("section") == "synthesis").alias("n"))
    cited = i.select(*keys, "at", F.posexplode("seg_ids").alias("i", "seg_id")).join(segments.select(*keys, "seg_id", F.col("pos").alias("place")), [*keys, "seg_id"])
    moved = cited.withColumn("before", F.lag("place").over(Window.partitionBy(*keys, "at").orderBy("i"))).filter("place < before").select(*keys, "at").distinct()
    say = F.lit
    return union(
        [
            finding(one, keys, F.col("n") != 1, "errors", "brief", say("brief"), say("needs one synthesis")),
            finding(i, keys, ~F.coalesce(F.col("section").isin("synthesis", "main_points", "takeaways"), F.lit(False)), "errors", "brief", F.col("at"), say("unknown section")),
            finding(i, keys, F.trim(F.coalesce("text", say(""))) == "", "errors", "brief", F.col("at"), say("no text")),
            finding(i, keys, F.coalesce(F.size("seg_ids"), F.lit(0)) <= 0, "errors", "brief", F.col("at"), say("cites nothing")),
            unknown_references(i, segments, keys, "seg_ids", "seg_id", "at"),
            finding(moved, keys, F.lit(True), "errors", "order", F.col("at"), say("citations out of order")),
        ]
    )


def manifest_rules(manifests: DataFrame, keys: list[str], inputs: tuple[str, ...]) -> DataFrame:
    """Manifests with recorded and current hashes (maps): every named input must be bound to what there is now."""
    x = manifests.withColumn("input", F.explode(F.array(*map(F.lit, inputs))))
    old, new = F.try_element_at("recorded", F.col("input")), F.try_element_at("current", F.col("input"))
    return union(
        [
            finding(x, keys, old.isNull(), "errors", "binding", F.col("input"), F.lit("not recorded")),
            finding(x, keys, old.isNotNull() & ~old.eqNullSafe(new), "errors", "stale", F.col("input"), F.lit("changed since")),
        ]
    )


def partial_accepted(transcripts: DataFrame, approvals: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, accepted): partial transcripts (fingerprint) whose very fingerprint was approved; whole ones need no approval."""
    ok = approvals.select(*keys, F.col("fingerprint").alias("approved"))
    x = transcripts.join(ok, keys, "left")
    return x.groupBy(*keys).agg(F.max((F.col("status") != "partial") | F.coalesce(F.col("approved") == F.col("fingerprint"), F.lit(False))).alias("accepted"))


def partial_fingerprint(status: Column, chunks: Column) -> Column:
    """SHA-256 of what is missing: status and the sorted failed chunks."""
    return F.sha2(F.to_json(F.struct(F.array_sort(chunks).alias("chunks"), status.alias("status"))), 256)


def spans_text(spans: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """(keys, text): the times of the first spans in order, "mm:ss-mm:ss, ..."."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("start"))
    one = spans.withColumn("rn", rn).filter(F.col("rn") <= most).withColumn("x", F.concat(format_clock(F.col("start")), F.lit("-"), format_clock(F.col("end"))))
    return one.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "x"))), lambda r: r["x"]), ", ").alias("text"))


def report_rows(findings: DataFrame, checks: list[str], keys: list[str], scope: DataFrame) -> DataFrame:
    """(keys, check, status): FAIL with an error, WARN with anything else, PASS without a finding, for every check and key of ``scope``."""
    worst = findings.groupBy(*keys, "check").agg(F.max(F.when(F.col("level") == "errors", 2).otherwise(1)).alias("x"))
    every = scope.select(*keys).distinct().withColumn("check", F.explode(F.array(*map(F.lit, checks))))
    return every.join(worst, [*keys, "check"], "left").select(*keys, "check", F.when(F.col("x") == 2, "FAIL").when(F.col("x") == 1, "WARN").otherwise("PASS").alias("status"))
