"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small, spare

BITS = 64
#: Fixed-point one of the shingle weights.
ONE = 1000


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, size: Column) -> Column:
    """A 64-bit hash of every ``size`` consecutive words; ``size`` must be 1 or more and at most the words there are."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: F.xxhash64(F.slice(words, i, size)))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The SimHash ``code`` of each group of ``rows`` (keys, h, w): for each of 64 bits, whether the weights of the shingles that have it outweigh the others'.

    A native aggregation: one sum a bit, made before the shuffle as far as rows of a group stand together.
    """
    bits = [F.sum(F.when(F.getbit("h", F.lit(b)) == 1, F.col("w")).otherwise(-F.col("w"))).alias(f"b{b}") for b in range(BITS)]
    code = F.lit(0).cast("long")
    for b in range(BITS):
        code = code.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.groupBy(*keys).agg(*bits).select(*keys, code.alias("code"))


def blocks_of(code: Column, radius: int) -> Column:
    """``radius`` + 1 blocks of a fingerprint, each with its number: codes within the radius share one."""
    n = radius + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.struct(F.lit(i).alias("at"), F.shiftrightunsigned(code, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def benchmark_items(benchmark: DataFrame, size: int, radius: int) -> DataFrame:
    """item (a number), item_id, m (words), k (words of a shingle), shingles, the distinct ones with count and weight, code, blocks.

    The weight of a shingle is ln(1 + items / items that hold it), in thousandths; ``top`` is
    that of one that a single item holds. Items without a word are left out; shorter ones than
    ``size`` words have one shingle of all. Different texts with one item_id are items of
    their own; repeated rows are one.
    """
    items = benchmark.filter("item_id IS NOT NULL").select("item_id", words_of(F.col("text")).alias("words")).distinct()
    items = items.withColumn("m", F.size("words")).filter("m > 0").withColumn("k", F.least(F.lit(size), "m")).withColumn("item", F.monotonically_increasing_id())
    items = checkpointed(items.withColumn("shingles", shingles_of(F.col("words"), F.col("k"))).drop("words"))
    one = items.select("item", "item_id", F.explode("shingles").alias("h")).groupBy("item", "item_id", "h").agg(F.count("*").alias("c"))
    held = one.groupBy("h").agg(F.countDistinct("item_id").alias("df"))
    total = items.agg(F.countDistinct("item_id").alias("items"))
    weight = F.round(F.log(1 + F.col("items") / F.col("df")) * ONE).cast("long")
    full = one.join(held, "h").crossJoin(F.broadcast(total)).withColumn("w", weight).withColumn("top", F.round(F.log(1 + F.col("items")) * ONE).cast("long"))  # total: one row
    full = checkpointed(full)
    codes = fingerprints(full.select("item", "h", F.explode(F.array_repeat("w", F.col("c").cast("int"))).alias("w")), ["item"])
    packed = full.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("h", "c", "w"))).alias("bag"), F.max("top").alias("top"))
    return items.join(packed, "item").join(codes, "item").withColumn("blocks", blocks_of(F.col("code"), radius))


def similarity(shingles: Column, bag: Column, top: Column) -> tuple[Column, Column]:
    """Weighted Jaccard of a window's and an item's shingles as multisets: numerator and denominator, in thousandths.

    A shingle that the item does not hold weighs as much as one that a single item holds.
    """
    counted = F.transform(bag, lambda b: F.struct(b["w"].alias("w"), b["c"].alias("c"), F.size(F.filter(shingles, lambda h: h == b["h"])).alias("d")))
    total = lambda f: F.aggregate(counted, F.lit(0).cast("long"), lambda s, x: s + f(x))
    both = total(lambda x: x["w"] * F.least(x["c"], x["d"]))
    either = total(lambda x: x["w"] * F.greatest(x["c"], x["d"]))
    other = F.size(shingles) - total(lambda x: x["d"].cast("long"))
    return both, either + other * top


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, percent: int = 80, radius: int = 20) -> DataFrame:
    """(doc_id, text_key, item_id, start, similarity): windows of ``docs`` that hold a benchmark item.

    A window has as many words as the item, or is the whole text if that is shorter; it may
    start at any word. Fingerprints of windows and items of one size meet if they share one of
    ``radius`` + 1 blocks, which misses none within the radius; those at most ``radius`` apart
    are verified by exact weighted-shingle similarity (at least ``percent``). At a similarity of
    0.8 a fingerprint differs in 10 bits of 64 on average (standard deviation 2.9), so a
    radius of 20 leaves out 1 in 10,000 at the very threshold.

    No window is fingerprinted that cannot reach ``percent``: as no shingle outweighs an unknown
    one, ``percent`` of its shingles at least must be the item's own. Windows with so many are
    read off the places where shingles of items stand in a text, whatever their order.
    text_key is a hash of the text, for rows that repeat an id.
    """
    items = checkpointed(benchmark_items(benchmark, size, radius))
    anchors = items.select("item", "m", "k", F.explode(F.array_distinct("shingles")).alias("h"))
    sizes = [r.k for r in items.select("k").distinct().limit(size).collect()]  # 1 to ``size``
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    texts = texts.withColumn("n", F.size("words"))
    parts = [
        texts.filter(F.col("n") >= k).select("doc_id", "text_key", "n", F.lit(k).alias("k"), F.posexplode(shingles_of(F.col("words"), F.lit(k))).alias("at", "h")) for k in sorted(sizes)
    ]
    if not parts:
        parts = [texts.select("doc_id", "text_key", "n", F.lit(size).alias("k"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("h")).filter(F.lit(False))]
    seen = parts[0]
    for p in parts[1:]:
        seen = seen.unionByName(p)
    met = seen.join(small(anchors), ["k", "h"]).groupBy("doc_id", "text_key", "n", "k", "m", "item").agg(F.array_sort(F.collect_set("at")).alias("places"))
    # Runs of as many places as a window needs, and the starts of the windows that hold one.
    met = met.withColumn("need", F.ceil((F.least("n", "m") - F.col("k") + 1) * percent / 100).cast("int")).filter(F.size("places") >= F.col("need"))
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    run = lambda j: F.struct(F.greatest(F.lit(0), F.least(last, F.element_at("places", j + F.col("need") - 1) - F.col("m") + F.col("k"))).alias("low"), F.least(last, F.element_at("places", j)).alias("high"))
    runs = F.filter(F.transform(F.sequence(F.lit(1), F.size("places") - F.col("need") + 1), run), lambda r: r["low"] <= r["high"])
    starts = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(r["low"], r["high"]))))
    spots = met.select("doc_id", "text_key", "k", "m", F.explode(starts).alias("start")).distinct()
    spots = checkpointed(spots.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("k", "m", "start")).alias("spots")))
    rows = _of(docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text")), spots, "left_semi").dropDuplicates(["doc_id", "text_key"])
    spots = spots.withColumnRenamed("text_key", "key_").withColumnRenamed("doc_id", "id_")
    rows = rows.join(spots, (F.col("text_key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")))
    rows = rows.select("doc_id", "text_key", words_of(F.col("text")).alias("words"), "spots")
    windows = rows.select("doc_id", "text_key", "words", F.explode("spots").alias("s")).select("doc_id", "text_key", "s.m", "s.k", "s.start", F.slice("words", F.col("s.start") + 1, F.col("s.m")).alias("words"))
    windows = windows.withColumn("shingles", shingles_of(F.col("words"), F.col("k"))).drop("words").withColumn("window", F.monotonically_increasing_id())
    return _verified(checkpointed(windows), items, percent, radius)


def _verified(windows: DataFrame, items: DataFrame, percent: int, radius: int) -> DataFrame:
    """Windows whose fingerprint is near an item's and whose similarity is high enough."""
    weights = items.select(F.explode("bag").alias("b")).select("b.h", "b.w").distinct()
    top = items.agg(F.max("top").alias("top"))
    shingles = windows.select("window", F.explode("shingles").alias("h")).join(small(weights), "h", "left").crossJoin(F.broadcast(top))  # one row
    codes = fingerprints(shingles.select("window", "h", F.coalesce("w", "top").alias("w")), ["window"])
    probes = windows.select("window", "m").join(codes, "window").select("window", "m", "code", F.explode(blocks_of(F.col("code"), radius)).alias("block"))
    index = items.select("item", "m", F.col("code").alias("item_code"), F.explode("blocks").alias("block"))
    near = probes.join(small(index), ["m", "block"]).filter(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= radius).select("window", "item").distinct()
    pairs = windows.join(near, "window").join(items.select("item", "item_id", "bag", "top"), "item")
    both, either = similarity(F.col("shingles"), F.col("bag"), F.col("top"))
    return (
        pairs.select("doc_id", "text_key", "item_id", "start", both.alias("both"), either.alias("either"))
        .filter(F.col("both") * 100 >= F.col("either") * percent)
        .select("doc_id", "text_key", "item_id", "start", (F.col("both") / F.col("either")).alias("similarity"))
    )


def _of(rows: DataFrame, found: DataFrame, how: str, key: str = "text_key") -> DataFrame:
    """The ``rows`` that ``found`` (doc_id, text_key) names, or the others; two numbers a row are broadcast while they are few."""
    id_, key_ = spare(rows, "found_id", "found_key")
    keys = small(found.select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_)).distinct())
    return rows.join(keys, (F.col(key) == F.col(key_)) & F.col("doc_id").eqNullSafe(F.col(id_)), how)


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a window that holds a benchmark item. All columns stay.

    Null and empty texts stay, and all rows where the benchmark is empty. Repeated rows fare
    alike; rows without an id, or that share one, are judged by their own text.
    """
    (key,) = spare(docs, "text_key")
    found = contaminated(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), **how)
    return _of(docs.withColumn(key, F.xxhash64("text")), found, "left_anti", key).drop(key)


def contamination(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id, n_items, item_ids, similarity, kept for every row of ``docs`` (doc_id, text).

    kept is false if a window of the text matches a benchmark item (item_id, text); item_ids
    lists those, similarity is the best (0 without one, rounded to 6 places). Null and empty
    texts and an empty benchmark give no match. Repeated rows each get their own equal result;
    rows without an id, or that share one, go by their own text. Item rows without an id are
    left out; texts that share an item_id are items of their own under one name. Very long
    texts are whole; equally similar windows count alike.
    """
    docs = docs.select("doc_id", "text")
    best = contaminated(docs, benchmark, **how).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    best = checkpointed(best).withColumnRenamed("doc_id", "id_").withColumnRenamed("text_key", "key_")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(best, (F.col("text_key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("id_")), "left")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity"),
        F.col("item_ids").isNull().alias("kept"),
    )
