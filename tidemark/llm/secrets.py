"""Secret scans: Boolean trigram queries derived from each rule pick the texts that the rule's regex verifies."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small, spare

#: Alternatives that an exact set of strings may have before it counts as unknown.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base rules, in their order.
BASE = (
    Rule("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}+", 0, 24),
)
#: Further rules of public formats.
FURTHER = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _strings_query(strings: set[str]) -> tuple | None:
    """Texts that hold one of the strings hold ... (None: no demand can be made)."""
    if min(map(len, strings)) < 3:
        return None
    options = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = sorted(sorted(o) for o in options if not any(other < o for other in options))
    return ("and", *least[0]) if len(least) == 1 else ("or", *(("and", *o) for o in least))


def _all(parts: list) -> tuple | None:
    parts = [p for p in parts if p]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


class _Pattern:
    """What a regex demands: for each part the exact strings it can stand for, if few, and its trigram query.

    Reads literals, escapes, classes, groups, alternations, quantifiers and anchors; classes
    that are not short lists, and anything unknown, stand for any string.
    """

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def peek(self, n: int = 1) -> str:
        return self.pattern[self.at : self.at + n]

    def alternatives(self) -> tuple[set[str] | None, tuple | None]:
        found = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            found.append(self.sequence())
        if len(found) == 1:
            return found[0]
        exact = set().union(*(f[0] for f in found)) if all(f[0] is not None for f in found) else None
        queries = [f[1] or (_strings_query(f[0]) if f[0] is not None else None) for f in found]
        return exact, ("or", *queries) if all(queries) else None

    def sequence(self) -> tuple[set[str] | None, tuple | None]:
        exact, run, parts = True, {""}, []
        while self.peek() and self.peek() not in "|)":
            strings, query = self.repeated()
            if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
                run = {a + b for a in run for b in strings}
                continue
            exact = False
            parts += [_strings_query(run), query]
            run = strings if strings is not None else {""}
        return run if exact else None, _all([*parts, _strings_query(run)])

    def repeated(self) -> tuple[set[str] | None, tuple | None]:
        strings, query = self.atom()
        while m := _TIMES.match(self.pattern, self.at):
            self.at = m.end()
            low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[1][0]) or (int(m[2]), int(m[4]) if m[4] else None if m[3] else int(m[2]))
            if strings is not None and high == 1:
                strings = strings | {""} if low == 0 else strings
            elif low == 0:
                strings, query = None, None
            else:
                strings, query = None, query or (_strings_query(strings) if strings is not None else None)
        return strings, query

    def atom(self) -> tuple[set[str] | None, tuple | None]:
        c = self.peek()
        self.at += 1
        if c == "(":
            m = _GROUP.match(self.pattern, self.at)
            self.at = m.end()
            found = self.alternatives()
            self.at += 1
            return found
        if c == "[":
            return self.letters(), None
        if c in "^$":
            return {""}, None
        if c == "\\":
            return self.escaped(), None
        return (None if c == "." else {c.lower()}), None

    def escaped(self) -> set[str] | None:
        c = self.peek()
        self.at += 1
        if c == "x":
            self.at += 2
            return {chr(int(self.pattern[self.at - 2 : self.at], 16)).lower()}
        if c in "bBAzZ":
            return {""}
        return None if c.isalnum() else {c}

    def letters(self) -> set[str] | None:
        """The members of a class if it lists eight or fewer."""
        out: set[str] | None = set()
        if self.peek() == "^":
            self.at += 1
            out = None
        first = self.at
        while self.peek() != "]" or self.at == first:
            c = self.peek()
            self.at += 1
            one = self.escaped() if c == "\\" else {c}
            if self.peek() == "-" and self.peek(2) != "-]":
                self.at += 1
                to = self.peek()
                self.at += 1
                one = {chr(x) for x in range(ord(c), ord(to) + 1)} if c != "\\" and ord(to) - ord(c) < 8 else None
            out = None if out is None or one is None else out | {x.lower() for x in one}
        self.at += 1
        return out if out is not None and len(out) <= 8 else None


_TIMES = re.compile(r"([*+?]|\{(\d+)(,(\d*))?\})[?+]?")
_GROUP = re.compile(r"\?:|\?[a-z]+(?=\))|")


def trigram_query(pattern: str) -> tuple | None:
    """A Boolean query over lower-case trigrams that every text with a match satisfies; None if there is no such demand.

    Alternations become "or", literal runs "and"; short optional parts and small classes are
    multiplied out; anything else ends the literal run.
    """
    exact, query = _Pattern(pattern).alternatives()
    return query


def trigrams(query) -> set[str]:
    return set() if not query else {query} if isinstance(query, str) else set().union(*(trigrams(q) for q in query[1:]))


def satisfied(query, held: Column) -> Column:
    """The query over the trigrams that a text is posted under."""
    if query is None:
        return F.lit(True)
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [satisfied(q, held) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = (out & p) if query[0] == "and" else (out | p)
    return out


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER) -> DataFrame:
    """The inverted index: (trigram, text_key) for every trigram that some rule asks for and every text that holds it.

    Letters in either case. text_key is a hash of the text, so copies are posted once.
    """
    wanted = sorted(set().union(*(trigrams(trigram_query(r.pattern)) for r in rules)))
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), F.lit(0).cast("long").alias("text_key")).filter(F.lit(False))
    low = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("low"))
    posted = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in wanted]))
    return low.select("text_key", F.explode(posted).alias("trigram")).distinct().select("trigram", "text_key")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """text_key and, for each rule with a query (``rule0``, ``rule1``, ...), whether the intersected postings satisfy it; texts that satisfy none are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    met = index.groupBy("text_key").agg(F.collect_set("trigram").alias("held"))
    flags = {f"rule{i}": satisfied(q, F.col("held")) for i, q in enumerate(queries) if q is not None}
    met = met.select("text_key", *[c.alias(n) for n, c in flags.items()])
    some = F.lit(False)
    for n in flags:
        some = some | F.col(n)
    return met.filter(some)


_SPAN = "array<struct<start:bigint,place:int,end:bigint,kind:string>>"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule in a text: start, place of the rule, end (code points, end exclusive), kind."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    steps = F.arrays_zip(
        F.transform(found, lambda x: F.length(x)).alias("size"),
        F.transform(F.slice(gaps, 1, F.size(found)), lambda x: F.length(x)).alias("gap"),
        F.transform(value, lambda x: F.length(x) >= rule.least).alias("good"),
    )
    none = F.array().cast(_SPAN)
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["gap"] + s["size"]).cast("bigint").alias("at"),
            F.when(
                s["good"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + s["gap"]).cast("bigint").alias("start"), F.lit(place).alias("place"), (acc["at"] + s["gap"] + s["size"]).cast("bigint").alias("end"), F.lit(rule.kind).alias("kind")))),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(none)


def found_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + FURTHER, name: str = "_spans") -> DataFrame:
    """Every column of ``docs`` plus an array of spans under a free name, sorted by start and then by the order of the rules.

    The rules' Boolean queries intersect the postings of the trigram index; only texts that
    satisfy a rule's query are verified by its regex. A rule without mandatory trigrams (hex)
    scans every text. The candidates are fixed-size rows: broadcast while few, else joined by
    shuffle. A text takes part by its hash; should two texts share one, both are verified.
    """
    key, row, held = spare(docs, "_key", "_row", "_rules")
    found = small(candidates(trigram_index(docs.select("text"), rules), rules))
    flags = [c for c in found.columns if c != "text_key"]
    found = found.select(F.col("text_key").alias(key), F.struct(*flags).alias(held)) if flags else None
    rows = docs.select(F.struct("*").alias(row), F.xxhash64("text").alias(key), F.coalesce("text", F.lit("")).alias("text"))
    if found is not None:
        rows = rows.join(found, key, "left")
    none = F.array().cast(_SPAN)
    parts = []
    for place, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, place)
        parts.append(F.when(F.col(held)[f"rule{place}"], spans).otherwise(none) if f"rule{place}" in flags else spans)
    return rows.select(*[F.col(row)[c].alias(c) for c in docs.columns], F.array_sort(F.concat(*parts)).alias(name))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, further: tuple[Rule, ...] = FURTHER) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs`` (doc_id, text).

    Spans are whole matches in code points. base_sha256 covers the base rules only, spans
    names those of the ``further`` rules too. Null texts count as empty; without spans the
    digest is that of nothing. Very long texts are scanned whole. Repeated rows each get their
    own equal result, rows without an id too.
    """
    rows = found_spans(docs.select("doc_id", "text"), BASE + tuple(further)).select("doc_id", "_spans")
    base = F.filter("_spans", lambda s: s["place"] < len(BASE))
    count = lambda i: F.size(F.filter("_spans", lambda s: s["place"] == i)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, further: tuple[Rule, ...] = FURTHER, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; all rows and columns stay.

    n_chars, if there, follows the text. Overlapping spans of several rules are masked as one. Null texts stay null.
    """
    (spans,) = spare(docs, "_spans")
    rows = found_spans(docs, BASE + tuple(further), spans)
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))),
    )
    some = F.size(spans) > 0
    rows = rows.withColumn("text", F.when(some, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(some, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return rows.drop(spans)


ORACLE = r"""
WITH found AS (
  SELECT doc_id, coalesce(text, '') AS text,
    {lists}
  FROM documents
), spans AS (
  SELECT doc_id, list_sort(list_concat({kinds})) AS spans FROM found
)
SELECT doc_id,
  len(list_filter(spans, lambda s: s.place = 0)) AS n_assign,
  len(list_filter(spans, lambda s: s.place = 1)) AS n_access,
  len(list_filter(spans, lambda s: s.place = 2)) AS n_hex,
  sha256(coalesce(list_aggregate(list_transform(list_filter(spans, lambda s: s.place < 3), lambda s: s.kind || ':' || s.start || ':' || s.stop), 'string_agg', ','), '')) AS base_sha256,
  coalesce(list_aggregate(list_transform(spans, lambda s: s.kind || ':' || s.start || ':' || s.stop), 'string_agg', ','), '') AS spans
FROM spans
"""


def oracle_sql(rules: tuple[Rule, ...] = BASE + FURTHER) -> str:
    """The scan in DuckDB's SQL, every rule over every text."""
    lists, kinds = [], []
    for i, r in enumerate(rules):
        p = r.pattern.replace("}+", "}").replace("'", "''")
        lists.append(f"regexp_extract_all(coalesce(text, ''), '{p}', 0) AS m{i}, regexp_extract_all(coalesce(text, ''), '{p}', {r.group}) AS v{i}, string_split_regex(coalesce(text, ''), '{p}') AS g{i}")
        start = f"list_sum(list_transform(g{i}[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m{i}[1:k-1], lambda x: length(x))), 0)::BIGINT"
        kinds.append(
            f"list_transform(list_filter(range(1, len(m{i}) + 1), lambda k: length(v{i}[k]) >= {r.least}), lambda k: {{'start': {start}, 'place': {i}, 'stop': {start} + length(m{i}[k]), 'kind': '{r.kind}'}})"
        )
    return ORACLE.format(lists=",\n    ".join(lists), kinds=",\n    ".join(kinds)).replace("{{", "{").replace("}}", "}")
