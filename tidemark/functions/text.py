"""Text rules: tokens, numbers, cues, hygiene, languages, addresses, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Written-out numbers that count as numbers.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17",
    "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
    "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
    "hundred": "100", "thousand": "1000", "million": "1000000",
    "אפס": "0", "אחד": "1", "אחת": "1", "שניים": "2", "שתיים": "2", "שני": "2", "שתי": "2",
    "שלושה": "3", "שלוש": "3", "ארבעה": "4", "ארבע": "4", "חמישה": "5", "חמש": "5",
    "שישה": "6", "שש": "6", "שבעה": "7", "שבע": "7", "שמונה": "8", "תשעה": "9", "תשע": "9",
    "עשרה": "10", "עשר": "10", "עשרים": "20", "שלושים": "30", "מאה": "100", "אלף": "1000", "מיליון": "1000000",
}
#: Phrases that point at the picture.
CUES = (
    r"\bas you can see\b", r"\byou can see\b", r"\bsee here\b", r"\bright here\b", r"\bover here\b",
    r"\bon (?:the|this) screen\b", r"\bon this slide\b", r"\bnotice\b", r"\blet me show\b", r"\bcheck (?:this|it) out\b",
    r"\bthis (?:chart|graph|diagram|table|example|slide|screen)\b", r"\bI(?:'ll| will) show you\b",
    r"\b(?:click|hit|press) (?:on )?(?:the |this )?(?:button|tab|menu|link|icon)\b",
    r"כפי שאתם רואים", r"אתם רואים", r"רואים פה", r"רואים כאן", r"אפשר לראות", r"תסתכלו על", r"שימו לב", r"הנה ",
    r"\bב?ה?גרף\b", r"\bב?ה?טבלה\b", r"\bב?ה?תרשים\b", r"\bב?ה?מסך\b", r"\bב?ה?שקף\b", r"\bב?ה?קוד\b", r"לחצתי", r"נלחץ על",
)
#: Patterns of the grounding rules.
NUMBER = r"(?<![A-Za-z_/.\-])\d[\d,.]*(?:%|k|K|x|×)?"
NEGATION = r"(?iU)\b(not|never|no|n't|without|cannot|can't|won't|don't|doesn't|isn't|aren't)\b"
NEGATION_HE = r"(?:^|\s)(לא|אין|אף פעם|בלי|אי אפשר|לעולם לא|איננו|אינה|אינם)(?=\s|$|[,.;:])"
CORRECTION = r"(?iUm)\b(i misspoke|i was wrong|i stand corrected|let me correct|scratch that|strike that|more precisely|i meant to say|i should have said)\b|^\s*correction\b|\bcorrection\s*[:,]"
CORRECTION_WEAK = r"(?iU)\b(actually|to be clear)\b"
CORRECTION_HE = r"(תיקון|טעיתי|אני מתקנ[תה]?|למען הדיוק|ליתר דיוק|לא מדויק)"
CORRECTION_WEAK_HE = r"בעצם"
WORD = r"(?U)[\w'׳״]+"
BACKTICK = r"`([^`\n]+)`"
URL = r"https?://\S+"
LATIN_RUN = r"[A-Za-z][A-Za-z0-9+#./_\-']*"
#: Codes that older caption tracks use for a language.
LEGACY_LANGUAGES = {"iw": "he", "ji": "yi", "in": "id"}
#: Hosts whose addresses name one video in several ways.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtube-nocookie.com", "www.youtube-nocookie.com")


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def cue(text: Column) -> Column:
    """The first cue phrase of a text, null without one."""
    found = F.regexp_extract(text, "(?iU)" + "|".join(CUES), 0)
    return F.when(found != "", found)


def numbers(text: Column, pattern: str = NUMBER) -> Column:
    """Distinct sorted numbers of a text, digits without grouping and units, written-out ones as digits."""
    digits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda n: F.regexp_replace(F.replace(n, F.lit(",")), "[%kKx×.]+$", ""))
    digits = F.transform(digits, lambda n: F.when(n == "", "0").otherwise(n))
    table = F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv])
    words = F.array_compact(F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\w]+"), F.lit(0)), lambda w: F.try_element_at(table, w)))
    return F.array_sort(F.array_distinct(F.concat(digits, words)))


def ungrounded_numbers(text: Column, evidence: Column, pattern: str = NUMBER) -> Column:
    """Numbers of a text that its evidence lacks; 0 and 1 need none."""
    return F.array_except(F.filter(numbers(text, pattern), lambda n: ~n.isin("0", "1")), numbers(evidence, pattern))


def ungrounded_terms(text: Column, evidence: Column) -> Column:
    """Identifiers in backticks and addresses that the evidence, without blanks and -_., does not hold."""
    terms = F.concat(F.regexp_extract_all(text, F.lit(BACKTICK), F.lit(1)), F.regexp_extract_all(text, F.lit(URL), F.lit(0)))
    squeezed = lambda c: F.lower(F.regexp_replace(c, r"[\s\-_.]", ""))
    joined = F.array_join(tokens(evidence), "")
    return F.filter(F.array_distinct(terms), lambda t: (squeezed(t) != "") & ~F.contains(joined, squeezed(t)))


def loses_negation(text: Column, evidence: Column) -> Column:
    return evidence.rlike(NEGATION) & ~(text.rlike(NEGATION) | text.rlike(NEGATION_HE))


def is_correction(text: Column) -> Column:
    """A phrase that corrects, or a weak one beside a negation of its own language."""
    strong = text.rlike(CORRECTION) | text.rlike(CORRECTION_HE)
    return strong | (text.rlike(CORRECTION_WEAK) & text.rlike(NEGATION)) | (text.rlike(CORRECTION_WEAK_HE) & text.rlike(NEGATION_HE))


def long_sentences(text: Column, most: int = 35) -> Column:
    """How many sentences have over ``most`` words."""
    words = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return F.size(F.filter(F.split(text, r"(?<=[.!?…])\s+"), lambda s: words(s) > most))


def hygiene(text: Column) -> Column:
    """Counts per text: Hebrew letters, Latin letters, vowel marks, direction controls, long dashes; and whether a Latin letter comes first."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    plain = F.regexp_replace(text, "`[^`\\n]+`", "")
    return F.struct(
        count("[א-ת]").alias("hebrew"),
        F.regexp_count(plain, F.lit("[A-Za-z]")).alias("latin"),
        count("[ְ-ׇ]").alias("niqqud"),
        count("[‎‏‪-‮⁦-⁩]").alias("bidi"),
        count("[–—]").alias("dash"),
        F.trim(text).rlike("^[A-Za-z]").alias("leading_latin"),
    )


def language(code: Column, underscore: bool = False) -> Column:
    """The base language of a code: en-US is en, old codes become current ones; null for none."""
    base = F.lower(F.get(F.split(code, "[-_]" if underscore else "-"), 0))
    table = F.create_map(*[F.lit(x) for kv in LEGACY_LANGUAGES.items() for x in kv])
    return F.when(F.coalesce(code, F.lit("")) != "", F.coalesce(F.try_element_at(table, base), base))


def is_url(text: Column) -> Column:
    return text.rlike("(?i)^https?://")


def has_host(text: Column) -> Column:
    """The stricter test: an http or https address that names a host; blanks around it are not allowed."""
    return F.coalesce(text.rlike("(?i)^https?://[^/?#]+"), F.lit(False))


def canonical_url(url: Column) -> Column:
    """One spelling per video of ``VIDEO_HOSTS`` and youtu.be; other addresses lose their fragment and get a lower-case scheme; other texts stay."""
    u = F.trim(url)
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    path = F.filter(F.split(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    first, second = F.get(path, 0), F.get(path, 1)
    query = F.try_parse_url(u, F.lit("QUERY"), F.lit("v"))
    found = F.when(host == "youtu.be", first).when(host.isin(*VIDEO_HOSTS), F.when(first.isin("shorts", "live", "embed", "v"), second).when(first == "watch", query))
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1))
    plain = F.concat(scheme, F.regexp_replace(F.regexp_replace(u, "^[A-Za-z]+", ""), "#.*$", ""))
    return F.when(~is_url(u), url).when(found.rlike("^[A-Za-z0-9_-]{11}$"), F.concat(F.lit("https://www.youtube.com/watch?v="), found)).otherwise(plain)


def version_drift(old: Column, new: Column) -> Column:
    """same, patch, minor, major or unknown."""
    part = lambda c, i: F.regexp_extract(c, r"^\s*(\d+)\.(\d+)(?:\.(\d+))?", i)
    number = lambda c, i: F.coalesce(part(c, i).try_cast("int"), F.lit(0))
    known = (F.coalesce(part(old, 1), F.lit("")) != "") & (F.coalesce(part(new, 1), F.lit("")) != "")
    return F.when(~known, "unknown").when(number(old, 1) != number(new, 1), "major").when(number(old, 2) != number(new, 2), "minor").when(number(old, 3) != number(new, 3), "patch").otherwise("same")


def option_diff(old: Column, new: Column) -> Column:
    """Sorted names of options (maps of strings) that differ; null, "" and "false" are equal to absence."""
    norm = lambda c: F.when(c.isin("", "false"), None).otherwise(c)
    names = F.array_union(F.map_keys(old), F.map_keys(new))
    return F.array_sort(F.filter(names, lambda k: ~norm(F.try_element_at(old, k)).eqNullSafe(norm(F.try_element_at(new, k)))))


def sanitized(text: Column, most: int = 400) -> Column:
    """The last three lines of a tool's output without colours and addresses, blanks collapsed, joined by " | ", cut at ``most``."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x1b\\[[0-9;?]*[A-Za-z]", ""), URL, "<url>")
    lines = F.filter(F.transform(F.split(clean, "\\R"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.substring(F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), " | "), 1, most)


def inline_markup(text: Column) -> Column:
    """HTML-escaped text, `code` in code elements."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, BACKTICK, "<code>$1</code>")


def provenance_line(texts: Column, most: int = 160, head: int = 160) -> Column:
    """Texts joined by blanks, blanks collapsed, cut at ``most`` with an ellipsis."""
    joined = F.trim(F.regexp_replace(F.array_join(texts, " "), r"\s+", " "))
    return F.when(F.length(joined) > most, F.concat(F.rtrim(F.substring(joined, 1, head)), F.lit("…"))).otherwise(joined)


def http_category(status: Column, code: Column, kind: Column) -> Column:
    """(category, retryable) of an HTTP failure."""
    c = F.lower(F.concat_ws(" ", code, kind))
    quota = F.lit(False)
    for term in ("quota", "billing", "credit", "spend", "usage_limit"):
        quota = quota | F.contains(c, F.lit(term))
    category = (
        F.when((status == 429) & quota, "quota_exceeded")
        .when(status == 429, "rate_limit")
        .when(status == 401, "authentication")
        .when(status == 403, "authorization")
        .when(status.isin(404, 410), "source_unavailable")
        .when((status == 408) | status.between(500, 599), "temporary_network")
        .otherwise("invalid_input")
    )
    return F.struct(category.alias("category"), category.isin("rate_limit", "temporary_network").alias("retryable"))


#: What a tool's message says of a failure, the first category with a hit counts.
TOOL_FAILURES = (
    ("rate_limit", ("429", "too many requests")),
    ("access_restricted", ("sign in", "login required", "po token", "po_token", "captcha", "403", "not a bot", "blocked")),
    ("source_unavailable", ("private video", "video unavailable", "video has been removed", "not available", "404", "410", "geo-restricted", "country")),
    ("temporary_network", ("timed out", "timeout", "connection reset", "temporary failure", "503", "502", "504", "unable to resolve", "name or service not known")),
    ("unsupported_resource", ("unsupported url", "no suitable extractor")),
    ("dependency", ("no such option", "unrecognized option", "javascript runtime", "ejs")),
)


def tool_category(message: Column) -> Column:
    """(category, retryable) of a tool's message."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda terms: _any(*[F.contains(m, F.lit(t)) for t in terms])
    denied = has(("proxy", "tunnel connection failed")) & has(("403", "denied", "blocked by", "network policy"))
    category = F.when(denied, "environment_blocked")
    for name, terms in TOOL_FAILURES:
        category = category.when(has(terms), name)
    category = category.otherwise("unknown")
    return F.struct(category.alias("category"), category.isin("rate_limit", "temporary_network").alias("retryable"))


def _any(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def retry_after(seconds: Column, milliseconds: Column, now: Column) -> Column:
    """Seconds to wait: from milliseconds, seconds or an HTTP date; never below 0, null for what cannot be read."""
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(seconds, r"^\w{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss z"))).cast("double") - now
    from tidemark.functions.clock import finite

    ms = finite(milliseconds) / 1000
    wait = F.when(milliseconds.isNotNull(), ms).otherwise(F.coalesce(seconds.try_cast("double"), date))
    return F.when(~F.isnan(wait) & (F.abs(wait) < float("inf")), F.greatest(F.lit(0.0), wait))


def is_safe_name(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9][A-Za-z0-9_-]{0,79}$")


def is_crop(text: Column) -> Column:
    return text.rlike(r"^\d+:\d+:\d+:\d+$")


def canonical_sha256(fields: dict[str, Column]) -> Column:
    """SHA-256 of the JSON of named values in the order of their names."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
