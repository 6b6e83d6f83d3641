"""A check of generated HTML against the static subset that the sinks write: rules over extracted tags and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of the subset; attributes it never has; where pictures, links and fonts may come from.
ELEMENTS = "html head meta title style body header div h1 h2 h3 h4 h5 h6 p nav ol ul li span a bdi b strong em code pre blockquote main section footer figure img figcaption br".split()
BANNED = r"on.*|srcdoc|srcset|style|background"
ASSET = r"(?i)assets/[A-Za-z0-9_-][A-Za-z0-9_.-]*\.(?:jpg|jpeg|png|webp|gif)"
IMAGE = r"data:image/(?:jpeg|png|webp|gif);base64,[A-Za-z0-9+/=]+"
FONT = r"data:font/woff;base64,[A-Za-z0-9+/=]+"
LINK = r"(?is)#.*|https?://(?:[^/?#@]*@)?[^/?#@:]+.*"
POLICY = r"(?i)content-security-policy"

_COMMENT = r"(?s)<!--.*?-->"
_RAW = r"(?is)(<{0}\b[^>]*>)(.*?)(</{0}|\z)"
_TAG = r"""<([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
_ATTRIBUTE = r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
_URL = r"(?is)url\((.*?)\)"
#: What an attribute (element, name, start of its value) must look like, and what is said where it does not.
RULES = (
    (None, BANNED, None, None, "attribute"),
    ("meta", "http-equiv", None, POLICY, "meta directive"),
    (None, "src|href", "assets/", ASSET, "asset path"),
    (None, "src", None, IMAGE, "remote source"),
    (None, "href", None, LINK, "link scheme"),
)


def _whole(value: Column, pattern: str) -> Column:
    flags, body = (pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]) if pattern.startswith("(?i") else ("", pattern)
    return F.rlike(value, F.lit(f"{flags}^(?:{body})$"))


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"""(?s)^["'](.*)["']$""", "$1")


def _attribute_fault(element: Column, name: Column, value: Column) -> Column:
    """What the first rule that an attribute falls under finds, null if nothing."""
    out = None
    for tag, names, start, must, fault in RULES:
        under = _whole(name, names)
        if tag:
            under &= element == tag
        if start:
            under &= F.startswith(value, F.lit(start))
        found = F.concat(F.lit(f"{fault} "), name) if must is None else F.when(~_whole(value, must), F.lit(fault))
        out = F.when(under, found) if out is None else out.when(under, found)
    return out


def faults(text: Column) -> Column:
    """What a page has that the static subset has not, in order, each once; none for null.

    Elements outside the list, attributes that break a rule, then what style sheets must not
    have. Comments, and the contents of style and script, hold no tags. Character references in
    attribute values are not resolved, so a value that needs them must break no rule as written.
    """
    page = F.regexp_replace(F.coalesce(text, F.lit("")), _COMMENT, "")
    css = F.array_join(F.regexp_extract_all(page, F.lit(_RAW.format("style")), F.lit(2)), "")
    for raw in ("style", "script"):
        page = F.regexp_replace(page, _RAW.format(raw), "$1$3")
    tags = F.arrays_zip(F.transform(F.regexp_extract_all(page, F.lit(_TAG), F.lit(1)), F.lower).alias("element"), F.regexp_extract_all(page, F.lit(_TAG), F.lit(2)).alias("rest"))

    def of_tag(t: Column) -> Column:
        names = F.transform(F.regexp_extract_all(t["rest"], F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
        values = F.transform(F.regexp_extract_all(t["rest"], F.lit(_ATTRIBUTE), F.lit(2)), _bare)
        element = F.when(~t["element"].isin(ELEMENTS), F.concat(F.lit("element "), t["element"]))
        return F.concat(F.array(element), F.zip_with(names, values, lambda n, v: _attribute_fault(t["element"], n, v)))

    urls = F.transform(F.regexp_extract_all(css, F.lit(_URL), F.lit(1)), lambda u: F.regexp_replace(u, r"""^[\s"']+|[\s"']+$""", ""))
    style = F.array(
        F.when(F.contains(css, F.lit("\\")) | F.rlike(css, F.lit(r"(?i)@import|/\*")), F.lit("css construct")),
        F.when(F.exists(urls, lambda u: ~_whole(u, FONT)), F.lit("css resource")),
    )
    return F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(tags, of_tag)), style)))


def faults_sql(table: str, key: str, column: str) -> str:
    """The same in DuckDB's SQL: one row a tag and attribute, then the first place of each fault."""
    quote = lambda p: "'" + p.replace("'", "''").replace("++", "+").replace("*+)", "*)") + "'"
    raw = lambda x: quote(_RAW.format(x))
    full = lambda v, p: f"regexp_full_match({v}, {quote(p)})"
    cases = []
    for tag, names, start, must, fault in RULES:
        under = full("n", names) + (f" AND e = '{tag}'" if tag else "") + (f" AND starts_with(v, '{start}')" if start else "")
        cases.append(f"WHEN {under} THEN " + (f"'{fault} ' || n" if must is None else f"CASE WHEN NOT {full('v', must)} THEN '{fault}' END"))
    elements = ", ".join(f"'{e}'" for e in ELEMENTS)
    return rf"""WITH p AS (SELECT {key}, regexp_replace(coalesce({column}, ''), {quote(_COMMENT)}, '', 'g') AS h FROM {table}),
c AS (SELECT {key}, array_to_string(regexp_extract_all(h, {raw('style')}, 2), '') AS css, regexp_replace(regexp_replace(h, {raw('style')}, '\1\3', 'g'), {raw('script')}, '\1\3', 'g') AS h FROM p),
t AS (SELECT {key}, unnest(range(1, len(es) + 1)) AS i, es, rs FROM (SELECT {key}, regexp_extract_all(h, {quote(_TAG)}, 1) AS es, regexp_extract_all(h, {quote(_TAG)}, 2) AS rs FROM c)),
u AS (SELECT {key}, i, lower(es[i]) AS e, rs[i] AS r FROM t),
a AS (SELECT {key}, i, e, unnest(range(1, len(ns) + 1)) AS j, ns, vs FROM (SELECT {key}, i, e, regexp_extract_all(r, {quote(_ATTRIBUTE)}, 1) AS ns, regexp_extract_all(r, {quote(_ATTRIBUTE)}, 2) AS vs FROM u)),
b AS (SELECT {key}, i, j, e, lower(ns[j]) AS n, regexp_replace(vs[j], '(?s)^["''](.*)["'']$', '\1') AS v FROM a),
f AS (SELECT {key}, i, 0 AS j, CASE WHEN e NOT IN ({elements}) THEN 'element ' || e END AS x FROM u
  UNION ALL SELECT {key}, i, j, CASE {' '.join(cases)} END FROM b
  UNION ALL SELECT {key}, 1000000000, 0, CASE WHEN contains(css, '\') OR regexp_matches(css, '(?i)@import|/\*') THEN 'css construct' END FROM c
  UNION ALL SELECT {key}, 1000000000, 1, CASE WHEN len(list_filter(regexp_extract_all(css, {quote(_URL)}, 1), lambda y: NOT regexp_full_match(trim(y, ' "''' || chr(9) || chr(10) || chr(13)), {quote(FONT)}))) > 0 THEN 'css resource' END FROM c),
g AS (SELECT {key}, x, min((i, j)) AS k FROM f WHERE x IS NOT NULL GROUP BY {key}, x)
SELECT p.{key}, coalesce(list(g.x ORDER BY g.k) FILTER (g.x IS NOT NULL), []) AS faults FROM p LEFT JOIN g USING ({key}) GROUP BY p.{key}"""
