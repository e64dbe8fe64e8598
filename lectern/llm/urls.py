"""URL filters: host and path rules, carried over to aliases.

Redirects (a page's meta refresh) and canonical links are edges between URLs; what they connect is one class, found as a
connected component. They may be relative to the page's URL, or to its base element. A URL that fits a rule gets that rule's verdict. Another is blocked if its class holds a blocked URL and
none that is explicitly allowed: an allow takes precedence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, tidy
from lectern.llm.graph import connected_components

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Rules that are written into the plan at most; more have to come as a table.
MOST_RULES = 512
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rest(url: Column) -> Column:
    """What follows the first ://, or an empty string."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _bound(value: Column, of) -> Column:
    """of(value), the value written into the plan once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _query_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)


def _without_dots(path: Column) -> Column:
    """A path that starts with / without its . and .. segments."""
    held = F.array(F.lit(None).cast("string"))  # a null, which array_join passes over, and the blank before the first /
    step = lambda held, x: F.when(x == "..", F.slice(held, F.lit(1), F.greatest(F.size(held) - 1, F.lit(2)))).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    end = F.when(path.rlike(r"/\.\.?$"), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.array_join(F.aggregate(F.split(path, "/"), held, step), "/"), end)).otherwise(path)


def key_of(url: Column) -> Column:
    """A URL as a node: host, path (/ if empty, without dot segments) and query; null without a host."""
    host, path = host_of(url), path_of(url)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(_without_dots(path)), _query_of(url)))


def resolved(url: Column, to: Column) -> Column:
    """The URL that a reference on the page at url names, dot segments and all; null for what has a scheme but no ://."""
    scheme, path = F.regexp_extract(url, r"^[^:/?#]*", 0), F.regexp_replace(path_of(url), "^$", "/")
    site = F.concat(scheme, F.lit("://"), host_of(url))
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), to).when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None).cast("string"))
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(site, to)).when(to.startswith("?"), F.concat(site, path, to))
        .when(to.startswith("#"), F.concat(site, path, _query_of(url), to)).otherwise(F.concat(site, F.regexp_extract(path, r"^.*/", 0), to))
    )


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


_HREF = r"(?i)[\s\"'/]href\s*=\s*[\"']?\s*([^\"'\s>]+)"
_CANONICAL = r"""(?i)<link\b[^>]*[\s"'/]rel\s*=\s*(?:"(?:[^">]*\s)?canonical["\s][^>]*|'(?:[^'>]*\s)?canonical['\s][^>]*|canonical(?:[\s/][^>]*)?>)"""
_REFRESH, _URL = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s>]+)"
_BASE, _COMMENT = r"(?i)<base\b[^>]*", r"(?s)<!--.*?(?:-->|$)"


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) keys of each page's URL and of what its canonical links and its meta refreshes name; what stands in a comment
    does not count. Of several base elements the first one does; of entities, &amp; is read."""
    lowered = F.lower(F.col(html_col))
    seen = pages.where(lowered.contains("canonical") | lowered.contains("refresh")).select(F.col(url_col).alias("url"), F.regexp_replace(html_col, _COMMENT, "").alias("html"))
    told = lambda tag, goal: F.transform(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, goal, 1))
    plain = lambda to: F.replace(to, F.lit("&amp;"), F.lit("&"))
    base = F.regexp_extract(F.regexp_extract("html", _BASE, 0), _HREF, 1)
    found = seen.select("url", base.alias("base"), F.explode(F.concat(told(_CANONICAL, _HREF), told(_REFRESH, _URL))).alias("to"))
    # Each step is bound, as the next one names it many times and the filter would copy it each time.
    based = _bound(plain(F.col("base")), lambda b: resolved(F.col("url"), b))
    page = F.when(F.col("base") != "", F.coalesce(based, "url")).otherwise(F.col("url"))
    goal = _bound(page, lambda p: _bound(plain(F.col("to")), lambda t: _bound(resolved(p, t), key_of)))
    return found.where(F.col("to") != "").select(key_of(F.col("url")).alias("src"), goal.alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """For every row of pages: id_col, host, path, rule (null where none fits) and verdict (allow or block).

    redirects: more edges (src, dst), as URLs. A null URL, or one without ://, has an empty host and path, fits no rule, is in
    no class, and is allowed. A null html has no link; an html of any length is read in whole. Of rules that fit, the longest
    wins; of two of one length, the first by host and path. Repeated rows come out repeated; other columns are not looked at; an
    empty table gives an empty result."""
    with tidy() as keep:
        edges = links(pages, url_col, html_col)
        if redirects is not None:
            edges = edges.union(redirects.select(key_of(F.col("src")), key_of(F.col("dst")))).distinct()
        classes = connected_components(edges, "src", "dst")
        node = F.concat(F.lit("x://"), F.col("node"))
        ruled = classes.withColumn("v", matched(host_of(node), path_of(node), rules)[1])
        blocked = ruled.groupBy("component").agg(F.max(F.col("v") == "block").alias("b"), F.max(F.col("v") == "allow").alias("a")).where("b and not coalesce(a, false)").select("component")
        aliases = keep(cut(classes.join(blocked, "component", "left_semi").select("node")))
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    # Pages without a key would all meet in one task; a key that no URL has deals them out.
    key = F.coalesce(key_of(F.col(url_col)), F.concat(F.lit("/"), F.xxhash64(id_col).cast("string")))
    own = pages.select(F.col(id_col), key.alias("key"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": verdict})
    return own.join(aliases, F.col("key") == F.col("node"), "left").select(id_col, "host", "path", "rule", F.coalesce("said", F.when(F.col("node").isNotNull(), "block").otherwise("allow")).alias("verdict"))


def _sql_parts(u: str) -> tuple[str, str, str]:
    """Host, path and query of a URL in DuckDB's SQL."""
    rest = f"(CASE WHEN strpos({u}, '://') > 0 THEN substr({u}, strpos({u}, '://') + 3) ELSE '' END)"
    host = f"translate(regexp_extract({rest}, '^[^/?#]*', 0), '{_UPPER}', '{_UPPER.lower()}')"
    return host, f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)", rf"regexp_extract({rest}, '^[^?#]*(\?[^#]*)', 1)"


def _sql_key(host: str, path: str, query: str) -> str:
    without = (
        f"CASE WHEN contains({path}, '/.') THEN array_to_string(list_reduce(list_transform(string_split({path}, '/'), lambda x: [x]), lambda a, b: CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 1)] "
        rf"WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END), '/') || CASE WHEN regexp_matches({path}, '/\.\.?$') THEN '/' ELSE '' END ELSE {path} END"
    )
    return f"CASE WHEN {host} <> '' THEN {host} || CASE WHEN {path} = '' THEN '/' ELSE {without} END || {query} END"


def _sql_resolved(u: str, host: str, path: str, query: str, t: str) -> str:
    scheme, full = f"regexp_extract({u}, '^[^:/?#]*', 0)", f"(CASE WHEN {path} = '' THEN '/' ELSE {path} END)"
    return (
        rf"CASE WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN {t} WHEN regexp_matches({t}, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN NULL WHEN starts_with({t}, '//') THEN {scheme} || ':' || {t} "
        f"WHEN starts_with({t}, '/') THEN {scheme} || '://' || {host} || {t} WHEN starts_with({t}, '?') THEN {scheme} || '://' || {host} || {full} || {t} "
        f"WHEN starts_with({t}, '#') THEN {scheme} || '://' || {host} || {full} || {query} || {t} ELSE {scheme} || '://' || {host} || regexp_extract({full}, '^.*/', 0) || {t} END"
    )


def _sql() -> str:
    quoted = lambda pattern: "'" + pattern.replace("'", "''") + "'"
    parts = lambda u: "{} AS host, {} AS path, {} AS query".format(*_sql_parts(u))
    told = lambda tag, goal: f"list_transform(regexp_extract_all(html, {quoted(tag)}, 0), lambda x: regexp_extract(x, {quoted(goal)}, 1))"
    key, rules = _sql_key("host", "path", "query"), ", ".join(map(repr, RULES))
    own = ("host", "path", "query")
    return f"""
WITH RECURSIVE parts AS (SELECT page_id, url, html, {parts("coalesce(url, '')")} FROM pages
), keyed AS (SELECT page_id, url, host, path, {key} AS key FROM parts
), bare AS (
  SELECT url, host, path, query, {key} AS src, regexp_replace(html, {quoted(_COMMENT)}, '', 'g') AS html FROM parts WHERE host <> ''
), listed AS (
  SELECT url, host, path, query, src, replace(regexp_extract(regexp_extract(html, {quoted(_BASE)}, 0), {quoted(_HREF)}, 1), '&amp;', '&') AS base,
    unnest(list_concat({told(_CANONICAL, _HREF)}, {told(_REFRESH, _URL)})) AS t FROM bare
), based AS (
  SELECT src, replace(t, '&amp;', '&') AS t, CASE WHEN base <> '' THEN coalesce({_sql_resolved("url", *own, "base")}, url) ELSE url END AS page FROM listed WHERE t <> ''
), named AS (SELECT src, t, page, {parts("page")} FROM based
), goals AS (SELECT src, {_sql_resolved("page", *own, "t")} AS goal FROM named
), split AS (SELECT src, {parts("coalesce(goal, '')")} FROM goals
), edges AS (SELECT src, {key} AS dst FROM split
), linked AS (SELECT src, dst FROM edges WHERE dst IS NOT NULL AND src <> dst
), both_ways AS (SELECT src, dst FROM linked UNION SELECT dst, src FROM linked
), reach AS (SELECT src AS a, dst AS b FROM both_ways UNION SELECT a, dst FROM reach JOIN both_ways ON b = src
), rules(rh, rp, v) AS (VALUES {rules}
), nodes AS (SELECT DISTINCT b, {parts("('x://' || b)")} FROM reach
), node_said AS (
  SELECT b, arg_max(v, length(rh || rp)) AS v FROM nodes JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY b
), bad AS (
  SELECT a FROM reach LEFT JOIN node_said USING (b) GROUP BY a HAVING bool_or(v = 'block') AND NOT coalesce(bool_or(v = 'allow'), false)
), fits AS (
  SELECT page_id, url, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS v FROM keyed JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, url
)
SELECT k.page_id, k.host, k.path, fits.rule, coalesce(fits.v, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM keyed k LEFT JOIN fits ON fits.page_id IS NOT DISTINCT FROM k.page_id AND fits.url IS NOT DISTINCT FROM k.url LEFT JOIN bad ON bad.a = k.key
"""


#: judge() over pages in DuckDB's SQL.
SQL = _sql()
