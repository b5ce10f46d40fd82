"""URL filters with redirect equivalence.

A rule names a host and the start of a path, and fits that host and its subdomains; of the rules that fit a url the
longest decides. Urls without a rule take the decision of their aliases: redirects and canonical links make edges
between urls, distributed connected components find the aliases, and a component that holds a blocked url is blocked,
unless one of its urls is allowed by a rule (allow goes first). What nothing decides is allowed.

Defined cases: null urls and urls without :// have an empty host and path and no rule; a null html has no links;
repeated rows give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.llm.base import ascii_lower, materialize
from strataspark.llm.components import components

#: (verdict, host, path). Fixed values.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_LINK = r"(?i)<link\b[^>]*>"
_META = r"(?i)<meta\b[^>]*>"
_BASE = r"(?i)<base\b[^>]*\bhref[^>]*>"
_CANONICAL = r"""(?i)\brel\s*=\s*["']?canonical\b"""
_REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1], r[2]))
    found = None
    for verdict, on, start in ordered:
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        what = F.struct(F.lit(on + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, what) if found is None else found.when(fits, what)
    return found


def without_dots(path: Column) -> Column:
    """A path without its segments . and .. (which takes away the one before)."""
    part = F.split(path, "/", -1)
    dots = lambda x: x.isin(".", "..")
    start = F.array().cast("array<string>")
    # the first part is what stands before the first slash: empty, and never taken away
    step = lambda a, x: F.when(x == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.array_join(F.aggregate(part, start, step), "/")
    return F.when(F.exists(part, dots), F.concat(kept, F.when(dots(F.element_at(part, -1)), "/").otherwise(""))).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """The url that a target means on a page: absolute as it is, else by the base's scheme, host and directory; null
    for other schemes (mailto:), for no target and for a relative one where the base is not absolute."""
    part = lambda k: F.regexp_extract(base, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)(\??[^#]*)", k)
    scheme, host, path, query = (part(k) for k in (1, 2, 3, 4))
    bare, rest = F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 2)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"(?s)^(.*/)[^/]*$", 1))
    onto = (
        F.when(target.startswith("//"), F.concat(scheme, F.regexp_extract(target, r"(?s)^(//[^/?#]*)", 1), without_dots(F.regexp_extract(target, r"(?s)^//[^/?#]*([^?#]*)", 1)), rest))
        .when(target.startswith("/"), F.concat(scheme, host, without_dots(bare), rest))
        .when(target.startswith("?"), F.concat(scheme, host, path, target))
        .when(target.startswith("#"), F.concat(scheme, host, path, query, target))
        .otherwise(F.concat(scheme, host, without_dots(F.concat(folder, bare)), rest))
    )
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when((target != "") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (scheme != ""), onto)


def links(pages: DataFrame) -> DataFrame:
    """(url, alias): canonical links and redirects by meta refresh, outside of comments. Relative targets are taken from
    the page's <base>, or else its url.

    What is found is written before targets are resolved, and again between the page's base and the targets: each step
    is long, and would be repeated in the next one's expressions."""
    html = F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?s)<!--.*?-->", "")
    told = pages.where(F.col("html").rlike(_CANONICAL) | F.col("html").rlike(_REFRESH)).select("url", html.alias("html"))
    tags = lambda tag, which, get: F.transform(F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(which)), lambda t: F.replace(F.regexp_extract(t, get, 1), F.lit("&amp;"), F.lit("&")))
    found = F.concat(tags(_LINK, _CANONICAL, _HREF), tags(_META, _REFRESH, _TARGET))
    base = F.replace(F.regexp_extract(F.regexp_extract("html", _BASE, 0), _HREF, 1), F.lit("&amp;"), F.lit("&"))
    some = materialize(told.select("url", base.alias("base"), F.explode(found).alias("target")))
    if some.isEmpty():
        return some.select("url", F.col("target").alias("alias"))
    onto = materialize(some.select("url", "target", F.when(F.col("base") != "", resolve(F.col("url"), F.col("base"))).alias("base")))
    return materialize(onto.select("url", resolve(F.coalesce("base", "url"), F.col("target")).alias("alias"))).where("alias IS NOT NULL")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, url -> page_id, host, path, rule, verdict. edges: (url, alias), by default what links() finds.

    A node of the graph is a url's host and path, so that queries and fragments do not part aliases. A host has no
    slash and a path that is not empty begins with one, so both together are one text. Urls without either are no nodes.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    node = lambda c: F.concat(host_of(F.col(c)), path_of(F.col(c)))
    edges = links(pages) if edges is None else edges
    by_alias = F.lit(None).cast("string")
    if not edges.isEmpty():
        alias = components(edges.select(node("url").alias("a"), node("alias").alias("b")).where("a != '' AND b != ''"), "a", "b")
        # a component's decision is that of its urls' rules, whether they are pages or only link targets
        ruled = alias.withColumn("by_rule", rule_of(F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "(?s)^[^/]*(.*)$", 1), rules)["verdict"])
        verdicts = ruled.groupBy("root").agg(F.when(F.max(F.col("by_rule") == "allow"), "allow").when(F.max(F.col("by_rule") == "block"), "block").alias("by_alias"))
        decided = alias.join(verdicts, "root").where(F.col("by_alias").isNotNull()).select("node", "by_alias")
        # pages without a url have keys of their own, that no node has, so that they do not meet in one task
        own = F.concat("host", "path")
        judged = judged.withColumn("node", F.when(own != "", own).otherwise(F.concat(F.lit("?"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))).join(decided, "node", "left")
        by_alias = F.col("by_alias")
    return judged.select("page_id", "host", "path", F.col("found")["rule"].alias("rule"), F.coalesce(F.col("found")["verdict"], by_alias, F.lit("allow")).alias("verdict"))


#: The verdicts for DuckDB where no page links to another, as in the driver's tables.
JUDGE_SQL = r"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
f AS (SELECT u.*, r.h || r.p AS rule, r.verdict, length(r.h || r.p) AS n FROM u LEFT JOIN r
      ON (u.host = r.h OR suffix(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f
QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY n DESC NULLS LAST) = 1
"""
