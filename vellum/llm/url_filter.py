"""URL block lists with redirect equivalence.

A page's own verdict comes from the longest rule that fits its host and path.  Pages that
no rule fits take the verdict of their aliases: URLs linked by a redirect (meta refresh), by
a canonical link, or by having one normal form are connected components of one graph, and a
block on any member reaches the whole component unless a member is explicitly allowed.  A
target is a member, and judged by the rules, whether it is a row of the pages or not.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower, components, land

# The registered query's rules (host/path, verdict).
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path: the text after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased, and from there up to ``?``, ``#`` or the end.  Both are empty for null
    and for a text without ``://``."""
    rest = F.when(url.contains("://"), F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return (ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, rule_host, rule_path, action) from ``host/path`` texts."""
    rows = [(r, r.partition("/")[0].lower(), "/" + r.partition("/")[2], v) for r, v in rules]
    return spark.createDataFrame(rows, "rule string, rule_host string, rule_path string, action string")


def own_verdicts(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(__row, rule, action) for rows that a rule fits.  Hosts are expanded to their
    suffixes (a.b.c, b.c, c), which makes the subdomain test an equi-join; the longest
    rule wins, then allow, then the smaller text."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    s = pages.select("__row", "path", F.explode(suffixes).alias("rule_host"))
    hits = s.join(rules, "rule_host").where(F.startswith("path", "rule_path"))
    rank = F.struct(F.length("rule"), (F.col("action") == "allow"))
    best = hits.groupBy("__row").agg(F.max(F.struct(rank.alias("rank"), "rule", "action")).alias("best"))
    return best.select("__row", "best.rule", "best.action")


def normal_form(url: Column) -> Column:
    """The URL that servers redirect its spellings to: no scheme, fragment, tracking
    parameters or trailing slash; the host A-Z lower-cased."""
    host, path = host_path(url)
    query = F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|gclid|fbclid)(=|$)")), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""),
                                       F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*(?:"[^">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b)[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>"""
BASE_TAG = r"""(?is)<base\b[^>]*\bhref\s*=[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def _no_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/", -1)
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda acc, x:
                       F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                       .otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def _resolved(target: Column, url: Column) -> Column:
    """``target`` as named on the page ``url``: absolute URLs as they are, others against the
    page's scheme, host and path.  Null for what has no host, as ``mailto:``."""
    site = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    scheme = F.regexp_extract(url, r"^([^:/?#]+:)//", 1)
    path = host_path(url)[1]
    own, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?", 1))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
             .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
             .when(site == "", F.lit(None))
             .when(target.startswith("//"), F.concat(scheme, target))
             .when(own == "", F.concat(site, path, rest))
             .when(target.startswith("/"), F.concat(site, _no_dots(own), rest))
             .otherwise(F.concat(site, _no_dots(F.concat(folder, own)), rest)))


def _target(html: Column, url: Column) -> Column:
    """Array of the absolute URLs that a page names as canonical or refresh targets, of all
    its links; ``<base>`` moves what relative targets start from."""
    named = lambda tag, at: F.filter(F.transform(
        F.regexp_extract_all(html, F.lit(tag), F.lit(0)),
        lambda t: F.replace(F.regexp_extract(t, at, 1), F.lit("&amp;"), F.lit("&"))), lambda t: t != "")
    base = F.regexp_extract(F.regexp_extract(html, BASE_TAG, 0), HREF, 1)
    start = F.when(base != "", F.coalesce(_resolved(base, url), url)).otherwise(url)
    found = F.when(html.rlike("(?i)canonical|refresh"), F.transform(
        F.concat(named(LINK, HREF), named(REFRESH, REFRESH_URL)), lambda t: _resolved(t, start)))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: t.isNotNull())


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, host, path, rule (null: none fits), verdict, component.

    A null URL, or one without a host, is linked with nothing and allowed unless a rule
    fits.  Null html names no target.  Repeated rows and ids are judged each.  Other columns
    are not read; an empty table gives no rows."""
    url = F.col(url_col).cast("string")
    host, path = host_path(url)
    p = pages.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("bigint").alias("page_id"),
                     host.alias("host"), path.alias("path"), normal_form(url).alias("node"),
                     F.array_distinct(_target(F.col(html_col).cast("string"), url)).alias("targets"))
    p = land(p, "pages")
    named = p.where(F.col("node").isNotNull()).select("node", F.explode("targets").alias("target"))
    named = named.select("node", normal_form(F.col("target")).alias("to"), *[
        c.alias(n) for c, n in zip(host_path(F.col("target")), ("host", "path"))]).where(F.col("to").isNotNull())
    edges = named.where(F.col("to") != F.col("node"))
    linked = components(edges.select(F.col("node").alias("u"), F.col("to").alias("v")))
    own = own_verdicts(p.select("__row", "host", "path"), rules)
    j = (p.select("__row", "page_id", "host", "path", "node").join(own, "__row", "left")
          .join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")))
    j = land(j.drop("__row", "node"), "judged")
    # Targets are judged by their spelling on the page, rows or not.
    spelt = named.select(F.struct(F.col("to").alias("node"), "host", "path").alias("__row"), "host", "path").distinct()
    ruled = own_verdicts(spelt, rules).select(F.col("__row.node").alias("node"), "action").join(linked, "node", "left")
    ruled = ruled.select(F.coalesce("component", "node").alias("component"), "action")
    # One verdict per component, made by a partial/final aggregate; a component with very
    # many pages comes back by a join that AQE splits.
    ruled = ruled.unionByName(j.where(F.col("component").isNotNull() & F.col("action").isNotNull()).select("component", "action"))
    spread = ruled.groupBy("component").agg(
        F.min("action").alias("shared"))     # "allow" sorts before "block": allow has precedence
    return j.join(spread, "component", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", "shared", F.lit("allow")).alias("verdict"), "component")
