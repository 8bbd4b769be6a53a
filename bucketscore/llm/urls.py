"""URL filtering with redirect equivalence.

Rules of host and path judge a URL directly; the longest that fits wins. A URL without a rule is
judged by its aliases: pages that redirect to each other or name each other as canonical are one
component of a graph, found by distributed connected components. A component with an explicitly
allowed page is allowed, otherwise one with a blocked page is blocked, otherwise it is allowed.
Everything is column expressions and joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bucketscore.llm.components import connected_components
from bucketscore.llm.rows import need
from bucketscore.staging import stage


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a verdict is allow or block, not {self.verdict!r}")

    @property
    def name(self) -> str:
        return self.host + self.path


_CANONICAL = r"""(?is:<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>)"""
_REFRESH = r"""(?is:<meta\b[^>]*\bhttp-equiv\s*=\s*["']?\s*refresh\b[^>]*>)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, null if none does. On a tie an allow
    rule wins, then the first by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.verdict == "allow", [-ord(c) for c in r.name])):
        inside = (host == rule.host) | host.endswith(f".{rule.host}")
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(inside & path.startswith(rule.path), value).otherwise(found)
    return found


def address(url: Column) -> Column:
    """What names the same page: host, path and query, without scheme, fragment and a last slash."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1), F.lit(""))
    return F.when(host(url) != "", F.concat(host(url), F.regexp_replace(path(url), "/+$", ""), query))


def absolute(link: Column, page: Column) -> Column:
    """A link of a page as an absolute URL: also ``//host/…``, ``/…``, ``?…`` and relative ones."""
    scheme = F.regexp_extract(page, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host(page))
    folder = F.regexp_replace(path(page), r"[^/]*$", "")
    link = F.trim(link)
    return (
        F.when(link.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path(page), link))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(a, b, target)``: hashes of the addresses of a page and of a redirect target or canonical
    link, and that link as an absolute URL.

    Redirects are ``<meta http-equiv="refresh" content="…;url=…">``, canonical links
    ``<link rel="canonical" href="…">``, both anywhere in the page, in any case and quoting.
    Pages without a host and links to nothing have no edges.
    """
    need(pages, url, html)
    tags = F.regexp_extract_all(F.col(html), F.lit(f"({_CANONICAL}|{_REFRESH})"), F.lit(1))
    # Pages without either word are not searched tag by tag.
    named = F.col(html).rlike("(?i)canonical|http-equiv")
    rows = pages.filter(named).select(F.col(url).alias("page"), F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    target = F.regexp_extract("tag", r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]*)""", 1)
    link = F.regexp_replace(F.when(F.col("tag").rlike("(?is)^<link"), href).otherwise(target), "&amp;", "&")
    # Each name below stands for one evaluation.
    whole = F.transform(F.array(link), lambda x: F.when(x != "", absolute(x, F.col("page"))))
    both = F.transform(whole, lambda x: F.struct(x.alias("target"), address(x).alias("y")))
    ends = rows.select(address(F.col("page")).alias("x"), F.inline(both)).filter("x is not null and y is not null")
    return ends.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b"), "target")


def judge(
    pages: DataFrame, rules: tuple[Rule, ...], edges: DataFrame | None = None, *keep: str, url: str = "url", html: str = "html"
) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` and ``verdict``, one row per row of ``pages``.

    ``edges(a, b)``, by default ``alias_edges(pages)``, link hashed addresses; all pages of a
    component share its verdict unless a rule fits them. With a column ``target``, rules also judge
    the URLs that no page has. Null URLs and those without ``://`` have
    empty host and path, no aliases, and are allowed. Repeated pages are each returned. The rules
    are a short list in the plan. Other columns are not read.
    """
    need(pages, url, *keep)
    edges = alias_edges(pages, url, html) if edges is None else edges
    links = stage(edges, "links").df
    united = stage(connected_components(links), "aliases").df
    rows = pages.select(*keep, F.col(url).alias("_url"))
    rows = rows.select(*keep, host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path"), F.xxhash64(address(F.col("_url"))).alias("_node"))
    rows = rows.withColumn("_match", matching_rule(F.col("host"), F.col("path"), rules))
    # Verdicts of whole components: one row each, merged on the map side.
    ruled = rows.filter("_match is not null").select(F.col("_node").alias("node"), F.col("_match.verdict").alias("verdict"))
    if "target" in links.columns:
        match = matching_rule(host(F.col("target")), path(F.col("target")), rules)
        ruled = ruled.union(links.filter(match.isNotNull()).select("b", match["verdict"]))
    ruled = ruled.distinct()
    spread = united.join(ruled, "node").groupBy("component").agg(
        F.max(F.col("verdict") == "allow").alias("allowed"), F.max(F.col("verdict") == "block").alias("blocked")
    )
    aliases = united.join(spread, "component").select(F.col("node").alias("_node"), (F.col("blocked") & ~F.col("allowed")).alias("_blocked"))
    verdict = F.coalesce(F.col("_match.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return rows.join(aliases, "_node", "left").select(*keep, "host", "path", F.col("_match.rule").alias("rule"), verdict.alias("verdict"))
