"""URL filters: longest-rule decisions, and block decisions carried to aliases over redirect and canonical links.

DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

#: (verdict, host, path); a rule fits its host and all subdomains where the url's path starts with the rule's path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule (of equal lengths an allow rule), null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    rule = verdict = None
    for kind, h, p in order:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def alias_key(url: Column) -> Column:
    """One spelling for the addresses of one document: no scheme, fragment, default port, tracking parameters or
    trailing slash, and a lower-case host.  A url without ``://`` stands for itself."""
    host = F.regexp_replace(url_host(url), r":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(query, r"(^|&)(utm_[^&=]*|gclid|fbclid)(=[^&]*)?(?=&|$)", "")
    query = F.regexp_replace(query, r"^&+", "")
    whole = F.concat(host, F.regexp_replace(url_path(url), r"/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(url.contains("://"), whole).otherwise(url)


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (src, dst): canonical links and meta-refresh redirects of each page, made absolute.  Only ``link`` and
    ``meta`` tags are looked at; pages without either give no row."""
    tags = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<(?:link|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))
    tags = F.filter(tags, lambda t: t.rlike(r"(?is)rel\s*=\s*[\"']?\s*canonical\b|http-equiv\s*=\s*[\"']?\s*refresh\b"))
    rows = (pages.where(F.col(url_col).isNotNull() & F.col(html_col).rlike(r"(?i)canonical|http-equiv"))
            .select(F.col(url_col).alias("src"), F.explode(tags).alias("tag")))
    canonical = F.regexp_extract("tag", r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", 0)
    canonical = F.regexp_replace(F.regexp_replace(canonical, r"(?is)^href\s*=\s*[\"']?", ""), r"[\"']$", "")
    refresh = F.regexp_replace(F.regexp_extract("tag", r"(?is)content\s*=\s*[\"']?[^>\"']*?\burl\s*=\s*['\"]?([^\"'>]*)", 1), r"\s+$", "")
    to = F.trim(F.regexp_replace(F.when(F.col("tag").rlike(r"(?is)^<meta"), refresh).otherwise(canonical), "&amp;", "&"))
    rows = rows.select("src", to.alias("to")).where(F.col("to") != "")
    scheme, root = F.regexp_extract("src", r"(?s)^(.*?):", 1), F.regexp_extract("src", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.concat(root, F.regexp_extract(url_path(F.col("src")), r"(?s)^(.*/)", 1))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    dst = (F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to")).when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
           .when(F.col("to").startswith("/"), F.concat(root, F.col("to"))).otherwise(F.concat(folder, F.col("to"))))
    return rows.select("src", dst.alias("dst"))


def _node(url: Column) -> Column:
    return F.unhex(F.md5(alias_key(url).cast("binary")))


def judge_urls(pages: DataFrame, rules=RULES, edges: DataFrame | None = None, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (id, host, path, rule, verdict), one per page.

    A fitting rule decides (longest wins).  Without one, a page is blocked if any address in its redirect group is
    blocked by a rule: the group is the connected component of its address over ``edges`` (src, dst; by default the
    pages' canonical links and meta refreshes), where addresses that differ only in scheme, fragment, tracking
    parameters, default port or trailing slash are one node.  An explicit allow rule on an address always wins over
    a block that only reaches it through aliases.  Everything else gets ``default``.

    Only link ends are labelled (128-bit address digests), so the iteration works on the edge table alone; pages
    join the resulting block list on their digest.  Null urls and urls without ``://`` have empty host and path, fit
    no rule and get ``default``; repeated rows are judged alike; empty tables give no rows; html may be null.
    """
    judged = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    host, path = url_host(F.col("_url")), url_path(F.col("_url"))
    judged = judged.select("_id", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    judged = judged.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_v"),
                           F.when(F.col("_url").contains("://"), _node(F.col("_url"))).alias("node"))
    edges = stage((link_edges(pages, url_col, html_col) if edges is None else edges).select("src", "dst"), "url-edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url")).where(F.col("url").isNotNull()).distinct()
    blocked_ends = ends.where(decide(url_host(F.col("url")), url_path(F.col("url")), rules)[1] == "block").select(_node(F.col("url")).alias("node"))
    seeds = judged.where(F.col("_v") == "block").select("node").unionByName(blocked_ends).distinct()
    labels = components(edges.select(_node(F.col("src")).alias("u"), _node(F.col("dst")).alias("v")))
    bad = labels.join(seeds, "node", "left_semi").select("component").distinct()
    blocked = labels.join(bad, "component", "left_semi").select("node").unionByName(seeds).distinct().withColumn("_b", F.lit(True))
    return judged.join(blocked, "node", "left").select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_v", F.when(F.col("_b"), F.lit("block")), F.lit(default)).alias("verdict"))
