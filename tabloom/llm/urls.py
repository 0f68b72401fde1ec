"""URL verdicts: host and path rules, and their spread over redirects and canonical links, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule), a rule being a host and then a path.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))"""
_CANONICAL = r"""(?is)<link\b[^<>]*\brel\s*=\s*["']?canonical\b[^<>]*>"""
_REFRESH = r"""(?is)<meta\b[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b[^<>]*>"""
_REFRESH_URL = r"""(?is)\burl\s*=\s*["']?\s*([^"'<>\s]+)"""


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node(url: Column) -> Column:
    """What stands for a url in the graph: host, path and query; null where there is no host."""
    key = F.concat(host(url), path(url), F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1))
    return F.when(host(url) != "", key)


def rule(host_: Column, path_: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Later rules win ties."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda x: len(x[1])):
        at, slash, rest = text.partition("/")
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def resolved(target: Column, base: Column) -> Column:
    """An absolute url for a link found on the page ``base``; null if empty."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target == "", None)
        .when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, alias_verdict; one row for each page.

    A page that a rule fits has the rule's verdict. Any other has the verdict of its component over canonical links and
    redirects (``meta refresh`` in the page, and ``redirects`` with columns src and dst if given): ``block`` if a rule
    blocks a url of the component and no rule allows one, else ``allow``. Null, relative or odd urls are in no component
    and have the verdict ``allow``. Urls that differ in scheme or fragment alone are one node. Pages may repeat."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    canonical = F.regexp_extract(html, _CANONICAL, 0)
    links = F.array(F.concat(*[F.regexp_extract(canonical, _HREF, g) for g in (1, 2, 3)]), F.regexp_extract(F.regexp_extract(html, _REFRESH, 0), _REFRESH_URL, 1))
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url"))
    linked = pages.select(url.alias("url"), F.explode(links).alias("to")).where("to <> ''")
    edges = linked.select(node(F.col("url")).alias("a"), node(resolved(F.trim("to"), F.col("url"))).alias("b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("src").cast("string")), node(F.col("dst").cast("string"))))
    labels = components(edges.where("a is not null and b is not null"), "urls")
    as_url = F.concat(F.lit("://"), F.col("node"))
    named = shared.settle(labels.withColumn("v", rule(host(as_url), path(as_url), rules)["verdict"]), "urls-nodes")
    spread = named.groupBy("component").agg(F.max((F.col("v") == "block").cast("int")).alias("blocks"), F.max((F.col("v") == "allow").cast("int")).alias("allows")).where("blocks = 1").select("component", F.when(F.col("allows") == 1, "allow").otherwise("block").alias("alias_verdict"))
    spread = shared.settle(spread, "urls-components")
    spread = shared.settle(named.join(spread, "component").select(F.col("node").alias("key"), "alias_verdict"), "urls-spread")
    out = base.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).withColumn("r", rule(F.col("host"), F.col("path"), rules)).withColumn("key", node(F.col("url")))
    out = out.join(spread, "key", "left")
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("alias_verdict"), F.lit("allow")).alias("verdict"), "alias_verdict")
