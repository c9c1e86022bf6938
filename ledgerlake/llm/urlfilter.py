"""URL filtering with redirect equivalence, in DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains, and the
longest fitting rule decides on a url.  Pages that name each other as canonical
(<link rel=canonical>) or redirect to each other (<meta http-equiv=refresh>, or a
table of redirects) are aliases: connected components over these links carry
decisions to members that no rule fits.  Precedence: a url's own rule; else an
explicit allow of any member; else a block of any member; else allow.

A url's node is its host, path and query: scheme and fragment name no other page.

Defined cases: a null url and one without "://" have empty host and path and no rule;
links to nowhere are ignored; repeated pages are judged alike; null html has no
links; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components, cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>;]+)"""

Rule = tuple[str, str, str]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node(url: Column) -> Column:
    return F.when(url.contains("://"), F.concat(F.lit("://"), host(url), path(url), F.regexp_extract(url, _URL, 3))).otherwise(url)


def judge(h: Column, p: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls if none does.  rules: (verdict, host, path)."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, rh, rp in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "allow")):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        out = F.when(fits, F.struct(F.lit(rh + rp).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def absolute(link: Column, url: Column) -> Column:
    """``link`` as found on the page ``url``; null if empty."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    base = F.concat(F.lit("://"), host(url))
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    return (
        F.when(link == "", F.lit(None).cast("string"))
        .when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit(":"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """a, b: nodes of pages and of what they name as canonical or redirect to."""
    url = F.col(url_col)
    every = F.concat(*(F.regexp_extract_all(html_col, F.lit(x), F.lit(1)) for x in (_CANONICAL, _REFRESH)))
    found = pages.where(url.isNotNull() & F.col(html_col).isNotNull()).select(url.alias("_url"), F.explode(every).alias("_link"))
    found = found.select(node(F.col("_url")).alias("a"), absolute(F.col("_link"), F.col("_url")).alias("_to"))
    return found.where(F.col("_to").isNotNull()).select("a", node(F.col("_to")).alias("b"))


def filter_urls(
    pages: DataFrame,
    rules: list[Rule],
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    from_col: str = "from_url",
    to_col: str = "to_url",
) -> DataFrame:
    """Per page: id, host, path, rule (null if none fits), verdict (allow or block)."""
    edges = links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col(from_col)), node(F.col(to_col))))
    edges = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).distinct())
    url = F.col(url_col)
    own = pages.select(F.col(id_col), host(url).alias("host"), path(url).alias("path"), node(url).alias("_node")).withColumn("_own", judge(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        alias = own.withColumn("_alias", F.lit(None).cast("string"))
    else:
        members = connected_components(edges)
        said = members.withColumn("_v", judge(host(F.col("node")), path(F.col("node")), rules).getField("verdict"))
        verdicts = said.groupBy("root").agg(F.when(F.max(F.col("_v") == "allow"), "allow").when(F.max(F.col("_v") == "block"), "block").alias("_alias"))
        alias = own.join(members.join(verdicts, "root").select(F.col("node").alias("_node"), "_alias"), "_node", "left")
    return alias.select(id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", "_alias", F.lit("allow")).alias("verdict"))
