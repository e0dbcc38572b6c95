"""URL filters with decisions that follow redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, settle
from quern.llm.components import connected_components

Rule = tuple[str, str, str]  # action, host, path
RULES: list[Rule] = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``,
    ``#`` or the end. A null url or one without ``://`` has an empty host and path."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as ``struct<length, allow, rule>`` (null if none fits; allow wins ties).

    A rule fits its host and all subdomains, if the path starts with its own.
    """
    if not rules:
        return F.lit(None).cast("struct<length:int,allow:boolean,rule:string>")
    tried = []
    for action, h, p in rules:
        on = (host == h) | F.endswith(host, F.lit("." + h))
        hit = F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(action == "allow").alias("allow"), F.lit(h + p).alias("rule"))
        tried.append(F.when(on & F.startswith(path, F.lit(p)), hit))
    return F.array_max(F.array(*tried))


def url_node(url: Column) -> Column:
    """What aliases are compared by: the url without scheme and fragment, its host lower-cased, no trailing empty path."""
    rest = _after_scheme(url)
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    tail = F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    tail = F.when(tail == "", F.lit("/")).when(F.startswith(tail, F.lit("?")), F.concat(F.lit("/"), tail)).otherwise(tail)
    return F.when((F.instr(url, "://") > 0) & (host != ""), F.concat(host, tail))


_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_META = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^>]*?url\s*=\s*[\"']?([^\"'\s>]+)"


def _absolute(target: Column, url: Column) -> Column:
    host, path = split_url(url)
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_extract(path, "^(.*/)", 1)
    return (
        F.when(t == "", None)
        .when(F.instr(t, "://") > 0, t)
        .when(F.startswith(t, F.lit("//")), F.concat(F.lit("http:"), t))
        .when(F.startswith(t, F.lit("/")), F.concat(F.lit("http://"), host, t))
        .otherwise(F.concat(F.lit("http://"), host, F.when(folder == "", "/").otherwise(folder), t))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges ``src``, ``dst`` (absolute urls) from a page to its canonical link and to its meta-refresh target.

    Relative targets are taken against the page's host and folder; dot segments are left as they are."""
    found = F.array(
        *[
            F.when(F.contains(F.lower(F.col(html)), F.lit(word)), _absolute(F.regexp_extract(html, rx, 1), F.col(url)))
            for word, rx in (("canonical", _LINK), ("refresh", _META))
        ]
    )
    rows = pages.where(F.contains(F.lower(F.col(html)), F.lit("canonical")) | F.contains(F.lower(F.col(html)), F.lit("refresh")))
    return rows.select(F.col(url).alias("src"), F.explode(found).alias("dst")).where("src is not null and dst is not null")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url", html: str | None = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """Judge every page: ``key``, ``host``, ``path``, ``rule``, ``verdict``, ``aliases`` (urls in its group, itself included).

    A page that a rule fits has that rule's verdict. Another page is blocked if it is an alias of a blocked url and of
    no explicitly allowed one, else allowed. Aliases are the urls connected by canonical links and meta refreshes in
    ``html`` and by ``redirects`` (columns ``src``, ``dst``), in either direction and over any number of steps; urls
    that differ only in scheme, host case or fragment are one. Rules are applied to every url of a group, whether it
    is a page or not.

    Urls that are null or without ``://`` have an empty host and path, fit no rule, have no alias and are allowed.
    Repeated rows and ties get equal verdicts; an empty table gives no rows; other columns are not read. Rules are a
    list in the plan, meant for up to some hundreds.
    """
    host, path = split_url(F.col(url))
    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), path.alias("path"))
    out = out.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", url_node(F.col("url")))
    edges = None
    if html is not None:
        edges = page_links(pages, url, html)
    if redirects is not None:
        more = redirects.select("src", "dst")
        edges = more if edges is None else edges.union(more)
    if edges is None:
        groups = None
    else:
        edges = settle(edges.select(url_node(F.col("src")).alias("a"), url_node(F.col("dst")).alias("b")).where("a <> b").distinct())
        cc = settle(connected_components(edges))
        h, p = F.regexp_extract("node", "^[^/?#]*", 0), F.regexp_extract("node", "^[^/?#]*([^?#]*)", 1)
        judged = cc.select("node", "component", rule_of(h, p, rules).alias("r"))
        sums = settle(judged.groupBy("component").agg(F.max(F.coalesce("r.allow", F.lit(False))).alias("ok"), F.max(F.coalesce(~F.col("r.allow"), F.lit(False))).alias("bad"), F.count("*").alias("aliases")))
        groups = settle(cc.join(sums, "component").select("node", (F.col("bad") & ~F.col("ok")).alias("bad"), "aliases"))
    if groups is None:
        out = out.withColumns({"bad": F.lit(False), "aliases": F.lit(1).cast("long")})
    else:
        out = out.join(groups, "node", "left")
    mine = F.when(F.col("own.allow"), "allow").when(~F.col("own.allow"), "block")
    verdict = F.coalesce(mine, F.when(F.col("bad"), "block"), F.lit("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("aliases", F.lit(1)).cast("long").alias("aliases"))


def rules_sql(host: str, path: str, rules: Sequence[Rule], want: str) -> str:
    """The same choice as a CASE expression: rules from the longest, allow before block."""
    order = sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[0] != "allow"))
    value = {"rule": lambda r: r[1] + r[2], "verdict": lambda r: r[0]}[want]
    return "CASE " + " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{value((a, h, p))}'" for a, h, p in order) + " END"
