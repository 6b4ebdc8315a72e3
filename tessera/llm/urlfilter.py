"""URL filters with redirect equivalence, in DataFrame operations only.

A rule is a host and a path prefix; it fits the host and its subdomains and the longest
fitting rule decides. Pages that redirects or canonical links join are one resource under
several names: connected components over those edges carry a block to every alias that no
rule of its own decides. An explicit allow inside a component wins over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .session import cut
from .totals import with_totals

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: fixed values.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """The name of a resource: scheme and host in lower case, no fragment; null without ://."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), url_host(url), rest))


def resolve(base: Column, link: Column) -> Column:
    """An absolute URL for a link found on the page `base`; null for an empty one."""
    link = F.replace(F.trim(link), F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?") | link.startswith("#"), F.concat(root, url_path(base), link))
        .otherwise(F.concat(root, F.when(folder == "", "/").otherwise(folder), link))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of pages and of what all their canonical links and refresh redirects name."""
    url, html = F.col("url"), F.col("html")
    named = lambda tag, target: F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))
    canonical = named(_LINK, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = named(_REFRESH, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)")
    links = F.filter(F.array_distinct(F.concat(canonical, refresh)), lambda x: x != "")
    found = pages.where("url is not null and html is not null").select(url.alias("url"), F.explode(links).alias("link"))
    return found.select(url_key(F.col("url")).alias("a"), url_key(resolve(F.col("url"), F.col("link"))).alias("b"))


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, ...) with rule and rule_verdict of the longest fitting rule, else null.

    rules: (rule, verdict). Distinct hosts meet the rules by their suffixes, so a host with
    most of the rows is joined once; rows then meet their host's few candidate rules.
    """
    slash = F.instr("rule", "/")
    split = rules.select(
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.struct(
            F.length("rule").alias("length"), "rule", "verdict",
            F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("prefix"),
        ).alias("r"),
    )
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    hosts = urls.select("host").where("host <> ''").distinct().select("host", F.explode(suffixes).alias("suffix"))
    chosen = hosts.join(split, "suffix").groupBy(F.col("host").alias("_host")).agg(F.collect_list("r").alias("_rules"))
    chosen = cut(chosen)  # the join below then has two plain shuffles (or a small side), so a common host can be split
    fit = F.filter("_rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    best = F.array_max(fit)
    return (
        urls.join(chosen, F.col("host") == F.col("_host"), "left")
        .withColumn("_best", best)
        .withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")})
        .drop("_host", "_rules", "_best")
    )


def rules_frame(spark, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    listed = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")) for rule, verdict in rules])
    return spark.range(1).select(F.inline(listed))


def judge_urls(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, html).

    redirects: further edges (src_url, dst_url). verdict: the rule's; without a rule, allow if
    any alias has an explicit allow, else block if any alias is blocked, else allow. A null
    url or one without :// has empty host and path, no rule and no alias: allow. Null html has no
    links; repeated rows are judged alike; other columns are ignored; no pages give no rows.
    """
    spread = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    edges = page_edges(spread)
    if redirects is not None:
        edges = edges.unionAll(redirects.select(url_key(F.col("src_url")).alias("a"), url_key(F.col("dst_url")).alias("b")))
    edges = cut(edges.where("a is not null and b is not null and a <> b").distinct())
    judged = with_rule(
        spread.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_key(F.col("url")).alias("_key")),
        rules,
    )
    if edges.isEmpty():
        verdict = F.coalesce("rule_verdict", F.lit("allow"))
        return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    members = connected_components(edges)
    named = with_rule(members.select("vertex", "component", url_host(F.col("vertex")).alias("host"), url_path(F.col("vertex")).alias("path")), rules)
    told = with_totals(
        named.select("vertex", "component", "rule_verdict"), ["component"], "vertex",
        [F.bool_or(F.col("rule_verdict") == "allow").alias("allowed"), F.bool_or(F.col("rule_verdict") == "block").alias("blocked")],
        "allowed or blocked",
    )
    aliases = told.select(F.col("vertex").alias("_vertex"), F.when(F.col("allowed"), "allow").otherwise("block").alias("alias_verdict"))
    return judged.join(aliases, F.col("_key") == F.col("_vertex"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "alias_verdict", F.lit("allow")).alias("verdict")
    )
