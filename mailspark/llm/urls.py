"""URL filter with redirect equivalence, in DataFrame operations only.

A rule (action, host, path) fits the host and all its subdomains if the url's path starts with the rule's path; the longest
host + path wins, and allow wins over block of the same length. Urls without a rule of their own follow their aliases: redirects
(meta refresh, or a table of links) and canonical links join urls into components, and a component with a blocked url blocks its other
members unless it also has an explicitly allowed one. Everything else is allowed.

A url's node is host + path + query: scheme and fragment don't make another page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailspark.llm.common import LOWER, UPPER, stored
from mailspark.llm.components import components

RULES = "action string, rule_host string, rule_path string"
LINK_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b[^>]*>"
REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, node) of a url; null or no ``://``: empty host and path, null node."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    tail = F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1)
    node = F.when(host != "", F.concat(host, tail))
    return host, F.regexp_extract(tail, r"^[^?]*", 0), node


def resolved(target: Column, host: Column, path: Column) -> Column:
    """Absolute form of a link found on a page; dot segments are kept as they are."""
    link = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    place = F.concat(F.lit("http://"), host)
    return (
        F.when(link.isNull() | (link == "") | link.startswith("#"), F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(place, link))
        .when(link.startswith("?"), F.concat(place, path, link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(place, F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), link))
    )


def link_targets(html: Column) -> Column:
    """Targets of all canonical links and meta refreshes, as written."""
    href = lambda tag: F.concat(*(F.regexp_extract(tag, HREF, g) for g in (1, 2, 3)))
    canonical = F.transform(F.regexp_extract_all(html, F.lit(LINK_TAG), F.lit(0)), href)
    refresh = F.transform(F.regexp_extract_all(html, F.lit(REFRESH_TAG), F.lit(0)), lambda tag: F.regexp_extract(tag, REFRESH_URL, 1))
    return F.concat(canonical, refresh)


def page_links(pages: DataFrame) -> DataFrame:
    """(from_url, to_url) of redirects and canonical links in the pages' HTML."""
    host, path, _ = parts(F.col("url"))
    rows = pages.filter(F.col("url").isNotNull()).select("url", "html", host.alias("host"), path.alias("path"))
    targets = F.transform(link_targets(F.col("html")), lambda target: resolved(target, F.col("host"), F.col("path")))
    return rows.select(F.col("url").alias("from_url"), F.explode(F.array_compact(targets)).alias("to_url"))


def fitting_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each distinct host and of its parent domains; looked up by equality, so rules may be many."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = hosts.filter("host <> ''").distinct().select("host", F.explode(suffixes).alias("rule_host"))
    rule = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("size"), (F.col("action") == "allow").alias("allows"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_path").alias("path"), "action",
    )
    return named.join(rules, "rule_host").groupBy("host").agg(F.collect_set(rule).alias("rules"))


def with_rule(spark: SparkSession, rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path, ...) with ``best``: the struct of the winning rule or null.

    The hosts' rules are written first: the join then knows their size, and where it shuffles, a hot host's rows can be split.
    """
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])))
    return rows.join(stored(spark, fitting_rules(rows.select("host"), rules), "host-rules"), "host", "left").withColumn("best", best).drop("rules")


def verdicts(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, host, path, rule (host + path or null), verdict (allow or block).

    rules: (action, host, path) rows. redirects: more (from_url, to_url) links. Null urls and urls without ``://`` have an empty host
    and path, no rule, and are allowed. Null html has no links. Rows of one url share their verdict. Other columns are not read.
    """
    rules = (rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, RULES)).dropna().dropDuplicates()
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    groups = components(links.select(parts(F.col("from_url"))[2].alias("a"), parts(F.col("to_url"))[2].alias("b")))
    node = F.concat(F.lit("any://"), F.col("node"))
    judged = with_rule(spark, groups.select("node", "component", parts(node)[0].alias("host"), parts(node)[1].alias("path")), rules)
    decided = judged.groupBy("component").agg(F.max(F.col("best.action") == "block").alias("blocks"), F.max("best.allows").alias("allows"))
    blocked = stored(
        spark,
        groups.join(decided.filter("blocks and not coalesce(allows, false)"), "component", "left_semi").select(F.col("node").alias("blocked_node")),
        "blocked-urls",
    )
    host, path, node = parts(F.col("url"))
    rows = with_rule(spark, pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("node")), rules)
    inherited = rows.join(blocked, rows["node"] == blocked["blocked_node"], "left")
    verdict = F.coalesce("best.action", F.when(F.col("blocked_node").isNotNull(), "block"), F.lit("allow"))
    return inherited.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
