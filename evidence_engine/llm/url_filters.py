"""URL verdicts from host and path rules, passed on to redirect and canonical aliases.

All of it is DataFrame operations. Addresses that differ in scheme, fragment, tracking parameters,
default port or a closing slash are one node; canonical links and immediate refreshes in a page's
HTML are edges between nodes. An address without a rule of its own is blocked if any address of its
connected component is blocked by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_engine.llm.common import Scratch, materialize
from evidence_engine.llm.components import components

#: Fixed: the given rules.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\bcontent\s*=\s*[\"']?\s*\d+\s*;\s*url\s*=\s*[\"']?([^\"'>\s]+)"
_TRACKING = r"(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*)"


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """``rule, verdict``."""
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")), F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """The address that its variants share; missing without ``://``."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{_TRACKING}$"))
    name = F.regexp_replace(host(url), ":(80|443)?$", "")
    joined = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(name, F.regexp_replace(path(url), "/+$", ""), joined))


def _targets(html: Column) -> Column:
    """Where a page says that it lives: all its canonical links and refreshes; missing without HTML."""
    found = F.concat(
        *(F.regexp_extract_all(html, F.lit(_LINK), F.lit(i)) for i in (1, 2, 3)),
        F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)),
    )
    trimmed = F.transform(F.filter(found, lambda t: t != ""), lambda t: F.trim(F.replace(t, F.lit("&amp;"), F.lit("&"))))
    return F.when(html.rlike("(?i)canonical|http-equiv"), F.array_distinct(trimmed))


def _absolute(url: Column, target: Column) -> Column:
    """A link target as an address; like the page's own if it names no host."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(url), "^[^/?#]*", 0))
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path(url), "(?s)^.*/", 0), F.lit("")), F.lit("/")))
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(folder, target))
    )


def with_rule(urls: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Each distinct ``host, path`` with its longest fitting rule, if one fits; of equally long ones an allow.

    A host meets the rules of its own labels by an equality join on each of its suffixes.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    rules = rules.select(
        "rule",
        F.col("verdict").alias("rule_verdict"),
        F.translate(F.regexp_extract("rule", "^[^/]*", 0), _UPPER, _LOWER).alias("suffix"),
        F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("start"),
    )
    best = (
        urls.select(key, "host", "path", F.explode(suffixes).alias("suffix"))
        .join(rules, "suffix")
        .where(F.startswith("path", F.col("start")))
        .groupBy("host", "path")
        .agg(
            F.max(F.struct(F.length("rule").alias("size"), (F.col("rule_verdict") == "allow").alias("allow"), "rule", "rule_verdict")).alias("best")
        )
    )
    return best.select("host", "path", "best.rule", "best.rule_verdict")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, passed_on`` of every page; rules ``rule, verdict``.

    The page's own longest rule decides, so an explicit allow is never overruled. Without a rule
    the page is blocked if an alias, be it a page or only the target of a link, is blocked by a
    rule (``passed_on``), else allowed. A missing url, or one without ``://``, has an empty host and
    path, no rule and no aliases, and is allowed. Missing or empty HTML has no links; repeated rows
    are judged alike, one row for each; other columns are ignored; an empty table gives an empty table.
    """
    scratch = Scratch(pages.sparkSession)
    url, target = F.col("url"), F.col("target")  # one row of ``target`` for each link
    parsed = scratch.write(
        pages.select("page_id", "url", _targets(F.col("html")).alias("targets")).select(
            "page_id",
            host(url).alias("host"),
            path(url).alias("path"),
            node(url).alias("node"),
            F.when(F.contains(url, F.lit("://")), F.transform("targets", lambda t: _absolute(url, t))).alias("targets"),
        ),
        "url-pages",
    )
    links = parsed.select(F.col("node").alias("from"), F.explode("targets").alias("target"))
    named = links.select(
        "from", host(target).alias("host"), path(target).alias("path"), node(target).alias("node")
    ).where("node is not null")
    addresses = parsed.select("host", "path", "node").union(named.select("host", "path", "node"))
    addresses = addresses.where("node is not null").distinct()
    ruled = scratch.write(with_rule(addresses, rules, "node"), "url-rules")
    found = components(named.select(F.col("from").alias("u"), F.col("node").alias("v")).distinct())
    blocked = (
        addresses.join(ruled.where("rule_verdict = 'block'"), ["host", "path"], "left_semi")
        .join(found, "node", "left")
        .select(F.coalesce("component", "node").alias("component"), F.lit(True).alias("passed"))
        .distinct()
    )
    reached = (
        addresses.select("node")
        .distinct()
        .join(found, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
        .join(blocked, "component")
        .select("node", "passed")
    )
    out = materialize(
        parsed.join(ruled, ["host", "path"], "left")
        .join(reached, "node", "left")
        .select(
            "page_id",
            "host",
            "path",
            "rule",
            F.coalesce("rule_verdict", F.when(F.col("passed"), "block").otherwise("allow")).alias("verdict"),
            (F.col("rule").isNull() & F.coalesce("passed", F.lit(False))).alias("passed_on"),
        ),
        "url-verdicts",
    )
    scratch.clear()
    return out
