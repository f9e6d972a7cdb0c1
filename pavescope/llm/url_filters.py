"""URL filtering with pattern rules indexed by their rarest literal token. DataFrame functions only.

Each rule names literal tokens that every URL it matches must contain. Token counts over all URLs
pick the rarest one as the rule's only index key. URL tokens fetch candidate rules from the index by
an equi-join, and only candidates run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Up to so many rules the index is broadcast; more are joined by shuffle.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """A pattern over ``host + path`` (host in lower case; for ``listed`` rules the path as it is, else in lower case)."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    listed: bool = False


def listed(name: str, action: str) -> Rule:
    """A host and path prefix, such as ``example.net/en/``: fits the host and its subdomains."""
    host, _, path = name.partition("/")
    return Rule(name, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", tuple(re.findall("[a-z0-9]+", name.lower())), True)


LISTED = (listed("net/", "block"), listed("example.net/en/", "allow"), listed("example.com/de/", "block"), listed("org/fr/", "allow"))
#: What the method itself blocks: hosts and path segments of link farms, pill shops, gambling and adult sites.
PATTERNS = (
    Rule("pills", "block", r"(?:^|[.-])(?:cheap|buy|discount)-pills(?:[.-]|/|$)", ("pills",)),
    Rule("farm", "block", r"(?:^|[.-])spam-farm(?:[.-]|/|$)", ("spam", "farm")),
    Rule("adult", "block", r"(?:^|[.-])adult-[a-z0-9]+\.", ("adult",)),
    Rule("xxx", "block", r"(?:^|[./-])xxx(?:[./-]|$)", ("xxx",)),
    Rule("casino", "block", r"(?:^|[./-])casino(?:[./-]|$)", ("casino",)),
    Rule("poker", "block", r"^[^/]*(?:^|[.-])poker(?:[.-]|/|$)", ("poker",)),
    Rule("payday", "block", r"(?:^|[./-])payday-loans?(?:[./-]|$)", ("payday",)),
    Rule("warez", "block", r"(?:^|[./-])warez(?:[./-]|$)", ("warez",)),
    Rule("porn", "block", r"(?:^|[./-])porn(?:[./-]|$)", ("porn",)),
    Rule("malware", "block", r"(?:^|[./-])malware-download(?:[./-]|$)", ("malware", "download")),
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _rules(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.lit(r.pattern).alias("pattern"), F.array(*map(F.lit, sorted(set(r.tokens)))).alias("tokens"), F.lit(r.listed).alias("listed")) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def rule_index(sites: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(token, rule, action, pattern, listed): one row per rule, its token the rarest in sites (column tokens), ties to the lesser token."""
    table = _rules(sites.sparkSession, rules)
    wanted = sorted({t for r in rules for t in r.tokens})
    if len(wanted) <= BROADCAST_RULES:
        found = sites.select(F.explode(F.array_intersect("tokens", F.array(*map(F.lit, wanted)))).alias("token"))
    else:
        found = sites.select(F.explode("tokens").alias("token")).join(table.select(F.explode("tokens").alias("token")).distinct(), "token", "left_semi")
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = table.select("*", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rank = F.row_number().over(Window.partitionBy("rule", "pattern").orderBy(F.coalesce("n", F.lit(0)), "token"))
    return each.withColumn("r", rank).where("r = 1").select("token", "rule", "action", "pattern", "listed")


def url_filter(pages: DataFrame, rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (of the listed rule, else null), verdict and pattern_rule for each row of pages.

    Null or schemeless urls have empty host and path, fit no rule and get the default. Rows are kept as
    they are, repeated ones too. The longest listed rule wins (ties to the greater name); without one, a
    pattern rule's action; without any, the default. Other columns are not looked at.
    """
    if not rules:
        raise ValueError("no rules")
    url = F.col("url")
    pages = pages.select("page_id", "url")
    site = F.concat(host_of(url), path_of(url))
    sites = pages.select("url").where(url.contains("://")).distinct().select("url", site.alias("site"))
    sites = sites.withColumn("tokens", F.array_distinct(F.split(F.translate("site", UPPER, LOWER), "[^a-z0-9]+")))
    index = rule_index(sites, rules)
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    fetched = sites.select("url", "site", F.explode("tokens").alias("token")).join(index, "token")
    fitting = fetched.where(F.when(F.col("listed"), F.expr("site RLIKE pattern")).otherwise(F.expr(f"translate(site, '{UPPER}', '{LOWER}') RLIKE pattern")))
    best = fitting.groupBy("url").agg(F.max(F.struct("listed", F.when(F.col("listed"), F.length("rule")).otherwise(0).alias("n"), "rule", "action")).alias("best"))
    return pages.join(best, "url", "left").select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.when(F.col("best.listed"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"), F.when(~F.col("best.listed"), F.col("best.rule")).alias("pattern_rule"),
    )


def oracle(rules: tuple[Rule, ...] = LISTED + PATTERNS, default: str = "allow") -> str:
    """DuckDB SQL of url_filter over pages, by trying every rule on every url."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    site = {True: "host || path", False: f"translate(host || path, '{UPPER}', '{LOWER}')"}
    cases = lambda of, pick: " ".join(f"WHEN regexp_matches({site[r.listed]}, {quoted(r.pattern)}) THEN {quoted(pick(r))}" for r in of)
    by_length = sorted((r for r in rules if r.listed), key=lambda r: (len(r.name), r.name), reverse=True)
    by_name = sorted((r for r in rules if not r.listed), key=lambda r: r.name, reverse=True)
    return f"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '{_URL}', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '{_URL}', 2), '') AS path,
           coalesce(contains(url, '://'), false) AS judged FROM pages),
     r AS (SELECT page_id, host, path, CASE WHEN NOT judged THEN NULL {cases(by_length, lambda r: r.name)} END AS rule,
           CASE WHEN NOT judged THEN NULL {cases(by_name, lambda r: r.name)} END AS pattern_any,
           CASE WHEN NOT judged THEN '{default}' {cases(by_length, lambda r: r.action)} {cases(by_name, lambda r: r.action)} ELSE '{default}' END AS verdict FROM p)
SELECT page_id, host, path, rule, verdict, CASE WHEN rule IS NULL THEN pattern_any END AS pattern_rule FROM r"""
