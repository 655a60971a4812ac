"""URL filters: pattern rules behind an index of their rarest literal token (operator 11).

A rule is a pattern over a URL's host and path (written one after the other).  Letters, digits and most
signs stand for themselves; ``||`` in front ties the pattern to the host or one of its parent domains,
``|`` in front or behind to the start or end, ``*`` is any run of characters, ``^`` a character that is
no ASCII letter or digit, or either end.  ``/.../`` is a regular expression as it is.

Every match of a pattern holds its *literal tokens*: runs of ASCII letters and digits that the pattern
closes on both sides.  The index lists each rule once, under the one of its tokens that the fewest URLs
hold.  A URL's own tokens fetch candidate rules by an equality join, and only those run their regular
expressions.  Rules without any such token (regular expressions, ``ab*``) are candidates for every URL.

Tokens are looked up for distinct URLs, so a page in a third of all rows costs one look-up; the number
of rules decides between a broadcast and a shuffled join by Spark's size threshold.  A URL's candidates
are reduced to the winning rule before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshore.llm.common import written

TOKEN = "[A-Za-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: the index entry of rules without a token; no URL token is empty
ANY = ""


@dataclass(frozen=True)
class Rule:
    """A pattern and its verdict.  Of the rules that fit, the lowest tier wins, then the longest name,
    then the name itself.  ``host_only`` patterns see the host alone."""
    name: str
    pattern: str
    verdict: str
    tier: int = 0
    host_only: bool = False


def site_rule(verdict: str, site: str) -> Rule:
    """``example.org/es/``: the host and its subdomains, paths that start so."""
    return Rule(site, f"||{site}", verdict)


SITE_RULES = [site_rule("allow", "org/"), site_rule("block", "example.org/es/"), site_rule("block", "example.org/en/1"),
              site_rule("allow", "com/fr/"), site_rule("block", "com/de/")]

# fixed values: words of host names that stand for adverts, betting, pills and adult pages
SPAM_WORDS = ["ads", "adserver", "adult", "bet", "bets", "betting", "casino", "escort", "gambling", "lottery", "pills",
              "poker", "porn", "viagra", "xxx"]

#: what decides where no site rule fits; no pattern at all: allow
SPAM_RULES = [Rule(f"^{w}^", f"^{w}^", "block", tier=1, host_only=True) for w in SPAM_WORDS]


def regular_expression(pattern: str) -> str:
    """The pattern as a regular expression to be found in the text."""
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return pattern[1:-1]
    head, tail = "", ""
    if pattern.startswith("||"):
        head, pattern = r"^(?:[^/]*\.)?", pattern[2:]
    elif pattern.startswith("|"):
        head, pattern = "^", pattern[1:]
    if pattern.endswith("|"):
        tail, pattern = r"\z", pattern[:-1]
    wild = {"*": r"[\s\S]*", "^": r"(?:[^A-Za-z0-9]|^|\z)"}
    return head + "".join(wild.get(c) or (c if re.match(r"\w", c) else "\\" + c) for c in pattern) + tail


def literal_tokens(pattern: str) -> list[str]:
    """Tokens that every matching text holds as a whole."""
    if len(pattern) > 1 and pattern[0] == pattern[-1] == "/":
        return []
    tied_start, tied_end = pattern.startswith("|"), pattern.endswith("|") and pattern != "|"
    body = pattern.lstrip("|") if tied_start else pattern
    body = body[:-1] if tied_end else body
    out = []
    for m in re.finditer(TOKEN, body):
        before = body[m.start() - 1] if m.start() else ("|" if tied_start else "*")
        after = body[m.end()] if m.end() < len(body) else ("|" if tied_end else "*")
        if before != "*" and after != "*":
            out.append(m[0])
    return list(dict.fromkeys(out))


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.name, regular_expression(r.pattern), r.verdict, r.tier, r.host_only, literal_tokens(r.pattern)) for r in rules]
    return spark.createDataFrame(rows, "rule string, regex string, verdict string, tier int, host_only boolean, tokens array<string>")


def rarest_token_index(rules: DataFrame, url_tokens: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that the fewest URLs hold (ties: the smaller token)."""
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    held = url_tokens.select(F.explode("tokens").alias("token")).join(wanted, "token", "left_semi").groupBy("token").agg(
        F.count(F.lit(1)).alias("urls"))
    keyed = rules.select("*", F.explode_outer("tokens").alias("token")).join(held, "token", "left")
    fewest = F.min(F.struct(F.coalesce("urls", F.lit(0)).alias("urls"), F.coalesce("token", F.lit(ANY)).alias("token")))
    columns = ["rule", "regex", "verdict", "tier", "host_only"]
    return keyed.groupBy(*columns).agg(fewest.alias("least")).select(*columns, F.col("least.token").alias("token"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, the winning rule, its tier and verdict.

    Null URLs and those without ``://`` have an empty host and path; only rules that match an empty text
    fit them.  Without any fitting rule, ``rule`` and ``tier`` are null and the verdict is ``default``.
    Repeated rows and ids give a row each, an empty table none; other columns of ``pages`` are not read.
    URLs of any length are matched whole.
    """
    rules = written(rules, "url-rule-list")          # its size is known then, so that a short list is broadcast
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # a host has no slash and a path starts with one or is empty, so the text stands for both
    text = F.concat("host", "path")
    urls = parts.select("host", text.alias("text")).distinct()
    urls = urls.select("*", F.array_distinct(F.regexp_extract_all("text", F.lit(TOKEN), 0)).alias("tokens"))
    urls = written(urls, "url-tokens")
    index = written(rarest_token_index(rules, urls), "url-rules")

    fetched = urls.select("host", "text", F.explode(F.concat("tokens", F.array(F.lit(ANY)))).alias("token")).join(index, "token")
    seen = F.when(F.col("host_only"), F.col("host")).otherwise(F.col("text"))
    fits = fetched.filter(F.regexp_like(seen, F.col("regex")))
    best = F.min(F.struct("tier", (-F.length("rule")).alias("length"), "rule", "verdict"))
    winner = fits.groupBy("text").agg(best.alias("best")).select("text", F.col("best.*"))
    out = parts.withColumn("text", text).join(winner, "text", "left")
    return out.select("page_id", "host", "path", "rule", "tier", F.coalesce("verdict", F.lit(default)).alias("verdict"))
