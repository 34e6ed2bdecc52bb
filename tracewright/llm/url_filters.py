"""URL filters (7): host and path rules, and pattern rules that are indexed by their rarest literal token.

A pattern is literal text with `*` (anything), `^` (a separator or the end), `||` in front (the start of a host label) and `|` at either
end (an anchor); `@@` in front makes it an exception. Patterns match regardless of A-Z case. A pattern's tokens are the runs of [a-z0-9%]
that every matching URL holds as whole tokens. Rarity is counted over all URLs by a grouped aggregation that keeps only tokens of rules,
so its result has at most as many rows as the rules have tokens. A URL's tokens fetch candidate rules and only those run their regular
expression; rules without a whole token run on every URL. The rules are configuration that each worker holds (most_rules bounds them).

Null URLs and those without `://` have empty host and path, fit no host rule and are judged by the patterns on the whole string (null:
allow). Rows depend on their own URL only; repeated rows get equal verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._names import unused

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class HostRule(NamedTuple):
    verdict: str
    rule: str


HOST_RULES = (HostRule("block", "com/en/"), HostRule("allow", "example.com/en/7"), HostRule("allow", "net/de/"), HostRule("block", "example.net/de/8"), HostRule("block", "org/es/"))
#: Block lists in small: advertising, adult, gambling and spam hosts, tracking paths, and one exception.
PATTERNS = ("||ads-track.", "||adult-x.", "||casino-win.", "||free-bets.", "||spam-farm.", "/casino/", "/porn*video^", "||doubleclick.", "/banner^*.gif|", "viagra", "@@||example.org/en/1^")
most_rules = 200_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[HostRule]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits; null if none does. A rule's host covers its subdomains."""
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.rule)):
        name, slash, start = rule.rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        verdict, text = F.when(fits, rule.verdict).otherwise(verdict), F.when(fits, rule.rule).otherwise(text)
    return verdict, text


def as_regex(pattern: str) -> str:
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        head, body = r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?", body[2:]
    elif body.startswith("|"):
        head, body = "^", body[1:]
    if body.endswith("|"):
        tail, body = r"\Z", body[:-1]
    parts = {"*": ".*", "^": r"(?:[^a-z0-9_.%\-]|\Z)"}
    return head + "".join(parts.get(c) or re.escape(c) for c in body) + tail


def whole_tokens(pattern: str) -> list[str]:
    """Runs that stand whole in any matching URL: none touches a `*` or an unanchored end of the pattern."""
    body = pattern.removeprefix("@@")
    opened, closed = body.startswith("|"), body.endswith("|")
    body = body.strip("|")
    found = []
    for m in re.finditer(r"[a-z0-9%]+", body):
        before = body[m.start() - 1] if m.start() else ("|" if opened else "*")
        after = body[m.end()] if m.end() < len(body) else ("|" if closed else "*")
        if "*" not in (before, after):
            found.append(m[0])
    return found


def tokens_of(url: str) -> list[str]:
    return re.findall(r"[a-z0-9%]+", url)


def rarest_index(rules: Sequence[str], counts: dict[str, int]) -> tuple[dict[str, list[str]], list[str]]:
    """Rules by their rarest token (fewest URLs, then the text), and rules without one."""
    index: dict[str, list[str]] = {}
    rest = []
    for rule in rules:
        if tokens := whole_tokens(rule):
            index.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            rest.append(rule)
    return index, rest


def token_counts(urls: DataFrame, url: str, rules: Sequence[str]) -> dict[str, int]:
    wanted = sorted({t for r in rules for t in whole_tokens(r)})
    if not wanted:
        return {}
    tokens = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")  # most_rules bounds it
    words = F.array_distinct(F.split(lower_ascii(F.col(url)), "[^a-z0-9%]+"))
    rows = urls.select(F.explode(words).alias("token")).join(F.broadcast(tokens), "token").groupBy("token").count().collect()  # one row for each token of a rule at most
    return {r["token"]: r["count"] for r in rows}


def pattern_verdict(urls: DataFrame, url: str = "url", patterns: Sequence[str] = PATTERNS) -> Column:
    """allow or block for each URL by the patterns: block if one matches and no exception does."""
    if len(patterns) > most_rules:
        raise ValueError(f"{len(patterns)} rules; most_rules is {most_rules}")
    rules = [p.lower() for p in patterns]
    index, rest = rarest_index(rules, token_counts(urls, url, rules))

    @F.pandas_udf("string")
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = {r: re.compile(as_regex(r.removeprefix("@@")), re.DOTALL) for r in rules}
        lower = str.maketrans(_UPPER, _LOWER)

        def judge(one: str | None) -> str:
            if one is None:
                return "allow"
            one = one.translate(lower)
            blocked = False
            for rule in [*rest, *(r for t in set(tokens_of(one)) if t in index for r in index[t])]:
                exception = rule.startswith("@@")
                if (exception or not blocked) and compiled[rule].search(one):
                    if exception:
                        return "allow"
                    blocked = True
            return "block" if blocked else "allow"

        for urls in batches:
            yield pd.Series([judge(x if isinstance(x, str) else None) for x in urls], dtype=object)

    return verdict(F.col(url))


def url_filters(rows: DataFrame, url: str = "url", host_rules: Sequence[HostRule] = HOST_RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """rows with host, path, rule and verdict; columns of those names are replaced."""
    (by_pattern,) = unused([*rows.columns, "host", "path", "rule", "verdict"], "by_pattern")
    host, path = host_and_path(F.col(url))
    judged = rows.withColumn(by_pattern, pattern_verdict(rows, url, patterns)).withColumns({"host": host, "path": path})
    by_rule, rule = longest_rule(F.col("host"), F.col("path"), host_rules)
    return judged.withColumns({"rule": rule, "verdict": F.coalesce(by_rule, F.col(by_pattern))}).drop(by_pattern)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filters(pages).select("page_id", "host", "path", "rule", "verdict")


#: The patterns above, each as a regular expression on the URL in lower case.
OP7_SQL = r"""
WITH u AS (SELECT page_id, url, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
  CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, low,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, rule, h, s) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'), ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
f AS (SELECT p.*, (SELECT max_by(struct_pack(v := r.verdict, n := r.rule), length(r.rule)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.s)) AS hit FROM p)
SELECT page_id, host, path, hit.n AS rule, coalesce(hit.v, CASE
  WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?example\.org/en/1([^a-z0-9_.%\-]|$)', 's') THEN 'allow'
  WHEN regexp_matches(low, '^[a-z][a-z0-9+.-]*://([^/?#]*\.)?(ads-track|adult-x|casino-win|free-bets|spam-farm|doubleclick)\.', 's') THEN 'block'
  WHEN regexp_matches(low, '/casino/|/porn.*video([^a-z0-9_.%\-]|$)|/banner([^a-z0-9_.%\-]|$).*\.gif$|viagra', 's') THEN 'block'
  ELSE 'allow' END) AS verdict
FROM f
"""
