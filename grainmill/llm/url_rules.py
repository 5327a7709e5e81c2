"""Operator 9 (native): URL filters by pattern rules indexed on their rarest literal token.

Each rule has literal tokens, whole runs of [a-z0-9] that every url it fits must hold. One pass over all urls
counts those tokens (the result is as small as the rule set), and each rule is filed under its rarest one, or, where
a fitting url must hold one of several literals, under the rarest of each. A url's own tokens then fetch the
candidate rules, and only those run their regular expression; no Python.

Up to INLINE_RULES rules travel in the plan, one branch each: a token test that guards a constant pattern, all within the
row, without shuffle or join. Larger sets are a table of (token, rule): distinct urls are joined with it by their
tokens, by broadcast while the table is below BROADCAST_BYTES, and each distinct url's judgement goes back to its
pages. Rules without a literal token are branches in either case. There is no limit on the number of rules.

Null urls and urls without `://` have empty host and path and fit no rule. Equal rows give equal results; an empty
table gives no rows; other columns are not read. Where named rules that fit have names of one length, the greatest
name, then verdict, decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm._common import small, table

INLINE_RULES = 64
BROADCAST_BYTES = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A regular expression over host + path; `literal` is text in it, or several alternatives split by |, one of
    which is; `name` is None for the method's own rules."""

    verdict: str
    regex: str
    literal: str
    name: str | None = None

    @property
    def tokens(self) -> list[str]:
        """Tokens that stand whole in every fitting url (of all alternatives): those with a sign, or an anchor (^), on both sides."""
        return re.findall(r"(?<![a-z0-9])[a-z0-9]+(?=[^a-z0-9])", self.literal.lower())

    @property
    def alternatives(self) -> list[list[str]]:
        """The tokens of each alternative; every fitting url holds all tokens of one."""
        return [Rule(self.verdict, self.regex, x).tokens for x in self.literal.split("|")]


def host_path(verdict: str, name: str) -> Rule:
    """Fits the host and its subdomains where the path starts with the rule's."""
    host, _, path = name.partition("/")
    quoted = re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", f"{host}/{path}")
    return Rule(verdict, rf"^(?:[^/]*\.)?{quoted}", f"{host}/{path}", name)


#: Fixed values of the contract.
HOST_RULES = [
    host_path("allow", "com/"),
    host_path("block", "example.com/en/"),
    host_path("allow", "www.example.com/en/"),
    host_path("block", "net/es/"),
    host_path("block", "net/fr/"),
]

#: The method's own rules: gambling, advertising and tracking hosts, and pages behind a login.
PATTERN_RULES = [
    Rule("block", r"^(?:[^/]*[.-])?casino[.-]", ".casino."),
    Rule("block", r"^(?:[^/]*[.-])?poker[.-]", ".poker."),
    Rule("block", r"^(?:[^/]*[.-])?(?:ads|ad)[.-](?:track|server|click)[.-]", "|".join(f".{a}.{b}." for a in ("ads", "ad") for b in ("track", "server", "click"))),
    Rule("block", r"^(?:[^/]*[.-])?doubleclick[.-]", ".doubleclick."),
    Rule("block", r"^[^/]*/(?:[^/]*/)*login(?:[/.]|$)", "/login/"),
    Rule("block", r"^[^/]*/(?:[^/]*/)*wp-admin/", "/wp-admin/"),
]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.split(F.translate(text, UPPER, LOWER), "[^a-z0-9]+"))


def token_counts(pages: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """In how many urls each wanted token stands, over all rows; at most len(wanted) rows reach the driver."""
    at = F.col(f"`{url}`")
    tokens = pages.select(F.explode(_tokens(F.concat(host_of(at), path_of(at)))).alias("token"))
    known = pages.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    few = small(known, BROADCAST_BYTES)
    hits = tokens.join(F.broadcast(known) if few else known, "token", "left_semi")
    return {r["token"]: r["count"] for r in hits.groupBy("token").count().collect()}


def _index(rules: list[Rule], counts: dict[str, int]) -> list[list[str]]:
    """The tokens that each rule is filed under; none for a rule that has an alternative without one."""
    rarest = lambda own: min(own, key=lambda t: (counts.get(t, 0), -len(t), t))
    return [sorted({rarest(own) for own in r.alternatives}) if all(r.alternatives) else [] for r in rules]


def _branches(rules: list[Rule], filed: list[list[str]], tokens: Column, at: Column) -> Column:
    """array<struct<n, name, verdict>> of the rules that fit; a pattern runs only after its token is found."""
    fits = []
    for r, own in zip(rules, filed, strict=True):
        fetched = F.lit(True)
        if own:
            fetched = F.arrays_overlap(tokens, F.array(*map(F.lit, own)))
        fits.append(F.when(fetched & at.rlike(r.regex), F.struct(F.lit(len(r.name or "")).alias("n"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("verdict"))))
    none = F.array().cast("array<struct<n:int,name:string,verdict:string>>")
    return F.filter(F.array(*fits), lambda x: x.isNotNull()) if fits else none


def _by_table(urls: DataFrame, rules: list[Rule], filed: list[list[str]]) -> DataFrame:
    """(_at, best, blocked) of the distinct urls that a filed rule fits."""
    rows = [(t, r.regex, len(r.name or ""), r.name, r.verdict) for r, own in zip(rules, filed, strict=True) for t in own]
    entries = urls.sparkSession.createDataFrame(rows, "token string, regex string, n int, name string, verdict string")
    few = small(entries, BROADCAST_BYTES)
    tokens = urls.select("_at").distinct().select("_at", F.explode(_tokens(F.col("_at"))).alias("token"))
    found = tokens.join(F.broadcast(entries) if few else entries, "token").where("regexp_instr(_at, regex) > 0")
    best = F.max(F.when(F.col("name").isNotNull(), F.struct("n", "name", "verdict"))).alias("best")
    return found.groupBy("_at").agg(best, F.max(F.col("name").isNull() & (F.col("verdict") == "block")).alias("blocked"))


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Per page: id, host, path, rule (the longest fitting named rule, else null) and verdict (that rule's; else
    block if one of the unnamed rules that block fits; else the default)."""
    wanted = sorted({t for r in rules for t in r.tokens})
    filed = _index(rules, token_counts(pages, url, wanted) if wanted else {})
    inline = [len(rules) <= INLINE_RULES or not own for own in filed]
    at = F.col(f"`{url}`")
    df = pages.select(F.col(f"`{id_col}`").alias("_id"), host_of(at).alias("host"), path_of(at).alias("path")).withColumn("_at", F.concat("host", "path"))
    pick = lambda xs, kind: [x for x, y in zip(xs, inline, strict=True) if y == kind]
    df = df.withColumn("_tokens", _tokens(F.col("_at")))
    df = df.withColumn("_fit", _branches(pick(rules, True), pick(filed, True), F.col("_tokens"), F.col("_at")))
    best = F.array_max(F.filter("_fit", lambda r: r["name"].isNotNull()))
    df = df.withColumns({"_best": best, "_blocked": F.exists("_fit", lambda r: r["name"].isNull() & (r["verdict"] == "block"))})
    if not all(inline):
        df = df.join(_by_table(df, pick(rules, False), pick(filed, False)), "_at", "left")
        df = df.withColumns({"_best": F.greatest("_best", "best"), "_blocked": F.col("_blocked") | F.coalesce("blocked", F.lit(False))})
    own = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit(default))
    return df.select(F.col("_id").alias(id_col), "host", "path", F.col("_best.name").alias("rule"), F.coalesce(F.col("_best.verdict"), own).alias("verdict"))


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), HOST_RULES + PATTERN_RULES)


def _sql() -> str:
    named = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.verdict}' AS verdict, '{r.name.partition('/')[0]}' AS h, '/{r.name.partition('/')[2]}' AS p" for r in HOST_RULES)
    own = " OR ".join(f"regexp_matches(host || path, '{r.regex}')" for r in PATTERN_RULES)
    return f"""
WITH rules AS ({named}),
u AS (SELECT row_number() OVER () AS i, page_id,
  translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT i, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {own} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN fit USING (i)"""


SQL = _sql()
