"""URL filters: rules fetched by their rarest literal token, then run as patterns.

Every rule is a regular expression over ``host || path`` together with
literal tokens that each matching url must contain as whole tokens.  Token
frequencies are counted over all urls, each rule is filed under its rarest
token, the urls' tokens fetch the candidate rules by an equi-join, and only
candidates run their expression.  The verdict depends on host and path
alone, so it is worked out once per distinct pair and joined back.

Defined cases: a null url, or one without ``://``, has empty host and path
and is allowed by default; a null page_id is carried through; repeated rows
stay repeated; no pages give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import literal_table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` runs on host || path; ``tokens`` occur in every url it fits.

    ``rank`` 1 rules (host and path prefix) decide before rank 0 rules
    (patterns of the method); within a rank the longest name wins, of equally long ones the greater."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int = 0

    def __post_init__(self):
        if not self.tokens:
            raise ValueError(f"rule {self.name!r} has no literal token to be indexed by")


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and its subdomains when the path starts with ``path`` (which starts with ``/``)."""
    literal = (host + path).lower()
    whole = [m.group() for m in re.finditer(r"[a-z0-9]+", literal) if m.end() < len(literal)]
    return UrlRule(host + path, verdict, r"^(?:[^/]*\.)?" + re.escape(host + path), tuple(whole), 1)


#: The rules that the url query is given.
BASE_RULES = (
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
)

#: The method's own rules: host labels of advertising, gambling and adult sites, and pages without prose.
METHOD_RULES = tuple(
    UrlRule(f"{a}-{b}", "block", rf"^(?:[^/]*[.])?{a}[-.]{b}[./]", (a, b)) for a, b in (
        ("cheap", "pills"), ("casino", "win"), ("free", "bets"), ("adult", "x"), ("spam", "farm"), ("ads", "track"))
) + tuple(
    UrlRule(f"/{w}", "block", rf"/{w}(?:/|$)", (w,)) for w in ("login", "signup", "cart", "checkout")
)


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = BASE_RULES + METHOD_RULES,
                default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, method_rule."""
    spark = pages.sparkSession
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    site = F.concat("host", "path")
    urls = parts.select(site.alias("site")).distinct()
    tokens = urls.select("site", F.explode(F.array_distinct(F.regexp_extract_all(
        F.lower("site"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"))

    given = literal_table(spark, [dict(id=i, name=r.name, verdict=r.verdict, pattern=r.pattern, rank=r.rank,
                                       token=t) for i, r in enumerate(rules) for t in r.tokens],
                          "id int, name string, verdict string, pattern string, rank int, token string")
    seen = tokens.join(given.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy("id").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = given.join(seen, "token", "left").withColumn("nth", F.row_number().over(rarest)).where("nth = 1")

    candidates = tokens.join(index.select("token", "name", "verdict", "pattern", "rank"), "token")
    fits = candidates.where(F.expr("site rlike pattern"))
    order = F.struct(F.length("name").alias("n"), "name", "verdict")
    decided = fits.groupBy("site").agg(F.max(F.when(F.col("rank") == 1, order)).alias("base"),
                                       F.max(F.when(F.col("rank") == 0, order)).alias("own"))
    found = parts.withColumn("site", site).join(decided, "site", "left")
    return found.select("page_id", "host", "path", F.col("base.name").alias("rule"),
                        F.coalesce("base.verdict", "own.verdict", F.lit(default)).alias("verdict"),
                        F.col("own.name").alias("method_rule"))
