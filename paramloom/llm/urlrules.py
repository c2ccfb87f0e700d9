"""URL filters by pattern rules that are indexed by their rarest literal token. DataFrame functions only.

Every rule has literal tokens; it is filed under the one that is rarest over all URLs of the table, and only
rules filed under a token of the URL's host or path run their regular expression on it. Up to MAX_RULES rules the index
is a constant of the plan, one slot per token hash, so a lookup costs the same for any number of rules and nothing is
shuffled; more rules are a table that distinct hosts and paths are joined with on the token.

Defined cases: null URLs and URLs without "://" have empty host and path and fit no rule; a path is compared
literally (an empty path does not start with "/"); the longest fitting rule wins, then the smallest rule text;
URLs that fit none get the default verdict; repeated rows stay; an empty table gives none; input columns host, path and best are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 4096
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """verdict for URLs that match: a host rule (host and path prefix) or a free pattern with its literals."""

    verdict: str
    name: str
    pattern: str
    literals: tuple[str, ...]
    rank: int

    @staticmethod
    def host(verdict: str, host: str, path: str) -> Rule:
        literals = tuple(re.findall(TOKEN, host.lower()))
        # the subject is host, a newline, path
        return Rule(verdict, host + path, rf"^(?:[^\n]*\.)?{re.escape(host)}\n{re.escape(path)}", literals, len(host + path))

    @staticmethod
    def free(verdict: str, name: str, pattern: str, *literals: str) -> Rule:
        return Rule(verdict, name, pattern, literals, 0)


#: The rules that the query's contract states.
STATED = (
    Rule.host("block", "net", "/"),
    Rule.host("allow", "example.net", "/en/"),
    Rule.host("block", "example.com", "/de/"),
    Rule.host("allow", "org", "/fr/"),
)
#: Patterns of our own for URLs that no stated rule fits; they only decide the verdict.
PATTERNS = tuple(
    Rule.free("block", name, rf"(?:^|[^a-z0-9\n]){literal}(?![a-z0-9])[^\n]*\n", *literal.split("-"))
    for name, literal in (
        ("spam farm host", "spam-farm"),
        ("pill shop host", "cheap-pills"),
        ("casino host", "casino"),
        ("adult host", "porn"),
        ("adult host", "xxx"),
    )
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    has = F.coalesce(url.contains("://"), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, F.translate(host, upper, upper.lower())).otherwise(""), F.when(has, path).otherwise("")


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct lower-case tokens of a host and a path."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.concat(host, F.lit("\n"), path)), F.lit(f"({TOKEN})"), F.lit(1)))


def token_counts(urls: DataFrame, tokens: list[str], column: str = "url") -> dict[str, int]:
    """In how many URLs each of the rules' literal tokens occurs, over the whole table: one row per token at most."""
    seen = tokens_of(*parts(F.col(column)))
    if len(tokens) <= 2 * MAX_RULES:
        found = urls.select(F.explode(F.array_intersect(seen, F.array(*[F.lit(t) for t in tokens]))).alias("token"))
    else:
        wanted = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
        found = urls.select(F.explode(seen).alias("token")).join(wanted, "token", "left_semi")
    rows = found.groupBy("token").count().collect()
    return {t: 0 for t in tokens} | {r["token"]: r["count"] for r in rows}


def rarest(rule: Rule, counts: dict[str, int]) -> str:
    return min(rule.literals, key=lambda t: (counts.get(t, 0), t))


def index(rules: tuple[Rule, ...], counts: dict[str, int]) -> Column:
    """Constant array of slots; slot hash(token) mod size holds the rules filed under that token."""
    size = max(8, 2 * len(rules))
    slots: list[list[tuple[str, Rule]]] = [[] for _ in range(size)]
    for r in rules:
        token = rarest(r, counts)
        slots[sum(map(ord, token)) % size].append((token, r))
    entry = lambda t, r: F.struct(F.lit(t).alias("token"), F.lit(r.pattern).alias("pattern"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.rank).alias("rank"))
    empty = F.filter(F.array(entry("", Rule("", "", "", (), 0))), lambda e: F.lit(False))
    return F.array(*[F.array(*[entry(t, r) for t, r in s]) if s else empty for s in slots]), size


def judge(urls: DataFrame, rules: tuple[Rule, ...], default: str = "allow", column: str = "url") -> DataFrame:
    """urls with host, path, and best: the winning rule (token, pattern, name, verdict, rank) or null."""
    counts = token_counts(urls, sorted({t for r in rules for t in r.literals}), column)
    host, path = parts(F.col(column))
    if len(rules) > MAX_RULES:
        return _joined(urls.withColumns({"host": host, "path": path}).drop("best"), rules, counts)
    table, size = index(rules, counts)
    slot = lambda t: F.pmod(F.aggregate(F.transform(F.split(t, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, c: a + c), F.lit(size)) + 1
    tokens = tokens_of(F.col("host"), F.col("path"))
    fetched = F.flatten(F.transform(tokens, lambda t: F.filter(F.element_at(table, slot(t)), lambda r: r["token"] == t)))
    subject = F.concat(F.col("host"), F.lit("\n"), F.col("path"))
    fits = F.filter(F.col("_fetched"), lambda r: F.regexp_like(subject, r["pattern"]))
    best = F.array_sort(fits, lambda a, b: F.when(a["rank"] != b["rank"], b["rank"] - a["rank"]).when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    return urls.withColumns({"host": host, "path": path}).withColumn("_fetched", fetched).withColumn("best", F.get(best, F.lit(0))).drop("_fetched")


def _joined(urls: DataFrame, rules: tuple[Rule, ...], counts: dict[str, int]) -> DataFrame:
    """judge() through a join of distinct hosts and paths with the rules on the token that each is filed under."""
    rows = [(rarest(r, counts), r.pattern, r.name, r.verdict, r.rank) for r in rules]
    table = urls.sparkSession.createDataFrame(rows, "token string, pattern string, name string, verdict string, rank int")
    places = urls.select("host", "path").distinct()
    fetched = places.withColumn("token", F.explode(tokens_of(F.col("host"), F.col("path")))).join(table, "token")
    fits = fetched.where(F.regexp_like(F.concat("host", F.lit("\n"), "path"), F.col("pattern")))
    first = F.min_by(F.struct("token", "pattern", "name", "verdict", "rank"), F.struct(-F.col("rank"), "name"))
    best = fits.groupBy("host", "path").agg(first.alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "best")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    found = judge(pages, STATED + PATTERNS)
    stated = F.col("best.rank") > 0
    return found.select("page_id", "host", "path", F.when(stated, F.col("best.name")).alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id,
        CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
        CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM u),
r AS (SELECT *,
        (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') AS net,
        (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') AS net_en,
        (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') AS com_de,
        (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') AS org_fr,
        regexp_matches(host, '(^|[^a-z0-9])(spam-farm|cheap-pills|casino|porn|xxx)([^a-z0-9]|$)') AS spam FROM p)
SELECT page_id, host, path,
  CASE WHEN net_en THEN 'example.net/en/' WHEN com_de THEN 'example.com/de/' WHEN org_fr THEN 'org/fr/' WHEN net THEN 'net/' END AS rule,
  CASE WHEN net_en THEN 'allow' WHEN com_de THEN 'block' WHEN org_fr THEN 'allow' WHEN net THEN 'block' WHEN spam THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
