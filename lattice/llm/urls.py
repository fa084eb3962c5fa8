"""URL filters: rules are found by their rarest literal token, and only rules so found run as regular expressions.

A rule names literal tokens that every url it fits must hold whole. Each rule is filed under the one of
them that is rarest among the urls. A url's own tokens fetch the rules filed under them. All of it is
DataFrame functions; with a rule list of bounded length the index is a map literal and the urls are not
shuffled, with a longer one it is a join on tokens of distinct urls.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX_LIMIT = 1000  # rules up to which the index is a literal of the plan


@dataclass(frozen=True)
class Rule:
    """verdict: allow or block. A site rule fits host and path and wins by length; a pattern rule judges what no site rule fits."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    site: bool


def site_rule(name: str, verdict: str) -> Rule:
    """``host/path``: the host and all its subdomains, paths that start with the rule's."""
    host, _, path = name.partition("/")
    whole = re.findall("[a-z0-9]+", host) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
    escape = lambda s: re.sub(r"([^A-Za-z0-9/])", r"[\1]", s)
    return Rule(name, verdict, f"^([^/]*[.])?{escape(host)}/{escape(path)}", tuple(whole), True)


def word_rule(name: str, words: str) -> Rule:
    """Blocks urls that hold the words, one after another between single marks."""
    tokens = re.findall("[a-z0-9]+", words)
    return Rule(name, "block", f"(^|[^a-z0-9]){'[^a-z0-9]'.join(tokens)}([^a-z0-9]|$)", tuple(tokens), False)


# The site rules that are asked for.
SITE_RULES = tuple(site_rule(name, verdict) for name, verdict in (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")))

# Patterns for urls that no site rule fits.
PATTERN_RULES = tuple(word_rule(w, w) for w in ("spam farm", "casino", "poker", "viagra", "porn", "xxx", "torrent", "wp login php", "cgi bin", "adserver"))


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(F.coalesce(url, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def filed_under(urls: DataFrame, rules: tuple[Rule, ...], url: str = "url") -> dict[str, list[Rule]]:
    """The index: each rule under the rarest of its literal tokens, by counts over all urls."""
    wanted = sorted({t for r in rules for t in r.literals})
    if any(not r.literals for r in rules):
        raise ValueError("every rule needs a literal token")
    own = F.filter(_tokens(F.col(url)), lambda t: t.isin(wanted)) if wanted else F.array().cast("array<string>")
    counts = dict(urls.select(F.explode(own).alias("t")).groupBy("t").count().collect())
    out: dict[str, list[Rule]] = {}
    for r in rules:
        out.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return out


def judge(pages: DataFrame, site_rules: tuple[Rule, ...] = SITE_RULES, pattern_rules: tuple[Rule, ...] = PATTERN_RULES, index_limit: int = INDEX_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict and pattern (the pattern rule's name, if one decides) of every row of ``pages``.

    The longest site rule that fits decides; else the url is blocked if a pattern rule fits, the first by
    name, and allowed if none does. A null url, or one without ``://``, has neither host nor path and
    no site rule; patterns still see it. Rows with the same or a null page_id stay apart.
    """
    rules = site_rules + pattern_rules
    host, path = parts(F.col("url"))
    own = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    index = filed_under(own, rules)
    if len(rules) <= index_limit:
        found = own.withColumn("fit", _fitting(index, F.concat("host", "path"), F.col("url")))
    else:
        found = _by_join(own, index)
    best = F.array_max(F.transform(F.filter("fit", lambda r: r.site), lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r.verdict.alias("verdict"))))
    word = F.array_min(F.transform(F.filter("fit", lambda r: ~r.site), lambda r: r["name"]))
    found = found.select("page_id", "host", "path", best.alias("best"), word.alias("word"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("word").isNotNull(), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.col("best.name").alias("rule"), verdict.alias("verdict"), F.when(F.col("best").isNull(), F.col("word")).alias("pattern"))


def _struct(r: Rule) -> Column:
    return F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"), F.lit(r.site).alias("site"))


def _fitting(index: dict[str, list[Rule]], target: Column, url: Column) -> Column:
    if not index:
        return F.array().cast("array<struct<name:string,verdict:string,pattern:string,site:boolean>>")
    filed = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(_struct, rs)))))
    fetched = F.flatten(F.transform(F.filter(_tokens(url), lambda t: F.map_contains_key(filed, t)), lambda t: F.element_at(filed, t)))
    lower = _lower(F.coalesce(url, F.lit("")))
    return F.filter(fetched, lambda r: F.rlike(F.when(r.site, target).otherwise(lower), r.pattern))


def _by_join(own: DataFrame, index: dict[str, list[Rule]]) -> DataFrame:
    """The fitting rules by a join of the distinct urls' tokens with the rules."""
    spark = own.sparkSession
    rules = spark.createDataFrame([(t, r.name, r.verdict, r.pattern, r.site) for t, rs in index.items() for r in rs], "token string, name string, verdict string, pattern string, site boolean")
    urls = own.select("url", "host", "path").distinct()
    fetched = urls.select("url", "host", "path", F.explode(_tokens(F.col("url"))).alias("token")).join(rules, "token")
    fits = fetched.where(F.rlike(F.when(F.col("site"), F.concat("host", "path")).otherwise(_lower(F.col("url"))), F.col("pattern")))
    by_url = fits.groupBy(F.col("url").alias("u")).agg(F.collect_set(F.struct("name", "verdict", "pattern", "site")).alias("fit"))
    joined = own.join(by_url, own.url == by_url.u, "left").drop("u")
    return joined.withColumn("fit", F.coalesce("fit", F.array().cast(by_url.schema["fit"].dataType)))


def oracle_sql() -> str:
    """The same judgement in DuckDB, every rule tried on every url."""
    up, low = string.ascii_uppercase, string.ascii_lowercase
    sites = " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}'" for r in sorted(SITE_RULES, key=lambda r: -len(r.name)))
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in SITE_RULES)
    words = " ".join(f"WHEN regexp_matches(url_low, '{r.pattern}') THEN '{r.name}'" for r in sorted(PATTERN_RULES, key=lambda r: r.name))
    return f"""
        WITH cut AS (SELECT page_id, translate(coalesce(url, ''), '{up}', '{low}') AS url_low,
                CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
            split AS (SELECT page_id, url_low, translate(regexp_extract(rest, '^[^/?#]*', 0), '{up}', '{low}') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
            ruled AS (SELECT *, CASE {sites} END AS rule, CASE {words} END AS word FROM split)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
            CASE WHEN rule IS NULL THEN word END AS pattern
        FROM ruled"""
