"""Verdicts on URLs by pattern rules that are indexed by their rarest literal token.

A rule is a text and a verdict (``allow`` or ``block``). A *site* rule ``host/path`` fits its host and all subdomains
where the path of the URL starts with its own; of several the longest text wins, and it decides before any other rule.
A *pattern* rule begins with ``^``, ``*`` or ``||`` and is looked for in host and path, whatever the case of letters:
``||`` is the begin of the host or of a label in it, ``^`` a place that is no ASCII letter or digit (or either end),
``*`` any run of characters, and everything else stands for itself. Among patterns ``allow`` beats ``block``. Where
nothing fits, the verdict is ``allow``.

Every rule becomes a regular expression and the list of its literal tokens: runs of ASCII letters and digits that every
URL which it fits must hold as a whole token. A rule is indexed under the one of these that the fewest different URLs of
the table have. A URL looks its tokens up in that index, and only the rules found there run their expressions; rules
without a whole token stand under the empty token, which all URLs look up if there are such rules.

All of it is DataFrame functions. Rules, index and counts are tables, so the list of rules may be long; different URLs
are judged once. A token or URL that much of the table has is split into as many keys as its count asks for.

Defined cases. A null URL or one without ``://`` has an empty host and path: no site rule fits, patterns hardly do.
Repeated rows get the same verdict, each its own row. A null or empty rule, or one with another verdict, is ignored; of equal rules
with both verdicts ``block`` counts. An empty table gives an empty result, an empty list of rules allows everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import fresh, lower_ascii, prepare, written
from seqcast.operators.skew import join_on_key

#: What an URL is cut into: everything before the host, the host, the path.
_PARTS = r"^[\s\S]*?://([^/?#]*)([^?#]*)"
_TOKEN = "[a-z0-9]+"
# A token that nothing can lengthen: between characters that are neither part of a token nor a run of any characters.
_WHOLE_TOKEN = r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"
_EDGE = r"(?:^|\z|[^A-Za-z0-9])"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def compiled(rules: DataFrame) -> DataFrame:
    """(rule, site, verdict, expression, tokens) of every rule (rule, verdict)."""
    kept = rules.where("rule != '' and verdict in ('allow', 'block')").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    site = ~F.col("rule").rlike(r"^(?:\^|\*|\|\|)")
    host = F.regexp_extract("rule", r"^[^/]*", 0)
    rest = F.expr("substring(rule, length(regexp_extract(rule, '^[^/]*', 0)) + 1)")
    # A host is in lower case; a site rule without a path ends where the host does.
    text = F.when(site, F.concat(F.lit("||"), lower_ascii(host), rest, F.when(rest == "", F.lit("^")).otherwise(F.lit("")))).otherwise(F.col("rule"))
    literal = F.regexp_replace(F.regexp_replace("text", r"^\|\|", ""), r"([\\.\[\]{}()+?$|-])", r"\\$1")
    anchor = F.when(F.col("text").startswith("||"), F.lit("^(?:[^/]*[.])?")).otherwise(F.lit(""))
    runs = F.replace(literal, F.lit("*"), F.lit(r"[\s\S]*"))
    # In a site rule every character but the end of a bare host stands for itself.
    plain = F.when(F.col("rest") == "", F.concat(F.expr("regexp_replace(left(literal, length(literal) - 1), '([*^])', '[$1]')"), F.lit(r"(?:/|\z)"))).otherwise(F.regexp_replace("literal", r"([*^])", r"\\$1"))
    expression = F.when(F.col("site"), F.concat(anchor, plain)).otherwise(F.concat(F.lit("(?i)"), anchor, F.replace(runs, F.lit("^"), F.lit(_EDGE))))
    tokens = F.array_distinct(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(_WHOLE_TOKEN), F.lit(0)))
    parts = kept.select("rule", "verdict", site.alias("site"), rest.alias("rest"), text.alias("text")).withColumn("literal", literal)
    return parts.select("rule", "site", "verdict", expression.alias("expression"), tokens.alias("tokens"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The pages with a struct column ``judged`` (underscores follow if the name is taken) as their last: ``host``,
    ``path``, the site ``rule`` and the ``pattern`` that fit (null: none) and the ``verdict``. ``rules`` is a table
    (rule, verdict)."""
    spark = pages.sparkSession
    prepare(spark)
    name, key = fresh(pages, "judged"), fresh(pages, "judged_url")
    whole = F.col(f"`{url}`").cast("string")
    # Different URLs, with the rows that have them.
    urls = pages.where(F.contains(whole, F.lit("://"))).groupBy(whole.alias("url")).agg(F.count("*").alias("n"))
    urls = written(urls.select("url", "n", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("target")), "urls")
    known = written(compiled(rules), "rules")
    by_token = known.select("rule", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))).alias("token"))
    anywhere = [F.lit("")] if not by_token.where("token = ''").isEmpty() else []
    found = F.array_distinct(F.concat(F.regexp_extract_all(lower_ascii(F.col("target")), F.lit(_TOKEN), F.lit(0)), F.array(*anywhere).cast("array<string>")))
    tokens = urls.select("url", "target", F.explode(found).alias("token"))
    counts = written(tokens.join(by_token.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n")), "tokens")
    rarest = by_token.join(counts, "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("least"))
    index = written(rarest.join(known, "rule").select(F.col("least.token").alias("token"), "rule", "site", "verdict", "expression"), "index")
    candidates = join_on_key(tokens, index, ["token"], counts=counts, spread_by=["url"])
    fits = candidates.where(F.rlike("target", F.col("expression")))
    best = fits.groupBy(F.col("url").alias(key)).agg(
        F.max(F.when(F.col("site"), F.struct(F.length("rule").alias("size"), "rule", "verdict"))).alias("by_site"),
        F.max(F.when(~F.col("site"), F.struct((F.col("verdict") == "allow").alias("allows"), F.col("rule").alias("pattern"), "verdict"))).alias("by_pattern"),
    )
    # A URL that many rows have is split by the values of the row.
    verdicts = written(best.select(key, F.struct("by_site", "by_pattern").alias(name)), "verdicts")
    met = join_on_key(pages.withColumn(key, whole), verdicts, [key], "left", counts=urls.select(F.col("url").alias(key), "n"), spread_by=[c for c in pages.columns if c != url] or [url])
    site, pattern = F.col(f"{name}.by_site"), F.col(f"{name}.by_pattern")
    judged = F.struct(
        host_of(whole).alias("host"),
        path_of(whole).alias("path"),
        site["rule"].alias("rule"),
        pattern["pattern"].alias("pattern"),
        F.coalesce(site["verdict"], pattern["verdict"], F.lit("allow")).alias("verdict"),
    )
    return met.select(*(F.col(f"`{c}`") for c in pages.columns), judged.alias(name))


def rules_of(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """A short list of rules as a table."""
    empty = spark.range(0).select(F.lit("").alias("rule"), F.lit("").alias("verdict"))
    if not rules:
        return empty
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for r, v in rules))))


def kept_urls(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The pages, with their columns, whose URL is allowed."""
    judged = judge_urls(pages, rules, url)
    return judged.where(F.col(f"`{judged.columns[-1]}`.verdict") == "allow").select(*(F.col(f"`{c}`") for c in pages.columns))


#: The site rules of the query.
SITE_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Patterns for URLs that no site rule decides: gambling, pills, adult sites, spam farms, advertisements and trackers,
#: and what looks like them but isn't.
PATTERN_RULES = [
    *((f"^{word}^", "block") for word in ("adult", "bets", "casino", "escorts", "gambling", "malware", "phishing", "pills", "poker", "porn", "spam", "viagra", "warez", "xxx")),
    *((f"||{word}^", "block") for word in ("ads", "adserver", "doubleclick", "tracker", "tracking")),
    ("^adult-education^", "allow"),
    ("^anti-spam^", "allow"),
]
