"""URL filters: longest-prefix rules by host and path, then a listed-URL test by blocked Bloom filter and exact join.

The main path uses DataFrame functions only. A blocked Bloom filter is a table of blocks of eight 64-bit words; a URL
sets one bit in each word of the block that its hash names. Pages are joined with the blocks by block number, those
whose eight bits are all set go on to a hash join with the listed URLs, which removes false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, table

WORDS = 8
#: Filters of at most so many bytes are broadcast; larger ones are joined by a shuffle on the block number.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


RULES = (Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling per page: no scheme, query, fragment, leading www. or trailing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The fitting rule with the longest host, then the longest path, as struct(rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("long")


def _bit(url: Column, word: int) -> Column:
    """The bit of a word of the block, from a hash independent of the block number."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.lit(word + 1), url), F.lit(64)).cast("int"))


def blocked_bloom(urls: DataFrame, column: str, blocks: int) -> DataFrame:
    """block and its words w0 to w7, by bitwise aggregation; the map side combines, so repeated URLs cost nothing."""
    url = F.col(column)
    return urls.filter(url.isNotNull()).groupBy(_block(url, blocks).alias("block")).agg(*[F.bit_or(_bit(url, k)).alias(f"w{k}") for k in range(WORDS)])


def listed_hits(urls: DataFrame, listed: DataFrame, column: str, bits_per_url: int = 16) -> DataFrame:
    """Distinct values of urls[column] that are in listed[column]; nulls are never listed. Both sides may hold repeats."""
    listed = listed.select(column).filter(F.col(column).isNotNull()).distinct()
    n = listed.count()
    blocks = max(1, -(-n * bits_per_url // (64 * WORDS)))
    bloom = blocked_bloom(listed, column, blocks)
    if blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    url = F.col(column)
    asked = urls.select(column).filter(url.isNotNull()).distinct().withColumn("block", _block(url, blocks))
    possible = asked.join(bloom, "block")
    for k in range(WORDS):
        possible = possible.filter(F.col(f"w{k}").bitwiseAND(_bit(url, k)) != 0)
    return possible.select(column).join(listed, column, "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All columns of pages in a struct row_, with host, path, url_key, rule and verdict.

    listed: a table with a column url; its canonical forms are the listed ones. A url that no rule fits is blocked if
    its canonical form is listed, else allowed. Null urls and those without :// have empty host and path, no rule, and
    are allowed. Repeated pages give repeated rows; empty tables give no rows; other columns stay in row_.
    """
    key = lambda df: df.withColumn("url_key", canonical(host_of(F.col("url")), path_of(F.col("url"))))
    judged = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row_"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("ruled", rule_of(F.col("host"), F.col("path"), rules)).withColumn("url_key", canonical(F.col("host"), F.col("path")))
    hits = listed_hits(judged.filter(F.col("ruled").isNull()), key(listed.select("url")), "url_key").withColumn("listed", F.lit(True))
    joined = judged.join(hits, "url_key", "left")
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("row_", "host", "path", "url_key", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"))


#: A page is listed if its title holds a junk mark; any page of the same canonical URL is then blocked.
JUNK_TITLE = r"(?s)<title>[^<]*(%%%|###)"


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    listed = pages.filter(F.col("html").rlike(JUNK_TITLE)).select("url")
    return filter_urls(pages.select("page_id", "url"), listed).select("row_.page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') END AS k FROM p),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN k IN (SELECT k FROM c WHERE k IS NOT NULL AND regexp_matches(html, '<title>[^<]*(%%%|###)', 's')) THEN 'block' ELSE 'allow' END AS verdict
FROM r"""
