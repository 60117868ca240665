"""URL verdicts: host and path rules, and a listing behind a blocked Bloom filter.

Each url gives a few canonical keys (host suffixes times path prefixes). A key
tests one bit in each of eight lanes of one filter block; possible hits go to
an exact hash join with the listing, which removes false positives. All of it is
DataFrame expressions, and the filter itself is a table that is built and read
in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import fold

#: Hosts whose urls are listed: fixed values, each under three endings.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_ENDINGS = ["example.com", "example.net", "example.org"]
#: Hosts of which single urls are listed: fixed values. Url k of ``LISTED_URLS`` has the number k * 7 modulo ``LISTED_NUMBERS``, so some repeat.
LISTED_HOSTS = ["blog.tionsh.example.com", "tionble.example.org", "tiontion.example.net", "www.ththon.example.org:8080", "ththan.example.com"]
LISTED_FOLDERS = ["de", "en", "es", "fr"]
LISTED_TAILS = ["", "/", ".html", "?utm_source=feed", "?page=2&ref=x"]
LISTED_URLS, LISTED_NUMBERS = 8000, 6000

#: (verdict, host, path): the host and its subdomains, paths that start with the path; the longest rule wins.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd multipliers, one a lane.
_SALTS = [0x3D2FAA5D, 0x373D2EE7, 0x3CA9349F, 0x3656EBF3, 0x39E89A7, 0x5DC8675, 0x56E8AF7, 0x171B90CD]


@dataclass(frozen=True)
class Bloom:
    """``bits`` of filter a key; a filter of more than ``broadcast_bytes`` is joined by block instead of broadcast."""

    bits: int = 16
    broadcast_bytes: int = 64 << 20


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query string with its question mark; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits as text (host and path), and its verdict; null without one."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        rule, verdict = F.when(fits(h, p), h + p).otherwise(rule), F.when(fits(h, p), v).otherwise(verdict)
    return rule, verdict


def canonical(host: Column, path: Column) -> tuple[Column, Column]:
    """Host without user, port and outer dots; path decoded, that begins with a slash, without double slashes and dot segments."""
    host = F.btrim(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), F.lit("."))
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.regexp_replace(F.concat(F.lit("/"), path), r"/+", "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    flat = F.aggregate(F.split(F.substr(path, F.lit(2)), "/"), F.array().cast("array<string>"), up)
    return host, F.when(F.regexp_like(path, F.lit(r"/\.\.?(/|$)")), F.concat(F.lit("/"), F.array_join(flat, "/"))).otherwise(path)


@dataclass(frozen=True)
class Shape:
    """What the keys of a listing have at most: labels of the host, slashes, characters. Longer keys of a url can't be among them."""

    labels: int
    slashes: int
    chars: int


def shape_of(listing: DataFrame) -> tuple[int, Shape]:
    """Number of keys, and their shape."""
    count = lambda text, c: F.max(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))))
    host, key = F.regexp_extract("key", "^[^/]*", 0), F.col("key")
    n, dots, slashes, chars = listing.agg(F.count("*"), count(host, "."), count(key, "/"), F.max(F.length(key))).first()
    return n, Shape((dots or 0) + 1, max(slashes or 0, 1), chars or 0)


def keys_of(host: Column, path: Column, query: Column, shape: Shape) -> Column:
    """Keys to look up: the host and its suffixes, with and without the port (80 and 443 are none), each with the
    path and query string, the whole path and each of its folders; only those that are no longer than ``shape``
    in any way are built, so a url of any length gives as many as the listing's own keys would."""
    port = F.regexp_replace(F.regexp_extract(host, r":[0-9]+$", 0), r"^:(80|443)$", "")
    host, path = canonical(host, path)
    parts, folders = F.split(host, r"\."), F.split(path, "/")
    count = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(count, F.lit(shape.labels))), lambda n: F.array_join(F.slice(parts, count - n + 1, n), "."))
    suffixes = F.filter(suffixes, lambda h: F.length(h) < shape.chars)
    hosts = F.array_distinct(F.concat(suffixes, F.transform(suffixes, lambda h: F.concat(h, port))))
    paths = F.transform(F.sequence(F.lit(1), F.least(F.size(folders) - 1, F.lit(shape.slashes))), lambda n: F.concat(F.array_join(F.slice(folders, F.lit(1), n), "/"), F.lit("/")))
    paths = F.filter(F.array_distinct(F.concat(F.array(F.concat(path, query), path), paths)), lambda p: F.length(p) < shape.chars)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))


def lanes(key: Column) -> list[Column]:
    h = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.shiftrightunsigned((h * salt).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for salt in _SALTS]


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks))


def build_filter(listing: DataFrame, blocks: int) -> DataFrame:
    """block and its eight lanes of 32 bits; blocks without a key have no row."""
    bit = [F.bit_or(F.pow(F.lit(2.0), lane).cast("long")).alias(f"lane{k}") for k, lane in enumerate(lanes(F.col("key")))]
    return listing.groupBy(block_of(F.col("key"), blocks).alias("block")).agg(*bit)


def possible(keys: DataFrame, listing: DataFrame, p: Bloom, n: int | None = None) -> DataFrame:
    """Rows of ``keys`` (with a column key) whose bits are all set in the filter of ``listing``; ``n`` is its number of keys, if known."""
    n = listing.count() if n is None else n
    blocks = max(1, -(-n * p.bits // 256))
    table = build_filter(listing, blocks)
    if blocks * 72 <= p.broadcast_bytes:  # a row is a block number and eight lanes
        table = F.broadcast(table)
    test = F.lit(True)
    for k, lane in enumerate(lanes(F.col("key"))):
        test = test & (F.pmod(F.floor(F.col(f"lane{k}") / F.pow(F.lit(2.0), lane)), F.lit(2)) == 1)
    return keys.withColumn("block", block_of(F.col("key"), blocks)).join(table, "block").where(test).select(*keys.columns)


def listed_urls(urls: DataFrame, listing: DataFrame, p: Bloom = Bloom()) -> DataFrame:
    """Distinct url of ``urls`` with a key in ``listing`` (key: canonical host and path, with the query string or port if only that url is listed)."""
    listing = listing.where("key is not null").select("key").distinct()
    n, shape = shape_of(listing)
    keys = urls.where("url is not null").select("url")  # tested where they are read: only possible hits are shuffled
    keys = keys.select("url", F.explode(F.array_distinct(keys_of(host_of(F.col("url")), path_of(F.col("url")), query_of(F.col("url")), shape))).alias("key"))
    return possible(keys, listing, p, n).join(listing, "key").select("url").distinct()


def url_verdicts(pages: DataFrame, listing: DataFrame, rules=RULES, p: Bloom = Bloom()) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is allowed. Repeated rows and null ids are judged like any others; an
    empty table gives no rows, an empty listing lists nothing. A long url costs what
    its length costs: the listing's own shape bounds the keys that are built for it.
    """
    pages = fold(pages, "page_id", "url")
    hit = listed_urls(pages, listing, p).withColumn("listed", F.lit(True))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.where("url is not null").join(hit, "url", "left")
    rows = rows.unionByName(pages.where("url is null").withColumn("listed", F.lit(None).cast("boolean")))  # not through the join, as one key
    rows = rows.select("page_id", host.alias("host"), path.alias("path"), "listed")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def default_listing(spark: SparkSession) -> DataFrame:
    """Whole hosts, and some thousand urls made by a rule, with repeats."""
    hosts = spark.createDataFrame([(f"{n}.{e}/",) for n in LISTED_NAMES for e in LISTED_ENDINGS], "key string")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    k = F.col("id")
    number = (k * 7 % LISTED_NUMBERS).cast("string")
    key = F.concat(pick(LISTED_HOSTS, k), F.lit("/"), pick(LISTED_FOLDERS, F.floor(k / 5)), F.lit("/"), number, pick(LISTED_TAILS, F.floor(k / 20)))
    return hosts.union(spark.range(LISTED_URLS).select(key))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), default_listing(spark))


_FITS = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2])))

_LIST = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"

#: The tables hold no dot segments, which the SQL leaves as they are.
OP2_SQL = f"""
WITH listing AS (
  SELECT n || '.' || e || '/' AS key FROM unnest({_LIST(LISTED_NAMES)}) AS names(n), unnest({_LIST(LISTED_ENDINGS)}) AS endings(e)
  UNION
  SELECT {_LIST(LISTED_HOSTS)}[k % {len(LISTED_HOSTS)} + 1] || '/' || {_LIST(LISTED_FOLDERS)}[k // 5 % {len(LISTED_FOLDERS)} + 1] || '/'
         || (k * 7 % {LISTED_NUMBERS}) || {_LIST(LISTED_TAILS)}[k // 20 % {len(LISTED_TAILS)} + 1]
  FROM range({LISTED_URLS}) AS numbers(k)
), parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^?#]*(\\?[^#]*)', 1), '') AS query
  FROM pages
), plain AS (
  SELECT DISTINCT url, query, regexp_replace(regexp_extract(host, ':[0-9]+$', 0), '^:(80|443)$', '') AS port,
         regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '^[.]+|[.]+$', '', 'g') AS host,
         regexp_replace('/' || url_decode(replace(path, '+', '%2B')), '/+', '/', 'g') AS path
  FROM parts WHERE host <> ''
), split AS (
  SELECT url, host, port, path, query, string_split(host, '.') AS labels, string_split(path, '/') AS folders FROM plain
), keys AS (
  SELECT url, unnest(list_transform(range(2 * len(labels)), lambda n: array_to_string(labels[n // 2 + 1:], '.') || CASE WHEN n % 2 = 1 THEN port ELSE '' END)) AS host,
         list_transform(range(1, len(folders)), lambda n: array_to_string(folders[:n], '/') || '/') || [path, path || query] AS paths
  FROM split
), listed AS (
  SELECT DISTINCT url FROM (SELECT url, host || unnest(paths) AS key FROM keys) SEMI JOIN listing USING (key)
), ruled AS (
  SELECT page_id, host, path,
         CASE {_FITS.format(*(h + p for _, h, p in RULES))} END AS rule,
         CASE {_FITS.format(*(v for v, _, _ in RULES))} END AS verdict,
         listed.url IS NOT NULL AS listed
  FROM parts LEFT JOIN listed USING (url)
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM ruled
"""

QUERIES = {"op2_url_filter": op2_url_filter}
ORACLES = {"op2_url_filter": OP2_SQL}
