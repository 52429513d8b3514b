"""URL filters: a blocked Bloom filter before an exact hash join.

Both sides are canonical URLs. The filter's blocks are rows of eight 32-bit
words; a URL sets one bit of each word of one block. The pages probe it by a
join on the block number, inside generated code. What passes is joined with
the list itself, which removes the false positives. A filter of up to
``BROADCAST_BYTES`` is broadcast, so that the other pages never shuffle; the
blocks of a larger one are partitioned, and the pages go to their block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

#: Listed URLs to a block (about 1 % false positives), and the bytes of the largest filter that is broadcast.
PER_BLOCK, BROADCAST_BYTES = 24, 64 << 20
#: Of a block: its number and eight words, in Spark's rows.
BLOCK_BYTES = 96
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
#: Labels of hosts, under whatever domain, whose pages make up the list that the query uses; top-level domains of their mirrors.
LISTED_LABELS = ("ads-track", "spam-farm", "casino-win", "adult-x", "cheap-pills", "free-bets")
MIRRORS = ("com", "net", "org")


def canonical(url: Column) -> Column:
    """Canonical form: host and path, and the query's own parameters in order.

    The scheme, credentials, a leading www. or m., default ports, the fragment,
    tracking parameters (utm_*, ref, gclid, fbclid) and a trailing slash go;
    the host is in lower case. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    own = F.array_sort(F.filter(F.split(query, "&", -1), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|gclid|fbclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise(F.lit("")))


def host_of(canonical_url: Column) -> Column:
    """Host of a canonical URL."""
    return F.regexp_extract(canonical_url, "^[^/?]*", 0)


def _bit(h: Column, salt: int) -> Column:
    """One of 32 bits, by a multiply-shift of the low half of the hash."""
    return F.shiftright((h.bitwiseAND(0xFFFFFFFF) * F.lit(salt)).bitwiseAND(0xFFFFFFFF), 27).cast("int")


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("int")


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """The filter: (block, w0 to w7) for the blocks that have a bit set. listed: (url)."""
    h = F.xxhash64("url")
    bits = listed.select(_block(h, blocks).alias("block"), *[F.expr("1L").alias("one")], h.alias("h"))
    words = [F.bit_or(F.call_function("shiftleft", F.col("one"), _bit(F.col("h"), s))).alias(f"w{i}") for i, s in enumerate(SALTS)]
    return bits.groupBy("block").agg(*words)


def flag_listed(pages: DataFrame, listed: DataFrame, per_block: int = PER_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All pages with their canonical URL, and whether it is listed.

    pages: page_id, url; listed: url (in any form). Returns (page_id, url,
    canonical_url, listed). A null URL is never listed, in either table; an
    empty one is listed by an empty one; an empty list lists nothing, and an empty
    table gives no rows. Repeated rows and repeated URLs stay; null page_ids are
    kept; URLs of any length are compared whole; other columns, whatever their
    names, are ignored. A filter of more than ``broadcast_bytes`` isn't broadcast.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    exact = scratch.table(listed.select(canonical(F.col("url")).alias("url")).where("url is not null").distinct(), "listed")
    n = exact.count()
    rows = pages.select("page_id", "url", canonical(F.col("url")).alias("canonical_url"))
    none = F.lit(False).alias("listed")
    blocks = n // per_block + 1
    keys = exact.select(F.col("url").alias("key"))
    words = scratch.table(bloom(exact, blocks), "bloom")
    words = F.broadcast(words) if blocks * BLOCK_BYTES <= broadcast_bytes else words.hint("merge")
    h = F.xxhash64("canonical_url")
    probed = rows.withColumn("at", _block(h, blocks)).join(words, F.col("at") == F.col("block"), "left")
    hit = F.col("canonical_url").isNotNull() & F.col("block").isNotNull()
    for i, salt in enumerate(SALTS):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), _bit(h, salt)).bitwiseAND(1) == 1)
    probed = probed.select("page_id", "url", "canonical_url", F.coalesce(hit, F.lit(False)).alias("hit"))
    possible = probed.where("hit").join(keys.hint("shuffle_hash"), F.col("canonical_url") == F.col("key"), "left")
    return probed.where("not hit").select("page_id", "url", "canonical_url", none).unionByName(possible.select("page_id", "url", "canonical_url", F.col("key").isNotNull().alias("listed")))


_CANONICAL = """
b AS (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (SELECT page_id, url,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^[^@]*@', ''), ':(80|443)$', ''), '^(www|m)\\.', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS own FROM b),
k AS (SELECT page_id, url, host, host || path || CASE WHEN len(own) > 0 THEN '?' || array_to_string(own, '&') ELSE '' END AS canonical_url FROM c)
"""
#: What the query gives for pages, as SQL.
SQL = f"""
WITH {_CANONICAL}, bad AS (SELECT host, canonical_url FROM k WHERE list_has_any(string_split(host, '.'), [{", ".join(f"'{x}'" for x in LISTED_LABELS)}])),
listed AS (SELECT DISTINCT regexp_replace(host, '[^.]+$', tld) || substr(canonical_url, length(host) + 1) AS listed_url FROM bad, (SELECT unnest([{", ".join(f"'{x}'" for x in MIRRORS)}]) AS tld))
SELECT page_id, url, canonical_url, listed_url IS NOT NULL AS listed FROM k LEFT JOIN listed ON canonical_url = listed_url
"""


def listed_of(pages: DataFrame) -> DataFrame:
    """The query's list (url): what has been reported, the pages of hosts with a listed label, and the same under all mirrors' domains."""
    url = canonical(F.col("url"))
    host = host_of(F.col("u"))
    bad = pages.select(url.alias("u")).where(F.arrays_overlap(F.split(host, "\\."), F.array(*[F.lit(x) for x in LISTED_LABELS])))
    mirrored = bad.select("u", host.alias("h"), F.explode(F.array(*[F.lit(x) for x in MIRRORS])).alias("tld"))
    return mirrored.select(F.concat(F.expr("regexp_replace(h, '[^.]+$', tld)"), F.expr("substring(u, length(h) + 1)")).alias("url"))
