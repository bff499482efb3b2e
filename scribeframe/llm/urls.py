"""Operator 8, URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The list goes into a Bloom filter whose bits for one URL all stand in one block of 512 bits. URLs that the filter may
hold go on to an exact hash join with the list, which removes the false positives; the others take a branch of their own
without a shuffle. A filter of up to MOST_BYTES is sent to all tasks; a larger one is a table of blocks, and URLs meet
their block by a join. Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed;
repeated urls and list entries give each page one verdict; very long urls are read whole; an empty list or table gives
no block; other columns are not returned by judge(), and kept, whatever their names, by listed().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import table, written
from .lines import unused

#: contract's rules: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: names of hosts whose pages may stand in the query's list
LISTED = ("cheap-pills", "spam-farm", "casino-win", "adult-x", "free-bets", "ads-track")
BLOCK_BITS, HASHES, BITS_A_KEY = 512, 8, 16
#: bytes of the largest filter that is sent to every task
MOST_BYTES = 32 << 20


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Without scheme, query, fragment, a leading www. or m., a trailing slash and .html."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/?$", ""))


def rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest fitting rule as text and its verdict; nulls where none fits."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(ordered):
        name, verdict = F.when(fits(h, p), F.lit(h + p)).otherwise(name), F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    return name, verdict


def bit_places(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a URL and its 64-bit words with the bits to set, as an array of 8 words."""
    h = F.xxhash64(key)
    block = F.pmod(h, F.lit(blocks).cast("long"))
    g = F.xxhash64(key, F.lit("bits"))
    places = F.array(*[F.shiftrightunsigned(g, 7 * i).bitwiseAND(F.lit(BLOCK_BITS // 8 - 1)) for i in range(HASHES)])
    return block, places  # one bit in each of the block's eight words


def filter_words(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """The filter over a column of keys: (block, w0 to w7)."""
    block, places = bit_places(F.col(column), blocks)
    word = lambda i: F.bit_or(F.expr(f"shiftleft(1L, cast(p[{i}] as int))")).alias(f"w{i}")
    return keys.select(block.alias("block"), places.alias("p")).groupBy("block").agg(*[word(i) for i in range(8)])


def bloom(keys: DataFrame, column: str, blocks: int) -> np.ndarray:
    """The filter as an array on the driver; the caller holds its size, blocks * 64 bytes, to MOST_BYTES."""
    words = np.zeros((blocks, 8), dtype=np.int64)
    found = filter_words(keys, column, blocks).toArrow()
    words[found["block"].to_numpy()] = np.stack([found[f"w{i}"].to_numpy() for i in range(8)], axis=1)
    return words


def maybe(words: np.ndarray):
    """A test of block and places against the filter, over Arrow batches."""

    def test(block: pd.Series, places: pd.Series) -> pd.Series:
        if not len(block):
            return pd.Series([], dtype=bool)
        p = np.stack(places.to_numpy()).astype(np.int64)
        got = (words[block.to_numpy()] >> p) & 1
        return pd.Series(got.all(axis=1))

    test.__annotations__ = {"block": pd.Series, "places": pd.Series, "return": pd.Series}
    return F.pandas_udf(test, "boolean").asNondeterministic()


def listed(pages: DataFrame, listing: DataFrame, key: str = "_key", into: str = "_listed") -> DataFrame:
    """pages with ``into``: whether the key column is in ``listing`` (a column ``key``, any repeats)."""
    entries = written(listing.where("key is not null").select("key").distinct(), "listing")
    blocks = max(1, -(-entries.count() * BITS_A_KEY // BLOCK_BITS))
    names = [c for c in pages.columns if c != into]
    flag, entry, number, at, *word = unused(pages.columns, "_maybe", "_entry", "_block", "_places", *[f"_w{i}" for i in range(8)])
    block, places = bit_places(F.col(key), blocks)
    if blocks * BLOCK_BITS // 8 <= MOST_BYTES:
        probed = pages.withColumn(flag, F.coalesce(maybe(bloom(entries, "key", blocks))(block, places), F.lit(False)))
    else:
        table = filter_words(entries, "key", blocks)
        table = table.select(F.col("block").alias(number), *[F.col(f"w{i}").alias(word[i]) for i in range(8)])
        bits = [F.expr(f"shiftrightunsigned(`{word[i]}`, cast(`{at}`[{i}] as int)) & 1 = 1") for i in range(8)]
        all_set = bits[0]
        for x in bits[1:]:
            all_set = all_set & x
        probed = pages.withColumns({number: block, at: places}).join(table, number, "left").withColumn(flag, F.coalesce(all_set, F.lit(False)))
    hits = probed.where(flag).join(entries.select(F.col("key").alias(entry)), F.col(key) == F.col(entry), "left")
    others = probed.where(~F.col(flag))
    return hits.select(*names, F.col(entry).isNotNull().alias(into)).unionByName(others.select(*names, F.lit(False).alias(into)))


def judge(pages: DataFrame, listing: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    parts = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"))
    keyed = parts.withColumns({"rule": name, "_verdict": verdict, "_key": canonical(F.col("host"), F.col("path"))})
    by_list = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return listed(keyed, listing).select("page_id", "host", "path", "rule", F.coalesce("_verdict", by_list).alias("verdict"))


def listing_of(pages: DataFrame) -> DataFrame:
    """The query's list, as there is no table of one: canonical URLs of pages that stand on a host with a LISTED name under
    a plain URL, without query and fragment. Other URLs of those hosts are blocked only if their canonical form is one."""
    parts = pages.select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"))
    plain = parts.where(F.col("h").rlike(r"(^|\.)(" + "|".join(LISTED) + r")\.") & ~F.col("url").rlike("[?#]"))
    return plain.select(canonical(F.col("h"), F.col("p")).alias("key"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listing_of(pages))


OP8_SQL = r"""
with parts as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) as path
  from pages),
keyed as (
  select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/?$', '') as key from parts),
listing as (
  select distinct key from keyed where regexp_matches(host, '(^|\.)(cheap-pills|spam-farm|casino-win|adult-x|free-bets|ads-track)\.') and not regexp_matches(url, '[?#]')),
ruled as (
  select k.page_id, k.host, k.path, l.key is not null as listed,
    case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
         when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
         when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
         when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule
  from keyed k left join listing l on k.key = l.key)
select page_id, host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when listed then 'block' else 'allow' end as verdict
from ruled
"""
