"""URL filters (operator 9): prefix rules, then a blocked Bloom filter and an exact join. Built-in functions only.

Listed canonical URLs fill a blocked Bloom filter: a hash names one 64-bit block and another sets PROBES bits in it.
The filter has a block for each KEYS_PER_BLOCK listed URLs, however many those are. Up to BROADCAST_BLOCKS blocks, a
size that is known before the join, it goes to every task; a larger filter is a table that hashed URLs are joined
with. Only URLs whose bits are all set are shuffled to the exact join with the list, which removes the false
positives; the others are done. Copies of one listed URL may hold many rows, so a key of the list is dealt over SALTS
places.

Canonical form: lower-case host without ``www.`` or ``m.``, path without trailing ``/``, then the query without
tracking parameters, its parameters in order; scheme and fragment go.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule, and is not listed;
repeated rows are judged one by one; an empty table gives an empty result; a URL of any length is read whole; of rules
that fit the longest decides, and no two are as long; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import settle

#: (host, path, verdict): the longest rule that fits decides.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LEAST_BLOCKS, KEYS_PER_BLOCK, PROBES = 1 << 6, 4, 4
#: Blocks of a filter that is still broadcast (about 50 MB in a task), and places that a listed URL is dealt over.
BROADCAST_BLOCKS, SALTS = 1 << 20, 8
#: Query parameters that name no other page.
TRACKING = ("ref", "utm_source", "utm_medium", "utm_campaign", "fbclid", "gclid")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """The canonical form; null for what is no URL."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    bare = F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.concat(bare, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, written as host and path, and its verdict; null where none fits."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host_col == h) | host_col.endswith(f".{h}")) & path_col.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def _bits(key: Column) -> Column:
    """The bits that a key sets in its block."""
    h = F.xxhash64(key, F.lit("bits"))
    out = None
    for k in range(PROBES):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
        out = bit if out is None else out.bitwiseOR(bit)
    return out


def bloom_blocks(keys: DataFrame) -> tuple[DataFrame, int]:
    """The filter as (block, bits), and its number of blocks."""
    n = keys.agg(F.approx_count_distinct("key")).first()[0]
    blocks = max(LEAST_BLOCKS, 1 << int(n // KEYS_PER_BLOCK).bit_length())
    at = F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")
    return keys.select(at, _bits(F.col("key")).alias("own")).groupBy("block").agg(F.bit_or("own").alias("bits")), blocks


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(id, host, path, rule, verdict, canonical, listed) of every row.

    ``listed``: its first column holds canonical URLs to block where no rule fits.
    """
    keys = listed.select(F.col(f"`{listed.columns[0]}`").alias("key")).where("key is not null").distinct()
    blocks, n = bloom_blocks(keys)
    url = F.col(f"`{url_col}`")
    named = pages.select(F.col(f"`{id_col}`").alias("id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    own = F.pmod(F.xxhash64("canonical"), F.lit(n))
    tested = named.select("*", name.alias("rule"), verdict.alias("ruled"), F.when(F.col("canonical").isNotNull(), own).alias("block"), _bits(F.col("canonical")).alias("own"))
    if n <= BROADCAST_BLOCKS:
        passed = tested.join(F.broadcast(blocks), "block", "left")
    else:  # what is no URL has no block, and need not be sent anywhere
        passed = tested.where("block is not null").join(blocks, "block", "left").unionByName(tested.where("block is null").withColumn("bits", F.lit(None).cast("long")))
    possible = F.coalesce(F.col("bits").bitwiseAND(F.col("own")) == F.col("own"), F.lit(False))
    parted = settle(passed.select("id", "host", "path", "rule", "ruled", "canonical", possible.alias("possible")), "filtered-urls")
    places = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    exact = keys.select("key", places, F.lit(True).alias("hit"))
    asked = parted.where("possible").withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS)))
    hits = asked.join(exact, (asked["canonical"] == exact["key"]) & (asked["salt"] == exact["salt"]), "left").select(*parted.columns, "hit")
    done = parted.where("not possible").withColumn("hit", F.lit(False)).unionByName(hits)
    hit = F.coalesce("hit", F.lit(False))
    return done.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(hit, "block").otherwise("allow")).alias("verdict"), "canonical", hit.alias("listed"))


def crawl_traps(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Canonical URLs that were fetched under two or more different spellings."""
    url = F.col(f"`{url_col}`")
    spelled = pages.select(canonical(url).alias("key"), F.xxhash64(url).alias("spelling")).where("key is not null")
    return spelled.groupBy("key").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("key")
