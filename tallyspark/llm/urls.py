"""Allow and block lists for URLs: a blocked Bloom filter, then an exact hash join.

A listed entry is a canonical URL prefix: a host (it stands for all its
subdomains too) and a path prefix.  A page's candidates are its host's suffixes,
each with the path's prefixes of the lengths that the list has.  The Bloom
filter is made of blocks of eight 64-bit words; a key's hash picks one block and
one bit in each of its words, so a test reads one block.  The test is made in the
page's row, so pages without a possible hit are neither joined nor shuffled.
Candidates that pass are joined with the list itself, on the very strings, which
removes the false positives.  Of the entries that fit, the longest (host plus path)
wins, then the one with the longer host.

Sizes are checked: the filter has at most ``max_blocks`` blocks of 64 bytes; the
list is broadcast up to ``broadcast_rows`` entries, and joined by shuffle beyond it.

Defined results: null URLs and URLs without ``://`` have empty host and path,
fit nothing and get the default verdict; repeated rows stay repeated; other
columns are dropped; entries with a null host or path are ignored, and of
entries with equal host and path the one with the smallest verdict holds; an
empty list gives the default verdict everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else ''."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else ''."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of (host, path) of all listed entries that could fit."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    paths = F.filter(F.array(*(F.struct(F.lit(k).alias("n"), F.substring(path, 1, k).alias("path")) for k in lengths)), lambda p: F.char_length(p["path"]) == p["n"])
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct(h.alias("host"), p["path"].alias("path")))))


def _hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\0"), path)


def _bit(key: Column, word: Column) -> Column:
    """The key's bit in one word of its block: six bits of a second hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftrightunsigned", F.xxhash64(key, F.lit(1)), word * 6).bitwiseAND(F.lit(63)).cast("int"))


def bloom(listed: DataFrame, blocks: int) -> list[int]:
    """The words of the keys' blocked Bloom filter, block after block."""
    keyed = listed.select(_hash(F.col("host"), F.col("path")).alias("key"))
    keyed = keyed.select("key", F.explode(F.sequence(F.lit(0), F.lit(WORDS - 1))).alias("w"))
    place = F.pmod("key", F.lit(blocks)) * WORDS + F.col("w")
    rows = keyed.groupBy(place.alias("place")).agg(F.bit_or(_bit(F.col("key"), F.col("w"))).alias("word")).collect()
    words = [0] * (blocks * WORDS)
    for r in rows:
        words[r["place"]] = r["word"]
    return words


def may_be_listed(host: Column, path: Column, words: list[int]) -> Column:
    """Whether the filter has the key; the words are a constant of the plan, so the test stays in the row."""
    filter_ = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")
    key = _hash(host, path)
    block = F.pmod(key, F.lit(len(words) // WORDS)).cast("int") * WORDS
    return F.forall(F.array(*map(F.lit, range(WORDS))), lambda w: F.get(filter_, block + w).bitwiseAND(_bit(key, w)) != 0)


def judge(
    pages: DataFrame,
    listed: DataFrame,
    default: str = "allow",
    keys_per_block: int = 24,
    max_blocks: int = 8192,
    broadcast_rows: int = 200_000,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(id, url, host, path, rule, verdict) of every page; ``listed`` has host, path and verdict.

    ``max_blocks`` bounds the filter (64 bytes a block); a longer list makes it pass more, never less.
    """
    listed = listed.select("host", "path", "verdict").where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    size = listed.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    words = bloom(listed, max(1, min(max_blocks, size["n"] // keys_per_block)))

    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    hits = F.filter(candidates(F.col("host"), F.col("path"), size["lengths"] or [0]), lambda c: may_be_listed(c["host"], c["path"], words))
    tried = urls.withColumn("hits", hits)
    names = [F.col("id").alias(id_col), F.col("url").alias(url_col), "host", "path"]
    # pages that the filter rules out are done where they are read
    clear = tried.where("size(hits) = 0").select(*names, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    asked = tried.where("size(hits) > 0").select("id", "url", "host", "path", F.size("hits").alias("n"), F.explode("hits").alias("c")).select("*", F.col("c.host").alias("c_host"), F.col("c.path").alias("c_path"))
    entries = listed.select(F.col("host").alias("c_host"), F.col("path").alias("c_path"), F.col("verdict").alias("listed_verdict"))
    found = asked.join(F.broadcast(entries) if size["n"] <= broadcast_rows else entries, ["c_host", "c_path"], "left")
    rule = F.when(F.col("listed_verdict").isNotNull(), F.struct((F.char_length("c_host") + F.char_length("c_path")).alias("length"), F.char_length("c_host").alias("host_length"), F.concat("c_host", "c_path").alias("rule"), F.col("listed_verdict").alias("verdict")))
    # a page's hits come one after another, so they are one row before the shuffle; copies of a row are counted and come back
    best = found.groupBy("id", "url", "host", "path").agg(F.max(rule).alias("best"), (F.count("*") / F.max("n")).cast("long").alias("copies"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return clear.union(best.select(*names, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
