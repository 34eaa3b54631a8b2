"""Verdicts on URLs from a list of hosts and path prefixes: a blocked Bloom filter, then an exact join.

A listed entry (host, path, verdict) fits its host and all subdomains if the path starts with its path. A
URL is therefore looked up under every host suffix and path prefix whose shape (number of labels, length
of the path) occurs in the list. The filter holds the listed (host, path) keys in blocks of 512 bits; a key
sets ``BITS`` bits of one block, so a probe reads one row of the filter. The filter has at most
``MAX_BLOCKS`` blocks (8 MB), whatever the list's size: that bound is what allows to broadcast it. A longer
list only lets more false hits through, and those are removed by the exact join. Everything is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioframe.session import prepare

MAX_BLOCKS = 1 << 17
KEY_BITS = 16          # filter bits per listed key while the bound allows
BITS = 4
WORDS = 8              # 64-bit words of a block
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower-case ASCII and path; both empty without ``://``."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substr(url, start + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _block(host: str, path: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks)).cast("int")


def _bit(host: str, path: str, k: int) -> Column:
    """Bit ``k`` of a key within its block, 0 to 511."""
    return F.shiftrightunsigned(F.xxhash64(path, F.lit("bits"), host), 9 * k).bitwiseAND(F.lit(511)).cast("int")


def _mask(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(F.lit(63)))


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """One row per block that has bits: its number and words."""
    bits = F.explode(F.array(*[_bit("host", "path", k) for k in range(BITS)]))
    rows = listed.select(_block("host", "path", blocks).alias("block"), bits.alias("bit"))
    words = [F.coalesce(F.bit_or(F.when(F.shiftright("bit", 6) == w, _mask(F.col("bit")))), F.lit(0).cast("bigint")) for w in range(WORDS)]
    return rows.groupBy("block").agg(F.array(*words).alias("words"))


def _passes(host: str, path: str) -> Column:
    hit = F.lit(True)
    for k in range(BITS):
        bit = _bit(host, path, k)
        hit = hit & (F.element_at("words", F.shiftright(bit, 6) + 1).bitwiseAND(_mask(bit)) != 0)
    return hit


def listed_keys(listed: DataFrame) -> DataFrame:
    """Distinct (host, path) with a verdict; ``block`` wins over ``allow``; entries with a null are left out."""
    rows = listed.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").dropna()
    return rows.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocked"))


def judge_urls(pages: DataFrame, listed: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: key, host, path, the longest fitting entry (``rule``) and its verdict, else ``default``.

    A null URL has empty host and path; repeated rows are returned as often as they occur; entries of equal
    length are ordered by host length, then ``block`` first; other columns of either table are not read; an
    empty list gives ``default``; an empty table gives no rows.
    """
    prepare(pages.sparkSession)
    keys = listed_keys(listed)
    # numbers of labels and path lengths of listed URLs: as many as URLs have, not as the list has entries
    shapes = [(r.labels, r.length) for r in keys.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length")).distinct().collect()]
    blocks = max(1, min(MAX_BLOCKS, -(-keys.count() * KEY_BITS // (64 * WORDS))))

    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("_key"), host.alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.")
    own = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("p")))
    looked_up = [
        F.when((F.size(labels) >= n) & (F.length("_path") >= size), F.struct(
            F.array_join(F.slice(labels, -n, n), ".").alias("h"), F.substring("_path", 1, size).alias("p")))
        for n, size in sorted(shapes)]
    tries = rows.select("_key", "_host", "_path", F.explode(F.concat(own, F.array_compact(F.array(*looked_up))) if shapes else own).alias("_try"))
    tries = tries.select("_key", "_host", "_path", F.col("_try.h").alias("_h"), F.col("_try.p").alias("_p"))

    tries = tries.withColumn("block", F.when(F.col("_h").isNotNull(), _block("_h", "_p", blocks)))
    possible = tries.join(F.broadcast(bloom(keys, blocks)), "block", "left").filter(F.col("_h").isNull() | _passes("_h", "_p")).drop("block", "words")
    exact = possible.join(keys, (F.col("_h") == F.col("host")) & (F.col("_p") == F.col("path")), "left")
    rule = F.concat("host", "path")
    best = F.max(F.when(F.col("host").isNotNull(), F.struct(F.length(rule).alias("n"), F.length("host").alias("m"), F.col("blocked"), rule.alias("rule"))))
    found = exact.groupBy("_key", "_host", "_path").agg(best.alias("best"), F.sum(F.col("_h").isNull().cast("int")).alias("times"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocked"), "block").otherwise("allow")
    out = found.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("best.rule").alias("rule"), verdict.alias("verdict"), "times")
    return out.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("times")
