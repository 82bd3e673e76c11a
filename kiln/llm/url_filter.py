"""URL rules behind a blocked Bloom filter (DataFrame functions only).

Each rule is a listed canonical URL: a host (fitting its subdomains) and a
path prefix. A page's candidate keys are its host suffixes of the label counts
that occur in the list times its path prefixes of the lengths that occur in it. A blocked Bloom filter of the
listed keys passes possible hits; an exact hash join with the list removes the
false positives; the longest listed rule wins.

Defined results: a null url, or one without ``://``, has empty host and path
and no rule. Without a rule the verdict is ``allow`` (the list names what to
block). Equal-length rules: the alphabetically first. Repeated pages each get
their row; repeated rules count once (smallest verdict); rules with a null
host, path or verdict are ignored; an empty list allows everything.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.helpers import UPPER, staged
from kiln.operators.joins import bounded_broadcast

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BITS = 4                      # bits set per key, all in one 64-bit block
KEYS_PER_BLOCK = 4            # 16 bits a key
MAX_BLOCKS = 1 << 20          # the filter is at most 8 MB; a longer list only makes it pass more to the exact join


def host_of(url: Column) -> Column:
    h = F.coalesce(F.regexp_extract(url, URL_PATTERN, 1), F.lit(""))
    return F.translate(h, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("key_host", "key_path"), F.lit(blocks))


def _mask() -> Column:
    h = F.xxhash64(F.lit("bits"), "key_path", "key_host")
    m = F.lit(0).cast("bigint")
    for i in range(BITS):
        bit = F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        m = m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))
    return m


def bloom_blocks(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(block, mask) rows of the blocked filter, and its number of blocks."""
    blocks = min(MAX_BLOCKS, 1 << max(0, math.ceil(math.log2(max(1, n_keys / KEYS_PER_BLOCK)))))
    return (keys.select(_block(blocks).alias("bloom_block"), _mask().alias("m"))
            .groupBy("bloom_block").agg(F.bit_or("m").alias("bloom_mask")), blocks)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``rules``: host, path, verdict. Returns id, host, path, rule, verdict."""
    listed = (rules.select(F.translate("host", UPPER, UPPER.lower()).alias("key_host"), F.col("path").alias("key_path"),
                           F.col("verdict").alias("listed_verdict"))
              .dropna().groupBy("key_host", "key_path").agg(F.min("listed_verdict").alias("listed_verdict")))
    listed = staged(listed, "url-rules")
    size = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("key_path")).alias("lens"),
                      F.collect_set(F.size(F.split("key_host", r"\.", -1))).alias("labels")).first()
    bloom, blocks = bloom_blocks(listed, size["n"])

    base = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
                        F.col(url_col).contains("://").alias("has_host"))
    labels = F.split(F.col("host"), r"\.", -1)
    depths = F.array(*[F.lit(n) for n in sorted(size["labels"])]).cast("array<int>")
    suffixes = F.transform(F.filter(depths, lambda k: k <= F.size(labels)),
                           lambda k: F.concat_ws(".", F.slice(labels, F.size(labels) - k + 1, k)))
    lens = F.array(*[F.lit(n) for n in sorted(size["lens"])]).cast("array<int>")
    prefixes = F.transform(F.filter(lens, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    cand = (base.filter("has_host").select("host", "path", F.explode(suffixes).alias("key_host"), prefixes.alias("prefixes"))
            .select("host", "path", "key_host", F.explode("prefixes").alias("key_path")))
    # At most MAX_BLOCKS narrow rows: the broadcast is bounded by construction.
    possible = (cand.withColumn("bloom_block", _block(blocks)).join(F.broadcast(bloom), "bloom_block")
                .filter(F.col("bloom_mask").bitwiseAND(_mask()) == _mask())
                .select("host", "path", "key_host", "key_path"))
    hits = possible.join(bounded_broadcast(listed, materialized=True), ["key_host", "key_path"])
    rule = F.concat("key_host", "key_path")
    # One row per distinct hit URL; written, so the join below has plain
    # shuffles on both sides and a hot URL's partition can be split.
    best = staged(hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length(rule)).alias("l"), rule.alias("rule"), F.col("listed_verdict").alias("verdict"))).alias("b")),
        "url-hits")
    best = best.select(F.col("host").alias("hit_host"), F.col("path").alias("hit_path"), "b.rule", "b.verdict")
    # The hits grow with the pages: always a shuffle join, never a broadcast.
    return (base.join(best.hint("merge"), (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")) & F.col("has_host"), "left")
            .select(id_col, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict")))
