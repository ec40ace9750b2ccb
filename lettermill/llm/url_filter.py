"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

All listed keys, that is rules (host and path prefix) and canonical URLs, set bits in a split-block Bloom filter: a key picks one
block of eight 64-bit words and one bit in each word. The number of blocks follows the length of the list up to a bound, so the filter may
be broadcast. Each distinct URL probes it with its canonical form and with its (host suffix, path prefix) pairs; what passes is joined
exactly with the list, which removes the false positives. Rules are few and join by themselves, so that all URLs under one of them do not
meet on its key. A list that outgrows the filter costs more probes in the exact join, never a wrong verdict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Keys a block of 512 bits is meant for, about one false positive in a hundred; the filter's rows have 72 bytes, so it has at most 38 MB.
KEYS_A_BLOCK, LEAST_BLOCKS, MOST_BLOCKS = 32, 4096, 1 << 19
MOST_RULES = 100_000  # more are joined without a broadcast


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?`` or ``#``; empty where the host is undefined."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without ``www.`` and default port, path without closing slashes; null if there is no host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, "/+$", "")))


def _bits(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    spread = F.xxhash64(key, F.lit("bits"))
    return block, [_one_bit(spread, i) for i in range(WORDS)]


def _one_bit(spread: Column, word: int) -> Column:
    place = F.shiftrightunsigned(spread, 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def blocks_for(n_keys: int) -> int:
    """Blocks of a filter for so many keys."""
    return max(LEAST_BLOCKS, min(MOST_BLOCKS, -(-n_keys // KEYS_A_BLOCK)))


def bloom_filter(keys: DataFrame, blocks: int = 4096) -> DataFrame:
    """``keys(key)`` as at most ``blocks`` rows (block, w0..w7); null keys set nothing."""
    block, masks = _bits(F.col("key"), blocks)
    marked = keys.where(F.col("key").isNotNull()).select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def with_bloom(probes: DataFrame, bloom: DataFrame, blocks: int = 4096) -> DataFrame:
    """``probes`` (with a column ``key``) and ``maybe``: whether all bits of the key are set. Null keys are not listed."""
    block, masks = _bits(F.col("key"), blocks)
    small = F.broadcast(bloom.withColumnRenamed("block", "bloom_block"))
    both = probes.join(small, block == F.col("bloom_block"), "left")
    hit = F.col("bloom_block").isNotNull() & F.col("key").isNotNull()
    for i, mask in enumerate(masks):
        hit &= F.col(f"w{i}").bitwiseAND(mask) != 0
    return both.select(*[probes[c] for c in probes.columns], hit.alias("maybe"))


def maybe_listed(probes: DataFrame, bloom: DataFrame, blocks: int = 4096) -> DataFrame:
    """The rows of ``probes`` whose bits are all set."""
    return with_bloom(probes, bloom, blocks).where("maybe").drop("maybe")


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    listed: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    blocks: int | None = None,
) -> DataFrame:
    """Judge every row of ``pages``: (id, host, path, rule, verdict, listed).

    ``rules``: (verdict, host, path prefix) with verdict ``allow`` or ``block``; a rule fits its host and all subdomains, the longest
    wins, ``block`` before ``allow`` for the same rule. ``listed(url)``: blocked URLs in canonical form. A page without a rule is
    blocked if its canonical URL is listed, else allowed. ``blocks``: the filter's size, by the length of the list if not given.

    Null, empty and host-less URLs: host and path empty, no rule, allow. Repeated rows are judged one by one and stay. Empty tables
    give no rows; an empty list blocks nothing. Other columns of ``pages`` are ignored. A very long URL probes no more than others:
    host suffixes and path prefixes are bounded by the longest rule.
    """
    spark = pages.sparkSession
    depth = max([len(h.split(".")) for _, h, _ in rules], default=0)
    lengths = sorted({len(p) for _, _, p in rules})
    rows = [(f"r:{h}{p}", f"{h}{p}", v) for v, h, p in rules]
    ruled = spark.createDataFrame(rows, "key string, rule string, verdict string")
    ruled = ruled.groupBy("key", "rule").agg(F.max("verdict").alias("verdict"))  # block > allow
    urls_listed = listed.where(F.col("url").isNotNull()).select(F.concat(F.lit("u:"), "url").alias("key")).distinct()
    urls_listed = materialize(urls_listed, "listed-urls")
    blocks = blocks or blocks_for(urls_listed.count() + len(rules))
    all_keys = ruled.select("key").unionByName(urls_listed)

    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    own = own.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    urls = own.where(F.col("host") != "").select("host", "path").distinct()
    probe_keys = [F.array(F.concat(F.lit("u:"), canonical_url(F.col("host"), F.col("path"))))]
    if rules:
        labels = F.split("host", r"\.", -1)
        suffix = F.transform(
            F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, -n, n), ".")
        )
        for n in lengths:
            start = F.substring("path", 1, n)
            keys = F.transform(suffix, lambda s: F.concat(F.lit("r:"), s, start))  # noqa: B023
            probe_keys.append(F.when(F.length("path") >= n, keys))
    probes = urls.select("host", "path", F.explode(F.array_compact(F.flatten(F.array_compact(F.array(*probe_keys))))).alias("key"))

    possible = maybe_listed(probes, bloom_filter(all_keys, blocks), blocks)
    of_rule = F.startswith("key", F.lit("r:"))
    by_rule = possible.where(of_rule).join(F.broadcast(ruled) if len(rules) <= MOST_RULES else ruled, "key").drop("key")
    by_url = possible.where(~of_rule).join(urls_listed, "key", "left_semi").select(
        "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")
    )
    exact = by_rule.unionByName(by_url)
    judged = exact.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "verdict", "rule"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    both = own.join(judged, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    is_listed = F.coalesce("listed", F.lit(False))
    return both.select(
        F.col("page_id"), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.when(is_listed, "block").otherwise("allow")).alias("verdict"), is_listed.alias("listed"),
    )
