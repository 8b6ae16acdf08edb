"""Listed hosts and paths: a blocked Bloom filter first, an exact hash join after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh

WORDS = 8  # 32-bit words of a block, one bit set in each


def url_host(url: Column) -> Column:
    """From after the first ``://`` up to ``/ ? #`` or the end, A-Z in lower case; empty without ``://``."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From after the host up to ``? #`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bit(key: Column, word: int) -> Column:
    """Bit 0-31 of a word for a key."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(7)), 5 * word), F.lit(32)).cast("int")


def blocked_bloom(listed: DataFrame, key: str = "url", blocks: int = 1 << 14) -> DataFrame:
    """Filter of at most ``blocks`` rows ``block, w0..w7``: a key sets one bit in each 32-bit word of one 32-byte block.

    Its size is bounded by ``blocks``, not by the list: a longer list fills it and lets more false positives through to the
    exact join. Only blocks in use are kept.
    """
    k = F.col(key)
    words = [F.bit_or(F.expr("shiftleft(1L, b%d)" % i)).alias(f"w{i}") for i in range(WORDS)]
    return (
        listed.filter(k.isNotNull()).select(_block_of(k, blocks).alias("block"), *[_bit(k, i).alias(f"b{i}") for i in range(WORDS)])
        .groupBy("block").agg(*words)
    )


def might_be_listed(candidates: DataFrame, bloom: DataFrame, key: str = "url", blocks: int = 1 << 14) -> DataFrame:
    """Candidates whose bits are all set; the filter has at most ``blocks`` rows, which makes it safe to broadcast."""
    tested = candidates.withColumn("_block", _block_of(F.col(key), blocks))
    all_set = F.lit(True)
    for i in range(WORDS):
        all_set = all_set & (F.col(f"w{i}").bitwiseAND(F.expr("shiftleft(1L, _b%d)" % i)) != 0)
    tested = tested.withColumns({f"_b{i}": _bit(F.col(key), i) for i in range(WORDS)})
    return tested.join(F.broadcast(bloom.withColumnRenamed("block", "_block")), "_block").filter(all_set).select(*candidates.columns)


def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", blocks: int = 1 << 14) -> DataFrame:
    """Verdict on every row of ``pages``: its columns plus ``host, path, rule, verdict``.

    The studied project has no URLs among its records; this operator is general. ``listed`` holds ``host, path, verdict``. An
    entry fits its host and all subdomains where the URL's path starts with the entry's path; the longest entry wins (host and
    path together, then the longer host, then the smaller verdict). Where no entry fits, ``rule`` is null and the verdict is ``default``.

    A URL has one canonical candidate per host suffix and listed path length. Candidates of distinct (host, path) pairs are tested
    against the Bloom filter and only possible hits are joined exactly, which removes false positives. Null URLs and URLs without
    ``://`` have empty host and path; repeated rows are judged alike; listed rows with nulls are ignored. Columns of ``pages`` with
    the names of results are replaced. Lengths of listed paths are read by the driver, at most one number per length in use.
    """
    entries = listed.select("host", "path", "verdict").dropna().dropDuplicates().withColumn("_key", F.concat_ws("\n", "host", "path"))
    lengths = [r[0] for r in entries.select(F.length("path")).distinct().collect()]
    split = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).drop("rule", "verdict")
    if not lengths:
        return split.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path"))
    sites = split.select("host", "path").distinct()
    candidates = (
        sites.withColumn("_host", F.explode(suffixes)).withColumn("_n", F.explode(prefixes))
        .withColumn("_key", F.concat_ws("\n", "_host", F.expr("substring(path, 1, _n)"))).select("host", "path", "_key")
    )
    hits = might_be_listed(candidates, blocked_bloom(entries, "_key", blocks), "_key", blocks)
    fits = entries.select("_key", F.struct(
        (F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h"), F.col("verdict"),
        F.concat("host", "path").alias("rule"),
    ).alias("_fit"))
    fit = fresh("_fit", pages)
    best = (
        hits.join(fits, "_key").groupBy("host", "path")
        .agg(F.max_by("_fit", F.struct(F.col("_fit.n"), F.col("_fit.h"), F.col("_fit.rule"))).alias(fit))
    )
    columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return split.join(best, ["host", "path"], "left").select(
        *columns, "host", "path", F.col(f"{fit}.rule").alias("rule"), F.coalesce(f"{fit}.verdict", F.lit(default)).alias("verdict"),
    )
