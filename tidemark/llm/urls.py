"""URL filters by a cascade of Bloom filters.

A rule lists a host and the start of a path, to block or allow; it fits the host and all its subdomains. A URL's keys
are every suffix of its host with every rule-long start of its path. Of each list a cascade is made over all keys that
occur in the corpus: the first filter holds the listed keys, the second those of the corpus that pass the first by
mistake, the third the listed ones that pass the second by mistake, and so on until a level has no mistakes. On the
corpus whose keys it was made over, membership is exact, and looking up needs no join, only the filters: a few bits for
each listed key, broadcast. Their size follows the rules, not the corpus, and is held to MOST_BYTES.

A URL that is null or has no :// has an empty host and path and fits no rule. URLs that no rule fits are allowed, as no
key of theirs is listed. Repeated rows are judged one by one; an empty table gives none. Columns of the input that
carry the name of a result column give way to it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import per_text, written

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_BYTES = 64_000_000
#: Bits of a stored block of a filter, that of Spark's bitmap functions.
BLOCK = 32768


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: str, path: str, path_lengths: list[int]) -> list[str]:
    """Keys of a URL, longest first, ties by text. path_lengths: those of the rules' paths."""
    labels = host.split(".")
    hosts = [".".join(labels[i:]) for i in range(len(labels))]
    return sorted({h + path[:n] for h in hosts if h for n in path_lengths if n <= len(path)}, key=lambda k: (-len(k), k))


def places(key: str, bits: int, hashes: int, level: int) -> list[int]:
    """Bits of a key; every level has its own, or two keys that share all bits of one level would share them in the next."""
    x = xxhash.xxh128_intdigest(key.encode("utf-8", "surrogatepass"), level)
    a, b = x >> 64, (x & (2**64 - 1)) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Level:
    """The filter of that number: hashes places of bits for each key."""

    def __init__(self, bits: int, hashes: int, number: int, stored: np.ndarray):
        self.bits, self.hashes, self.number, self.stored = bits, hashes, number, stored

    def __contains__(self, key: str) -> bool:
        s = self.stored
        return all(s[p >> 3] >> (p & 7) & 1 for p in places(key, self.bits, self.hashes, self.number))


def listed(key: str, levels: list[Level]) -> bool:
    """The first level that a key doesn't pass decides: an odd one is for what is listed."""
    for i, level in enumerate(levels):
        if key not in level:
            return i % 2 == 1
    return len(levels) % 2 == 1


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """The filter of n keys with that rate of mistakes, its bits set by an aggregation over blocks."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    if bits > MOST_BYTES * 8:
        raise ValueError(f"the listed keys need a filter of {bits // 8} bytes; at most {MOST_BYTES} are sent to the executors")
    hashes = max(1, round(-math.log2(rate)))

    def at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({p for k in b.column(0).to_pylist() for p in places(k, bits, hashes, number)})
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["place"])

    blocks = keys.mapInArrow(at, "place bigint").groupBy(F.floor(F.col("place") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("place") % BLOCK).alias("bits")).collect()
    stored = np.zeros((bits // BLOCK + 1) * BLOCK // 8, np.uint8)
    for r in blocks:
        part = np.frombuffer(r["bits"], np.uint8)
        stored[r["block"] * BLOCK // 8 :][: len(part)] = part
    return Level(bits, hashes, number, stored)


def cascade(rules: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels for the keys of rules, exact on every key of universe; both have a column key without repeats."""
    n, others = rules.count(), universe.join(rules, "key", "left_anti")
    if not n:
        return []
    rest, levels = rules, []
    # at this rate about as many unlisted keys pass the first level as are listed
    rate = min(0.5, max(1e-9, n / (math.sqrt(2) * max(others.count(), 1))))
    while n:
        level = build_level(rest, n, rate, len(levels))
        levels.append(level)
        rest, others = written(_passing(others, level), "cascade"), rest
        n, rate = rest.count(), 0.5
    return levels


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    held = keys.sparkSession.sparkContext.broadcast(level)  # at most MOST_BYTES

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in b.column(0).to_pylist() if k in held.value], pa.string())], names=["key"])

    return keys.select("key").mapInArrow(keep, "key string")


def _universe(lengths: list[int], texts: list[str | None]) -> list[tuple]:
    """Keys of each host and path (with \\0 between them), each once a slice."""
    seen: set[str] = set()
    for t in set(texts):
        host, _, path = (t or "").partition("\x00")
        seen.update(keys_of(host, path, lengths))
    return [(sorted(seen),)] + [([],)] * (len(texts) - 1)


def _judged(lengths: list[int], held, texts: list[str | None]) -> list[tuple]:
    lists, out, seen = held.value, [], {}
    for t in texts:
        if t not in seen:
            host, _, path = (t or "").partition("\x00")
            seen[t] = next(((k, verdict) for k in keys_of(host, path, lengths) for verdict, levels in lists if listed(k, levels)), (None, "allow"))
        out.append(seen[t])
    return out


def filter_urls(urls: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """urls with host, path, the longest rule that fits (null if none) and the verdict.

    rules: (verdict, host, path) each. Of rules as long as each other that fit one URL the first by its text counts;
    one listed both to block and to allow blocks.
    """
    spark = urls.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    own = ("host", "path", "rule", "verdict")
    rest = [c for c in urls.columns if c.lower() not in own]
    src = urls.select(*[F.col(f"`{c}`") for c in rest], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    src = src.withColumn("_hp", F.concat("host", F.lit("\x00"), "path"))
    universe = written(per_text(src.select("_hp").distinct(), "keys array<string>", partial(_universe, lengths), "_hp", keep=[]).select(F.explode("keys").alias("key")).distinct(), "url-keys")
    lists = []
    for verdict in ("block", "allow"):
        keys = sorted({h + p for v, h, p in rules if v == verdict})
        lists.append((verdict, cascade(spark.createDataFrame([(k,) for k in keys], "key string"), universe)))
    held = spark.sparkContext.broadcast(lists)
    return per_text(src, "rule string, verdict string", partial(_judged, lengths, held), "_hp", keep=[*rest, "host", "path"])


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule,
  coalesce(max_by(verdict, length(rhost || rpath)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)
GROUP BY ALL
"""
