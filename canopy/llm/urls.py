"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to ``?``, ``#``
or the end. A rule (action, host, path) fits its host and all subdomains where the path starts with the rule's; the
longest rule wins (by host, then by path). Urls that no rule fits are judged by the list: its canonical URLs (host
without user, port and a leading ``www.`` or ``m.``; path without trailing slashes)
set bits of a blocked Bloom filter, eight in one 512-bit block each, built in parts and merged. The filter passes
possible hits, and an exact join on the canonical URL removes the false ones.

The filter has ``BITS_PER_URL`` bits for each listed URL but never more than ``MOST_BYTES``: that is the bound of what
is broadcast. A longer list fills it more densely, and more rows then reach the exact join; the result is the same.

Null urls and urls without ``://`` have empty host and path, fit no rule, are on no list and are allowed. Repeated
rows are judged each. An empty list or table is no special case. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.shared import ascii_lower, materialize, pick

BITS_PER_URL, MOST_BYTES = 12, 4 << 20
BLOCK, PROBES, PIECE = 64, 8, 64 << 10  # bytes of a block, bits set in it, bytes of a piece that travels alone

#: The rules that op6_urls applies.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Null for an empty host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":[0-9]*\z", "")
    bare = F.regexp_replace(bare, r"^(?:www|m)\.(?=[^.]+\.)", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"/+\z", "")))


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name (host and path) and action of the longest rule that fits; null if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def _places(h1: np.ndarray, h2: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """For each URL its block and the bits in it (a row of PROBES)."""
    h2 = h2.astype(np.uint64)
    return (h1.astype(np.uint64) % np.uint64(blocks)).astype(np.int64), np.stack([(h2 >> np.uint64(7 * i)) & np.uint64(511) for i in range(PROBES)], 1).astype(np.int64)


def bloom(listed: DataFrame, count: int) -> np.ndarray:
    """The filter over ``listed(h1, h2)``, ``count`` rows at about."""
    size = min(MOST_BYTES, max(PIECE, 1 << (max(1, count * BITS_PER_URL // 8) - 1).bit_length()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            block, bit = _places(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), size // BLOCK)
            at = (block[:, None] * BLOCK * 8 + bit).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        pieces = [(i // PIECE, bits[i : i + PIECE].tobytes()) for i in range(0, size, PIECE) if bits[i : i + PIECE].any()]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.binary())], ["piece", "bits"])

    def merge(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in groups:
            for piece, bits in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = np.frombuffer(bits.as_buffer(), np.uint8)
                held[piece] = held[piece] | got if piece in held else got.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["piece", "bits"])

    schema = "piece int, bits binary"
    merged = listed.mapInArrow(part, schema).repartition("piece").mapInArrow(merge, schema)
    out = np.zeros(size, np.uint8)
    for row in merged.collect():  # no more than MOST_BYTES
        out[row["piece"] * PIECE : (row["piece"] + 1) * PIECE] = np.frombuffer(row["bits"], np.uint8)
    return out


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", list_url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and whether the canonical URL is listed, for each row of ``pages``."""
    spark = pages.sparkSession
    key = canonical(host(F.col("u")), path(F.col("u")))
    known = pick(listed, u=list_url_col).select(key.alias("listed_url")).where("listed_url is not null").distinct()
    known = materialize(known, "listed")
    hashes = known.select(F.xxhash64("listed_url").alias("h1"), F.xxhash64(F.lit(1), "listed_url").alias("h2"))
    filled = spark.sparkContext.broadcast(bloom(hashes, known.count()))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filled.value
        for b in batches:
            block, bit = _places(b.column("h1").to_numpy(zero_copy_only=False), b.column("h2").to_numpy(zero_copy_only=False), len(bits) // BLOCK)
            at = block[:, None] * BLOCK * 8 + bit
            hit = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(hit)], ["page_id", "host", "path", "rule", "action", "maybe"])

    base = pick(pages, id=id_col, u=url_col).select(F.col("id").alias("page_id"), host(F.col("u")).alias("host"), path(F.col("u")).alias("path"))
    rule, action = best_rule(F.col("host"), F.col("path"), rules)
    key = canonical(F.col("host"), F.col("path"))
    rows = base.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
    probed = rows.mapInArrow(probe, f"page_id {dict(base.dtypes)['page_id']}, host string, path string, rule string, action string, maybe boolean")
    # rows that can't be listed get keys of their own, which join with nothing: one null key would gather them in one task
    alone = F.concat(F.lit("\x00"), F.xxhash64("page_id", "host", "path").cast("string"))
    asked = F.when(F.col("maybe") & F.col("action").isNull(), canonical(F.col("host"), F.col("path"))).otherwise(alone)
    joined = probed.withColumn("asked", asked).join(known, F.col("asked") == F.col("listed_url"), "left")
    hit = F.col("listed_url").isNotNull()
    return joined.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce(F.col("action"), F.when(hit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        hit.alias("listed"),
    )


def op6_urls(spark, sf_dir: str) -> DataFrame:
    """The list: the urls of the query set, pages whose id is divisible by 20; every page is judged."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, pages.where("page_id % 20 = 0"), RULES)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(url, '^(?:.|\n)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '^(?:.|\n)*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(action, h, q) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT p.page_id, p.host, p.path, r.action, r.h || r.q AS rule,
    row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.h) DESC NULLS LAST, length(r.q) DESC) AS k
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q)
), c AS (
  SELECT page_id, host, path, action, rule,
    CASE WHEN host <> '' THEN
      CASE WHEN regexp_matches(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '^(www|m)\.[^.]+\.')
        THEN regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', ''), '^(www|m)\.', '')
        ELSE regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':[0-9]*$', '') END
      || regexp_replace(path, '/+$', '') END AS canon
  FROM fit WHERE k = 1
), l AS (SELECT DISTINCT canon FROM c WHERE page_id % 20 = 0 AND canon IS NOT NULL)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN l.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  (action IS NULL AND l.canon IS NOT NULL) AS listed
FROM c LEFT JOIN l ON c.canon = l.canon
"""
