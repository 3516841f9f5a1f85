"""Sharding by a hierarchical weighted hash tree (region, rack, shard).

A leaf draws -ln(u) / weight, with u a hash of the document id and the leaf. A node's draw is the least of its subtree,
which is again a weighted draw with the node's total weight. The descent takes the region with the least draw, then the
rack inside it, then the shard. A changed weight only changes the draws of one path, so rows move only into
(or, with less weight, out of) that subtree; with one more shard, all rows that move go to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import chunk_count, numbered
from skyledger.session import cut_lineage

RACK, REGION = 4, 4  # shards of a rack, racks of a region


def _spans(n: int, width: int) -> list[tuple[int, int]]:
    return [(i, min(width, n - i)) for i in range(0, n, width)]


def _least(draws: Column, start: Column, length: Column) -> Column:
    """Place of the least draw among ``length`` draws from ``start`` on (from 0)."""
    part = F.slice(draws, start + 1, length)
    return start + F.array_position(part, F.array_min(part)).cast("int") - 1


def _level(draws: Column, spans: list[tuple[int, int]]) -> Column:
    return F.array(*[F.array_min(F.slice(draws, lo + 1, n)) for lo, n in spans])


def placed(docs: DataFrame, key: Column, weights: list[float], seed: int = 11, names: tuple[str, str, str] = ("region", "rack", "shard")) -> DataFrame:
    """Add region, rack and shard of every row. The result depends on the key and the weights only; a null key is a key."""
    uniform = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    leaves = F.array(*[-F.log(uniform(i)) / F.lit(float(w)) for i, w in enumerate(weights)])
    racks = _spans(len(weights), RACK)
    regions = _spans(len(racks), REGION)
    pick = lambda spans, at, k: F.element_at(F.array(*[F.lit(s[k]) for s in spans]), at + 1)
    region, rack, shard = names
    return (docs.withColumn("_leaf", leaves).withColumn("_rack", _level(F.col("_leaf"), racks)).withColumn("_region", _level(F.col("_rack"), regions))
            .withColumn(region, _least(F.col("_region"), F.lit(0), F.lit(len(regions))))
            .withColumn(rack, _least(F.col("_rack"), pick(regions, F.col(region), 0), pick(regions, F.col(region), 1)))
            .withColumn(shard, _least(F.col("_leaf"), pick(racks, F.col(rack), 0), pick(racks, F.col(rack), 1)))
            .drop("_leaf", "_rack", "_region"))


def sharded(docs: DataFrame, shards: int = 40, weights: list[float] | None = None, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack.

    Size is the UTF-8 length plus 16; a null text counts as empty. Slots number the rows of a shard from 0. Rows that
    repeat a doc_id share its shard and get a slot each; a null doc_id is a key of its own. Other columns are ignored.
    """
    weights = weights or [1.0] * shards
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", (F.length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    rows = placed(rows, F.col("doc_id"), weights, seed)
    grown = placed(rows, F.col("doc_id"), [*weights, 1.0], seed, ("_r", "_k", "grown_shard")).drop("_r", "_k")
    grown = cut_lineage(grown)
    out = numbered(grown, ["shard"], F.xxhash64("doc_id", "text_crc32"), chunk_count(grown.count() // len(weights)), ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")
