"""Helpers shared by the operators: tables, words and shingles, gapless numbers, components."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import cut_lineage

#: Words of a text: runs without ASCII white space (what ``bytes.split`` gives on UTF-8).
WORD = r"[^\x20\x09-\x0D]+"
_CACHE_WORDS = 400_000
_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Words of a text as long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


class _WordHashes(dict):
    """64-bit hash per word; emptied when it holds too many words, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _WordHashes()


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside; for rows that carry whole sequences."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_words() -> None:
    """Empty the cache of this process. Workers are used again by later stages, which need the memory for their own."""
    _WORDS.clear()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes (uint64) of the words of ``text`` with A-Z lower-cased, in order; empty for null."""
    if not text:
        return np.empty(0, _U)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_WORDS.__getitem__, words), _U, len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> _U(27))) * _U(0xBF58476D1CE4E5B9)
    return h ^ (h >> _U(32))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of ``k`` words, in order; a shorter text is one run; no words give none."""
    n = len(words)
    if n == 0:
        return np.empty(0, _U)
    width = min(n, k)
    out = np.full(n - width + 1, width, _U)
    for j in range(width):
        out = (out ^ words[j:n - width + 1 + j]) * _U(0xD6E8FEB86659FD93)
        out ^= out >> _U(29)
    return _mix(out)


def numbered(df: DataFrame, keys: list[str], salt: Column, chunks: int, order: list, name: str) -> DataFrame:
    """Add ``name``: gapless numbers from 0 per ``keys``, by chunk of ``salt`` and then ``order``.

    A key is cut into ``chunks`` pieces by the hash ``salt``; rows are numbered inside (key, chunk) and shifted by the
    counts of the chunks before, so a key with a third of all rows is spread over its chunks.
    """
    src = df.withColumn("_chunk", F.pmod(salt, F.lit(chunks)))
    part = [*keys, "_chunk"]
    inside = Window.partitionBy(*part).orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (src.groupBy(*part).agg(F.count("*").alias("_n"))
             .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(part)]
    rows = src.withColumn(name, (F.row_number().over(inside) - 1).cast("bigint"))
    return (rows.join(shift, on).withColumn(name, F.col(name) + F.col("_shift"))
            .drop("_chunk", "_shift", *[f"_k{i}" for i in range(len(part))]))


def chunk_count(rows: int, per_chunk: int = 1_000) -> int:
    """Chunks for :func:`numbered`, so that a chunk of one hot key stays near ``per_chunk`` rows."""
    return max(1, -(-rows // per_chunk))


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): every id of ``links`` (a, b: long) with the smallest id it reaches.

    Alternating large and small stars on the distributed link table, until it no longer changes. A star centre with many
    leaves only meets partial minima (aggregate and join back), never one group in one task.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _checksum(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b")))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        edges = cut_lineage(small)
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def tokenizer_file(name: str) -> str:
    """Path of a vocabulary file among the public tokenizers installed on every machine."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))
