"""Vector tables for the searches: valid rows, shards of bounded size, blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import small_batches
from skyledger.session import cut_lineage


def valid(rows: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, written once.

    Left out: a null id, a null vector, null or non-finite components and, unless ``zero``, vectors without a component
    other than 0. Rows equal in id and vector are one. Shorter vectors count as filled up with 0. Other columns are ignored.
    """
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.select("vec_id", e.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull()).filter(finite)
    if not zero:
        kept = kept.filter(F.exists(e, lambda x: x != 0))
    return cut_lineage(kept.distinct())


def sharded(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Add ``shard``, by a hash of id and vector, so that copies of one vector are spread."""
    return rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(max(1, -(-n // size)))).cast("int"))


def answered(held: DataFrame, queries: DataFrame, shards: int, size: int, answer: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``answer(held rows of a shard, at most ``size`` queries)`` for all queries and shards, written once.

    A task sorts what its shard holds before the queries and streams the queries past it, so it keeps one shard and one batch
    of queries. The shards are never copied per batch: only where there are fewer of them than cores, each is
    copied until all cores have one.
    """
    spark = held.sparkSession
    blocks = max(1, -(-spark.sparkContext.defaultParallelism // shards))
    block = F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(blocks)).cast("int")
    held = held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("turn", F.lit(0))
    asked = queries.select("vec_id", "embedding", block.alias("block"), F.lit(1).alias("turn")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    rows = held.unionByName(asked, allowMissingColumns=True).repartition(shards * blocks, "shard", "block").sortWithinPartitions("shard", "block", "turn")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, mine = None, []
        for batch in batches:
            for at, part in batch.groupby(["shard", "block"], sort=False):
                if at != key:
                    key, mine = at, []
                before, asked = part[part["turn"] == 0], part[part["turn"] == 1]
                if len(before):
                    mine.append(before)
                if mine:  # a shard may hold nothing
                    mine = [pd.concat(mine)] if len(mine) > 1 and len(asked) else mine
                    for lo in range(0, len(asked), size):
                        yield answer(mine[0], asked.iloc[lo:lo + size])

    with small_batches(spark, size):
        return cut_lineage(rows.mapInPandas(run, schema))


def matrix(values: pd.Series, width: int | None = None) -> np.ndarray:
    """Rows as a float64 matrix, filled up with 0 to the longest row or ``width``."""
    lengths = np.fromiter((len(v) for v in values), np.int64, len(values))
    width = max([width or 0, *lengths])
    out = np.zeros((len(values), width))
    if len(values):
        out[np.arange(width) < lengths[:, None]] = np.concatenate(values.to_list())
    return out


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all shards per query: query_id, rank, vec_id, score."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
