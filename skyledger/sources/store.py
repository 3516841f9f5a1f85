"""Keyed tables in files: hash buckets, a log of what replaced what, and merges that writers may run side by side.

A merge rewrites only the buckets its keys fall into. Its data are written first, then one log file tells for every bucket the new
folder and the folders that went into it. The valid folders of a bucket are those that no entry has used up. Writers do not lock
each other: where two merged into the same bucket from the same state, both results stay valid side by side until the next merge of that bucket
takes both in. Merging keeps the newest version of a key, in any order and however often, so nothing is lost and readers agree.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a new store; a bucket is rewritten by one task.
BUCKETS = 64
LOG = "merge STRING, epoch STRING, buckets INT, bucket INT, folder STRING, used ARRAY<STRING>"


def read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON files below ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def log_of(spark: SparkSession, root: str) -> DataFrame | None:
    return read_or_none(spark, f"{root.rstrip('/')}/log", LOG)


def valid_folders(log: DataFrame) -> DataFrame:
    """(bucket, folder): what makes up the store now."""
    used = log.select(F.explode("used").alias("folder")).distinct()
    return log.filter("folder IS NOT NULL").select("bucket", "folder").join(used, "folder", "left_anti")


def _newest(rows: DataFrame, key: str, version: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    # ties of the version go to the row that sorts last, so that all readers choose the same
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.xxhash64(*rest))).alias("r")).select(key, "r.*")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _load(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*folders)


def upsert(changes: DataFrame, root: str, key: str, version: str, epoch: str | None = None, buckets: int = BUCKETS) -> str:
    """Merge ``changes`` into the store below ``root``; the newest ``version`` per key wins. Returns the name of the merge.

    An ``epoch`` (name of a batch of a stream) that is already merged is not merged again. ``buckets`` counts for a new store only. Columns that
    are new are added. Only names of folders of touched buckets pass through the driver.
    """
    spark, root, name = changes.sparkSession, root.rstrip("/"), f"m{uuid.uuid4().hex}"
    log = log_of(spark, root)
    if log is not None:
        again = log.filter(F.col("epoch") == epoch).first() if epoch is not None else None
        if again:
            return again["merge"]
        first = log.select("buckets").first()
        buckets = first["buckets"] if first else buckets
    rows = changes.withColumn("_bucket", _bucket(key, buckets))
    touched = [r["_bucket"] for r in rows.select("_bucket").distinct().collect()]
    held = {} if log is None else {b: [] for b in touched}
    if log is not None:
        for r in valid_folders(log).filter(F.col("bucket").isin(touched)).collect():
            held[r["bucket"]].append(r["folder"])
    old = [f for folders in held.values() for f in folders]
    if old:
        base = _load(spark, old)
        rows = base.withColumn("_bucket", _bucket(key, buckets)).unionByName(rows, allowMissingColumns=True)
    if touched:
        _newest(rows, key, version).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{root}/data/{name}")
    entries = [(name, epoch, buckets, b, f"{root}/data/{name}/_bucket={b}", held.get(b, [])) for b in touched] or [(name, epoch, buckets, None, None, [])]
    # one file: a merge counts as a whole or not at all
    spark.createDataFrame(entries, LOG).coalesce(1).write.mode("append").json(f"{root}/log")
    return name


def read_store(spark: SparkSession, root: str, key: str, version: str) -> DataFrame | None:
    """The newest row per key, or None before the first merge. Buckets with one valid folder are read as they are."""
    log = log_of(spark, root)
    if log is None:
        return None
    per = valid_folders(log).groupBy("bucket").agg(F.collect_list("folder").alias("folders")).collect()  # buckets and folders, not rows
    alone = [r["folders"][0] for r in per if len(r["folders"]) == 1]
    beside = [f for r in per if len(r["folders"]) > 1 for f in r["folders"]]
    parts = ([_load(spark, alone)] if alone else []) + ([_newest(_load(spark, beside), key, version)] if beside else [])
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
