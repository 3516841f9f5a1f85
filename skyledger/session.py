"""Session construction and lineage cuts that survive executor loss."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "skyledger", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset, a folder below the warehouse, which the driver and all executors reach as well.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"


def cut_lineage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the files.

    The plan restarts at a parquet scan with exact sizes, so a lost executor costs one re-read and the
    next join is planned from real statistics. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/skyledger-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
