"""Exports and stores: case JSON and CSV, append-only audit log, graph tables, evaluation reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions.columns import utc_clock
from skyledger.functions.sliced import first_by
from skyledger.sources.store import read_or_none


def iso_time(us: str) -> Column:
    """ISO-8601 UTC text of epoch microseconds."""
    return F.concat(F.date_format(utc_clock(us), "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(F.col(us) % 1_000_000 != 0, F.date_format(utc_clock(us), ".SSSSSS")).otherwise(""), F.lit("+00:00"))


# ---------------------------------------------------------------- case exports

def export_case_json(items: DataFrame, path: str) -> None:
    """Context items as JSON lines, one folder per case, in (section, ord) order inside each file.

    Items are spread over (case, section, block of items): a case with a third of all items is many files.
    """
    rows = items.withColumn("block", F.floor(F.col("ord") / 100_000))
    (rows.repartition("case_id", "section", "block").sortWithinPartitions("case_id", "section", "ord")
     .select("case_id", F.to_json(F.struct("ord", "ref", "section", F.col("item").alias("value"))).alias("value"))
     .write.mode("overwrite").partitionBy("case_id").text(path))


CSV_COLUMNS = ["case_id", "event_ts", "principal", "action", "target", "detections", "attack_ids", "blast_score"]


def case_csv_rows(ranked: DataFrame, step_event: DataFrame, case_detection: DataFrame) -> DataFrame:
    """One line per timeline event: detections of the event and techniques of the case joined by ``;``."""
    keys = (case_detection.filter("event_id IS NOT NULL").groupBy("case_id", "event_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "seq", "sub", "key"))), lambda s: s["key"]), ";").alias("detections")))
    info = ranked.select("case_id", F.array_join(F.sort_array("techniques"), ";").alias("attack_ids"), F.col("blast").alias("blast_score"))
    return (step_event.join(keys, ["case_id", "event_id"], "left").join(info, "case_id")
            .select("case_id", iso_time("us").alias("event_ts"), "principal", F.col("event").alias("action"), F.coalesce("target", F.lit("")).alias("target"),
                    F.coalesce("detections", F.lit("")).alias("detections"), "attack_ids", "blast_score", "us", "seq"))


def export_case_csv(rows: DataFrame, path: str) -> None:
    (rows.repartitionByRange("case_id", "us", "seq").sortWithinPartitions("case_id", "us", "seq").select(*CSV_COLUMNS)
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))


# ---------------------------------------------------------------- audit log

AUDIT = ("record_id STRING, ts STRING, case_id STRING, action_key STRING, decision STRING, status STRING, approver STRING, channel STRING, "
         "approval_decision STRING, reason STRING, parent_id STRING, target STRING, before STRING, after STRING, undo_ref STRING")


def append_audit(records: DataFrame, path: str) -> None:
    """Append audit records as JSON lines; existing files are never rewritten."""
    records.write.mode("append").json(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT).json(path)


def insert_audit_if_absent(records: DataFrame, path: str) -> None:
    """Append only the records whose id is not stored yet."""
    spark = records.sparkSession
    fresh = first_by(records, ["record_id"], [c for c in ("ts", "status") if c in records.columns])
    stored = read_or_none(spark, path, AUDIT)
    if stored is not None:
        fresh = fresh.join(stored.select("record_id"), "record_id", "left_anti")
    append_audit(fresh, path)


# ---------------------------------------------------------------- graph and reports

def write_graph(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    """Node and edge tables partitioned by kind, one row per id and per (kind, src, dst)."""
    first_by(nodes, ["id"], ["ord"]).drop("ord").write.mode("overwrite").partitionBy("kind").parquet(f"{root}/nodes")
    first_by(edges, ["kind", "src", "dst"], ["ord"]).drop("ord").write.mode("overwrite").partitionBy("kind").parquet(f"{root}/edges")


def write_reports(results: DataFrame, summary: DataFrame, coverage: DataFrame, root: str) -> None:
    """Evaluation report as JSON, CSV and technique coverage."""
    results.write.mode("overwrite").json(f"{root}/evaluation_json")
    flat = [f.name for f in results.schema.fields if f.dataType.simpleString() in ("string", "boolean", "double", "bigint", "int")]
    results.select(*flat).write.mode("overwrite").option("header", True).csv(f"{root}/evaluation_csv")
    summary.write.mode("overwrite").json(f"{root}/summary_json")
    coverage.write.mode("overwrite").json(f"{root}/attack_coverage_json")
