"""Landed events, dealt documents and slices of files: nothing of them grows with the input in one task."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skyledger.functions.sliced import SLICE
from skyledger.plans import registry_sources, workspace
from skyledger.sources import split_json


def test_events_are_dealt_before_they_are_widened(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}", i % 7, "view", 1.5, f'{{"k": {i % 90}}}') for i in range(200)]
    rows += [(None, None, None, None, None, None), rows[3]]
    base = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    base.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    w, plans, cut = workspace.Workspace(spark, str(tmp_path)), [], workspace.cut_lineage
    monkeypatch.setattr(workspace, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    got = w.events
    lines = plans[0].splitlines()
    at = next(i for i, line in enumerate(lines) if "RepartitionByExpression" in line)
    assert "params" not in "".join(lines[at:]) and "params" in "".join(lines[:at])
    want = w.event_view(w.table("events"))
    assert got.count() == 202 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_range_of_a_file_is_many_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split_json, "SLICE_BITS", 4)
    items = [{"n": i, "a": {"b": '}{"' * (i % 3)}, "c": [{}, {}]} for i in range(300)]
    for name, doc in (("a", items), ("b", {"Findings": items[::-1], "x": 1}), ("c", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    fragments = split_json.file_fragments(spark, str(tmp_path))
    most = fragments.groupBy("path", SLICE).count().agg(F.max("count")).first()[0]
    assert most <= 16
    got = sorted((r["path"][-6:], r["pos"], json.loads(r["item"])["n"]) for r in split_json.split_objects(fragments).collect() if r["item"])
    assert got == [("a.json", i, i) for i in range(300)] + [("b.json", i, 299 - i) for i in range(300)]


def test_documents_are_more_not_longer_on_larger_input(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        items = spark.range(20_000).select(F.col("id").alias("seq"), F.lit("Records").alias("section"), F.concat(F.lit('{"n":"'), F.sha2(F.col("id").cast("string"), 512), F.lit('"}')).alias("item"))
        split_json.write_documents(registry_sources._dealt(items, "seq"), f"{tmp_path}/docs", ["seq"])
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = list((tmp_path / "docs").glob("part-*"))
    assert len(files) > 2
    docs = [json.loads(f.read_text())["Records"] for f in files if f.stat().st_size]
    assert sorted(r["n"] for d in docs for r in d) == sorted(r["n"] for r in items.select(F.get_json_object("item", "$.n").alias("n")).collect())
