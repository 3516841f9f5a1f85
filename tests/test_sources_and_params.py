"""Parameter text of rules, unreadable times, address tables and the numbered merges of a store."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skyledger.operators import normalise, rules
from skyledger.session import cut_lineage
from skyledger.sources import snapshots, store


def test_params_keep_order_numbers_and_escapes(spark):
    texts = ['{"z":1,"a":"café","m":1.0}', '{ "k" : "a, b: \\"c\\"" , "l" : [1, {"x":null}] }', '{"e":"\U0001f600"}', "{}", "[1]", "no json", None,
             '{"long":"' + "x" * 20_000 + '"}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, p string")
    got = {r["i"]: r["t"] for r in rows.select("i", rules.canonical_params(F.col("p"), F.lit("s3"), F.lit(5).cast("long")).alias("t")).collect()}
    for i, t in enumerate(texts):
        known = json.loads(t) if t and t.startswith("{") else {}
        assert got[i] == json.dumps({**known, "__event_source": "s3", "bytesTransferred": 5}), i


def test_unreadable_time_stays_as_null(spark):
    rows = spark.createDataFrame([("2026-01-02T03:04:05Z",), ("yesterday",), (None,)], "t string").select("t", *normalise._time(F.col("t")))
    assert [r["t"] for r in normalise.without_time(rows).collect()] == ["yesterday", None] and rows.filter("us is not null").count() == 1


def test_address_table_has_one_row_per_address(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"1.1.1.1": {"asn": "AS1", "geo": "DE"}, "2.2.2.2": {"asn": "AS2", "geo": "FR"}}))
    (tmp_path / "b.json").write_text(json.dumps({"1.1.1.1": {"asn": "AS9", "geo": "US"}}))
    rows = {tuple(r) for r in snapshots.read_geo_table(spark, str(tmp_path)).collect()}
    assert rows == {("1.1.1.1", "AS9", "US"), ("2.2.2.2", "AS2", "FR")}


def rows_of(spark, root):
    return {r["id"]: r["version"] for r in store.read_store(spark, root, "id", "version").collect()}


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, version long")


def test_a_changed_key_rewrites_one_bucket_and_an_epoch_counts_once(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_store(spark, root, "id", "version") is None
    store.upsert(frame(spark, *[(f"k{i}", 1) for i in range(200)]), root, "id", "version", "0", buckets=16)
    before = {r["folder"] for r in store.valid_folders(store.log_of(spark, root)).collect()}
    name = store.upsert(frame(spark, ("k7", 2)), root, "id", "version", "1")
    after = {r["folder"] for r in store.valid_folders(store.log_of(spark, root)).collect()}
    assert len(before) == 16 and len(before - after) == len(after - before) == 1
    assert store.upsert(frame(spark, ("k7", 9)), root, "id", "version", "1") == name
    assert rows_of(spark, root) == {**{f"k{i}": 1 for i in range(200)}, "k7": 2}


def test_writers_side_by_side_lose_nothing(spark, tmp_path, monkeypatch):
    """Both writers read the same log before either writes; later merges and readers see both."""
    root = str(tmp_path / "store")
    store.upsert(frame(spark, ("a", 1), ("b", 1)), root, "id", "version", buckets=1)
    early = cut_lineage(store.log_of(spark, root))
    monkeypatch.setattr(store, "log_of", lambda s, r: early)
    store.upsert(frame(spark, ("a", 2), ("c", 1)), root, "id", "version")
    store.upsert(frame(spark, ("a", 3), ("b", 0), ("d", 1)), root, "id", "version")
    monkeypatch.undo()
    assert store.valid_folders(store.log_of(spark, root)).count() == 2
    assert rows_of(spark, root) == {"a": 3, "b": 1, "c": 1, "d": 1}
    store.upsert(frame(spark, ("e", 1)), root, "id", "version")
    assert store.valid_folders(store.log_of(spark, root)).count() == 1 and rows_of(spark, root) == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}


def test_new_columns_and_empty_changes(spark, tmp_path):
    root = str(tmp_path / "store")
    store.upsert(frame(spark), root, "id", "version", "0")
    assert store.read_store(spark, root, "id", "version") is None
    store.upsert(frame(spark, ("a", 1)), root, "id", "version", "1")
    store.upsert(spark.createDataFrame([("b", 1, "x")], "id string, version long, note string"), root, "id", "version", "2")
    assert {(r["id"], r["note"]) for r in store.read_store(spark, root, "id", "version").collect()} == {("a", None), ("b", "x")}
