"""Permission tables of the registered queries: made when asked for, the order lines joined once, snapshots written by as many tasks as they need."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skyledger.plans import registry_sources, shared_views, workspace

LAST = {"attachment": ("o_custkey", "l_partkey"), "trust_statement": ("o_custkey", "l_suppkey")}


@pytest.fixture()
def w(spark, tmp_path):
    """Accounts and lines with keys that repeat or are null, and a line without an order."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    put("customer", [(i, i % 5, float(i % 3 - 1), ["BUILDING", "MACHINERY"][i % 2]) for i in range(40)], "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    put("supplier", [(i, i % 9, float(i % 3 - 1)) for i in range(12)], "s_suppkey long, s_nationkey int, s_acctbal double")
    put("part", [(i, f"Brand#{i % 5}", ["PROMO", "ECONOMY"][i % 2], i % 50) for i in range(60)], "p_partkey long, p_brand string, p_type string, p_size int")
    orders = [(i, i % 40, f"200{i % 3}-05-01") for i in range(100)] + [(7, 3, "2000-01-01"), (None, 5, "2000-01-01"), (500, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d string").withColumn("o_orderdate", F.col("d").cast("date")).drop("d").write.parquet(f"{tmp_path}/orders.parquet")
    put("lineitem", [(i % 110, i % 60, i % 12, float(1 + i % 7)) for i in range(700)] + [(None, 1, 1, 90.0), (500, 2, 2, 3.0), (7, None, None, 2.0)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")
    return workspace.Workspace(spark, str(tmp_path))


def test_order_lines_are_joined_once(w, monkeypatch):
    joins, cut = [], workspace.cut_lineage
    monkeypatch.setattr(workspace, "cut_lineage", lambda df, **o: joins.append(any("/lineitem.parquet/" in f for f in df.inputFiles())) or cut(df, **o))
    for name in ("attachment", "trust_statement", "statement"):
        w.permissions[name]
    assert sum(joins) == 1
    for t in ("orders", "lineitem", "part", "supplier"):
        w.table(t).createOrReplaceTempView(t)
    for tables, end in ((w.permissions, ""), (w.permissions_before, "_before")):
        for name in LAST:
            want, got = w.spark.sql(shared_views.view_sql(f"{name}{end}", shared_views.SPARK)), tables[name]
            assert got.count() > 0 and got.schema.names == want.schema.names
            assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_permission_tables_are_made_when_asked_for(w):
    w.index
    assert "trust_statement" not in w.permissions and "ordered_lines" in w._made
    assert w.permissions_before["principal"] is w.permissions["principal"]
    with pytest.raises(KeyError):
        w.permissions["nothing"]


def test_snapshot_documents_are_more_not_longer_on_larger_input(w, tmp_path, monkeypatch):
    monkeypatch.setattr(registry_sources, "DOCUMENT_ROWS", 10)
    registry_sources.authorization_documents(w, f"{tmp_path}/docs")
    docs = [json.loads(f.read_text()) for f in (tmp_path / "docs").glob("part-*") if f.stat().st_size]
    assert len(docs) > 4
    found = sorted(x["arn"] for d in docs for x in d.get("users", []) + d.get("roles", []) + d.get("groups", []))
    assert found == sorted(r["arn"] for r in w.permissions["principal"].collect()) and sum(len(d.get("resources", [])) for d in docs) == 60
