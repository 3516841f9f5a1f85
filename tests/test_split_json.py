"""Documents cut into objects by many tasks, against a JSON parser."""

from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.sources import split_json

RNG = np.random.default_rng(3)


def value(depth: int = 0):
    kind = int(RNG.integers(0, 6 if depth < 3 else 4))
    if kind == 4:
        return {f"k{i}": value(depth + 1) for i in range(int(RNG.integers(0, 4)))}
    if kind == 5:
        return [value(depth + 1) for _ in range(int(RNG.integers(0, 4)))]
    return [1.5, None, 'a "quoted" } brace { and \\ back\\', "é日{}\n\t\"}"][kind]


def thing(i: int) -> dict:
    return {"eventID": f"e{i}", "body": value(), "}": "{"}


def whole(rows):
    return [(r["section"], r["pos"], json.loads(r["item"])) for r in sorted(rows, key=lambda r: (r["section"] or "", r["pos"])) if r["item"] is not None]


@pytest.fixture
def small_ranges(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


DOCUMENTS = {
    "bare": [thing(i) for i in range(60)], "none": [], "empty": {}, "one": [thing(1)],
    "records": {"Records": [thing(i) for i in range(40)]},
    "sections": {"account": "12 \"} {", "users": [thing(i) for i in range(7)], "meta": {"a": {"b": 1}}, "n": [1, 2, "{"], "roles": [thing(i) for i in range(5)], "last": "x}{"},
    "map": {f"10.0.0.{i}": {"asn": f"AS{i}", "geo": "DE"} for i in range(30)},
}


def expected(doc):
    if isinstance(doc, list):
        return [(None, i, x) for i, x in enumerate(doc)]
    lists = {k: [v] if isinstance(v, dict) else [x for x in v if isinstance(x, dict)] if isinstance(v, list) else [] for k, v in doc.items()}
    return [(k, i, x) for k in sorted(lists) for i, x in enumerate(lists[k])]


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_equal_the_parser(spark, tmp_path, small_ranges, indent):
    for name, doc in DOCUMENTS.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "blank.json").write_text("")
    fragments = split_json.file_fragments(spark, str(tmp_path))
    assert fragments.filter(F.col("path").endswith("bare.json")).select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    got = split_json.split_objects(fragments).collect()
    for name, doc in DOCUMENTS.items():
        assert whole([r for r in got if r["path"].endswith(f"/{name}.json")]) == expected(doc), name
    outside = "".join(r["outside"] for r in got if r["path"].endswith("/sections.json"))
    assert '"account"' in outside and '"last"' in outside


def test_a_document_cut_short_gives_whole_objects(spark, tmp_path):
    text = json.dumps({"Records": [{"a": 1}, {"a": {"b": 2}}, {"a": 3}]})
    (tmp_path / "cut.json").write_text(text[:text.index('{"b"') + 4])
    rows = [r for r in split_json.split_objects(split_json.file_fragments(spark, str(tmp_path))).collect() if r["item"]]
    assert [json.loads(r["item"]) for r in rows] == [{"a": 1}]


def test_compression_is_told_by_content(spark, tmp_path, monkeypatch):
    doc = {"Records": [thing(i) for i in range(50)]}
    data = json.dumps(doc).encode()
    objects = {"a.json.gz": data, "b": gzip.compress(data), "c.gz": gzip.compress(data[:300]) + gzip.compress(data[300:]), "d.json": data, "e": b"", "f": gzip.compress(b"")}
    for name, content in objects.items():
        (tmp_path / name).write_bytes(content)
    rows = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in objects], "uri string")
    got = split_json.split_objects(split_json.object_fragments(rows)).collect()
    for name in "abcd":
        assert whole([r for r in got if r["path"].split("/")[-1].startswith(name)]) == expected(doc), name
    assert not [r for r in got if r["path"][-1] in "ef" and r["item"]]


def test_inflation_is_bounded():
    import io

    data = b"x" * 50_000_000
    sizes = [len(p) for p in split_json.inflated(io.BytesIO(gzip.compress(data)))]
    assert sum(sizes) == len(data) and max(sizes) <= split_json.PIECE


def test_landed_batches_add_nothing_twice(spark, tmp_path):
    """An object announced in two batches is read in the first; a batch that is replayed or was cut off before its manifest adds nothing."""
    from skyledger.sources import audit

    for key in "abc":
        (tmp_path / "store" / "logs").mkdir(parents=True, exist_ok=True)
        (tmp_path / "store" / "logs" / key).write_bytes(gzip.compress(json.dumps({"Records": [{"eventID": f"{key}{i}", "eventName": "ListRoles"} for i in range(3)]}).encode()))
    note = lambda *keys: json.dumps({"Records": [{"s3": {"bucket": {"name": "logs"}, "object": {"key": k}}} for k in keys]})
    bare = json.dumps({"eventID": "x", "eventName": "GetObject"})
    batches = [(0, [note("a", "b"), note("a")]), (1, [note("b", "c"), bare]), (1, [note("b", "c"), bare]), (0, [note("a", "b"), note("a")])]
    out = str(tmp_path / "out")
    for epoch, bodies in batches:
        audit.land_notified(spark.createDataFrame([(b,) for b in bodies], "body string"), out, epoch, root=f"file://{tmp_path}/store/")
    rows = [(r["raw_ref"], r["record"]["eventID"]) for r in spark.read.parquet(f"{out}/records").collect()]
    assert sorted(e for _, e in rows) == sorted([f"{k}{i}" for k in "abc" for i in range(3)] + ["x"])
    assert ("s3://logs/a#a0", "a0") in rows and ("sqs://raw#x", "x") in rows
