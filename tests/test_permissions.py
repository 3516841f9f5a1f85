"""Hand-derived answer keys for decisions, questions, escalation paths, blast radius."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skyledger.operators import escalation, graph, ranking
from skyledger.session import cut_lineage
from skyledger.sources import sinks, snapshots
from tests import fixtures as fx

SECRET, REPORT, INTAKE = fx.S3 + "secrets/a.csv", fx.S3 + "reports/b.pdf", fx.S3 + "intake/c.txt"
TRAIL = f"arn:aws:cloudtrail:eu-west-1:{fx.ACC}:trail/ward"
U = lambda n: fx.arn("user", n)


def loaded(spark, folder, snapshot, **style):
    (folder / "snapshot.json").write_text(json.dumps(snapshot, **style))
    tables = snapshots.read_authorization(spark, str(folder))
    return tables, escalation.prepare_graph(tables)


@pytest.fixture(scope="module")
def clinic(spark, tmp_path_factory):
    return loaded(spark, tmp_path_factory.mktemp("auth"), fx.clinic(), indent=1)


@pytest.fixture(scope="module")
def ladders(spark, tmp_path_factory):
    return loaded(spark, tmp_path_factory.mktemp("auth"), fx.ladders())


def test_decisions(spark, clinic):
    tables, g = clinic
    want = {
        (U("nora"), "s3:GetObject", REPORT): ("ALLOW", False, False), (U("nora"), "s3:GetObject", SECRET): ("IMPLICIT_DENY", False, False),
        (U("nora"), "s3:PutObject", INTAKE): ("ALLOW", False, False), (U("otto"), "s3:PutObject", INTAKE): ("EXPLICIT_DENY", False, False),
        (U("petra"), "logs:GetLogEvents", "*"): ("ALLOW", False, True), (U("petra"), "s3:GetObject", REPORT): ("IMPLICIT_DENY", False, True),
        (U("quinn"), "s3:DeleteObject", SECRET): ("ALLOW", False, False), (U("quinn"), "kms:Decrypt", "*"): ("EXPLICIT_DENY", False, False),
        (U("rosa"), "s3:GetObject", INTAKE): ("ALLOW", False, False), (U("rosa"), "s3:DeleteObject", INTAKE): ("IMPLICIT_DENY", False, False),
        (U("rosa"), "s3:GetObject", REPORT): ("IMPLICIT_DENY", False, False), (U("sven"), "s3:GetObject", INTAKE): ("ALLOW", True, False),
        (U("sven"), "s3:GetObject", SECRET): ("IMPLICIT_DENY", False, False), (fx.ARCHIVER, "s3:DeleteObject", SECRET): ("ALLOW", False, False),
        (fx.BATCH, "s3:DeleteObject", SECRET): ("IMPLICIT_DENY", False, False), (U("stranger"), "s3:GetObject", INTAKE): ("IMPLICIT_DENY", False, False),
    }
    probes = spark.createDataFrame(list(want), "principal STRING, action STRING, resource STRING")
    got = {(r["principal"], r["action"], r["resource"]): r for r in graph.decide(probes, tables, g["index"]).collect()}
    assert {k: (r["effect"], r["conditional"], r["boundary_limited"]) for k, r in got.items()} == want
    assert "group:nurses" in got[(U("nora"), "s3:PutObject", INTAKE)]["matched"]
    notes = {(r["principal"], r["note"]) for r in graph.decision_notes(probes, tables, g["index"]).collect()}
    assert any(p == U("sven") and "aws:SourceIp" in n for p, n in notes)
    assert (U("stranger"), "principal absent from snapshot; result is a guess") in notes


def test_questions(clinic):
    tables, g = clinic
    who = lambda a, r, e="ALLOW": {x["principal"] for x in graph.who_can(a, r, tables, g["index"]).filter(F.col("effect") == e).collect()}
    assert who("s3:DeleteObject", SECRET) == {U("quinn"), fx.ARCHIVER}
    assert who("s3:GetObject", REPORT) == {U("nora"), U("quinn"), U("sven"), fx.ARCHIVER}
    assert who("cloudtrail:StopLogging", TRAIL) == {U("quinn"), fx.ARCHIVER} and who("s3:PutObject", INTAKE, "EXPLICIT_DENY") == {U("otto"), fx.arn("group", "trainees")}
    via = {(r["assumer"], r["role"]) for r in graph.who_can_via_assume("s3:DeleteObject", SECRET, tables, g["edges"]).collect()}
    assert via == {(fx.BATCH, fx.ARCHIVER)}


def test_graph_edges(clinic, tmp_path, spark):
    _, g = clinic
    e = {(r["kind"], r["src"], r["dst"]): r["external"] for r in g["edges"].collect()}
    assert {d for k, s, d in e if k == "MEMBER_OF" and s == U("otto")} == {fx.arn("group", "nurses"), fx.arn("group", "trainees")}
    assert e[("CAN_ASSUME", fx.BATCH, fx.ARCHIVER)] is False
    assert e[("CAN_ASSUME", "arn:aws:iam::555566667777:root", fx.arn("role", "partner"))] is True
    sinks.write_graph(g["nodes"], g["edges"], str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g" / "nodes")).count() == g["nodes"].select("id").distinct().count()


def test_escalation_paths(ladders):
    _, g = ladders
    got = {r["principal"]: r for r in g["paths"].collect()}
    want = {"uma": ["CreatePolicyVersion"], "viktor": ["PutUserPolicy"], "vera": ["AttachUserPolicy"], "wanda": ["PassRole:ec2"], "xaver": ["AssumeRole", "PutRolePolicy"],
            "yara": ["AssumeRole"] * 3, "zoe": ["AssumeRole", "s3:GetObject"]}
    assert {k: got[U(k)]["techniques"] for k in want} == want
    assert U("idle") not in got
    assert got[U("zoe")]["target_priv"] == "sensitive-resource:high" and [h["dst"] for h in got[U("yara")]["hops"]][:2] == [fx.arn("role", "stair-1"), fx.arn("role", "stair-2")]
    order = [(r["length"], r["principal"]) for r in g["paths"].orderBy("length", "principal").collect()]
    assert order == sorted(order)


def test_new_paths_and_blast(ladders, clinic):
    tables, g = clinic
    assert escalation.new_paths(g["paths"], g["paths"]).count() == 0
    b = {r["principal"]: r for r in ranking.blast_explanation(ranking.blast_radius(tables, g)).collect()}
    assert b[fx.BATCH]["reach_sensitive"] == 1.0 and "can_assume" in b[fx.BATCH]["caps"]
    assert b[U("quinn")]["current_privilege"] == 1.0 and b[U("quinn")]["privesc_available"] == 0.0 and b[U("quinn")]["reach_admin"] == 1.0
    for r in b.values():
        assert r["blast"] == pytest.approx(sum(r[f"{n}_points"] for n in ("reach_sensitive", "reach_admin", "privesc_available", "current_privilege")))
    assert b[fx.BATCH]["explanation"].startswith("blast ")


def test_paths_that_are_new(spark, ladders, tmp_path):
    """A snapshot with one ladder taken away: only that one is new against it."""
    _, g = ladders
    before = fx.ladders()
    before["users"] = [u for u in before["users"] if u["name"] != "viktor"]
    (tmp_path / "auth").mkdir()
    _, old = loaded(spark, tmp_path / "auth", before)
    assert {r["principal"] for r in escalation.new_paths(old["paths"], g["paths"]).collect()} == {U("viktor")}


def test_equal_principals_are_decided_once(spark, tmp_path):
    read = fx.allow("s3:GetObject", "*")
    some = {"Effect": "Allow", "Action": "s3:GetObject", "Resource": "*", "Condition": {"IpAddress": {"aws:SourceIp": "10.0.0.0/8"}}}
    snapshot = {
        "account": fx.ACC, "resources": [fx.bucket(f"vault{i}", "high") for i in range(6)],
        "roles": [fx.post(f"box{i}", fx.trust(Service="ec2.amazonaws.com")) for i in range(4)]
        + [fx.post("top", fx.trust(Service="ec2.amazonaws.com"), attached_managed_policies=[fx.POL + "everything"])],
        "users": [fx.person(f"reader{i}", read) for i in range(8)] + [fx.person("later", some)]
        + [fx.person(f"held{i}", read, permission_boundary=fx.POL + "only-logs") for i in range(3)]
        + [fx.person(f"starter{i}", fx.allow("iam:PassRole", "*"), fx.allow("ec2:RunInstances", "*")) for i in range(7)],
        "managed_policies": [{"arn": fx.POL + "everything", "name": "everything", "document": fx.doc(fx.allow("*", "*"))},
                             {"arn": fx.POL + "only-logs", "name": "only-logs", "document": fx.doc(fx.allow("logs:*", "*"))}],
    }
    (tmp_path / "snapshot.json").write_text(json.dumps(snapshot))
    tables = {n: cut_lineage(t) for n, t in snapshots.read_authorization(spark, str(tmp_path)).items()}
    # a principal listed twice has its edges twice, as every reader of the tables does
    tables["principal"] = cut_lineage(tables["principal"].unionByName(tables["principal"].filter(F.col("name") == "reader3")))
    index = graph.statement_index(tables)
    own, shared = escalation.escalation_parts(tables, index)
    own = cut_lineage(own)
    whole = cut_lineage(own.unionByName(escalation.expand(shared)))
    # who may read without condition is one class, the role that may do all included; six resources a class, two rows each for the one listed twice
    assert {r["kind"]: r["count"] for r in shared["edges"].groupBy("kind").count().collect()} == {"CAN_ACCESS": 24, "CAN_ESCALATE_VIA": 10}
    access = {(r["src"], r["conditional"]): r["count"] for r in whole.filter("kind = 'CAN_ACCESS'").groupBy("src", "conditional").count().collect()}
    assert access == {**{(U(f"reader{i}"), False): 12 if i == 3 else 6 for i in range(8)}, (U("later"), True): 6, (fx.arn("role", "top"), False): 6}
    passed = {r["src"]: r["count"] for r in whole.filter("technique = 'PassRole:ec2'").groupBy("src").count().collect()}
    assert passed == {**{U(f"starter{i}"): 5 for i in range(7)}, fx.arn("role", "top"): 5}
    # one search over classes equals the search over all edges written out, for all goals and for the admin ones
    held = graph.identity_statements(index)
    for which in ({}, {"sensitive": False}):
        goals = cut_lineage(escalation.goals(tables, held, **which))
        rows = lambda p: sorted(str(r) for r in p.collect())
        assert rows(escalation.shortest_paths(own, goals, shared)) == rows(escalation.shortest_paths(whole, goals))


def test_equal_resources_are_decided_once(spark, tmp_path, monkeypatch):
    """Resources that match the same patterns take one decision per class of principals, and keep an edge each."""
    snapshot = {
        "account": fx.ACC, "resources": [fx.bucket(f"vault{i}", "high") for i in range(9)] + [fx.bucket(f"open{i}", "high") for i in range(3)], "roles": [],
        "users": [fx.person(f"reader{i}", fx.allow("s3:GetObject", fx.S3 + "vault*")) for i in range(4)] + [fx.person("one", fx.allow("s3:GetObject", fx.S3 + "vault7/*"))],
        "managed_policies": [],
    }
    (tmp_path / "snapshot.json").write_text(json.dumps(snapshot))
    tables = {n: cut_lineage(t) for n, t in snapshots.read_authorization(spark, str(tmp_path)).items()}
    asked = []
    decide = graph.decide
    monkeypatch.setattr(escalation, "decide", lambda probes, *rest, **more: asked.append(probes.filter("action = 's3:GetObject'").distinct().count()) or decide(probes, *rest, **more))
    own, shared = escalation.escalation_parts(tables, graph.statement_index(tables))
    # vault7, the other vaults and the open ones are three classes; two classes of readers meet what their patterns reach
    assert asked[0] == 3
    edges = {(r["src"], r["dst"]) for r in escalation.expand(shared).collect()}
    vault = lambda i: fx.S3 + f"vault{i}"
    assert edges == {(U(f"reader{i}"), vault(k)) for i in range(4) for k in range(9)} | {(U("one"), vault(7))}


def test_one_sweep_serves_both_aims(spark, ladders, monkeypatch):
    """Admin and sensitive paths of the blast radius come from the rounds of one search, and equal two searches."""
    tables, g = ladders
    calls = []
    search = escalation.shortest_paths
    monkeypatch.setattr(ranking, "shortest_paths", lambda *a, **k: calls.append(1) or search(*a, **k))
    blast = {r["principal"]: r for r in ranking.blast_radius(tables, g).collect()}
    assert len(calls) == 1
    held = graph.identity_statements(g["index"])
    for name, which in (("admin_path", {"sensitive": False}), ("sensitive_path", {"admin": False})):
        alone = {r["node"]: r for r in search(g["edges"], escalation.goals(tables, held, **which)).collect()}
        for who, row in blast.items():
            assert (row[name] is None) == (who not in alone)
            if row[name]:
                assert (row[name]["target"], row[name]["hops"]) == (alone[who]["target"], alone[who]["hops"])


def test_long_ladders_outlast_the_trims(spark):
    """A chain of 12 roles is walked to its end for both aims although edges already used are dropped on the way."""
    node = lambda i: f"n{i:02d}"
    rows = [("CAN_ESCALATE_VIA", node(i + 1), node(i), [3, i, 0, 0, 0], None, None, "AssumeRole", "T1548", False, None) for i in range(12)]
    rows += [("CAN_ESCALATE_VIA", node(20 + i), node(6), [3, 40 + i, 0, 0, 0], None, None, "AssumeRole", "T1548", False, None) for i in range(3)]
    edges = spark.createDataFrame(rows, graph.EDGE)
    class_edges = spark.createDataFrame([("CAN_ESCALATE_VIA", "pass|a", node(9), [2, 0, 0, 0, 0], None, None, "PassRole:ec2", "T1548", False, None)], graph.EDGE)
    shared = {"edges": class_edges, "member": spark.createDataFrame([("late", "pass|a"), (node(3), "pass|a")], "principal STRING, cls STRING")}
    targets = spark.createDataFrame([(node(0), "admin-equivalent", "admin"), (node(4), "sensitive-resource:high", "sensitive")], "node STRING, target_priv STRING, aim STRING")
    got = {(r["aim"], r["node"]): len(r["hops"]) for r in escalation.shortest_paths(edges, targets, shared).collect()}
    want = {("admin", node(i)): i for i in range(13)} | {("admin", node(20 + i)): 7 for i in range(3)} | {("admin", "late"): 10}
    want |= {("sensitive", node(i)): i - 4 for i in range(4, 13)} | {("sensitive", node(20 + i)): 3 for i in range(3)} | {("sensitive", "late"): 6, ("sensitive", node(3)): 6}
    assert got == want


@pytest.mark.parametrize("widest", [graph.WIDEST, 0])
def test_ring_of_roles_is_closed_in_few_rounds(spark, monkeypatch, widest):
    """40 roles in a ring, a leaf on every tenth, a side chain: doubled steps need few rounds, single hops give the same pairs."""
    n = 40
    edge = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [(f"u{i}", f"r{i}") for i in range(0, n, 10)] + [("x2", "x1"), ("x1", "x0"), ("u0", "x2"), ("u0", "x0")]
    edges = spark.createDataFrame(edge, "src STRING, dst STRING").withColumn("kind", F.lit("CAN_ASSUME"))
    roles = spark.createDataFrame([("r0",), ("r5",), ("x0",), ("nobody",)], "role STRING")
    writes, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df, **o: writes.append(1) or cut(df, **o))
    monkeypatch.setattr(graph, "WIDEST", widest)
    got = sorted((r["assumer"], r["role"]) for r in graph.assumers(roles, edges).collect())
    ring = [f"r{i}" for i in range(n)] + [f"u{i}" for i in range(0, n, 10)]
    assert got == sorted([(a, r) for r in ("r0", "r5") for a in ring] + [(a, "x0") for a in ("x1", "x2", "u0")])
    assert widest == 0 or len(writes) < 20
