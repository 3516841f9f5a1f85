"""Sliced windows, metrics, rules, sources, stores and drift on small inputs."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.functions import sliced
from skyledger.functions.columns import glob_matches, ipv4_to_long, json_list
from skyledger.operators import behaviour, context, exposure, graph, metrics, normalise, rules
from skyledger.sources import audit, sinks, snapshots, store
from tests import fixtures as fx


@pytest.mark.parametrize("width", [7, 1000, 10 ** 9])
def test_sliced_windows_equal_plain_windows(spark, width):
    rng = random.Random(width)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(12)}", rng.randrange(0, 3000), i, rng.choice("abc")) for i in range(800)]
    df = spark.createDataFrame(rows, "k STRING, us BIGINT, seq BIGINT, v STRING")
    w = Window.partitionBy("k").orderBy("us", "seq")
    flag = F.col("v") == "a"
    plain = df.select("seq", F.lag("seq").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum(F.when(flag, 1).otherwise(0)).over(w).alias("s"),
                      F.last(F.when(flag, F.col("seq")), True).over(w).alias("l"))
    out = sliced.with_previous(df, ["k"], ["v"], width=width)
    out = sliced.with_next(out, ["k"], ["v"], width=width)
    out = sliced.with_running_sum(out, ["k"], F.when(flag, 1).otherwise(0), "s", ["us", "seq"], width=width)
    out = sliced.with_latest(out, ["k"], flag, [], "l", width=width)
    got = out.select("seq", F.col("prev.seq").alias("p"), F.col("next.v").alias("n"), "s", F.col("l.seq").alias("l"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    numbered = sliced.with_global_number(df.withColumn("us", F.when(F.col("seq") % 9 != 0, F.col("us"))), "us", ["seq"], "no", width=width)
    nos = [(r["us"] is None, r["us"], r["seq"]) for r in numbered.orderBy("no").collect()]
    assert nos == sorted(nos, key=lambda t: (t[0], t[1] or 0, t[2])) and numbered.agg(F.max("no")).first()[0] == 800


def _lcs(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            dp[i + 1][j + 1] = dp[i][j] + 1 if x == y else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


def test_chain_accuracy_in_blocks(spark):
    rng = random.Random(1)
    exp = {f"s{i}": [rng.choice("ABCD") for _ in range(rng.randrange(1, 6))] for i in range(6)}
    act = {f"s{i}": [rng.choice("ABCDE") for _ in range(rng.randrange(0, 40))] for i in range(6)}
    frame = lambda d: spark.createDataFrame([(s, i, a) for s, xs in d.items() for i, a in enumerate(xs)], "scenario STRING, pos BIGINT, action STRING")
    got = {r[0]: r[1] for r in metrics.chain_accuracy(frame(exp), frame(act), block=5).collect()}
    assert got == {s: pytest.approx(round(_lcs(exp[s], act[s]) / max(len(exp[s]), len(act[s]), 1), 4)) for s in exp}


def test_ranking_and_paths(spark):
    rng = random.Random(2)
    a, b = list(range(30)), list(range(5, 40))
    rng.shuffle(a), rng.shuffle(b)
    f = lambda xs: spark.createDataFrame([("r", x, i) for i, x in enumerate(xs)], "ranking STRING, item INT, pos INT")
    common = [x for x in a if x in b]
    pairs = [(x, y) for i, x in enumerate(common) for y in common[i + 1:]]
    want = round(sum(b.index(x) < b.index(y) for x, y in pairs) / len(pairs), 4)
    assert metrics.ranking_agreement(f(a), f(b)).first()["agreement"] == want
    one = spark.createDataFrame([(["AssumeRole", "AttachRolePolicy"], ["AssumeRole", "AttachRolePolicy"]), ([], [])], "expected ARRAY<STRING>, actual ARRAY<STRING>")
    assert [r["path_similarity"] for r in metrics.compare_paths(one).collect()] == [1.0, 1.0]


def test_globs_addresses_and_json(spark):
    d = spark.createDataFrame([("s3:Get*", "s3:GetObject"), ("s3:Get?bject", "s3:GetObject"), ("a_b%!*", "a_b%!x"), ("a_b", "axb"), ("[x]*", "[x]y")], "p STRING, v STRING")
    assert [r[0] for r in d.select(glob_matches(F.col("p"), F.col("v"))).collect()] == [True, True, True, False, True]
    ips = spark.createDataFrame([("10.0.0.1",), ("256.0.0.1",), ("1.2.3",), ("x",), (None,)], "ip STRING")
    assert [r[0] for r in ips.select(ipv4_to_long(F.col("ip"))).collect()] == [167772161, None, None, None, None]
    js = spark.createDataFrame([('["a","b"]',), ("s3:*",), ('{"a":1}',), (None,)], "t STRING")
    assert [r[0] for r in js.select(json_list(F.col("t"))).collect()] == [["a", "b"], ["s3:*"], ['{"a":1}'], []]
    v = spark.createDataFrame([("2001:db8::5",), ("10.0.0.1",), ("junk",)], "ip STRING")
    assert [r[0] for r in v.select(rules.in_network(F.col("ip"), "2001:db8::/32")).collect()] == [True, False, False]


def test_trust_documents(spark):
    other = "arn:aws:iam::999988887777:root"
    docs = [json.dumps({"Statement": [{"Effect": "Allow", "Principal": {"AWS": other}}]}), json.dumps({"Statement": {"Effect": "allow", "Principal": {"AWS": ["*"]}}}),
            json.dumps({"Statement": [{"Effect": "Deny", "Principal": {"AWS": other}}]}), json.dumps({"Statement": [{"Effect": "Allow", "Principal": "*"}]}), "not json *", "not json", None]
    df = spark.createDataFrame([(d,) for d in docs], "d STRING")
    assert [r[0] for r in df.select(rules.trusts_outside(F.col("d"), F.lit(fx.ACC))).collect()] == [True, True, False, False, True, False, False]


def test_trust_drift(spark):
    role = fx.arn("role", "AppRole")
    vendor = {"Effect": "Allow", "Principal": {"AWS": "arn:aws:iam::444455556666:root"}, "Action": "sts:AssumeRole"}
    safe = json.dumps(fx.doc({**vendor, "Condition": {"StringEquals": {"sts:ExternalId": "vendor-123"}}}))
    cases_ = [("dropped", safe, json.dumps(fx.doc(vendor))), ("wild", safe, json.dumps(fx.doc({**vendor, "Principal": {"AWS": "*"}}))), ("same", safe, safe), ("new", json.dumps(fx.doc()), safe)]
    df = spark.createDataFrame([(fx.ACC, n, b, a) for n, b, a in cases_], "account STRING, role STRING, before STRING, after STRING")
    got = {(r["role"], r["type"]) for r in exposure.trust_drift(df).collect()}
    assert got == {("dropped", "condition_dropped"), ("wild", "wildcard_principal"), ("new", "external_account")}
    ok = spark.createDataFrame([("444455556666",)], "account STRING")
    assert ("new", "external_account") not in {(r["role"], r["type"]) for r in exposure.trust_drift(df, ok).collect()}
    assert role


def test_public_access(spark):
    rows = [("PutPublicAccessBlock", '{"PublicAccessBlockConfiguration":{"BlockPublicAcls": false}}', True), ("PutPublicAccessBlock", '{"PublicAccessBlockConfiguration":{"BlockPublicAcls": true}}', False),
            ("PutPublicAccessBlock", "{}", False), ("PutBucketAcl", '{"acl":"Public-Read"}', True), ("PutBucketAcl", '{"grants":["http://acs/AllUsers"]}', True), ("DeletePublicAccessBlock", None, True),
            ("PutBucketPolicy", '{"policy":"{\\"Statement\\":[{\\"Effect\\":\\"Allow\\",\\"Principal\\":{\\"AWS\\":[\\"*\\"]}}]}"}', True), ("PutBucketPolicy", None, False), ("GetObject", None, False)]
    df = spark.createDataFrame([Row(i=i, event=e, params=p) for i, (e, p, _) in enumerate(rows)], "i INT, event STRING, params STRING")
    assert {r["i"] for r in exposure.public_access_changes(df).collect()} == {i for i, r in enumerate(rows) if r[2]}


def test_unused_grants(spark):
    who = fx.arn("user", "alice")
    g = spark.createDataFrame([(who, [0], "Allow", ["s3:GetObject"], ["*"], False, "managed:ReadData"), (who, [1], "Allow", ["iam:CreatePolicyVersion"], ["*"], False, "inline:legacy-admin"),
                               (who, [2], "Allow", ["NOT s3:*"], ["*"], False, "negated"), (who, [3], "Allow", ["ec2:*"], ["*"], True, "conditional")],
                              "principal STRING, ord ARRAY<BIGINT>, effect STRING, actions ARRAY<STRING>, resources ARRAY<STRING>, conditional BOOLEAN, source STRING")
    use = spark.createDataFrame([(who, "s3:GetObject", 10), (who, "iam:CreatePolicyVersion", -40 * 86_400_000_000)], "principal STRING, action STRING, us BIGINT")
    assert [r["source"] for r in exposure.unused_grants(g, use).collect()] == ["inline:legacy-admin"]


def test_sources(spark, tmp_path):
    rec = fx.record("a1", "2026-09-18T03:00:00Z", "ListRoles")
    (tmp_path / "a.json").write_text(json.dumps({"Records": [rec, fx.record("a2", "2026-09-18T03:01:00Z", "GetObject")]}))
    with gzip.open(tmp_path / "b.json.gz", "wt") as fh:
        fh.write(json.dumps({"Records": [rec]}))
    raw = audit.read_audit_files(spark, str(tmp_path))
    assert raw.count() == 3 and raw.filter("raw_ref LIKE 'file:%#a2'").count() == 1
    ev = normalise.dedup(normalise.normalise_audit(raw), ["path", "pos"])
    assert ev.count() == 2
    (tmp_path / "f").mkdir()
    finding = {"AccountId": fx.ACC, "Type": "T", "Id": "g1", "Severity": 8, "CreatedAt": "2026-09-18T03:00:00Z"}
    (tmp_path / "f" / "1.json").write_text(json.dumps([finding]))
    (tmp_path / "f" / "2.json").write_text(json.dumps({"Findings": [finding, finding]}))
    assert audit.read_finding_files(spark, str(tmp_path / "f")).count() == 3
    with pytest.raises(Exception):
        normalise.assert_known_sources(raw.withColumn("source", F.lit("vpcflow"))).collect()
    with pytest.raises(KeyError):
        p = tmp_path / "rules"
        p.mkdir()
        (p / "x.yml").write_text("id: x\nattack: T0000\ndetection: {a: {event: x}}\n")
        snapshots.read_rules(str(p))


def test_stores(spark, tmp_path):
    root = str(tmp_path / "cases")
    frame = lambda rows: spark.createDataFrame(rows, "case_id STRING, payload STRING, version BIGINT")
    store.upsert(frame([("a", "1", 1), ("b", "1", 1)]), root, "case_id", "version")
    store.upsert(frame([("a", "2", 2), ("b", "0", 0), ("c", "1", 1)]), root, "case_id", "version")
    assert {(r["case_id"], r["payload"]) for r in store.read_store(spark, root, "case_id", "version").collect()} == {("a", "2"), ("b", "1"), ("c", "1")}
    log = str(tmp_path / "audit")
    rec = lambda ids: spark.createDataFrame([(i, "t", "case-1") for i in ids], "record_id STRING, ts STRING, case_id STRING")
    sinks.insert_audit_if_absent(rec(["1", "2"]), log)
    sinks.insert_audit_if_absent(rec(["2", "3"]), log)
    assert sorted(r["record_id"] for r in sinks.read_audit(spark, log).collect()) == ["1", "2", "3"]


def test_sanitiser(spark):
    got = spark.createDataFrame([("<a href='x'>\n" + "y" * 600,)], "t STRING").select(context.sanitize("f", F.col("t")).alias("d")).first()["d"]
    assert got["value"].startswith("&lt;a href=&#x27;x&#x27;&gt;\\n") and got["truncated"] and got["original_length"] == 613


def test_automation_tokens(spark):
    d = spark.createDataFrame([("user/ci-bot",), ("user/alice",), ("user/SVC-1",)], "p STRING")
    none = F.lit(None).cast("string")
    assert [r[0] for r in d.select(behaviour.is_automation(F.col("p"), none, none)).collect()] == [True, False, True]
    assert graph is not None


def test_case_feed_keeps_the_newest_row(spark, tmp_path):
    from skyledger.streaming import jobs
    src, root, state = (str(tmp_path / n) for n in ("src", "cases", "state"))
    schema = "case_id STRING, rank DOUBLE, version BIGINT"
    spark.createDataFrame([("case-1", 0.2, 1), ("case-2", 0.5, 1)], schema).coalesce(1).write.parquet(src)
    jobs.start_case_feed(spark.readStream.schema(schema).parquet(src), root, state).awaitTermination()
    spark.createDataFrame([("case-1", 0.9, 2)], schema).coalesce(1).write.mode("append").parquet(src)
    jobs.start_case_feed(spark.readStream.schema(schema).parquet(src), root, state).awaitTermination()
    got = store.read_store(spark, root, "case_id", "version").collect()
    assert {(r["case_id"], r["rank"]) for r in got} == {("case-1", 0.9), ("case-2", 0.5)}


def test_plans_push_filters_and_avoid_nested_loops(spark, tmp_path):
    """Detectors read only their columns, push their filters to the files and never build a product."""
    from skyledger.operators import behaviour as b
    from skyledger.plans import shared_views  # noqa: F401
    path = str(tmp_path / "ev")
    cols = ("seq BIGINT, us BIGINT, principal STRING, src_ip STRING, account STRING, region STRING, event_id STRING, event STRING, geo STRING, params STRING, user_agent STRING, "
            "session STRUCT<issuer_arn: STRING, issuer_type: STRING, session_name: STRING, mfa_authenticated: BOOLEAN>")
    spark.createDataFrame([], cols).write.parquet(path)
    ev = spark.read.parquet(path).filter("us >= 5")
    plan = b.impossible_travel(ev)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(us,5)" in plan and "user_agent" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    plan = b.automation_iam_writes(ev)._jdf.queryExecution().executedPlan().toString()
    assert "In(event" in plan and "Exchange" not in plan


def test_chain_accuracy_of_long_truths_and_chains(spark):
    """Against the full table: words of bits, truths beyond a word, blocks without a useful action, many rounds of the tree."""
    rnd = random.Random(4)
    truths = {"bits": 9, "word": metrics.WORD, "cells": metrics.WORD + 20, "empty": 0, "unseen": 5}
    expected = {k: [rnd.choice("abcde") for _ in range(n)] for k, n in truths.items()}
    chains = {k: [rnd.choice("abcdexyz") for _ in range(rnd.randint(60, 200))] for k in truths if k != "unseen"}
    chains["bits"][20:50] = ["z"] * 30
    rows = lambda d: spark.createDataFrame([(k, i, a) for k, v in d.items() for i, a in enumerate(v)], "scenario string, pos long, action string")
    got = {r[0]: r[1] for r in metrics.chain_accuracy(rows(expected), rows(chains), block=7).collect()}
    for k in truths:
        e, a = expected[k], chains.get(k, [])
        table = [0] * (len(a) + 1)
        for x in e:
            table, old = [0], table
            for j, y in enumerate(a, 1):
                table.append(old[j - 1] + 1 if x == y else max(old[j], table[j - 1]))
        want = (1.0 if not a else 0.0) if not e else round(table[-1] / max(len(e), len(a)), 4)
        assert got.get(k, 1.0) == pytest.approx(want, abs=1e-9), k
