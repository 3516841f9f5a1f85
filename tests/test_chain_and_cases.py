"""End-to-end golden chain, collapse against a sequential fold, components against pairwise links."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from skyledger.operators import cases, chain, context, escalation, ranking
from skyledger.operators.normalise import EVENT_COLUMNS  # noqa: F401
from skyledger.sources import sinks, snapshots
from tests import fixtures as fx

ARCHIVER, SESS = fx.ARCHIVER, f"arn:aws:sts::{fx.ACC}:assumed-role/archiver/sess1"
T0 = 1_789_009_200_000_000
EVENT = ("seq BIGINT, us BIGINT, event STRING, principal STRING, principal_type STRING, session STRUCT<issuer_arn: STRING, issuer_type: STRING, session_name: STRING, mfa_authenticated: BOOLEAN>, "
         "target STRING, src_ip STRING, geo STRING, region STRING, account STRING, event_id STRING, mfa BOOLEAN, read_only BOOLEAN, resource_sensitivity STRING, asn STRING, user_agent STRING, "
         "error_code STRING, severity DOUBLE, source STRING, params STRING, event_source STRING, bytes_transferred BIGINT")


def row(seq, minute, event, who, target=None, geo="DE", ip=fx.IP):
    sess = (ARCHIVER, "Role", None, None) if who == SESS else None
    return (seq, T0 + minute * 60_000_000, event, who, "assumed_role" if sess else "user", sess, target, ip, geo, "us-east-1", fx.ACC, f"e{seq}", False, None,
            "unknown", None, "<ua>&", None, None, "cloudtrail", None, None, None)


def story(spark):
    steps = [("ListBuckets", fx.BATCH, None), ("AssumeRole", fx.BATCH, ARCHIVER), ("CreatePolicyVersion", SESS, f"arn:aws:iam::{fx.ACC}:policy/everything"), ("DescribeInstances", SESS, None),
             ("ListRoles", SESS, None), ("GetObject", SESS, "arn:aws:s3:::clinic-secrets"), ("StopLogging", SESS, f"arn:aws:cloudtrail:eu-west-1:{fx.ACC}:trail/ward")]
    stream = spark.createDataFrame([row(i, i, e, w, t) for i, (e, w, t) in enumerate(steps)], EVENT)
    past = spark.createDataFrame([row(100, -120, "ListBuckets", fx.BATCH, geo="US"), row(101, -119, "GetCallerIdentity", fx.BATCH, geo="US")], EVENT)
    return past, stream


def test_story_becomes_one_ranked_case(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps(fx.clinic()))
    tables = snapshots.read_authorization(spark, str(p))
    g = escalation.prepare_graph(tables)
    past, stream = story(spark)
    found = cases.run_detection(stream, past)
    assert found["case"].count() == 1
    c = chain.reconstruct(found, stream, g["edges"])
    steps = c["step"].orderBy("step_no").collect()
    assert [s["action"] for s in steps] == ["ListBuckets", "AssumeRole", "CreatePolicyVersion", "Discovery (2 reads)", "GetObject", "StopLogging"]
    assert [s["tactic"] for s in steps] == ["Discovery", "Privilege Escalation", "Privilege Escalation", "Discovery", "Collection", "Defense Evasion"]
    assert [s["actor"] for s in steps] == [fx.BATCH, fx.BATCH] + [ARCHIVER] * 4
    assert steps[1]["via_edge"] == "CAN_ASSUME night-batch -> archiver" and steps[4]["via_edge"].startswith("CAN_ACCESS")

    ranked = ranking.rank_cases(found, c["step"], ranking.blast_radius(tables, g)).cache()
    r = ranked.first()
    assert r["rank"] == pytest.approx(round(0.6 * r["blast"] / 100 + 0.4 * r["score"], 4))
    plan = ranking.response_plan(ranked, c["step"]).cache()
    modes = {(x["action_key"], x["mode"]) for x in plan.collect()}
    assert ("quarantine-principal", "human") in modes and ("re-enable-logging", "human") in modes
    assert ranking.unsafe_automatic(plan).isEmpty()

    books = snapshots.playbooks(spark)
    tags = context.case_tags(found["case"], found["case_detection"], plan)
    items = context.context_items(ranked, c, found["case_detection"], stream, tags, books).cache()
    ua = json.loads(items.filter("section = 'event'").first()["item"])["user_agent"]
    assert ua["value"] == "&lt;ua&gt;&amp;" and ua["tag"] == "DATA"
    text = context.summary_text(context.summary_parts(ranked, c["step"], found["case_detection"], tags, books))
    assert context.audit_summaries(text, context.allowed_entities(items)).isEmpty()
    bad = text.withColumn("summary", F.lit("Delete the user. See [[ref:nope]]."))
    v = {x["violation"] for x in context.audit_summaries(bad, context.allowed_entities(items)).collect()}
    assert {"unsupported provenance ref: nope", "uncited sentence: Delete the user.", "action directive detected"} <= v
    assert context.approved_summaries(bad, context.audit_summaries(bad, context.allowed_entities(items)), text).first()["source"] == "template"

    sinks.export_case_json(items, str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "json")).count() == items.count()
    csv = sinks.case_csv_rows(ranked, c["step_event"], found["case_detection"])
    sinks.export_case_csv(csv, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == sinks.CSV_COLUMNS and back.count() == 7


def _fold(rows, gap):
    """Sequential reference: rows sorted by position; returns (action, reads) per step."""
    steps = []
    for us, who, event in rows:
        disc = event.startswith(("Describe", "List", "Get")) and event != "GetObject"
        if steps and disc and steps[-1][3] and steps[-1][1] == who and us - steps[-1][0] <= gap:
            steps[-1][2] += 1
        else:
            steps.append([us, who, 1, disc, event])
    return [(f"Discovery ({s[2]} reads)" if s[2] > 1 else s[4]) for s in steps]


def test_long_discovery_runs_fold_like_the_sequential_rule(spark):
    rng = random.Random(7)
    rows, minute = [], 0.0
    for i in range(400):
        minute += rng.choice([0, 0.5, 2, 3, 7, 9.99, 10, 10.01])
        rows.append((i, int(minute * 60_000_000), rng.choice(["ListRoles", "ListUsers", "DescribeVpcs", "ListRoles", "GetPolicy", "ListKeys"]) if rng.random() > 0.02 else "StopLogging"))
    ev = spark.createDataFrame([row(i, 0, e, fx.BATCH)[:1] + (us,) + row(i, 0, e, fx.BATCH)[2:] for i, us, e in rows], EVENT)
    last = rows[-1][1]
    table = {
        "case": spark.createDataFrame([("case-1", 0, last)], "case_id STRING, us_start BIGINT, us_end BIGINT"),
        "case_entity": spark.createDataFrame([("case-1", "principal", fx.BATCH), ("case-1", "src_ip", fx.IP)], "case_id STRING, kind STRING, value STRING"),
        "case_detection": spark.createDataFrame([], "case_id STRING, event_id STRING, det_id STRING, key STRING, stage INT, seq BIGINT, sub INT")}
    got = [r["action"] for r in chain.reconstruct(table, ev)["step"].orderBy("step_no").collect()]
    # within one instant the tactic rank decides before arrival: tampering comes before discovery
    ordered = sorted(rows, key=lambda r: (r[1], 4 if r[2] == "StopLogging" else 6, r[0]))
    assert got == _fold([(us, fx.BATCH, e) for _, us, e in ordered], 600_000_000)


def test_components_equal_pairwise_links_even_with_a_hot_address(spark):
    rng = random.Random(3)
    dets = []
    for i in range(600):
        ip = "10.0.0.1" if rng.random() < 0.34 else f"10.1.{rng.randrange(60)}.1"
        dets.append((f"d{i:04d}", "iam-create-user", 0.6, 0, i, 0, rng.randrange(0, 60 * 24 * 20) * 60_000_000 if rng.random() > 0.02 else None, f"u{rng.randrange(90)}", ip, f"e{i}", "x", "m", "{}", "a", "r"))
    df = spark.createDataFrame(dets, "det_id STRING, key STRING, confidence DOUBLE, stage INT, seq BIGINT, sub INT, us BIGINT, principal STRING, src_ip STRING, event_id STRING, event_name STRING, "
                                     "message STRING, evidence STRING, account STRING, region STRING")
    parent = {d[0]: d[0] for d in dets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(dets):
        for b in dets[:i]:
            if a[6] is not None and b[6] is not None and abs(a[6] - b[6]) <= 3600_000_000 and (a[7] == b[7] or a[8] == b[8]):
                parent[find(a[0])] = find(b[0])
    want = {}
    for d in dets:
        want.setdefault(find(d[0]), set()).add(d[0])
    got = {}
    for r in cases.assign_components(df).collect():
        got.setdefault(r["component"], set()).add(r["det_id"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_ordered_passes_start_from_written_rows(spark, monkeypatch):
    """A pass reads its input twice, so what it starts from must not be a join or an aggregate that runs again."""
    past, stream = story(spark)
    found, plans = cases.run_detection(stream, past), {}

    def seen(name, fn):
        return lambda df, *a, **k: plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()) and fn(df, *a, **k)

    for name in ("with_previous", "with_latest", "with_running_sum"):
        monkeypatch.setattr(chain, name, seen(name, getattr(chain, name)))
    assert chain.reconstruct(found, stream)["step"].count() == 6
    assert len(plans) == 3 and not any(op in plan for plan in plans.values() for op in ("Join", "Aggregate", "Window"))
