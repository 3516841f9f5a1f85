"""Seven scenarios in one job against the published quality figures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from skyledger.operators import exposure, metrics
from skyledger.plans import evaluation
from skyledger.sources import audit
from tests import fixtures as fx


def test_scenarios_reach_the_published_metrics(spark, tmp_path):
    attack, history = fx.scenarios()
    for name, records in attack.items():
        (tmp_path / f"{name}.json").write_text(json.dumps({"Records": records}))
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "history.json").write_text(json.dumps(history))
    geo = spark.createDataFrame(fx.GEO, "src_ip STRING, asn STRING, geo STRING")
    events = evaluation.replay(audit.read_scenarios(spark, str(tmp_path / "*.json")), geo).cache()
    past = evaluation.replay(audit.read_scenarios(spark, str(tmp_path / "h" / "*.json")), geo).drop("scenario").cache()

    s3 = exposure.s3_exfiltration(events.filter("scenario = 's3-exfiltration'"), exposure.s3_profile(past))
    role = fx.arn("role", "deploy")
    before, after = (json.dumps(fx.doc({"Effect": "Allow", "Principal": {"AWS": p}, "Action": "sts:AssumeRole"})) for p in (f"arn:aws:iam::{fx.ACC}:root", "*"))
    drift = exposure.trust_drift(spark.createDataFrame([(fx.ACC, role, before, after)], "account STRING, role STRING, before STRING, after STRING"))
    anchored = exposure.trust_drift_detections(drift, events.filter("scenario = 'trust-policy-backdoor'").withColumn("role", F.lit(role)))
    advanced = s3.unionByName(anchored)

    truth = spark.createDataFrame([(n, n != "benign-automation") for n in attack], "scenario STRING, attack BOOLEAN")
    keys = spark.createDataFrame([(s, k) for s, ks in fx.EXPECTED_KEYS.items() for k in ks], "scenario STRING, key STRING")
    actions = spark.createDataFrame([(s, i, a) for s, acts in fx.EXPECTED_ACTIONS.items() for i, a in enumerate(acts)], "scenario STRING, pos INT, action STRING")
    paths = spark.createDataFrame([("iam-privesc", 1.0)], "scenario STRING, privesc_path_score DOUBLE")
    result = evaluation.evaluate(events, past, truth, keys, actions, advanced, path_scores=paths).cache()
    got = {r["scenario"]: r for r in result.collect()}

    assert all(r["passed"] for r in got.values())
    want = {  # precision, recall, f1, chain accuracy
        "compromised-key": (1.0, 1.0, 1.0, 1.0), "iam-privesc": (0.5, 1.0, 0.667, 1.0), "assume-role-chain": (1.0, 1.0, 1.0, 1.0), "s3-exfiltration": (0.5, 1.0, 0.667, 0.0645),
        "defense-evasion": (0.5, 1.0, 0.667, 1.0), "trust-policy-backdoor": (0.25, 1.0, 0.4, 1.0), "benign-automation": (0.0, 0.0, 0.0, 1.0)}
    for name, (p, r, f1, chain) in want.items():
        row = got[name]
        assert (row["precision"], row["recall"], round(row["f1"], 3), row["chain_accuracy"]) == (p, r, f1, chain), name
        assert row["correlation_score"] == 1.0, name
    summary = metrics.summarize(result).first()
    assert (summary["scenarios_passed"], summary["precision"], summary["recall"], summary["false_positive_rate"]) == (7, 1.0, 1.0, 0.0)
    assert summary["average_chain_accuracy"] == pytest.approx(0.8440833, abs=1e-6)
    assert summary["average_correlation_accuracy"] == 1.0 and summary["average_privesc_accuracy"] == 1.0
