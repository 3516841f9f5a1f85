"""Scenario evaluation: replay, detect, correlate, rebuild chains and score all scenarios in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.sliced import with_global_number
from skyledger.operators import cases, chain, metrics, normalise
from skyledger.operators.rules import attack_ids
from skyledger.session import cut_lineage


def replay(raw: DataFrame, geo: DataFrame) -> DataFrame:
    """Scenario records to enriched, deduplicated events numbered in time order per scenario."""
    ev = normalise.enrich_geo(normalise.normalise_audit(raw), geo)
    ev = normalise.dedup(ev, ["pos"], ["scenario", "source", "event_id"])
    ev = with_global_number(ev, "us", ["pos"], "seq", keys=["scenario"])
    return ev.withColumn("bytes", F.coalesce("bytes_transferred", F.lit(0).cast("bigint")))


def evaluate(events: DataFrame, history: DataFrame, truth: DataFrame, expected_keys: DataFrame, expected_actions: DataFrame,
             advanced: DataFrame | None = None, edges: DataFrame | None = None, path_scores: DataFrame | None = None,
             unsafe_actions: Column | None = None) -> DataFrame:
    """One result row per scenario of ``truth(scenario, attack)``.

    ``expected_keys(scenario, key)``, ``expected_actions(scenario, pos, action)``, ``path_scores(scenario, privesc_path_score)``.
    The scenario is a key of every join and group, so scenarios never mix.
    """
    found = cases.run_detection(events, history, advanced=advanced)
    detections = cut_lineage(found["case_detection"])
    steps = chain.reconstruct(found, events, edges)
    keys = detections.select("scenario", "key").distinct()
    quality = metrics.rule_set_metrics(expected_keys, keys)
    held = steps["step_event"].select("scenario", "case_id", "event_id")
    cohesion = metrics.correlation_score(events.select("scenario", "event_id"), held)
    # the chain compared with the truth belongs to the best-scored case
    top = found["case"].groupBy("scenario").agg(F.max_by("case_id", F.struct("score", -F.col("case_no"))).alias("case_id"))
    actions = steps["step"].join(top, ["scenario", "case_id"]).select("scenario", F.col("step_no").alias("pos"), "action")
    similarity = metrics.chain_accuracy(expected_actions, actions)
    missing = expected_keys.join(keys, ["scenario", "key"], "left_anti").groupBy("scenario").agg(F.count("*").alias("missing"))
    fired = keys.groupBy("scenario").agg(F.sort_array(F.collect_set("key")).alias("detections_actual"),
                                         F.sort_array(F.array_distinct(F.flatten(F.collect_set(attack_ids(F.col("key")))))).alias("attack_ids"))
    has_case = found["case"].select("scenario").distinct().withColumn("has_case", F.lit(True))
    d = truth
    for part in (quality, cohesion, similarity, missing, fired, has_case):
        d = d.join(part, "scenario", "left")
    if path_scores is not None:
        d = d.join(path_scores, "scenario", "left")
    else:
        d = d.withColumn("privesc_path_score", F.lit(0.0))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    any_fired, cased = F.col("detections_actual").isNotNull(), F.coalesce("has_case", F.lit(False))
    unsafe = F.lit(0) if unsafe_actions is None else unsafe_actions
    passed = F.when(F.col("attack"), F.coalesce("missing", F.lit(0)) == 0).otherwise(~any_fired) & (unsafe == 0)
    return d.select(
        "scenario", "attack", passed.alias("passed"), any_fired.alias("fired"), F.coalesce("detections_actual", F.array().cast("array<string>")).alias("detections_actual"),
        F.coalesce("attack_ids", F.array().cast("array<string>")).alias("attack_ids"), zero("precision").alias("precision"), zero("recall").alias("recall"),
        zero("f1").alias("f1"), zero("false_positive_rate").alias("false_positive_rate"),
        F.when(F.col("attack") & cased, zero("correlation_score")).when(~F.col("attack") & ~cased, 1.0).otherwise(0.0).alias("correlation_score"),
        F.when(F.col("attack"), zero("chain_accuracy")).otherwise(1.0).alias("chain_accuracy"), zero("privesc_path_score").alias("privesc_path_score"),
        unsafe.alias("safety_violations"))
