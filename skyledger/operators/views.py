"""Read models over the case tables: lists, dashboards, timelines, graph elements, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.columns import tactic_of, tail
from skyledger.operators.rules import describe


def case_list(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    pending = plan.filter("mode = 'human'").groupBy("case_id").agg(F.count("*").alias("pending_actions"))
    return (ranked.join(pending, "case_id", "left").select(
        "case_id", "title", "rank", "blast", F.col("score").alias("confidence"), F.sort_array("techniques").alias("techniques"),
        F.col("blast_detail.sensitive_path").isNotNull().alias("sensitive_exposed"), F.coalesce("pending_actions", F.lit(0)).alias("pending_actions"), "case_no")
        .orderBy(F.desc("rank"), "case_no"))


def cases_by_blast(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.desc("blast"), F.desc("rank"), "case_no")


def open_case_count(listed: DataFrame) -> DataFrame:
    return listed.agg(F.count("*").alias("open_cases"))


def logging_health(events: DataFrame) -> DataFrame:
    """Latest start/stop call per trail decides whether it is logging."""
    calls = events.filter(F.col("event").isin("StartLogging", "StopLogging", "DeleteTrail", "CreateTrail") & (F.col("target") != ""))
    last = calls.groupBy(F.col("target").alias("trail")).agg(F.max_by("event", F.struct("us", "seq")).alias("last_event"))
    return last.withColumn("logging", F.col("last_event").isin("StartLogging", "CreateTrail"))


def logging_healthy(health: DataFrame) -> DataFrame:
    return health.agg(F.coalesce(F.bool_and("logging"), F.lit(True)).alias("healthy"))


def sensitive_exposure(ranked: DataFrame) -> DataFrame:
    """(resource, sensitivity, reachable_by): one row per principal, so a popular resource stays rows."""
    return (ranked.filter("blast_detail.sensitive_path IS NOT NULL")
            .select(F.col("blast_detail.sensitive_path.target").alias("resource"), F.lit("high").alias("sensitivity"), F.col("blast_principal").alias("reachable_by")).distinct())


def timeline(step_event: DataFrame, case_detection: DataFrame) -> DataFrame:
    """Events of each case with one row per attached detection key (null when none)."""
    keys = case_detection.filter("event_id IS NOT NULL").select("case_id", "event_id", "key", "det_id")
    return step_event.select("case_id", "us", "seq", "principal", F.col("event").alias("action"), "target", "event_id").join(keys, ["case_id", "event_id"], "left")


def attack_map(cases: DataFrame) -> DataFrame:
    """(case_id, tactic, techniques): the arrays are bounded by the technique registry."""
    t = cases.select("case_id", F.explode("techniques").alias("technique")).withColumn("tactic", tactic_of(F.col("technique")))
    return t.groupBy("case_id", "tactic").agg(F.sort_array(F.collect_set("technique")).alias("techniques"))


def detection_rows(case_detection: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Detections as listed in a case, with the resource named in the evidence."""
    d = describe(case_detection, rules)
    field = lambda n: F.get_json_object("evidence", f"$.{n}")
    return d.select("case_id", "det_id", "key", "title", "layer", "attack_ids", "confidence", "principal", "us",
                    F.coalesce(field("role_arn"), field("bucket"), field("target")).alias("resource"), "message",
                    F.col("key").startswith("m8-").alias("advanced"))


def latest_advanced(rows: DataFrame, n: int = 4) -> DataFrame:
    """The n latest advanced findings over all cases (a top-n report)."""
    return rows.filter("advanced").orderBy(F.desc_nulls_last("us"), "det_id").limit(n)


# ---------------------------------------------------------------- graph elements

def node_type(arn: Column) -> Column:
    return F.when(F.contains(arn, F.lit(":role/")), "role").when(F.contains(arn, F.lit(":user/")), "user").otherwise("resource")


def short_name(arn: Column) -> Column:
    slash, colon = tail(arn), tail(arn, ":")
    return F.when(slash != "", slash).when(colon != "", colon).otherwise(arn)


def graph_edges(steps: DataFrame, ranked: DataFrame) -> DataFrame:
    """(case_id, kind, ord, source, target, label, tactic): activity steps with a target, then escalation hops."""
    act = steps.filter("target <> ''").select("case_id", F.lit("activity").alias("kind"), F.col("step_no").alias("ord"), F.col("actor").alias("source"),
                                              "target", F.col("action").alias("label"), "tactic")
    hop = ranked.select("case_id", F.explode(F.array(F.struct(F.lit(0).alias("w"), F.col("blast_detail.admin_path.hops").alias("h")),
                                                     F.struct(F.lit(1).alias("w"), F.col("blast_detail.sensitive_path.hops").alias("h")))).alias("p"))
    hop = hop.select("case_id", F.col("p.w").alias("w"), F.posexplode("p.h").alias("i", "h")).select(
        "case_id", F.lit("escalation").alias("kind"), (F.col("w") * 1000000 + F.col("i")).cast("bigint").alias("ord"),
        F.col("h.src").alias("source"), F.col("h.dst").alias("target"), F.col("h.technique").alias("label"), F.lit(None).cast("string").alias("tactic"))
    return act.unionByName(hop)


def graph_nodes(steps: DataFrame, edges: DataFrame) -> DataFrame:
    ids = (steps.select("case_id", F.col("actor").alias("id")).unionByName(edges.select("case_id", F.explode(F.array("source", "target")).alias("id"))))
    return ids.filter("id <> ''").distinct().select("case_id", "id", short_name(F.col("id")).alias("label"), node_type(F.col("id")).alias("type"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes over all cases with the number of cases; memberships stay in ``nodes``."""
    return nodes.groupBy("id").agg(F.min("label").alias("label"), F.min("type").alias("type"), F.count_distinct("case_id").alias("n_cases"))


def merged_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target", "label", "kind").agg(F.count_distinct("case_id").alias("n_cases"), F.min("tactic").alias("tactic"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "user").alias("users"), F.count_if(F.col("type") == "role").alias("roles"),
                  F.count_if(F.col("type") == "resource").alias("resources"), F.count_if(F.col("n_cases") > 1).alias("shared")).withColumn("_k", F.lit(1))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("kind") == "escalation").alias("escalations")).withColumn("_k", F.lit(1))
    return n.join(e, "_k").drop("_k")


def filter_graph(nodes: DataFrame, edges: DataFrame, *, escalation_only: bool = False, node_kind: str | None = None,
                 search: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Graph filters: escalation edges, node type, text search with one-hop neighbours."""
    if escalation_only:
        edges = edges.filter("kind = 'escalation'")
        ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        nodes = nodes.join(ends, "id", "left_semi")
    if node_kind:
        nodes = nodes.filter(F.col("type") == node_kind)
        edges = _inside(nodes, edges)
    if search:
        text = search.strip().lower()
        hit = nodes.filter(F.lower(F.concat_ws(" ", "id", "label", "type")).contains(text)).select("id")
        named = edges.filter(F.lower(F.concat_ws(" ", "label", "kind", "tactic")).contains(text)).select(F.explode(F.array("source", "target")).alias("id"))
        seed = hit.unionByName(named).distinct()
        out = edges.join(seed.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
        back = edges.join(seed.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
        nodes = nodes.join(seed.unionByName(out).unionByName(back).distinct(), "id", "left_semi")
        edges = _inside(nodes, edges)
    return nodes, edges


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    return (edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))


# ---------------------------------------------------------------- searches and bands

def detection_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.90, "Critical").when(confidence >= 0.85, "High").when(confidence >= 0.65, "Medium").otherwise("Low")


def case_band(blast: Column) -> Column:
    return F.when(blast >= 70, "Critical").when(blast >= 50, "High").when(blast >= 30, "Medium").otherwise("Low")


def search_detections(rows: DataFrame, text: str = "", layer: str | None = None, advanced: bool | None = None) -> DataFrame:
    """Text, layer and kind filters over detection rows, most confident first."""
    hay = F.lower(F.concat_ws(" ", "title", "key", F.coalesce("principal", F.lit("")), F.coalesce("resource", F.lit("")),
                               F.array_join("attack_ids", " "), "message"))
    d = rows.filter(hay.contains(text.strip().lower())) if text.strip() else rows
    d = d.filter(F.col("layer") == layer) if layer else d
    d = d.filter(F.col("advanced") == advanced) if advanced is not None else d
    return d.withColumn("severity", detection_band(F.col("confidence"))).orderBy(F.desc("confidence"), "det_id")


def detection_counters(rows: DataFrame) -> DataFrame:
    techniques = rows.select(F.explode("attack_ids").alias("t")).agg(F.count_distinct("t").alias("techniques")).withColumn("_k", F.lit(1))
    base = rows.agg(F.count("*").alias("total"), *[F.count_if(F.col("layer") == n).alias(n) for n in ("signature", "behavioural", "correlation")],
                    F.count_if("advanced").alias("advanced"), F.count_if(F.col("confidence") >= 0.85).alias("critical")).withColumn("_k", F.lit(1))
    return base.join(techniques, "_k").drop("_k")


def search_cases(listed: DataFrame, text: str = "", severity: str | None = None, pending_only: bool = False) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "case_id", "title", F.array_join("techniques", " ")))
    d = listed.withColumn("severity", case_band(F.col("blast")))
    d = d.filter(hay.contains(text.strip().lower())) if text.strip() else d
    d = d.filter(F.col("severity") == severity) if severity else d
    return d.filter("pending_actions > 0") if pending_only else d
