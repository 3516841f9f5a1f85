"""Correlation: link detections, connected components, scored and numbered cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import MINUTE, lookup, tactic_of, tactic_rank
from skyledger.functions.sliced import with_global_number, with_latest, with_previous
from skyledger.operators.rules import attack_ids
from skyledger.session import cut_lineage


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("scenario",) if c in df.columns]


def link_sessions(detections: DataFrame, window_minutes: int = 60) -> DataFrame:
    """(det_id, kind, value, node): runs of detections on one principal or address with gaps within the window.

    Two detections of one key within the window always share a run, because every gap between them is smaller, so the
    runs carry the same connectivity as the pairwise link test without comparing pairs.
    """
    scope = _scope(detections)
    window = window_minutes * MINUTE
    keys = F.array(F.struct(F.lit("principal").alias("kind"), F.col("principal").alias("value")),
                   F.struct(F.lit("src_ip").alias("kind"), F.col("src_ip").alias("value")))
    keyed = (detections.filter(F.col("us").isNotNull()).select(*scope, "det_id", "us", F.explode(keys).alias("k"))
             .select(*scope, "det_id", "us", "k.*").filter(F.col("value") != ""))
    part = [*scope, "kind", "value"]
    near = with_previous(keyed, part, [], "prev", order=["us", "det_id"])
    starts = F.coalesce(F.col("us") - F.col("prev.us") > window, F.lit(True))
    runs = with_latest(near.withColumn("starts", starts).drop("prev"), part, F.col("starts"), [], "head", order=["us", "det_id"])
    return runs.select(*scope, "det_id", "kind", "value", F.concat_ws("|", *scope, "kind", "head.det_id").alias("node"))


def links(detections: DataFrame, window_minutes: int = 60) -> DataFrame:
    """(kind, value, det_id, prev_det_id): each detection with its predecessor on the key inside the window."""
    scope = _scope(detections)
    keys = F.array(F.struct(F.lit("principal").alias("kind"), F.col("principal").alias("value")),
                   F.struct(F.lit("src_ip").alias("kind"), F.col("src_ip").alias("value")))
    keyed = (detections.filter(F.col("us").isNotNull()).select(*scope, "det_id", "us", F.explode(keys).alias("k"))
             .select(*scope, "det_id", "us", "k.*").filter(F.col("value") != ""))
    near = with_previous(keyed, [*scope, "kind", "value"], [], "prev", order=["us", "det_id"])
    return (near.filter(F.col("us") - F.col("prev.us") <= window_minutes * MINUTE)
            .select(*scope, "kind", "value", "det_id", F.col("prev.det_id").alias("prev_det_id")))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
                           F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected edge list (a, b), component = smallest node name.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): O(log^2 n) rounds, each linear in the edges.
    Star minima are partial aggregates and the joins are many-to-one, so a hub is split by the skew join.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    e = cut_lineage(e)
    state = _fingerprint(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(hub, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(hub.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        before, state = state, _fingerprint(e)
        if before == state:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))


def assign_components(detections: DataFrame, window_minutes: int = 60) -> DataFrame:
    """(det_id, component) for every detection; one without a linkable key or time stands alone."""
    scope = _scope(detections)
    sessions = cut_lineage(link_sessions(detections, window_minutes))
    pair = sessions.groupBy(*scope, "det_id").agg(
        F.max(F.when(F.col("kind") == "principal", F.col("node"))).alias("p"),
        F.max(F.when(F.col("kind") == "src_ip", F.col("node"))).alias("i"))
    edges = pair.filter(F.col("p").isNotNull() & F.col("i").isNotNull()).select(F.col("p").alias("a"), F.col("i").alias("b"))
    comps = connected_components(edges)
    member = pair.select(*scope, "det_id", F.coalesce("p", "i").alias("node")).join(comps, "node", "left")
    member = member.select(*scope, "det_id", F.coalesce("component", "node").alias("component"))
    return (detections.select(*scope, "det_id").join(member, [*scope, "det_id"], "left")
            .select(*scope, "det_id", F.coalesce("component", F.concat_ws("|", *scope, F.lit("alone"), "det_id")).alias("component")))


def score(confidence: Column, n_tactics: Column) -> Column:
    """Noisy-OR of the confidences plus 0.05 per further tactic, at most 0.99, three decimals."""
    miss = F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)))
    return F.round(F.least(F.lit(0.99), (1 - miss) + 0.05 * F.greatest(F.lit(0), n_tactics - 1)), 3)


def case_title(tactics: Column) -> Column:
    """Tactics in kill-chain order, joined by arrows. Unranked tactics come last."""
    ranked = F.array_sort(F.transform(tactics, lambda t: F.struct(tactic_rank(t).alias("r"), t.alias("t"))))
    text = F.array_join(F.transform(ranked, lambda s: s["t"]), " -> ")
    return F.when(text == "", "Uncategorised activity").otherwise(text)


def correlate(detections: DataFrame, window_minutes: int = 60, rules: list[dict] | None = None) -> dict[str, DataFrame]:
    """Cases as tables: ``case`` (one row each), ``case_detection`` and ``case_entity`` (bridges).

    Technique and tactic arrays are bounded by the registry; detections and entities stay rows.
    """
    scope = _scope(detections)
    detections = cut_lineage(detections)
    member = assign_components(detections, window_minutes)
    rows = cut_lineage(detections.join(member, [*scope, "det_id"]))
    by = [*scope, "component"]
    ids = attack_ids(F.col("key"), rules)
    # detections of one key in one component share techniques: fold them before exploding
    keyed = rows.groupBy(*by, "key").agg(
        F.product(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))).alias("miss"),
        F.count("*").alias("n"), F.min("us").alias("us_start"), F.max("us").alias("us_end"),
        F.min(F.struct("stage", "seq", "sub", "det_id")).alias("first"))
    base = keyed.groupBy(*by).agg(
        F.product("miss").alias("miss"), F.sum("n").alias("n_detections"), F.min("us_start").alias("us_start"),
        F.max("us_end").alias("us_end"), F.min("first").alias("first"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(ids)))).alias("techniques"))
    tactic_set = F.array_distinct(F.transform("techniques", tactic_of))
    cases = base.withColumn("tactics", tactic_set).select(
        *by, "us_start", "us_end", "n_detections", "first", "techniques", "tactics",
        F.round(F.least(F.lit(0.99), (1 - F.col("miss")) + 0.05 * F.greatest(F.lit(0), F.size("tactics") - 1)), 3).alias("score"),
        case_title(F.col("tactics")).alias("title"))
    cases = with_global_number(cases, "us_start", ["first"], "case_no", keys=scope or None)
    cases = cases.withColumn("case_id", F.concat(F.lit("case-"), F.col("case_no").cast("string"))).drop("first")
    cases = cut_lineage(cases)
    bridge = cut_lineage(rows.join(cases.select(*by, "case_id"), by).drop("component"))
    entity = F.array(F.struct(F.lit("principal").alias("kind"), F.col("principal").alias("value")),
                     F.struct(F.lit("src_ip").alias("kind"), F.col("src_ip").alias("value")))
    entities = (bridge.select(*scope, "case_id", F.explode(entity).alias("e")).select(*scope, "case_id", "e.*")
                .filter(F.col("value") != "").distinct())
    return {"case": cases.drop("component"), "case_detection": bridge, "case_entity": entities}


def enrich_with_escalation(cases: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Fold known escalation paths (principal, target_priv, techniques) of case principals into the cases.

    A case gains T1548 and +0.1 once; ``case_note`` keeps one note per principal.
    """
    known = paths.select(F.col("principal").alias("value"), "target_priv", F.col("techniques").alias("path_techniques"))
    hits = cases["case_entity"].filter("kind = 'principal'").join(known, "value")
    scope = _scope(hits)
    notes = hits.select(*scope, "case_id", F.col("value").alias("principal"), F.concat(
        F.col("value"), F.lit(" has a privesc path to "), F.col("target_priv"), F.lit(" via "),
        F.array_join("path_techniques", " -> ")).alias("note"))
    touched = hits.select(*scope, "case_id").distinct().withColumn("_hit", F.lit(True))
    hit = F.coalesce("_hit", F.lit(False))
    techniques = F.sort_array(F.array_union("techniques", F.array(F.lit("T1548"))))
    out = (cases["case"].join(touched, [*scope, "case_id"], "left")
           .withColumn("techniques", F.when(hit, techniques).otherwise(F.col("techniques")))
           .withColumn("tactics", F.array_distinct(F.transform("techniques", tactic_of)))
           .withColumn("score", F.when(hit, F.round(F.least(F.lit(0.99), F.col("score") + 0.1), 3)).otherwise(F.col("score")))
           .withColumn("title", F.when(hit, case_title(F.col("tactics"))).otherwise(F.col("title"))).drop("_hit"))
    return {**cases, "case": out, "case_note": notes}


def ranked_by_score(cases: DataFrame) -> DataFrame:
    """Cases by score, ties in case order (a range-partitioned sort)."""
    return cases.orderBy(F.desc("score"), "case_no")


def detect(events: DataFrame, history: DataFrame | None = None, *, rules: list[dict] | None = None,
           allow_list: DataFrame | None = None, advanced: DataFrame | None = None, **behaviour) -> DataFrame:
    """All detections of one run: signatures, behaviour and injected advanced findings."""
    from skyledger.operators.behaviour import behaviour_detections, known_countries
    from skyledger.operators.rules import match_rules

    parts = [match_rules(events, rules),
             behaviour_detections(events, None if history is None else known_countries(history), allow_list, **behaviour)]
    if advanced is not None:
        parts.append(advanced)
    return reduce(DataFrame.unionByName, parts)


def run_detection(events: DataFrame, history: DataFrame | None = None, *, window_minutes: int = 60,
                  escalation_paths: DataFrame | None = None, rules: list[dict] | None = None, **options) -> dict[str, DataFrame]:
    """The three layers as one job: detections, then cases, then known escalation paths folded in."""
    detections = detect(events, history, rules=rules, **options)
    out = correlate(detections, window_minutes, rules)
    if escalation_paths is not None:
        out = enrich_with_escalation(out, escalation_paths)
    return out
