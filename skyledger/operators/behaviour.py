"""Behaviour layer: principal profiles and the detectors that compare activity with them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import HOUR, MINUTE, blank_to_null, is_read_action
from skyledger.functions.sliced import slice_of, with_latest, with_next, with_previous, with_running_sum
from skyledger.operators.rules import ANCHOR, detection_columns
from skyledger.session import cut_lineage

FACETS = {"region": "region", "country": "geo", "asn": "asn", "src_ip": "src_ip", "action": "event"}


def _scope(df: DataFrame) -> list[str]:
    """Independent runs (such as evaluation scenarios) in one table are kept apart."""
    return [c for c in ("scenario",) if c in df.columns]


def profile_members(history: DataFrame) -> DataFrame:
    """Profile in long form: (principal, facet, value, events). Sets stay rows, so no principal builds a huge array."""
    values = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(c).alias("value")) for f, c in FACETS.items()])
    return (history.select("principal", F.explode(values).alias("m")).select("principal", "m.*")
            .filter((F.col("value") != "") | ((F.col("facet") == "action") & F.col("value").isNotNull()))
            .groupBy("principal", "facet", "value").agg(F.count("*").alias("events")))


def profile_summary(history: DataFrame) -> DataFrame:
    """Events and distinct value count per facet of every principal."""
    members = profile_members(history)
    sizes = members.groupBy("principal").agg(
        *[F.count_if(F.col("facet") == f).alias(f"n_{f}") for f in FACETS],
        F.sum(F.when(F.col("facet") == "action", F.col("events"))).alias("event_count"))
    return sizes


def known_countries(history: DataFrame) -> DataFrame:
    """Sorted country list per principal; its length is bounded by the number of countries."""
    return (history.filter(F.col("geo") != "").groupBy("principal")
            .agg(F.sort_array(F.collect_set("geo")).alias("known_geos")))


def new_geo(events: DataFrame, countries: DataFrame) -> DataFrame:
    """Known principal acting from a country outside its profile, once per (principal, country), first arrival."""
    scope = _scope(events)
    anchor = [c for c in ANCHOR if c != "principal"]
    first = (events.filter(F.col("geo") != "").groupBy(*scope, "principal", "geo")
             .agg(F.min_by(F.struct(*anchor), "seq").alias("a")).select(*scope, "principal", "geo", "a.*"))
    hits = first.join(countries, "principal").filter(~F.array_contains("known_geos", F.col("geo")))
    return hits.select(*scope, *detection_columns(
        F.lit("bhv-new-geo"), F.lit(0.6), F.concat("principal", F.lit(" first seen from "), "geo"),
        F.to_json(F.struct(F.col("geo").alias("new_geo"), "known_geos")), stage=1))


def is_automation(principal: Column, issuer: Column, session_name: Column) -> Column:
    """Automation token anywhere in the names of the identity."""
    names = F.lower(F.concat_ws(" ", principal, issuer, session_name))
    return names.rlike("|".join(re.escape(t) for t in fixed.AUTOMATION_TOKENS))


def automation_iam_writes(events: DataFrame, allow_list: DataFrame | None = None) -> DataFrame:
    """Identity mutations by automation principals; ``allow_list(principal)`` names further ones."""
    writes = events.filter(F.col("event").isin(fixed.IAM_WRITES))
    auto = is_automation(F.col("principal"), F.col("session.issuer_arn"), F.col("session.session_name"))
    if allow_list is not None:
        listed = allow_list.select(F.col("principal").alias("_listed")).distinct()
        by_name = listed.withColumnRenamed("_listed", "_p").withColumn("_hp", F.lit(True))
        by_issuer = listed.withColumnRenamed("_listed", "_i").withColumn("_hi", F.lit(True))
        writes = (writes.join(by_name, F.col("principal") == F.col("_p"), "left")
                  .join(by_issuer, F.col("session.issuer_arn") == F.col("_i"), "left"))
        auto = auto | F.coalesce("_hp", "_hi", F.lit(False))
    return writes.filter(auto).select(*_scope(events), *detection_columns(
        F.lit("bhv-automation-iam-write"), F.lit(0.7), F.concat(F.lit("automation "), "principal", F.lit(" called "), "event"),
        F.to_json(F.struct(F.col("event").alias("action"))), stage=1, sub=F.lit(1)))


def impossible_travel(events: DataFrame, max_gap_minutes: int = 60) -> DataFrame:
    """Country change against the previous geo-bearing event of the principal within the gap (inclusive)."""
    scope = _scope(events)
    geo = events.filter(F.col("geo") != "").select(*scope, *ANCHOR, "geo")
    seen = with_previous(geo, [*scope, "principal"], ["geo"])
    gap = F.col("us") - F.col("prev.us")
    minutes = F.floor(gap / MINUTE).cast("bigint")
    hits = seen.filter((F.col("prev.geo") != F.col("geo")) & (gap <= max_gap_minutes * MINUTE))
    return hits.select(*scope, *detection_columns(
        F.lit("bhv-impossible-travel"), F.lit(0.75),
        F.concat("principal", F.lit(" moved "), "prev.geo", F.lit(" -> "), "geo", F.lit(" in "), minutes.cast("string"), F.lit(" min")),
        F.to_json(F.struct(F.col("prev.geo").alias("from"), F.col("geo").alias("to"), minutes.alias("minutes"))), stage=2))


def enumeration_bursts(events: DataFrame, window_minutes: int = 5, distinct_threshold: int = 8) -> DataFrame:
    """Rising edges of 'at least N distinct read APIs within the trailing window' per principal.

    A name is active at time t when its latest call lies in [t - window, t]. Per (principal, name) the calls form
    activity intervals [first call, last call + window]; the distinct count at t is the number of intervals covering
    t, a running sum of +1/-1. Everything is linear in the reads: no frame is rescanned per row and a hot principal is
    cut into time slices.
    """
    scope = _scope(events)
    window = window_minutes * MINUTE
    who = [*scope, "principal"]
    reads = events.filter(is_read_action(F.col("event"))).select(*scope, *ANCHOR)
    name = [*who, "event"]
    calls = with_previous(reads, name, [], "prev")
    calls = with_next(calls, name, [], "next")
    calls = (calls.withColumn("starts", F.coalesce(F.col("us") - F.col("prev.us") > window, F.lit(True)))
             .withColumn("ends", F.coalesce(F.col("next.us") - F.col("us") > window, F.lit(True))).drop("prev", "next"))
    calls = cut_lineage(calls)  # read three times below
    # the end of an interval is inclusive: at equal times reads (kind 0) come before ends (kind 1)
    ends = calls.filter("ends").select(*who, (F.col("us") + window).alias("us"), F.lit(1).alias("kind"), "seq",
                                       F.lit(-1).alias("delta"))
    ticks = calls.select(*who, "us", F.lit(0).alias("kind"), "seq", F.when(F.col("starts"), 1).otherwise(0).alias("delta"))
    counted = with_running_sum(ticks.unionByName(ends), who, F.col("delta"), "distinct_names", ["us", "kind", "seq"])
    at_reads = counted.filter(F.col("kind") == 0).withColumn("hit", F.col("distinct_names") >= distinct_threshold)
    edges = with_previous(at_reads, who, ["hit"], "before")
    fired = cut_lineage(edges.filter(F.col("hit") & ~F.coalesce(F.col("before.hit"), F.lit(False))).select(*who, "us", "seq", "distinct_names"))

    # evidence: intervals covering the firing time, met on window-wide slices. Intervals of one name are disjoint, so
    # a slice holds at most a few per name.
    bounds = with_next(calls.filter("starts OR ends").select(*name, "us", "seq", "starts", "ends"), name, [], "close")
    intervals = bounds.filter("starts").select(
        *name, F.col("us").alias("_from"), F.col("seq").alias("_from_seq"),
        (F.when(F.col("ends"), F.col("us")).otherwise(F.col("close.us")) + window).alias("_to"))
    spread = intervals.withColumn("_cell", F.explode(F.sequence(slice_of(F.col("_from"), window), slice_of(F.col("_to"), window))))
    covering = (fired.withColumn("_cell", slice_of(F.col("us"), window)).join(spread, [*who, "_cell"])
                .filter((F.struct("_from", "_from_seq") <= F.struct("us", "seq")) & (F.col("us") <= F.col("_to"))))
    names = covering.groupBy(*who, "us", "seq", "distinct_names").agg(F.sort_array(F.collect_set("event")).alias("distinct_actions"))
    hits = names.join(reads, [*who, "us", "seq"])
    return hits.select(*scope, *detection_columns(
        F.lit("bhv-enumeration-burst"), F.lit(0.6),
        F.concat("principal", F.lit(" issued "), F.col("distinct_names").cast("string"),
                 F.lit(f" distinct read APIs in <= {window_minutes} min")),
        F.to_json(F.struct("distinct_actions")), stage=3))


def behaviour_detections(events: DataFrame, countries: DataFrame | None = None, allow_list: DataFrame | None = None,
                         travel_minutes: int = 60, burst_minutes: int = 5, burst_threshold: int = 8) -> DataFrame:
    """Union of the behaviour detectors; new-country scoring needs a profile."""
    parts = [automation_iam_writes(events, allow_list), impossible_travel(events, travel_minutes),
             enumeration_bursts(events, burst_minutes, burst_threshold)]
    if countries is not None:
        parts.insert(0, new_geo(events, countries))
    return reduce(DataFrame.unionByName, parts)
