"""Snapshot- and baseline-aware findings: object-store exfiltration, public exposure, unused grants, trust drift."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import DAY, blank_to_null, json_field, json_list
from skyledger.operators.graph import match_globs
from skyledger.operators.rules import ANCHOR, detection_columns, unanchored
from skyledger.sources.snapshots import parse_statements, trust_names

MIB = 1024 * 1024


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("scenario",) if c in df.columns]


# ---------------------------------------------------------------- event helpers

def event_bytes(params: Column, bytes_transferred: Column | None = None) -> Column:
    """First usable byte count among the known parameters, else 0. Strings count if they are digits only; numbers may have decimals."""
    found, doc = [], F.try_parse_json(params)
    for name in fixed.BYTE_PARAMS:
        value = F.try_variant_get(doc, f"$.{name}", "variant")
        text = F.try_variant_get(value, "$", "string")
        usable = F.when(F.schema_of_variant(value) == "STRING", text.rlike("^[0-9]+$")).otherwise(text.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
        found.append(F.when(usable, F.floor(text.cast("double")).cast("bigint")))
    first = [F.when(bytes_transferred >= 0, bytes_transferred)] if bytes_transferred is not None else []
    return F.coalesce(*first, *found, F.lit(0).cast("bigint"))


def event_bucket(params: Column, target: Column) -> Column:
    """Bucket name from the parameters, else from the target."""
    named = blank_to_null(json_field(params, "bucketName"))
    bare = F.regexp_replace(blank_to_null(target), "^arn:aws:s3:::", "")
    return F.coalesce(named, F.substring_index(bare, "/", 1))


def service_action(event: Column, event_source: Column) -> Column:
    """``service:Action`` from the event source, else inferred for the known APIs, else the bare name."""
    service = F.lower(F.substring_index(blank_to_null(event_source), ".", 1))
    return (F.when(service.isNotNull(), F.concat(service, F.lit(":"), event)).when(F.contains(event, F.lit(":")), event)
            .when(event.isin(fixed.S3_APIS), F.concat(F.lit("s3:"), event)).when(event.isin(fixed.IAM_APIS), F.concat(F.lit("iam:"), event))
            .when(event == "AssumeRole", "sts:AssumeRole").otherwise(event))


def policy_is_public(policy: Column) -> Column:
    """An allow statement for everyone. The document may be an object or URL-encoded text."""
    doc = F.coalesce(F.when(F.startswith(policy, F.lit("%")), F.try_url_decode(policy)), policy)
    parsed = F.transform(json_list(json_field(doc, "Statement")), lambda s: F.from_json(s, "Effect STRING, Principal STRING"))

    def public(s: Column) -> Column:
        named = json_list(json_field(s["Principal"], "AWS"))
        return (F.lower(s["Effect"]) == "allow") & ((s["Principal"] == "*") | F.array_contains(named, "*"))

    return F.coalesce(F.exists(parsed, public), F.lit(False))


def public_access_changes(events: DataFrame) -> DataFrame:
    """Events that weaken public access through one of the four API calls.

    The request is parsed once and staged, so each test reads a column instead of parsing again. Only an explicit
    ``false`` counts as a setting switched off.
    """
    calls = ["DeletePublicAccessBlock", "PutPublicAccessBlock", "PutBucketAcl", "PutBucketPolicy"]
    field = lambda n: F.try_element_at("_fields", F.lit(n))
    names = "|".join(n + "|" + n[0].lower() + n[1:] for n in fixed.BLOCK_SETTINGS)
    e = events.filter(F.col("event").isin(calls)).withColumn("_fields", F.from_json("params", "map<string, string>"))
    e = e.withColumn("_config", F.coalesce(field("PublicAccessBlockConfiguration"), field("publicAccessBlockConfiguration"), F.to_json(F.try_parse_json("params"))))
    e = e.withColumn("_acl", F.lower(F.coalesce(blank_to_null(field("ACL")), blank_to_null(field("acl")), blank_to_null(field("x-amz-acl")))))
    e = e.withColumn("_policy", F.coalesce(field("bucketPolicy"), field("policy")))
    weak = (F.when(F.col("event") == "DeletePublicAccessBlock", True)
            .when(F.col("event") == "PutPublicAccessBlock", F.col("_config").rlike(f'"(?:{names})":false'))
            .when(F.col("event") == "PutBucketAcl", F.coalesce(F.col("_acl").isin(fixed.PUBLIC_ACLS), F.lit(False)) | F.col("params").rlike("AllUsers|AuthenticatedUsers"))
            .when(F.col("event") == "PutBucketPolicy", policy_is_public(F.col("_policy"))))
    # a null test means the call did not weaken anything
    return e.filter(F.coalesce(weak, F.lit(False))).drop("_fields", "_config", "_acl", "_policy")


# ---------------------------------------------------------------- object store

def s3_profile(history: DataFrame) -> DataFrame:
    """Daily read profile per principal: mean and population deviation of count and bytes, regions, days seen.

    Two aggregates, both with map-side partials; the region set is bounded by the number of regions.
    """
    reads = history.filter("event = 'GetObject'")
    daily = reads.groupBy("principal", F.floor(F.col("us") / DAY).alias("day")).agg(
        F.count("*").alias("gets"), F.sum("bytes").alias("bytes"), F.collect_set(blank_to_null(F.col("region"))).alias("regions"))
    return daily.groupBy("principal").agg(
        F.avg("gets").alias("daily_get_mean"), F.stddev_pop("gets").alias("daily_get_std"),
        F.avg("bytes").alias("daily_bytes_mean"), F.stddev_pop("bytes").alias("daily_bytes_std"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("regions")))).alias("regions"), F.count("*").alias("samples"))


def s3_activity(events: DataFrame) -> DataFrame:
    """Reads of the batch per principal with the latest event as anchor."""
    scope = _scope(events)
    anchor = [c for c in ANCHOR if c != "principal"]
    # among equally late events the first arrival is the anchor
    return (events.filter("event = 'GetObject'").groupBy(*scope, "principal").agg(
        F.count("*").alias("get_count"), F.sum("bytes").alias("bytes"),
        F.array_sort(F.collect_set(blank_to_null(F.col("region")))).alias("seen_regions"),
        F.max_by(F.struct(*anchor), F.struct(F.col("us"), -F.col("seq"))).alias("a")))


def s3_exfiltration(events: DataFrame, profile: DataFrame, sigma: float = 3.0, minimum_get_delta: int = 20,
                    minimum_byte_delta: int = 50 * MIB) -> DataFrame:
    """Count, volume and region deviations against the daily profile; principals without a profile are skipped."""
    scope = _scope(events)
    d = s3_activity(events).join(profile, "principal")
    count_limit = F.greatest(F.col("daily_get_mean") + sigma * F.col("daily_get_std"), F.col("daily_get_mean") + minimum_get_delta)
    byte_limit = F.greatest(F.col("daily_bytes_mean") + sigma * F.col("daily_bytes_std"), F.col("daily_bytes_mean") + minimum_byte_delta)
    new_regions = F.array_except("seen_regions", "regions")
    reasons = F.filter(F.array(
        F.when(F.col("get_count") > count_limit, F.to_json(F.struct(
            F.lit("getobject_volume_anomaly").alias("type"), F.col("get_count").alias("observed"),
            F.col("daily_get_mean").alias("baseline_mean"), count_limit.alias("threshold")))),
        F.when(F.col("bytes") > byte_limit, F.to_json(F.struct(
            F.lit("byte_volume_anomaly").alias("type"), F.col("bytes").alias("observed_bytes"),
            F.col("daily_bytes_mean").alias("baseline_mean_bytes"), byte_limit.alias("threshold_bytes")))),
        F.when((F.size(new_regions) > 0) & (F.size("regions") > 0), F.to_json(F.struct(
            F.lit("cross_region_access").alias("type"), new_regions.alias("new_regions"), F.col("regions").alias("known_regions"))))),
        lambda r: r.isNotNull())
    hits = d.withColumn("reasons", reasons).filter(F.size("reasons") > 0)
    evidence = F.concat(F.lit('{"reasons":['), F.array_join("reasons", ","), F.lit('],"get_count":'), F.col("get_count").cast("string"),
                        F.lit(',"bytes":'), F.col("bytes").cast("string"), F.lit("}"))
    return hits.select(*scope, "principal", "a.*", "reasons", evidence.alias("_ev")).select(*scope, *detection_columns(
        F.lit("m8-s3-exfil-anomaly"), F.lit(0.8),
        F.concat("principal", F.lit(" showed "), F.size("reasons").cast("string"), F.lit(" S3 exfiltration indicator(s)")), F.col("_ev"), stage=5))


def sensitive_public_access(events: DataFrame, sensitive_buckets: DataFrame) -> DataFrame:
    """Public-access weakening on a sensitive bucket (``sensitive_buckets(bucket)``)."""
    e = public_access_changes(events).withColumn("bucket", event_bucket(F.col("params"), F.col("target")))
    e = e.join(sensitive_buckets.select("bucket").distinct(), "bucket", "left_semi")
    return e.select(*_scope(events), *detection_columns(
        F.lit("m8-s3-sensitive-public-access"), F.lit(0.9), F.concat("event", F.lit(" may expose sensitive bucket "), "bucket"),
        F.to_json(F.struct("bucket", F.col("event").alias("action"))), stage=4))


# ---------------------------------------------------------------- least privilege

def unused_grants(grants: DataFrame, usage: DataFrame, as_of_us: Column | None = None, lookback_days: int = 30,
                  ignore_conditional: bool = True) -> DataFrame:
    """Allow grants without a matching call in the look-back window, one row each.

    ``grants`` from :func:`graph.effective_grants`; ``usage(principal, action, us)``. Distinct observed actions meet
    distinct grant patterns once, by literal prefix, then the used grants are removed with an anti join.
    """
    if lookback_days <= 0:
        raise ValueError("lookback_days must be > 0")
    limit = usage.agg(F.max("us")).scalar() if as_of_us is None else as_of_us
    seen = usage.filter((F.col("us") >= limit - lookback_days * DAY) & (F.col("us") <= limit)).select("principal", "action").distinct()
    g = grants.filter(F.lower("effect") == "allow")
    if ignore_conditional:
        g = g.filter(~F.col("conditional"))
    pattern = g.select("principal", "ord", F.explode("actions").alias("pattern"))
    negated = pattern.filter(F.col("pattern").startswith("NOT ")).select("principal", "ord")
    pairs = match_globs(seen, "action", pattern, "pattern", ignore_case=True)
    # from the calls that happened to the patterns they satisfy, then to the grants of the same principal
    used = seen.join(pairs, "action").join(pattern, ["principal", "pattern"]).select("principal", "ord")
    return g.join(used.unionByName(negated).distinct(), ["principal", "ord"], "left_anti")


def unused_grant_detections(unused: DataFrame, usage: DataFrame, as_of_us: Column | None = None, lookback_days: int = 30) -> DataFrame:
    """One finding per principal; the unused grants themselves stay rows of :func:`unused_grants`."""
    limit = usage.agg(F.max("us")).scalar() if as_of_us is None else as_of_us
    per = unused.groupBy("principal").agg(F.count("*").alias("n")).withColumn("_us", limit)
    return unanchored(per, F.concat_ws("|", F.lit("m8-least-privilege-unused"), "principal"), "m8-least-privilege-unused", F.lit(0.45),
                      F.concat("principal", F.lit(" has "), F.col("n").cast("string"),
                               F.lit(f" effective grant(s) with no matching use in the last {lookback_days} days")),
                      F.to_json(F.struct(F.lit(lookback_days).alias("lookback_days"), F.col("n").alias("unused_grants"))), F.col("_us"), stage=6)


def new_path_detections(paths: DataFrame, observed_us: Column) -> DataFrame:
    """Findings for the escalation paths returned by :func:`escalation.new_paths`."""
    return unanchored(paths, F.concat_ws("|", F.lit("m8-new-privesc-path"), "principal", "target"), "m8-new-privesc-path",
                      F.when(F.col("conditional"), 0.65).otherwise(0.8),
                      F.concat(F.lit("new path from "), "principal", F.lit(" to "), "target_priv"),
                      F.to_json(F.struct("target", "target_priv", "conditional", "techniques", "hops")), observed_us, stage=7)


# ---------------------------------------------------------------- trust policies

def _account_of(principal: Column) -> Column:
    part = F.try_element_at(F.split(principal, ":"), F.lit(5))
    return F.when(principal.rlike("^[0-9]{12}$"), principal).when(part.rlike("^[0-9]+$"), part)


def trust_drift(policies: DataFrame, allowed_accounts: DataFrame | None = None) -> DataFrame:
    """Risky changes per role, one row each: (role, type, principal, detail).

    ``policies(account, role, before, after)`` holds policy documents as JSON or URL-encoded JSON. Reported: added
    wildcard principals, added principals of other accounts, and conditions dropped from a statement whose effect,
    actions and principals stayed the same.
    """
    def decoded(c: str) -> Column:
        return F.when(F.ltrim(c).startswith("{"), F.col(c)).otherwise(F.try_url_decode(c))

    docs = policies.select("account", "role", decoded("before").alias("before"), decoded("after").alias("after"))
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("doc")), F.struct(F.lit(1).alias("side"), F.col("after").alias("doc"))))
    s = parse_statements(docs.select("account", "role", side.alias("d")).select("account", "role", "d.*"), "doc", ["account", "role", "side"])
    names = F.array_sort(F.array_distinct(trust_names(F.col("principal_json"), "AWS")))
    s = s.select("account", "role", "side", "stmt_ord", "effect", F.array_sort("actions").alias("actions"), names.alias("names"), "condition_json")

    by_name = s.select("account", "role", "side", F.explode("names").alias("principal")).distinct()
    added = by_name.filter("side = 1").join(by_name.filter("side = 0"), ["account", "role", "principal"], "left_anti")
    other = _account_of(F.col("principal"))
    added = added.withColumn("other", F.when(F.col("principal") != "*", other))
    if allowed_accounts is not None:
        ok = allowed_accounts.select(F.col("account").alias("other")).distinct().withColumn("_ok", F.lit(True))
        added = added.join(ok, "other", "left").filter("_ok IS NULL").drop("_ok")
    opened = added.filter((F.col("principal") == "*") | (F.col("other") != F.col("account"))).select(
        "account", "role", F.when(F.col("principal") == "*", "wildcard_principal").otherwise("external_account").alias("type"), "principal",
        F.col("other").alias("detail"))

    # condition atoms per subject; the last statement of a subject counts before, every one of them after
    subject = ["account", "role", "effect", "actions", "names"]
    body = F.from_json("condition_json", "map<string, map<string, string>>")
    atom = s.select(*subject, "side", "stmt_ord", body.alias("body"))
    last = atom.filter("side = 0").groupBy(*subject).agg(F.max_by("body", "stmt_ord").alias("body"))

    def atoms(df: DataFrame, keep: list[str]) -> DataFrame:
        a = df.select(*keep, F.explode("body").alias("op", "m")).select(*keep, "op", F.explode("m").alias("name", "v"))
        return a.select(*keep, "op", "name", F.explode(json_list(F.col("v"))).alias("value"))

    old = atoms(last, subject)
    new = atom.filter("side = 1").select(*subject, "stmt_ord")
    kept = atoms(atom.filter("side = 1"), [*subject, "stmt_ord"])
    lost = old.join(new, subject).join(kept, [*subject, "stmt_ord", "op", "name", "value"], "left_anti")
    dropped = lost.select("account", "role", F.lit("condition_dropped").alias("type"), F.array_join("names", ",").alias("principal"),
                          F.concat_ws(" ", F.col("stmt_ord").cast("string"), "op", "name", "value").alias("detail"))
    return opened.unionByName(dropped)


def trust_drift_detections(changes: DataFrame, events: DataFrame | None = None, observed_us: Column | None = None) -> DataFrame:
    """One finding per role, anchored on the changing event where ``events`` (with a ``role`` column) has it."""
    # all dropped conditions of one statement are one risky change
    stmt = F.when(F.col("type") == "condition_dropped", F.substring_index("detail", " ", 1))
    unit = changes.select("account", "role", "type", "principal", stmt.alias("stmt")).distinct()
    per = unit.groupBy("account", "role").agg(F.count("*").alias("n"))
    message = F.concat(F.lit("trust policy for "), "role", F.lit(" introduced "), F.col("n").cast("string"), F.lit(" risky change(s)"))
    evidence = F.to_json(F.struct(F.col("role").alias("role_arn"), F.col("n").alias("changes")))
    if events is not None:
        anchored = per.drop("account").join(events, "role")
        return anchored.select(*_scope(events), *detection_columns(F.lit("m8-backdoor-trust-policy"), F.lit(0.9), message, evidence, stage=8))
    return unanchored(per.withColumn("principal", F.lit(None).cast("string")), F.concat_ws("|", F.lit("m8-backdoor-trust-policy"), "role"),
                      "m8-backdoor-trust-policy", F.lit(0.9), message, evidence, observed_us, stage=8, account=F.col("account"))
