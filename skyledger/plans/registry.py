"""Registered queries and their reference SQL. Names start with the operator they cover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import tactic_of, utc_clock
from skyledger.functions.sliced import with_global_number
from skyledger.operators import behaviour, cases, chain, context, escalation, exposure, graph, metrics, normalise, ranking, rules, views
from skyledger.plans import oracle as o
from skyledger.plans.oracle import BURST_MIN, BURST_N, TRAVEL_MIN, compose
from skyledger.plans.shared_views import ACCOUNT, IAM, SPLIT_US
from skyledger.plans.workspace import Workspace, workspace
from skyledger.session import checkpoint_root, cut_lineage
from skyledger.sources import audit, sinks, store
from skyledger.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(fn: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(workspace(spark, folder))
        if sql is not None:
            ORACLE[name] = compose(sql)
        return fn
    return keep


# ================================================================ sources and normalisation

def _audit_json(w: Workspace) -> DataFrame:
    """The events as audit records in JSON text, the way the lookup API hands them over."""
    kind = F.when(F.col("principal_type") == "assumed_role", "AssumedRole").when(F.col("principal_type") == "root", "Root").otherwise("IAMUser")
    ident = F.struct(kind.alias("type"), F.when(F.col("k") % 9 != 0, F.col("principal")).otherwise("").alias("arn"), F.col("account").alias("accountId"),
                     F.when(F.col("k") % 18 == 0, "svc.amazonaws.com").alias("invokedBy"),
                     F.when(F.col("issuer").isNotNull(), F.struct(F.struct(F.lit("Role").alias("type"), F.col("issuer").alias("arn")).alias("sessionIssuer"),
                            F.struct(F.when(F.col("mfa"), " TRUE ").otherwise("false").alias("mfaAuthenticated")).alias("attributes"))).alias("sessionContext"))
    arn = F.when(F.col("k") % 4 == 0, F.array(F.struct(F.lit("").alias("ARN")), F.struct(F.col("target").alias("ARN"))))
    rec = F.struct(F.col("event_id").alias("eventID"), F.date_format(utc_clock("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"),
                   F.col("event").alias("eventName"), F.col("event_source").alias("eventSource"), F.col("region").alias("awsRegion"), F.col("src_ip").alias("sourceIPAddress"),
                   F.col("user_agent").alias("userAgent"), F.col("read_only").alias("readOnly"), ident.alias("userIdentity"), arn.alias("resources"),
                   F.struct(F.col("bytes").alias("bytesTransferred")).alias("additionalEventData"))
    text = F.to_json(rec)
    # request parameters keep their own JSON text; a nested roleName object must be skipped for the string that follows
    body = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"requestParameters":{"roleArn":{"x":1},"bucketName":"bkt'), F.col("k").cast("string"), F.lit('"}}'))
    return w.events.select("seq", body.alias("CloudTrailEvent"), F.col("event_id").alias("EventId"), "account")


@register("N1_normalise_audit_records", """
SELECT event_id, us, account AS account, region, event, CASE WHEN k % 18 = 0 THEN 'svc.amazonaws.com' WHEN k % 9 = 0 THEN account ELSE principal END AS principal,
  principal_type, CASE WHEN k % 4 = 0 AND target IS NOT NULL THEN target ELSE 'bkt' || k END AS target, src_ip, (issuer IS NOT NULL AND mfa) AS mfa, issuer AS issuer_arn,
  read_only, event_source, bytes AS bytes_transferred FROM ev""")
def n1(w):
    ev = normalise.normalise_audit(audit.records_from_json_column(_audit_json(w)))
    return ev.select("event_id", "us", "account", "region", "event", "principal", "principal_type", "target", "src_ip", "mfa",
                     F.col("session.issuer_arn").alias("issuer_arn"), "read_only", "event_source", "bytes_transferred")


@register("S3_queue_messages", """
SELECT CASE k % 3 WHEN 0 THEN 'eventbridge://m' || seq WHEN 1 THEN 'sqs://raw#' || event_id ELSE 'sqs://raw#' || event_id END AS raw_ref, event_id, event FROM ev""")
def s3_messages(w):
    rec = F.to_json(F.struct(F.col("event_id").alias("eventID"), F.col("event").alias("eventName")))
    body = (F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"id":"m'), F.col("seq").cast("string"), F.lit('","detail-type":"AWS API Call","detail":'), rec, F.lit("}")))
            .when(F.col("k") % 3 == 1, F.concat(F.lit('{"Records":['), rec, F.lit("]}"))).otherwise(rec))
    out = audit.records_from_messages(w.events.select(body.alias("body")))
    return out.select("raw_ref", F.col("record.eventID").alias("event_id"), F.col("record.eventName").alias("event"))


@register("S3_announced_objects", "SELECT 'logs' || (k % 7) AS bucket, 'day/' || event_id || '.json.gz' AS key FROM ev")
def s3_objects(w):
    body = F.concat(F.lit('{"Records":[{"s3":{"bucket":{"name":"logs'), (F.col("k") % 7).cast("string"), F.lit('"},"object":{"key":"day/'), F.col("event_id"), F.lit('.json.gz"}}}]}'))
    return audit.notified_objects(w.events.select(body.alias("body")))


def finding_json(w: Workspace) -> DataFrame:
    """(seq, item): the events as findings in JSON text."""
    ip = F.struct(F.col("src_ip").alias("IpAddressV4"), F.struct(F.when(F.col("k") % 2 == 0, F.col("asn")).otherwise(F.substring("asn", 3, 10)).alias("Asn")).alias("Organization"),
                  F.struct(F.col("geo").alias("CountryName")).alias("Country"))
    details = F.struct(ip.alias("RemoteIpDetails"))
    action = F.struct(F.when(F.col("k") % 3 == 0, details).alias("AwsApiCallAction"), F.when(F.col("k") % 3 == 1, details).alias("NetworkConnectionAction"),
                      F.when(F.col("k") % 3 == 2, details).alias("PortProbeAction"))
    time = F.date_format(utc_clock("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    finding = F.to_json(F.struct(
        F.col("account").alias("AccountId"), F.col("region").alias("Region"), F.concat(F.lit("Recon:"), "event").alias("Type"), F.col("event_id").alias("Id"), F.col("severity").alias("Severity"),
        F.struct(F.struct(F.when(F.col("k") % 3 == 0, F.concat(F.lit("u"), F.col("uid").cast("string"))).alias("UserName"),
                          F.concat(F.lit("AIDA"), F.col("uid").cast("string")).alias("PrincipalId")).alias("AccessKeyDetails"),
                 F.struct(F.when(F.col("k") % 3 == 1, F.concat(F.lit("i-"), F.col("uid").cast("string"))).alias("InstanceId")).alias("InstanceDetails")).alias("Resource"),
        F.when(F.col("k") % 2 == 0, time).alias("UpdatedAt"), time.alias("CreatedAt"), F.struct(action.alias("Action")).alias("Service")))
    return w.events.select("seq", finding.alias("item"))


@register("N7_normalise_findings", """
SELECT event_id, us, 'Recon:' || event AS event, CASE WHEN k % 3 = 0 THEN 'arn:aws:iam::' || account || ':user/u' || uid WHEN k % 3 = 1 THEN 'i-' || uid ELSE 'AIDA' || uid END AS principal,
  CASE WHEN k % 3 = 0 THEN 'user' ELSE 'unknown' END AS principal_type, src_ip, asn, geo, severity FROM ev""")
def n7(w):
    raw = finding_json(w).select(audit.parse_finding(F.col("item")).alias("record"), F.lit("r").alias("raw_ref"), F.lit("guardduty").alias("source"))
    return normalise.normalise_findings(raw).select("event_id", "us", "event", "principal", "principal_type", "src_ip", "asn", "geo", "severity")


@register("N12_dedup", "SELECT source, event_id, seq, principal, us FROM ev")
def n12(w):
    twice = w.events.unionByName(w.events.withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("principal", F.lit("late copy")))
    return normalise.dedup(twice.select("source", "event_id", "seq", "principal", "us"), ["seq"])


@register("E1_geo_lookup", """
SELECT e.event_id, CASE WHEN k % 3 = 0 THEN coalesce(g.asn) ELSE e.asn END AS asn, CASE WHEN k % 3 = 1 THEN g.geo WHEN k % 3 = 0 AND k % 2 = 0 THEN g.geo ELSE e.geo END AS geo
FROM ev e LEFT JOIN (SELECT src_ip, max(asn) AS asn, max(geo) AS geo FROM hist GROUP BY src_ip) g ON e.src_ip = g.src_ip""")
def e1(w):
    table = w.history.groupBy("src_ip").agg(F.max("asn").alias("asn"), F.max("geo").alias("geo"))
    ev = (w.events.withColumn("asn", F.when(F.col("k") % 3 != 0, F.col("asn")))
          .withColumn("geo", F.when(F.col("k") % 3 == 1, None).when((F.col("k") % 3 == 0) & (F.col("k") % 2 == 0), "").otherwise(F.col("geo"))))
    return normalise.enrich_geo(ev, table).select("event_id", "asn", "geo")


@register("E2_longest_prefix_sensitivity", """
SELECT e.event_id, coalesce((SELECT arg_max(sensitivity, length(arn)) FROM resource r WHERE starts_with(e.target, r.arn)), 'unknown') AS resource_sensitivity FROM ev e""")
def e2(w):
    ev = w.events.withColumn("resource_sensitivity", F.lit("unknown"))
    return normalise.enrich_sensitivity(ev, w.view("resource").select("arn", "sensitivity")).select("event_id", "resource_sensitivity")


@register("E3_sensitivity_from_tags", "SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 'unknown' WHEN p_size > 25 THEN 'high' ELSE 'low' END AS sensitivity FROM part")
def e3(w):
    from skyledger.sources.snapshots import sensitivity
    tag = F.when(F.col("p_type") == "LARGE", "Bogus").when(F.col("p_size") > 25, "HIGH").otherwise("Low")
    return w.table("part").select("p_partkey", sensitivity(F.create_map(F.lit("Sensitivity"), tag)).alias("sensitivity"))


# ================================================================ rules

_DET = "det_id, key, confidence, us, principal, src_ip, event_id, event_name, message"


def _flat(d: DataFrame) -> DataFrame:
    return d.select("det_id", "key", "confidence", "us", "principal", "src_ip", "event_id", "event_name", "message")


@register("F8_rule_matches", f"SELECT {_DET} FROM ({o.signatures('ev')})")
def f8(w):
    return _flat(rules.match_rules(w.events))


def _rule(rule: dict):
    @register(f"R_{rule['id'].replace('-', '_')}", f"SELECT event_id, principal, region FROM ev WHERE {o.RULE_SQL[rule['id']]}")
    def one(w):
        return rules.match_rules(w.events, [rule]).select("event_id", "principal", "region")


for _r in fixed.RULES:
    _rule(_r)

MATCHING_RULES = [
    {"id": "t-contains", "attack": "T1580", "detection": {"a": {"user_agent|contains": "CLICK"}}},
    {"id": "t-edges", "attack": "T1580", "detection": {"a": {"event|startswith": "list", "principal|endswith": ["7", "9"]}, "condition": "a"}},
    {"id": "t-re", "attack": "T1580", "detection": {"a": {"principal|re": "user/u[0-9]$"}, "condition": "a"}},
    {"id": "t-cidr", "attack": "T1580", "detection": {"a": {"src_ip|cidr": "10.0.12.5/22"}, "condition": "a"}},
    {"id": "t-number", "attack": "T1580", "detection": {"a": {"severity": 2}, "b": {"params.k": [20, 30]}, "condition": "a or b"}},
    {"id": "t-quantifier", "attack": "T1580", "detection": {"sel_a": {"geo": "de"}, "sel_b": {"mfa": True}, "other": {"region": "us-east-1"}, "condition": "all of sel* and not other"}},
    {"id": "t-any", "attack": "T1580", "detection": {"x": [{"geo": "FR", "read_only": False}, {"geo": "SG", "mfa": False}], "y": {"event": "PutObject"}, "condition": "1 of them and not (y or ghost)"}},
    {"id": "t-null", "attack": "T1580", "detection": {"a": {"error_code": "x"}, "b": {"read_only": False}, "condition": "not a and not b"}},
    {"id": "t-params", "attack": "T1580", "detection": {"a": {"params|contains": '"note": "a<b & C"'}, "b": {"params.k|startswith": "7"}, "condition": "a and b"}},
]
_plain = "params LIKE '{\"k\":%'"


@register("F7_rule_conditions", f"""
SELECT 't-contains' AS key, event_id FROM ev WHERE lower(user_agent) LIKE '%click%'
UNION ALL SELECT 't-edges', event_id FROM ev WHERE lower(event) LIKE 'list%' AND (principal LIKE '%7' OR principal LIKE '%9')
UNION ALL SELECT 't-re', event_id FROM ev WHERE regexp_matches(principal, 'user/u[0-9]$')
UNION ALL SELECT 't-cidr', event_id FROM ev WHERE CAST(split_part(src_ip, '.', 3) AS INT) BETWEEN 12 AND 15 OR src_ip LIKE '10.0.12.%'
UNION ALL SELECT 't-number', event_id FROM ev WHERE severity = 2 OR ({_plain} AND k IN (20, 30))
UNION ALL SELECT 't-quantifier', event_id FROM ev WHERE geo = 'DE' AND mfa AND region <> 'us-east-1'
UNION ALL SELECT 't-any', event_id FROM ev WHERE ((geo = 'FR' AND coalesce(NOT read_only, false)) OR (geo = 'SG' AND NOT mfa) OR event = 'PutObject') AND event <> 'PutObject'
UNION ALL SELECT 't-null', event_id FROM ev WHERE read_only OR read_only IS NULL
UNION ALL SELECT 't-params', event_id FROM ev WHERE {_plain} AND (k = 7 OR k BETWEEN 70 AND 79)""")
def f7(w):
    return rules.match_rules(w.events, MATCHING_RULES).select("key", "event_id")


@register("F9_F10_F11_derived_flags", f"""
SELECT event_id, CASE WHEN event = 'AuthorizeSecurityGroupIngress' THEN {o.RULE_SQL['ec2-sg-open-world'].split(' AND ', 1)[1]} END AS sg_opens_world,
  CASE WHEN event = 'UpdateAssumeRolePolicy' THEN regexp_matches(params, '999988887777|"[*]"') END AS external_trust_added,
  CASE WHEN event = 'RunInstances' THEN {o._big} END AS gpu_or_large_instance FROM ev""")
def f9(w):
    d = rules.derived_indicators()
    return w.events.select("event_id", *[c.alias(n) for n, c in d.items()])


@register("F13_detection_tactics", f"""
SELECT det_id, array_to_string(list(DISTINCT tactic ORDER BY tactic), ',') AS tactics, array_to_string(list(technique ORDER BY technique), ',') AS techniques FROM det JOIN kt USING (key) GROUP BY det_id""")
def f13(w):
    d = rules.describe(w.detections)
    return d.select("det_id", F.array_join(F.sort_array("tactics"), ",").alias("tactics"), F.array_join(F.sort_array("attack_ids"), ",").alias("techniques"))


# ================================================================ behaviour

@register("B1_profile_members", " UNION ALL ".join(
    f"SELECT principal, '{f}' AS facet, {c} AS value, count(*) AS events FROM ev WHERE {c} <> '' GROUP BY principal, {c}" for f, c in behaviour.FACETS.items()))
def b1(w):
    return behaviour.profile_members(w.events)


@register("B1_profile_summary", """SELECT principal, count(DISTINCT region) AS n_region, count(DISTINCT geo) AS n_country, count(DISTINCT asn) AS n_asn, count(DISTINCT src_ip) AS n_src_ip,
  count(DISTINCT event) AS n_action, count(*) AS event_count FROM ev GROUP BY principal""")
def b1s(w):
    return behaviour.profile_summary(w.events)


@register("B4_new_geo", f"SELECT {_DET} FROM newgeo")
def b4(w):
    return _flat(behaviour.new_geo(w.current, behaviour.known_countries(w.history)))


@register("B5_automation_iam_writes", f"SELECT {_DET} FROM ({o.automation('ev')})")
def b5(w):
    return _flat(behaviour.automation_iam_writes(w.events))


@register("B5_automation_allow_list", f"""SELECT event_id, principal, event FROM ev WHERE event IN {o._in(fixed.IAM_WRITES)} AND (regexp_matches(lower(principal || ' ' || coalesce(issuer, '')), '{o._tokens}')
  OR principal IN (SELECT principal FROM hist WHERE event = 'StopLogging') OR issuer IN (SELECT principal FROM hist WHERE event = 'StopLogging'))""")
def b5l(w):
    listed = w.history.filter("event = 'StopLogging'").select("principal")
    return behaviour.automation_iam_writes(w.events, listed).select("event_id", "principal", F.col("event_name").alias("event"))


@register("B6_impossible_travel", f"SELECT {_DET} FROM ({o.travel('ev')})")
def b6(w):
    return _flat(behaviour.impossible_travel(w.events, TRAVEL_MIN))


@register("B7_enumeration_bursts", f"SELECT {_DET}, names FROM ({o.bursts('ev')})")
def b7(w):
    d = behaviour.enumeration_bursts(w.events, BURST_MIN, BURST_N)
    names = F.array_join(F.from_json("evidence", "distinct_actions ARRAY<STRING>")["distinct_actions"], ",")
    return _flat(d).join(d.select("det_id", names.alias("names")), "det_id")


@register("B8_behaviour_union", f"SELECT {_DET} FROM (SELECT * FROM newgeo UNION ALL SELECT * FROM autow UNION ALL SELECT * FROM travel UNION ALL SELECT * EXCLUDE (names) FROM burst)")
def b8(w):
    return _flat(behaviour.behaviour_detections(w.current, behaviour.known_countries(w.history), **w.behaviour_options()))


# ================================================================ object store, least privilege, trust drift

_PROFILE = """SELECT principal, round(avg(gets), 6) AS daily_get_mean, round(stddev_pop(gets), 6) AS daily_get_std, round(avg(bytes), 3) AS daily_bytes_mean, round(stddev_pop(bytes), 3) AS daily_bytes_std, count(*) AS samples
  FROM (SELECT principal, us // 86400000000 AS d, count(*) AS gets, sum(bytes) AS bytes FROM hist WHERE event = 'GetObject' GROUP BY ALL) GROUP BY principal"""


@register("B9_s3_profile", _PROFILE)
def b9(w):
    p = exposure.s3_profile(w.history)
    return p.select("principal", *[F.round(c, n).alias(c) for c, n in (("daily_get_mean", 6), ("daily_get_std", 6), ("daily_bytes_mean", 3), ("daily_bytes_std", 3))], "samples")


@register("B10_s3_exfiltration", f"SELECT {_DET} FROM exfil")
def b10(w):
    return _flat(exposure.s3_exfiltration(w.current, exposure.s3_profile(w.history), 3.0, 5, 400_000_000))


@register("B11_sensitive_public_access", f"SELECT {_DET} FROM ({o.public_access('ev')})")
def b11(w):
    return _flat(exposure.sensitive_public_access(w.events, w.sensitive_buckets))


@register("B13_B14_bytes_bucket_action", """
SELECT event_id, bytes, CASE WHEN target LIKE 'arn:aws:s3:::%' THEN regexp_extract(target, 'arn:aws:s3:::([^/]*)', 1) WHEN target IS NOT NULL THEN split_part(target, '/', 1) END AS bucket,
  CASE WHEN event_source IS NOT NULL THEN split_part(event_source, '.', 1) || ':' || event WHEN event = 'AssumeRole' THEN 'sts:AssumeRole' ELSE event END AS action FROM ev""")
def b13(w):
    e = w.events
    return e.select("event_id", exposure.event_bytes(F.to_json(F.struct(F.col("bytes").cast("string").alias("objectSize")))).alias("bytes"),
                    exposure.event_bucket(F.lit(None).cast("string"), F.col("target")).alias("bucket"), exposure.service_action(F.col("event"), F.col("event_source")).alias("action"))


_USAGE = "SELECT DISTINCT principal, CASE WHEN event_source IS NOT NULL THEN split_part(event_source, '.', 1) || ':' || event WHEN event = 'AssumeRole' THEN 'sts:AssumeRole' ELSE event END AS action FROM ev WHERE us >= (SELECT max(us) FROM ev) - 20 * 86400000000"


@register("B15_unused_grants", f"""
WITH u AS ({_USAGE}) SELECT principal, label AS source, array_to_string(actions, ',') AS actions FROM app a WHERE lower(effect) = 'allow' AND NOT conditional AND len(actions) > 0
AND NOT EXISTS (SELECT 1 FROM u WHERE u.principal = a.principal AND len(list_filter(a.actions, lambda p: lower(u.action) GLOB lower(p))) > 0)
UNION ALL SELECT principal, label, '' FROM app WHERE lower(effect) = 'allow' AND NOT conditional AND len(actions) = 0 AND len(not_actions) = 0""")
def b15(w):
    usage = w.events.select("principal", exposure.service_action(F.col("event"), F.col("event_source")).alias("action"), "us")
    g = exposure.unused_grants(graph.effective_grants(w.permissions, w.index), usage, lookback_days=20)
    return g.select("principal", "source", F.array_join("actions", ",").alias("actions"))


def _trust_docs(w: Workspace) -> DataFrame:
    """Before and after trust documents of every role, from supplier attributes."""
    role = F.concat(F.lit(f"{IAM}role/s"), F.col("s_suppkey").cast("string"))
    own = F.concat(F.lit(f'"{IAM}user/u'), F.col("s_nationkey").cast("string"), F.lit('"'))
    cond = F.lit(',"Condition":{"StringEquals":{"sts:ExternalId":["v1","v2"]},"Bool":{"aws:MultiFactorAuthPresent":"true"}}')
    doc = lambda who, c: F.concat(F.lit('{"Statement":[{"Effect":"Allow","Action":"sts:AssumeRole","Principal":{"AWS":['), who, F.lit("]}"), c, F.lit("}]}"))
    after_who = (F.when(F.col("s_acctbal") < 0, F.concat(own, F.lit(',"*"'))).when(F.col("s_nationkey") % 3 == 0, F.concat(own, F.lit(',"arn:aws:iam::999988887777:root"')))
                 .when(F.col("s_nationkey") % 3 == 1, F.concat(own, F.lit(f',"{ACCOUNT}"'))).otherwise(own))
    after_cond = F.when(F.col("s_nationkey") % 2 == 0, cond).otherwise(F.lit(',"Condition":{"StringEquals":{"sts:ExternalId":"v1"}}'))
    after = doc(after_who, after_cond)
    return w.table("supplier").select(F.lit(ACCOUNT).alias("account"), role.alias("role"), doc(own, cond).alias("before"),
                                      F.when(F.col("s_nationkey") % 5 == 0, F.url_encode(after)).otherwise(after).alias("after"))


@register("B17_trust_policy_drift", f"""
WITH s AS (SELECT '{IAM}role/s' || s_suppkey AS role, '{IAM}user/u' || s_nationkey AS own, s_acctbal < 0 AS star, s_nationkey AS n FROM supplier)
SELECT role, 'wildcard_principal' AS type, '*' AS principal, NULL AS detail FROM s WHERE star
UNION ALL SELECT role, 'external_account', 'arn:aws:iam::999988887777:root', '999988887777' FROM s WHERE NOT star AND n % 3 = 0
UNION ALL SELECT role, 'condition_dropped', own, '0 ' || d FROM s, (SELECT unnest(['StringEquals sts:ExternalId v2', 'Bool aws:MultiFactorAuthPresent true']) AS d) x WHERE NOT star AND n % 3 = 2 AND n % 2 = 1""")
def b17(w):
    return exposure.trust_drift(_trust_docs(w)).select("role", "type", "principal", "detail")


# ================================================================ correlation

@register("C1_links", f"""
SELECT kind, value, det_id, prev_det_id FROM (SELECT kind, value, det_id, us, lag(det_id) OVER w AS prev_det_id, lag(us) OVER w AS pu FROM keyed WINDOW w AS (PARTITION BY kind, value ORDER BY us, det_id)) WHERE us - pu <= {60 * o.MIN}""")
def c1(w):
    return cases.links(w.detections)


@register("C2_components", "SELECT count(*) AS n, min(det_id) AS first_det, max(det_id) AS last_det FROM comp GROUP BY comp")
def c2(w):
    return cases.assign_components(w.detections).groupBy("component").agg(F.count("*").alias("n"), F.min("det_id").alias("first_det"), F.max("det_id").alias("last_det")).drop("component")


_CASE = "case_id, n_detections, us_start, us_end, score, title, techniques"


@register("C8_cases", f"SELECT {_CASE} FROM cases")
def c8(w):
    return w.cases["case"].select("case_id", "n_detections", "us_start", "us_end", "score", "title", F.array_join("techniques", ",").alias("techniques"))


@register("C8_detection_run", f"SELECT {_DET} FROM det")
def c8d(w):
    return _flat(w.detections)


@register("C4_case_entities", "SELECT case_id, kind, value FROM ent")
def c4(w):
    return w.cases["case_entity"]


_ESC_TECH = "CASE WHEN hit THEN array_to_string(list_sort(list_distinct(list_append(string_split(techniques, ','), 'T1548'))), ',') ELSE techniques END"


@register("C7_escalation_enrichment", f"""
WITH h AS (SELECT DISTINCT case_id FROM ent JOIN paths p ON ent.kind = 'principal' AND ent.value = p.principal),
c AS (SELECT cases.*, case_id IN (SELECT case_id FROM h) AS hit FROM cases)
SELECT case_id, CASE WHEN hit THEN round(least(0.99, score + 0.1), 3) ELSE score END AS score, {_ESC_TECH} AS techniques FROM c""")
def c7(w):
    paths = w.paths
    out = cases.enrich_with_escalation(w.cases, paths)["case"]
    return out.select("case_id", "score", F.array_join("techniques", ",").alias("techniques"))


# ================================================================ graph and decisions

@register("G1_nodes", f"""
SELECT id, kind, label, ptype FROM (
 SELECT '{ACCOUNT}' AS id, 'Account' AS kind, '{ACCOUNT}' AS label, NULL AS ptype UNION SELECT arn, 'Policy', name, 'managed' FROM policy UNION SELECT arn, 'Principal', name, ptype FROM principal
 UNION SELECT principal || '#inline/' || policy_name, 'Policy', policy_name, 'inline' FROM inline_policy
 UNION SELECT who, 'Principal', who, CASE WHEN external THEN 'external' ELSE 'user' END FROM trust WHERE who NOT IN (SELECT arn FROM principal)
 UNION SELECT arn, 'Resource', arn, NULL FROM resource)""")
def g1(w):
    return graph.build_nodes(w.permissions).select("id", "kind", "label", "ptype")


@register("G2_G3_edges", f"""
SELECT 'HAS_POLICY' AS kind, principal AS src, policy AS dst, 'attached' AS detail FROM attachment UNION ALL SELECT 'HAS_POLICY', principal, principal || '#inline/' || policy_name, 'inline' FROM inline_policy
UNION ALL SELECT 'PERMISSION_BOUNDARY', arn, boundary, NULL FROM principal WHERE boundary IS NOT NULL UNION ALL SELECT 'MEMBER_OF', principal, grp.arn, NULL FROM membership JOIN grp ON grp.name = group_name
UNION ALL SELECT 'CAN_ASSUME', who, role, CASE WHEN external THEN 'true' ELSE 'false' END FROM trust UNION ALL SELECT 'OWNS_RESOURCE', '{ACCOUNT}', arn, NULL FROM resource""")
def g2(w):
    return graph.build_edges(w.permissions).select("kind", "src", "dst", F.coalesce("attachment", F.col("external").cast("string")).alias("detail"))


@register("G5_applicable_statements", "SELECT principal, label, effect, array_to_string(actions, ',') AS actions, array_to_string(resources, ',') AS resources, conditional FROM app")
def g5(w):
    a = graph.applicable_statements(w.permissions)
    return a.select("principal", "label", "effect", F.array_join("actions", ",").alias("actions"), F.array_join("resources", ",").alias("resources"), "conditional")


@register("G6_boundary_statements", """SELECT p.arn AS principal, p.boundary, s.effect, array_to_string(s.actions, ',') AS actions FROM principal p LEFT JOIN statement s ON s.owner = p.boundary AND s.owner_kind = 'policy' WHERE p.boundary IS NOT NULL""")
def g6(w):
    return graph.boundary_statements(w.permissions).select("principal", "boundary", "effect", F.array_join("actions", ",").alias("actions"))


@register("G7_glob_matches", """
SELECT DISTINCT a.action, p.pattern FROM (SELECT DISTINCT event_source || ':' || event AS action FROM ev WHERE event_source IS NOT NULL) a,
 (SELECT DISTINCT replace(unnest(actions), ':', '.amazonaws.com:') AS pattern FROM statement) p WHERE lower(a.action) GLOB lower(p.pattern)""")
def g7(w):
    acts = w.events.filter("event_source IS NOT NULL").select(F.concat("event_source", F.lit(":"), "event").alias("action"))
    pats = w.permissions["statement"].select(F.explode("actions").alias("p")).select(F.replace("p", F.lit(":"), F.lit(".amazonaws.com:")).alias("pattern"))
    return graph.match_globs(acts, "action", pats, "pattern", ignore_case=True)


_PROBE_ACTIONS = ["s3:GetObject", "s3:PutObject", "iam:CreatePolicyVersion", "iam:PutUserPolicy", "cloudtrail:StopLogging", "sts:AssumeRole", "s3:ListBucket"]
o.CTES["probe"] = (f"SELECT arn AS principal, unnest({_PROBE_ACTIONS}) AS action, 'arn:aws:s3:::b' || (ordinal % (SELECT count(*) FROM part)) AS resource FROM principal "
                   "UNION ALL SELECT principal, 'iam:CreatePolicyVersion', policy FROM attachment")
_DECISION = "principal, action, resource, effect, conditional, boundary_limited, reason, matched, potential_denies"


def _probes(w: Workspace) -> DataFrame:
    n = w.table("part").count()
    p = w.permissions["principal"].select(F.col("arn").alias("principal"), F.explode(F.array(*map(F.lit, _PROBE_ACTIONS))).alias("action"),
                                          F.concat(F.lit("arn:aws:s3:::b"), (F.col("ordinal") % n).cast("string")).alias("resource"))
    return p.unionByName(w.permissions["attachment"].select("principal", F.lit("iam:CreatePolicyVersion").alias("action"), F.col("policy").alias("resource")))


@register("G9_decisions", f"SELECT {_DECISION} FROM ({o.decisions('probe')})")
def g9(w):
    return graph.decide(_probes(w), w.permissions, w.index)


@register("G10_effective_grants", "SELECT principal, label AS source, lower(effect) = 'deny' AS is_deny, CASE WHEN len(actions) > 0 THEN array_to_string(actions, ',') ELSE array_to_string(list_transform(not_actions, lambda x: 'NOT ' || x), ',') END AS actions FROM app")
def g10(w):
    return graph.effective_grants(w.permissions, w.index).select("principal", "source", "is_deny", F.array_join("actions", ",").alias("actions"))


@register("G11_action_universe", f"SELECT DISTINCT action FROM (SELECT unnest(actions) AS action FROM statement WHERE owner_kind IN ('policy', 'principal') UNION SELECT unnest({fixed.SENSITIVE_ACTIONS})) WHERE contains(action, ':') AND NOT contains(action, '*')")
def g11(w):
    return graph.action_universe(w.permissions)


_ASKED = [*fixed.SENSITIVE_ACTIONS, "s3:ListBucket", "lambda:CreateFunction"]
o.CTES["p_group"] = (f"SELECT g.arn AS principal, a.action, r.arn AS resource FROM principal g, (SELECT unnest({_ASKED}) AS action) a, (SELECT arn FROM resource) r WHERE ptype = 'group'")


@register("G12_what_can_groups_do", f"SELECT principal, action, resource, conditional, matched FROM ({o.decisions('p_group')}) WHERE effect = 'ALLOW'")
def g12(w):
    who = w.permissions["principal"].filter("ptype = 'group'").select(F.col("arn").alias("principal"))
    acts = w.spark.createDataFrame([(a,) for a in _ASKED], "action STRING")
    res = w.permissions["resource"].select(F.col("arn").alias("resource"))
    d = graph.decide(graph.candidate_probes(who, acts, res, w.permissions, w.index), w.permissions, w.index)
    return d.filter("effect = 'ALLOW'").select("principal", "action", "resource", "conditional", "matched")


_WHO = ("s3:GetObject", "arn:aws:s3:::b17")
o.CTES["p_who"] = f"SELECT arn AS principal, '{_WHO[0]}' AS action, '{_WHO[1]}' AS resource FROM principal"


@register("G13_who_can", f"SELECT principal, effect, conditional, matched FROM ({o.decisions('p_who')}) WHERE effect <> 'IMPLICIT_DENY'")
def g13(w):
    return graph.who_can(*_WHO, w.permissions, w.index).select("principal", "effect", "conditional", "matched")


o.CTES["w_allowed"] = f"SELECT principal FROM ({o.decisions('p_who')}) WHERE effect = 'ALLOW'"
o.CTES["w_reach"] = ("SELECT who AS assumer, role FROM trust WHERE role IN (SELECT principal FROM w_allowed) UNION SELECT t.who, w.role FROM w_reach w JOIN trust t ON t.role = w.assumer")


@register("G14_reach_by_assumption", "SELECT DISTINCT assumer, role FROM w_reach WHERE assumer NOT IN (SELECT principal FROM w_allowed)")
def g14(w):
    return graph.who_can_via_assume(*_WHO, w.permissions, graph.build_edges(w.permissions))


# ================================================================ escalation

@register("P1_admin_principals", "SELECT principal FROM admins")
def p1(w):
    return escalation.admin_equivalent(graph.identity_statements(w.index))


@register("P7_escalation_edges", "SELECT kind, src, dst, array_to_string(ord, ',') AS ord, technique, conditional FROM esc")
def p7(w):
    e = escalation.escalation_edges(w.permissions, w.index)
    return e.select("kind", "src", "dst", F.concat_ws(",", F.transform("ord", lambda x: x.cast("string"))).alias("ord"), "technique", "conditional")


@register("P8_goals", "SELECT node, max(priv) AS target_priv FROM g_both GROUP BY node")
def p8(w):
    return escalation.goals(w.permissions, graph.identity_statements(w.index))


@register("P10_escalation_paths", "SELECT principal, target, target_priv, techniques, nodes, length, conditional FROM paths")
def p10(w):
    p = w.paths
    return p.select("principal", "target", "target_priv", F.array_join("techniques", ",").alias("techniques"),
                    F.array_join(F.transform("hops", lambda h: h["dst"]), ",").alias("nodes"), "length", "conditional")


@register("B16_new_paths", """SELECT principal, target, techniques FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths_before b WHERE b.principal = p.principal AND b.target = p.target
  AND b.target_priv = p.target_priv AND b.techniques = p.techniques AND b.nodes = p.nodes AND b.flags = p.flags)""")
def b16(w):
    after = w.paths
    earlier = w.permissions_before
    index = graph.statement_index(earlier)
    own, shared = escalation.escalation_parts(earlier, index)
    before = escalation.escalation_paths(earlier, cut_lineage(own), index, shared)
    return escalation.new_paths(before, after).select("principal", "target", F.array_join("techniques", ",").alias("techniques"))


# ================================================================ chains and ranking

@register("H1_case_events", "SELECT case_id, event_id FROM sel")
def h1(w):
    return chain.select_events(w.cases["case"], w.cases["case_entity"], w.current, o.PAD_MIN).select("case_id", "event_id")


@register("H3_step_classes", f"SELECT event_id, actor, {o.classify('event')} AS attack_id, coalesce({o.tactic(o.classify('event'))}, 'Unknown') AS tactic FROM cur")
def h3(w):
    c = chain.classify(F.col("event"))
    return w.current.select("event_id", chain.actor(F.col("principal"), F.col("principal_type"), F.col("session.issuer_arn")).alias("actor"), c.alias("attack_id"),
                            F.coalesce(tactic_of(c), F.lit("Unknown")).alias("tactic"))


@register("H8_chain_steps", "SELECT case_id, step_no, us, actor, raw_principal, action, attack_id, target, read_count FROM steps")
def h8(w):
    return w.chain["step"].select("case_id", "step_no", "us", "actor", "raw_principal", "action", "attack_id", "target", "read_count")


@register("H5_step_detections", "SELECT f.case_id, f.step_no, d.det_id FROM fold f JOIN sel s USING (case_id, rn) JOIN cdet d ON d.case_id = f.case_id AND d.event_id = s.event_id")
def h5(w):
    return w.chain["step_detection"].select("case_id", "step_no", "det_id")


@register("H7_step_edges", f"""
SELECT case_id, step_no, CASE WHEN attack_id = 'T1548' AND target <> '' AND (actor, target) IN (SELECT (who, role) FROM trust) THEN 'CAN_ASSUME ' || {o._tail('actor')} || ' -> ' || {o._tail('target')}
  WHEN attack_id = 'T1530' AND target <> '' AND (actor, target) IN (SELECT (src, dst) FROM esc WHERE kind = 'CAN_ACCESS') THEN 'CAN_ACCESS -> ' || {o._tail('target')}
  WHEN attack_id = 'T1098.003' THEN 'CAN_ESCALATE_VIA ' || (SELECT arg_min(technique, ord) FROM esc WHERE kind = 'CAN_ESCALATE_VIA' AND src = actor) END AS via_edge FROM steps""")
def h7(w):
    return w.chain["step"].select("case_id", "step_no", "via_edge")


@register("X4_blast_radius", "SELECT principal, reach_sensitive, reach_admin, privesc_available, current_privilege, blast FROM blast")
def x4(w):
    b = ranking.blast_radius(w.permissions, w.graph)
    return b.select("principal", "reach_sensitive", "reach_admin", "privesc_available", "current_privilege", "blast")


@register("X7_ranked_cases", "SELECT case_id, blast_principal, blast, score, rank FROM ranked")
def x7(w):
    return ranking.rank_cases(w.cases, w.chain["step"], w.blast).select("case_id", "blast_principal", "blast", "score", "rank")


o.CTES["capable"] = f"""
SELECT arn AS principal, arn IN (SELECT principal FROM admins) AS is_admin, arn IN (SELECT src FROM esc WHERE kind = 'CAN_ACCESS') AS read_sensitive,
  arn IN (SELECT principal FROM app WHERE lower(effect) = 'allow' AND NOT conditional AND (len(resources) > 0 OR len(not_resources) > 0) AND len(list_filter(actions, lambda x: lower(x) IN ('*', 'iam:*') OR regexp_matches(lower(x), '^iam:.*({o._verbs})'))) > 0) AS iam_write,
  arn IN (SELECT who FROM trust) AS can_assume FROM principal"""


def _shown(kind: str) -> str:
    """Text of one path: its hops with a mark on the conditional ones."""
    hops = "list_transform(range(1, length + 1), lambda i: string_split(techniques, ',')[i] || CASE WHEN flags[i] = '?' THEN '?' ELSE '' END)"
    return (f"SELECT principal, principal || '  ==' || array_to_string({hops}, '  ->  ') || '==>  ' || target_priv || CASE WHEN conditional THEN '  [conditional]' ELSE '' END AS shown "
            f"FROM path_{kind} WHERE length > 0")


_POINTS = ", ".join(f"printf('  {n:<18} value=%.2f x w={v:.2f} -> %.1f', CAST({n} AS DOUBLE), round({n} * {v} * 100, 1))" for n, v in fixed.BLAST_WEIGHTS.items())


@register("X5_explanations", f"""
SELECT b.principal, concat_ws(chr(10), printf('blast %.0f/100 for %s', blast, b.principal), {_POINTS}, '  admin path:     ' || a.shown, '  sensitive path: ' || s.shown,
  '  current caps:   ' || CASE WHEN is_admin THEN 'admin-equivalent' ELSE nullif(concat_ws(', ', CASE WHEN read_sensitive THEN 'read_sensitive' END, CASE WHEN iam_write THEN 'iam_write' END, CASE WHEN can_assume THEN 'can_assume' END), '') END) AS explanation
FROM blast b JOIN capable c USING (principal) LEFT JOIN ({_shown('admin')}) a USING (principal) LEFT JOIN ({_shown('sens')}) s USING (principal)""")
def x5(w):
    return ranking.blast_explanation(w.blast).select("principal", "explanation")


# ================================================================ response

@register("Q1_proposals", "SELECT case_id, action_key, subject, step_no, sensitivity FROM prop")
def q1(w):
    return ranking.propose(w.chain["step"]).select("case_id", "action_key", "subject", "step_no", "sensitivity")


@register("Q3_decided_actions", "SELECT case_id, action_key, subject, mode, priority FROM plan")
def q3(w):
    return ranking.response_plan(w.ranked, w.chain["step"]).select("case_id", "action_key", "subject", "mode", "priority")


@register("Q4_plan_counts", "SELECT case_id, count(*) FILTER (mode = 'auto') AS auto_actions, count(*) FILTER (mode = 'human') AS pending_actions FROM plan GROUP BY case_id")
def q4(w):
    return ranking.plan_counts(w.plan)


@register("Q5_recommended", "SELECT case_id, action_key, mode, CASE WHEN mode = 'auto' THEN 'planned' ELSE 'pending' END AS status FROM plan")
def q5(w):
    return ranking.recommended(w.plan).select("case_id", "action_key", "mode", "status")


@register("M10_unsafe_automatic", "SELECT case_id, action_key FROM plan WHERE mode = 'auto' AND action_key <> 'deactivate-access-key'")
def m10(w):
    return ranking.unsafe_automatic(w.plan).select("case_id", "action_key")


# ================================================================ views

@register("V1_case_list", """SELECT r.case_id, r.title, r.rank, r.blast, r.score AS confidence, r.techniques, r.blast_principal IN (SELECT principal FROM path_sens) AS sensitive_exposed,
  coalesce(p.n, 0) AS pending_actions FROM ranked r LEFT JOIN (SELECT case_id, count(*) AS n FROM plan WHERE mode = 'human' GROUP BY case_id) p USING (case_id)""")
def v1(w):
    return views.case_list(w.ranked, w.plan).withColumn("techniques", F.array_join("techniques", ",")).drop("case_no")


@register("V3_logging_health", "SELECT target AS trail, arg_max(event, us) AS last_event, arg_max(event, us) = 'StartLogging' AS logging FROM ev WHERE event IN ('StartLogging', 'StopLogging', 'DeleteTrail') GROUP BY target")
def v3(w):
    return views.logging_health(w.events)


@register("V4_sensitive_exposure", "SELECT DISTINCT s.target AS resource, 'high' AS sensitivity, blast_principal AS reachable_by FROM ranked JOIN path_sens s ON s.principal = blast_principal")
def v4(w):
    return views.sensitive_exposure(w.ranked)


@register("V5_timeline", "SELECT s.case_id, s.us, s.principal, s.event AS action, s.target, d.key FROM sel s LEFT JOIN cdet d ON d.case_id = s.case_id AND d.event_id = s.event_id")
def v5(w):
    return views.timeline(w.chain["step_event"], w.cases["case_detection"]).select("case_id", "us", "principal", "action", "target", "key")


@register("V6_attack_map", "SELECT case_id, tactic, array_to_string(list_sort(list(DISTINCT technique)), ',') AS techniques FROM ctech JOIN cases USING (comp) GROUP BY ALL")
def v6(w):
    return views.attack_map(w.cases["case"]).withColumn("techniques", F.array_join("techniques", ","))


@register("V8_graph_edges", """
SELECT case_id, 'activity' AS kind, actor AS source, target, action AS label FROM steps WHERE target <> ''
UNION ALL SELECT r.case_id, 'escalation', n.src, n.dst, n.technique FROM ranked r JOIN trail_admin t ON t.principal = r.blast_principal JOIN next_admin n ON n.src = t.at
UNION ALL SELECT r.case_id, 'escalation', n.src, n.dst, n.technique FROM ranked r JOIN trail_sens t ON t.principal = r.blast_principal JOIN next_sens n ON n.src = t.at""")
def v8(w):
    return views.graph_edges(w.chain["step"], w.ranked).select("case_id", "kind", "source", "target", "label")


def _merged(w: Workspace) -> tuple[DataFrame, DataFrame]:
    edges = views.graph_edges(w.chain["step"], w.ranked)
    return views.merged_nodes(views.graph_nodes(w.chain["step"], edges)), views.merged_edges(edges)


o.CTES["gedge"] = ORACLE["V8_graph_edges"][ORACLE["V8_graph_edges"].index("\nSELECT case_id, 'activity'"):]
o.CTES["gnode"] = "SELECT DISTINCT case_id, id FROM (SELECT case_id, actor AS id FROM steps UNION ALL SELECT case_id, source FROM gedge UNION ALL SELECT case_id, target FROM gedge) WHERE id <> ''"
o.CTES["mnode"] = "SELECT id, CASE WHEN contains(id, ':role/') THEN 'role' WHEN contains(id, ':user/') THEN 'user' ELSE 'resource' END AS type, count(DISTINCT case_id) AS n_cases FROM gnode GROUP BY id"
o.CTES["medge"] = "SELECT source, target, label, kind, count(DISTINCT case_id) AS n_cases FROM gedge GROUP BY ALL"


@register("V9_merged_graph", "SELECT id, type, n_cases FROM mnode")
def v9(w):
    return _merged(w)[0].select("id", "type", "n_cases")


@register("V9_graph_stats", """SELECT * FROM (SELECT count(*) AS nodes, count(*) FILTER (type = 'user') AS users, count(*) FILTER (type = 'role') AS roles, count(*) FILTER (type = 'resource') AS resources,
  count(*) FILTER (n_cases > 1) AS shared FROM mnode), (SELECT count(*) AS edges, count(*) FILTER (kind = 'escalation') AS escalations FROM medge)""")
def v9s(w):
    return views.graph_stats(*_merged(w))


@register("V10_graph_search", """
WITH seed AS (SELECT id FROM mnode WHERE contains(lower(id || ' ' || coalesce(nullif(split_part(id, '/', -1), ''), id) || ' ' || type), 'trail/t3') UNION SELECT unnest([source, target]) FROM medge WHERE contains(lower(label || ' ' || kind), 'trail/t3'))
SELECT id, type FROM mnode WHERE id IN (SELECT id FROM seed UNION SELECT target FROM medge WHERE source IN (SELECT id FROM seed) UNION SELECT source FROM medge WHERE target IN (SELECT id FROM seed))""")
def v10(w):
    return views.filter_graph(*_merged(w), search="Trail/t3")[0].select("id", "type")


@register("V11_detection_search", """
SELECT det_id, confidence, CASE WHEN confidence >= 0.90 THEN 'Critical' WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.65 THEN 'Medium' ELSE 'Low' END AS severity FROM det
WHERE contains(lower(principal), 'svc') AND key NOT LIKE 'bhv-%' AND key <> 'm8-s3-exfil-anomaly'""")
def v11(w):
    rows = views.detection_rows(w.cases["case_detection"])
    hits = views.search_detections(rows, " SVC", layer="signature")
    return hits.select("det_id", "confidence", "severity")


@register("V11_detection_counters", "SELECT * FROM (SELECT count(*) AS total, count(*) FILTER (key NOT LIKE 'bhv-%' AND key <> 'm8-s3-exfil-anomaly') AS signature, count(*) FILTER (key LIKE 'bhv-%' OR key = 'm8-s3-exfil-anomaly') AS behavioural, 0 AS correlation, count(*) FILTER (key LIKE 'm8-%') AS advanced, count(*) FILTER (confidence >= 0.85) AS critical FROM det), (SELECT count(DISTINCT technique) AS techniques FROM det JOIN kt USING (key))")
def v11c(w):
    return views.detection_counters(views.detection_rows(w.cases["case_detection"]))


@register("V12_case_search", """SELECT case_id, CASE WHEN blast >= 70 THEN 'Critical' WHEN blast >= 50 THEN 'High' WHEN blast >= 30 THEN 'Medium' ELSE 'Low' END AS severity FROM ranked
WHERE contains(lower(title || ' ' || techniques), 'persistence') AND case_id IN (SELECT case_id FROM plan WHERE mode = 'human')""")
def v12(w):
    return views.search_cases(views.case_list(w.ranked, w.plan), "Persistence", pending_only=True).select("case_id", "severity")


@register("V14_latest_advanced", "SELECT principal, us FROM det WHERE key LIKE 'm8-%' ORDER BY us DESC, det_id LIMIT 4")
def v14(w):
    rows = views.detection_rows(w.cases["case_detection"])
    return views.latest_advanced(rows).select("principal", "us")


# ================================================================ context

@register("T1_sanitised_documents", """
SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(left(text, 512), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS value,
  length(text) > 512 AS truncated, length(text) AS original_length FROM documents""")
def t1(w):
    return w.table("documents").select("doc_id", context.sanitize("text", F.col("text")).alias("d")).select("doc_id", "d.value", "d.truncated", "d.original_length")


@register("T1_sanitised_pages", """
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), chr(13), '\\r'), chr(10), '\\n'), chr(9), '\\t') AS value FROM pages""")
def t1p(w):
    return w.table("pages").select("page_id", context.sanitize("html", F.col("html"), cap=1 << 30)["value"].alias("value"))


_books = " UNION ALL ".join(f"SELECT '{p['id']}' AS playbook_id, '{k}' AS kind, {wt} AS weight, unnest({p[c]}) AS tag" for p in fixed.PLAYBOOKS
                            for k, wt, c in (("detection", 3, "detection_types"), ("technique", 2, "attack_ids"), ("action", 1, "action_names")))


o.CTES["booktag"] = _books
o.CTES["casetag"] = "SELECT DISTINCT case_id, 'detection' AS kind, key AS tag FROM cdet UNION SELECT case_id, 'technique', technique FROM ctech JOIN cases USING (comp) UNION SELECT case_id, 'action', action_key FROM plan"
o.CTES["bookhit"] = "SELECT case_id, playbook_id, sum(weight) AS score FROM casetag JOIN booktag USING (kind, tag) GROUP BY ALL"
o.CTES["dnum"] = ("SELECT case_id, key, i, coalesce(nullif(event_id, ''), 'case') || ':' || key || ':' || i AS ref FROM (SELECT case_id, key, event_id, row_number() OVER (PARTITION BY case_id ORDER BY stage, seq, sub, det_id) AS i FROM cdet)")
# the hops of the worst identity's paths to an admin and to sensitive data
o.CTES["way"] = ("SELECT case_id, 'privesc_admin' AS kind, principal, nodes, length FROM ranked JOIN path_admin ON principal = blast_principal WHERE length > 0 "
                 "UNION ALL SELECT case_id, 'sensitive_resource', principal, nodes, length FROM ranked JOIN path_sens ON principal = blast_principal WHERE length > 0")
o.CTES["hop"] = ("SELECT case_id, kind, i, CASE WHEN i = 0 THEN principal ELSE split_part(nodes, ',', i) END AS src, split_part(nodes, ',', i + 1) AS dst FROM (SELECT *, unnest(range(length))::INT AS i FROM way)")


@register("T2_playbooks", "SELECT case_id, playbook_id, score FROM bookhit")
def t2(w):
    return context.retrieve_playbooks(w.tags, w.playbooks)


@register("T3_context_items", f"""
SELECT case_id, 'case' AS section, 0::BIGINT AS ord, case_id AS ref, NULL AS about FROM ranked UNION ALL SELECT case_id, 'event', s.seq, event_id, s.event FROM sel s
UNION ALL SELECT case_id, 'detection', i, ref, key FROM dnum UNION ALL SELECT case_id, 'chain-step', step_no, 'chain-step:' || step_no, action FROM steps
UNION ALL SELECT case_id, 'path-hop', i, kind || ':' || (i + 1) || ':' || src || '->' || dst, kind FROM hop
UNION ALL SELECT case_id, 'blast-component', i, case_id || ':' || n, n FROM ranked, (SELECT unnest({sorted(fixed.BLAST_WEIGHTS)}) AS n, unnest([0, 1, 2, 3]) AS i)
UNION ALL SELECT case_id, 'playbook', 0, playbook_id, title FROM bookhit JOIN (SELECT unnest({[p["id"] for p in fixed.PLAYBOOKS]}) AS playbook_id, unnest({[p["title"] for p in fixed.PLAYBOOKS]}) AS title) USING (playbook_id)""")
def t3(w):
    """Every item of every section with its place, its reference and what it is about."""
    items = context.context_items(w.ranked, w.chain, w.cases["case_detection"], w.current, w.tags, w.playbooks)
    field = {"event": "event", "detection": "key", "chain-step": "action", "path-hop": "kind", "blast-component": "name", "playbook": "title"}
    about = F.coalesce(*[F.when(F.col("section") == k, F.get_json_object("item", f"$.{v}")) for k, v in field.items()])
    return items.select("case_id", "section", "ord", "ref", about.alias("about"))


@register("T4_summary_parts", """
WITH k AS (SELECT key, array_to_string(list(technique), ',') AS ids FROM kt GROUP BY key), w AS (SELECT case_id, list(kind ORDER BY kind) AS kinds FROM way GROUP BY case_id),
v AS (SELECT case_id, list(playbook_id ORDER BY score DESC, playbook_id) AS books FROM bookhit GROUP BY case_id)
SELECT case_id, 1 AS line, 1::BIGINT AS part, 'Case ' || case_id || ': ' || title || ' [[ref:' || case_id || ']].' AS text FROM cases
UNION ALL SELECT case_id, 2, 1, printf('Rank %.4f; detection confidence %.3f; blast radius %.1f/100 ', rank, score, blast) || '[[ref:' || case_id || ']] [[ref:' || case_id || ']].' FROM ranked
UNION ALL SELECT case_id, 3, i, CASE WHEN i = 1 THEN 'Detections: ' ELSE '; ' END || key || ' (' || ids || ') [[ref:' || ref || ']]' FROM dnum JOIN k USING (key)
UNION ALL SELECT DISTINCT case_id, 3, 4611686018427387904, '.' FROM cdet
UNION ALL SELECT case_id, 4, step_no, CASE WHEN step_no = 1 THEN 'Activity chain: ' ELSE ' -> ' END || action FROM steps
UNION ALL SELECT DISTINCT case_id, 4, 4611686018427387904, ' [[ref:activity-chain]].' FROM steps
UNION ALL SELECT case_id, 5, 1, 'Graph paths: ' || array_to_string(kinds, ', ') || ' ' || array_to_string(list_transform(kinds, lambda x: '[[ref:' || x || ']]'), ' ') || '.' FROM w
UNION ALL SELECT case_id, 6, 1, 'Matched playbooks: ' || array_to_string(list_transform(books, lambda x: x || ' v1.0.0 [[ref:' || x || ']]'), ', ') || '.' FROM v
UNION ALL SELECT case_id, 7, 1, 'All attacker-controlled values remain inside structured DATA fields and are not rendered into this narrative [[ref:' || case_id || ']].' FROM ranked""")
def t4(w):
    parts = context.summary_parts(w.ranked, w.chain["step"], w.cases["case_detection"], w.tags, w.playbooks)
    return parts.select("case_id", "line", "part", F.concat("lead", "text").alias("text"))


def _texts(w: Workspace) -> DataFrame:
    d = w.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("case_id"), F.col("text").alias("summary"))
    e = w.events.select("event_id", F.concat_ws(" ", "principal", "target", "event", "params").alias("summary")).withColumnRenamed("event_id", "case_id")
    return d.unionByName(e).unionByName(w.table("conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("case_id"), F.col("text").alias("summary")))


o.CTES["texts"] = "SELECT 'd' || doc_id AS case_id, text AS summary FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations UNION ALL SELECT event_id, concat_ws(' ', principal, target, event, params) FROM ev"


@register("T5_text_entities", f"""
SELECT DISTINCT case_id, kind, value FROM (SELECT case_id, 'ref' AS kind, unnest(regexp_extract_all(summary, '{fixed.REF_PATTERN}', 1)) AS value FROM texts
UNION ALL SELECT case_id, 'arn', unnest(regexp_extract_all(summary, '{fixed.ARN_PATTERN}')) FROM texts UNION ALL SELECT case_id, 'api', unnest(regexp_extract_all(summary, '{fixed.API_PATTERN}')) FROM texts
UNION ALL SELECT case_id, 's3', unnest(regexp_extract_all(summary, '{fixed.S3_URI_PATTERN.replace("'", "''")}')) FROM texts)""")
def t5(w):
    return context.text_entities(_texts(w), ["case_id"], "summary")


@register("T5_text_directives", f"SELECT case_id FROM texts WHERE regexp_matches(summary, '{fixed.DIRECTIVE_PATTERN}')")
def t5d(w):
    none = w.spark.createDataFrame([], "case_id STRING, kind STRING, value STRING")
    return context.audit_summaries(_texts(w), none).filter("violation = 'action directive detected'").select("case_id")


@register("T5_grounding_audit", """
SELECT case_id, unnest(['unsupported provenance ref: nowhere', 'unsupported ARN: arn:aws:iam::1:user/ghost', 'unsupported API/action: CreateGhost', 'unsupported resource: s3://ghost-bucket/x',
  'action directive detected', 'uncited sentence: Delete it now.']) AS violation FROM cases WHERE n_detections > 1""")
def t5g(w):
    """Every part of every summary is audited, with the citation that closes its line; cases of several detections get a bad part as well."""
    items = cut_lineage(context.context_items(w.ranked, w.chain, w.cases["case_detection"], w.current, w.tags, w.playbooks))
    parts = context.summary_parts(w.ranked, w.chain["step"], w.cases["case_detection"], w.tags, w.playbooks)
    rows = parts.select("case_id", F.concat("lead", "text", F.when(F.col("line") == 4, " [[ref:activity-chain]].").otherwise("")).alias("summary"))
    bad = F.lit("Seen arn:aws:iam::1:user/ghost calling CreateGhost on s3://ghost-bucket/x [[ref:nowhere]]. Delete it now.")
    drafts = rows.unionByName(w.cases["case"].filter("n_detections > 1").select("case_id", bad.alias("summary")))
    return context.audit_summaries(drafts, context.allowed_entities(items))


# ================================================================ metrics

@register("M1_rule_set_metrics", """
WITH e AS (SELECT DISTINCT principal AS scenario, event AS key FROM hist), a AS (SELECT DISTINCT principal AS scenario, event AS key FROM cur),
c AS (SELECT coalesce(e.scenario, a.scenario) AS scenario, count(*) FILTER (e.key IS NOT NULL AND a.key IS NOT NULL) AS tp, count(*) FILTER (e.key IS NULL) AS fp, 0::BIGINT AS tn, count(*) FILTER (a.key IS NULL) AS fn
  FROM e FULL JOIN a ON e.scenario = a.scenario AND e.key = a.key GROUP BY 1)
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN fp > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS false_positive_rate,
  CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1 FROM c""")
def m1(w):
    key = lambda df: df.select(F.col("principal").alias("scenario"), F.col("event").alias("key"))
    return metrics.rule_set_metrics(key(w.history), key(w.current))


@register("M2_binary_metrics", """
WITH c AS (SELECT count(*) FILTER (toxic = 1 AND n_chars < 400) AS tp, count(*) FILTER (toxic = 0 AND n_chars < 400) AS fp, count(*) FILTER (toxic = 0 AND n_chars >= 400) AS tn, count(*) FILTER (toxic = 1 AND n_chars >= 400) AS fn
  FROM labels JOIN documents USING (doc_id)) SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0.0 END AS f1, fp / (fp + tn) AS false_positive_rate FROM c""")
def m2(w):
    d = w.table("labels").join(w.table("documents"), "doc_id")
    return metrics.binary_metrics(d.select((F.col("toxic") == 1).alias("expected"), (F.col("n_chars") < 400).alias("predicted")))


_TRUTH = ["ListRoles", "GetObject", "AssumeRole", "PutObject", "StopLogging", "GetObject"]


@register("M3_chain_accuracy", f"""
WITH best AS (SELECT principal, list_reduce(list_prepend([0, 0, 0, 0, 0, 0], list(list_transform({_TRUTH}, lambda t: CASE WHEN t = event THEN 1 ELSE 0 END) ORDER BY seq)),
  lambda a, m: list_transform(range(1, 7), lambda j: CAST(list_max(list_transform(range(1, j + 1), lambda i: greatest(a[i], CASE WHEN m[i] = 0 THEN 0 WHEN i = 1 THEN 1 ELSE a[i - 1] + 1 END))) AS INT))) AS a, count(*) AS n FROM cur GROUP BY principal)
SELECT principal, round(a[6] / greatest(6, n), 4) AS chain_accuracy FROM best""")
def m3(w):
    expected = w.current.select("principal").distinct().select("principal", F.posexplode(F.array(*map(F.lit, _TRUTH))).alias("pos", "action"))
    return metrics.chain_accuracy(expected, w.current.select("principal", F.col("seq").alias("pos"), F.col("event").alias("action")), by="principal", block=1000)


@register("M4_correlation_score", """
WITH e AS (SELECT DISTINCT event AS scenario, event_id FROM cur), c AS (SELECT DISTINCT event_name AS scenario, case_id, event_id FROM cdet), b AS (SELECT event AS scenario, event_id FROM cur WHERE geo = 'US'),
p AS (SELECT c.scenario, c.case_id, count(e.event_id) AS hit, count(b.event_id) AS bad, count(*) AS n FROM c LEFT JOIN e USING (scenario, event_id) LEFT JOIN b USING (scenario, event_id) GROUP BY ALL),
w AS (SELECT scenario, count(*) AS n FROM e GROUP BY scenario)
SELECT w.scenario, round(coalesce(max((hit / w.n) * (1 - bad / greatest(1, p.n))), 0.0), 4) AS correlation_score FROM w LEFT JOIN p USING (scenario) GROUP BY w.scenario""")
def m4(w):
    ev = w.current
    held = w.cases["case_detection"].select(F.col("event_name").alias("scenario"), "case_id", "event_id")
    key = lambda df: df.select(F.col("event").alias("scenario"), "event_id")
    return metrics.correlation_score(key(ev), held, key(ev.filter("geo = 'US'")))


@register("M6_ranking_agreement", """
WITH a AS (SELECT c_mktsegment AS ranking, c_custkey AS item, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS e FROM customer),
b AS (SELECT ranking, item, e, row_number() OVER (PARTITION BY ranking ORDER BY n DESC, item) AS p FROM (SELECT ranking, item, e, count(o_orderkey) AS n FROM a LEFT JOIN orders ON o_custkey = item GROUP BY ALL))
SELECT x.ranking, round(count(*) FILTER (x.p < y.p) / count(*), 4) AS agreement FROM b x JOIN b y ON x.ranking = y.ranking AND x.e < y.e GROUP BY x.ranking""")
def m6(w):
    c = w.table("customer").select(F.col("c_mktsegment").alias("ranking"), F.col("c_custkey").alias("item"), "c_acctbal")
    n = w.table("orders").groupBy(F.col("o_custkey").alias("item")).agg(F.count("*").alias("n"))
    both = c.join(n, "item", "left").select("ranking", "item", (-F.round(F.col("c_acctbal") * 100)).cast("bigint").alias("by_balance"), (-F.coalesce("n", F.lit(0))).cast("bigint").alias("by_orders"))

    def placed(order: str, width: int) -> DataFrame:
        return with_global_number(both, order, ["item"], "pos", keys=["ranking"], width=width).select("ranking", "item", "pos")

    return metrics.ranking_agreement(placed("by_balance", 1000), placed("by_orders", 1))


@register("M7_timing", """SELECT case_id, round((us_end - us_start) / 1000, 3) AS detection_latency_ms, NULL::DOUBLE AS mttr_ms FROM cases""")
def m7(w):
    c = w.cases["case"]
    none = F.lit(None).cast("bigint")
    d = c.select("case_id", F.col("us_start").alias("event_ingested"), F.col("us_end").alias("detected"), F.col("us_end").alias("case_created"), none.alias("investigation_started"),
                 none.alias("response_recommended"), none.alias("approved"), none.alias("response_completed"))
    return metrics.timing_metrics(d).select("case_id", "detection_latency_ms", "mttr_ms")


@register("M8_technique_coverage", "SELECT technique AS technique_id, array_to_string(list_sort(list(DISTINCT key)), ',') AS scenarios, count(*) AS number_of_detections FROM (SELECT DISTINCT key, technique FROM det JOIN kt USING (key)) GROUP BY technique")
def m8(w):
    r = w.detections.select(F.col("key").alias("scenario")).distinct().withColumn("attack_ids", rules.attack_ids(F.col("scenario")))
    return metrics.technique_coverage(r)


@register("M5_path_similarity", """
WITH p AS (SELECT principal, string_split(nodes, ',') AS a, list_prepend(principal, string_split(nodes, ',')) AS e FROM paths),
q AS (SELECT *, list_distinct([{'a': e[i], 'b': e[i + 1]} for i in range(1, len(e))]) AS ee, list_distinct([{'a': a[i], 'b': a[i + 1]} for i in range(1, len(a))]) AS ae FROM p),
r AS (SELECT *, CASE WHEN len(ae) > 0 THEN len(list_intersect(ee, ae)) / len(ae) ELSE 0.0 END AS ep, CASE WHEN len(ee) > 0 THEN len(list_intersect(ee, ae)) / len(ee) ELSE 0.0 END AS er,
  len([i for i in range(1, len(a) + 1) if a[i] = e[i]]) / greatest(1, len(e), len(a)) AS pos FROM q)
SELECT principal, e = a AS exact_path_match, round(ep, 4) AS edge_precision, round(er, 4) AS edge_recall, round((pos + CASE WHEN ep + er > 0 THEN 2 * ep * er / (ep + er) ELSE 0.0 END) / 2, 4) AS path_similarity FROM r""")
def m5(w):
    p = w.paths
    nodes = F.transform("hops", lambda h: h["dst"])
    d = metrics.compare_paths(p.select("principal", F.concat(F.array("principal"), nodes).alias("expected"), nodes.alias("actual")))
    return d.drop("expected", "actual")


# ================================================================ streaming forms

def _stream(w: Workspace) -> DataFrame:
    """The event view over a file stream of the events table."""
    base = jobs.read_events(w.spark, w.folder, w.table("events").schema, "events.parquet")
    return w.event_view(base).withColumn("ts", F.timestamp_micros("us"))


@register("ST1_stream_dedup", "SELECT source, event_id, us FROM ev")
def st1(w):
    s = _stream(w)
    twice = s.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return jobs.drain(jobs.bounded_dedup(twice.select("source", "event_id", "us", "ts"), "60 days"), "dedup").select("source", "event_id", "us")


@register("ST2_stream_rules", f"SELECT {_DET} FROM ({o.signatures('ev')})")
def st2(w):
    return _flat(jobs.drain(jobs.stream_rules(_stream(w)), "rules"))


@register("ST3_stream_new_geo", "SELECT DISTINCT principal, geo FROM cur c WHERE principal IN (SELECT principal FROM hist) AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.principal = c.principal AND h.geo = c.geo)")
def st3(w):
    known = cut_lineage(behaviour.known_countries(w.history))
    return jobs.drain(jobs.stream_new_geo(_stream(w).filter(F.col("us") >= int(SPLIT_US)), known), "geo").select("principal", "geo")


@register("ST6_stream_sessions", f"""
SELECT 'principal' AS kind, principal AS value, count(*) AS n, min(us) AS us_start, max(us) AS us_end FROM (SELECT *, sum(g) OVER (PARTITION BY principal ORDER BY us, det_id) AS sid FROM
 (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY principal ORDER BY us, det_id) <= {60 * o.MIN} THEN 0 ELSE 1 END AS g FROM ({o.signatures('ev')}))) GROUP BY principal, sid
UNION ALL SELECT 'src_ip', src_ip, count(*), min(us), max(us) FROM (SELECT *, sum(g) OVER (PARTITION BY src_ip ORDER BY us, det_id) AS sid FROM
 (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY src_ip ORDER BY us, det_id) <= {60 * o.MIN} THEN 0 ELSE 1 END AS g FROM ({o.signatures('ev')}))) GROUP BY src_ip, sid""")
def st6(w):
    det = jobs.stream_rules(_stream(w)).withColumn("ts", F.timestamp_micros("us"))
    return jobs.complete(jobs.stream_case_sessions(det), "sessions").select("kind", "value", "n", "us_start", "us_end")


def _to_the_end(w: Workspace, job: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """The job over the whole stream of events, followed by rows of a user that does not exist, a year later, that pass its filters."""
    base = w.table("events")
    later = base.groupBy().agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.max("event_id").alias("event_id"))
    marker = later.select(F.explode(F.array(F.lit("view"), F.lit("click"))).alias("event_type"), "ts", "event_id", F.lit(-1).cast("bigint").alias("user_id"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props"))
    build = lambda folder: job(w.event_view(jobs.read_events(w.spark, folder, base.schema)).withColumn("ts", F.timestamp_micros("us")))
    return jobs.drain_to_the_end(build, base, marker.select([F.col(f.name).cast(f.dataType) for f in base.schema.fields]), name)


@register("ST4_stream_impossible_travel", f"SELECT principal, event_id, us, message FROM ({o.travel('ev')})")
def st4(w):
    d = _to_the_end(w, lambda s: jobs.stream_impossible_travel(s, TRAVEL_MIN), "travel")
    return d.select("principal", "event_id", "us", F.concat("principal", F.lit(" moved "), "from_geo", F.lit(" -> "), "to_geo", F.lit(" in "), F.col("minutes").cast("string"), F.lit(" min")).alias("message"))


@register("ST5_stream_enumeration_bursts", f"SELECT principal, event_id, us, names FROM ({o.bursts('ev')})")
def st5(w):
    return _to_the_end(w, lambda s: jobs.stream_enumeration_bursts(s, BURST_MIN, BURST_N), "bursts").select("principal", "event_id", "us", "names")


@register("ST7_stream_s3_daily", f"""
WITH p AS ({_PROFILE.replace('round(', '(').replace(', 6)', ')').replace(', 3)', ')')}),
d AS (SELECT principal, us // 86400000000 AS day, count(*) AS get_count, sum(bytes) AS bytes FROM ev WHERE event = 'GetObject' GROUP BY ALL)
SELECT principal, day, get_count, bytes FROM d JOIN p USING (principal)
WHERE get_count > greatest(daily_get_mean + 1.0 * daily_get_std, daily_get_mean + 1) OR bytes > greatest(daily_bytes_mean + 1.0 * daily_bytes_std, daily_bytes_mean + 50000000)""")
def st7(w):
    profile = cut_lineage(exposure.s3_profile(w.history))
    d = _to_the_end(w, lambda s: jobs.stream_s3_daily(s, profile, 1.0, 1, 50_000_000), "daily")
    return d.select("principal", F.expr("unix_micros(day) div 86400000000").alias("day"), "get_count", "bytes")


# ================================================================ further views and parts

@register("X2_X3_capabilities", "SELECT * FROM capable")
def x23(w):
    a = graph.identity_statements(w.index)
    flag = lambda df, name: df.select("principal").distinct().withColumn(name, F.lit(True))
    edges = w.graph["edges"]
    d = w.permissions["principal"].select(F.col("arn").alias("principal"))
    for df, name in ((escalation.admin_equivalent(a), "is_admin"), (escalation.sources(edges, "CAN_ACCESS", w.graph["shared"]), "read_sensitive"),
                     (ranking.iam_writers(a), "iam_write"), (graph.edges_of(edges, "CAN_ASSUME").select(F.col("src").alias("principal")), "can_assume")):
        d = d.join(flag(df, name), "principal", "left")
    return d.select("principal", *[F.coalesce(n, F.lit(False)).alias(n) for n in ("is_admin", "read_sensitive", "iam_write", "can_assume")])


@register("V2_open_cases", "SELECT count(*) AS open_cases FROM cases")
def v2(w):
    return views.open_case_count(views.cases_by_blast(views.case_list(w.ranked, w.plan)))


@register("V7_detection_rows", """SELECT case_id, det_id, key, CASE WHEN key = 'm8-s3-sensitive-public-access' THEN regexp_extract(message, 'bucket (.*)', 1) END AS resource, key LIKE 'm8-%' AS advanced FROM cdet""")
def v7(w):
    return views.detection_rows(w.cases["case_detection"]).select("case_id", "det_id", "key", "resource", "advanced")


@register("X5_chain_parts", "SELECT case_id, step_no AS part_no, action AS text FROM steps")
def x5c(w):
    return ranking.case_summary(w.ranked, w.chain["step"]).filter("part_no > 0")


@register("K2_case_csv_rows", """
WITH k AS (SELECT case_id, event_id, array_to_string(list(key ORDER BY stage, seq, sub, key), ';') AS detections FROM cdet GROUP BY ALL)
SELECT s.case_id, s.us, s.principal, s.event AS action, coalesce(s.target, '') AS target, coalesce(k.detections, '') AS detections, replace(r.techniques, ',', ';') AS attack_ids, r.blast AS blast_score
FROM sel s JOIN ranked r USING (case_id) LEFT JOIN k ON k.case_id = s.case_id AND k.event_id = s.event_id""")
def k2(w):
    return sinks.case_csv_rows(w.ranked, w.chain["step_event"], w.cases["case_detection"]).drop("seq", "event_ts")


@register("K4_latest_per_key", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def k4(w):
    """Two writers that both started from the first merge, and one that takes both in for the buckets it touches."""
    import uuid

    root = f"{checkpoint_root(w.spark).rstrip('/')}/upsert-{uuid.uuid4().hex}"
    rows = w.table("events").select("user_id", "event_id")
    for part in ("ts < TIMESTAMP_NTZ '2024-01-11 00:00:00'", "ts >= TIMESTAMP_NTZ '2024-01-16 00:00:00'", "ts >= TIMESTAMP_NTZ '2024-01-11 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-16 00:00:00'"):
        store.upsert(rows.filter(part), root, "user_id", "event_id")
    return store.read_store(w.spark, root, "user_id", "event_id")


@register("ST8_case_feed", "SELECT event_id % 500 AS case_id, max(event_id) AS version, arg_max(user_id, event_id) AS owner FROM events GROUP BY 1")
def st8(w):
    """A stream of changed rows kept up to date in the store."""
    import uuid

    root = f"{checkpoint_root(w.spark).rstrip('/')}/feed-{uuid.uuid4().hex}"
    base = jobs.read_events(w.spark, w.folder, w.table("events").schema, "events.parquet")
    changed = base.select((F.col("event_id") % 500).alias("case_id"), F.col("event_id").alias("version"), F.col("user_id").alias("owner"))
    jobs.start_case_feed(changed, f"{root}/cases", f"{root}/state").awaitTermination()
    return store.read_store(w.spark, f"{root}/cases", "case_id", "version")


from skyledger.plans import registry_sources  # noqa: E402,F401  registers the file sources; needs the names above
