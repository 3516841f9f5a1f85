"""Raw records to the event schema, enrichment joins, idempotent dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import blank_to_null, lookup
from skyledger.functions.sliced import first_by

EVENT_COLUMNS = [
    "ts", "us", "account", "region", "event", "principal", "principal_type", "session", "target", "src_ip", "asn",
    "geo", "user_agent", "mfa", "resource_sensitivity", "read_only", "error_code", "severity", "event_id", "source",
    "raw_ref", "params", "event_source", "bytes_transferred",
]
SESSION = "struct<issuer_arn: string, issuer_type: string, session_name: string, mfa_authenticated: boolean>"
_NULL = F.lit  # typed nulls are written as F.lit(None).cast(...)


def text_flag(c: Column) -> Column:
    """'true'/'false' text to boolean, null stays null."""
    return F.lower(F.trim(c)) == "true"


def principal_of(identity: Column) -> Column:
    return F.coalesce(blank_to_null(identity["arn"]), blank_to_null(identity["invokedBy"]),
                      blank_to_null(identity["accountId"]), F.lit("unknown"))


def session_of(identity: Column) -> Column:
    ctx = identity["sessionContext"]
    return F.when(ctx.isNotNull(), F.struct(
        ctx["sessionIssuer"]["arn"].alias("issuer_arn"), ctx["sessionIssuer"]["type"].alias("issuer_type"),
        ctx["sessionIssuer"]["userName"].alias("session_name"),
        text_flag(ctx["attributes"]["mfaAuthenticated"]).alias("mfa_authenticated"))).cast(SESSION)


def first_string_param(params: Column, names: list[str]) -> Column:
    """First of the named top-level request parameters whose JSON value is a string. Parses the text once."""
    entries = F.map_entries(F.try_variant_get(F.try_parse_json(params), "$", "map<string,variant>"))
    usable = F.filter(entries, lambda e: e["key"].isin(names) & (F.schema_of_variant(e["value"]) == "STRING"))
    ranked = F.transform(usable, lambda e: F.struct(F.array_position(F.array(*map(F.lit, names)), e["key"]).alias("rank"),
                                                    F.try_variant_get(e["value"], "$", "string").alias("text")))
    return F.array_min(ranked)["text"]


def target_of(resources: Column, params: Column) -> Column:
    """First non-empty resource ARN, else the first string among the known parameters."""
    arn = F.try_element_at(F.filter(resources, lambda r: r["ARN"] != ""), F.lit(1))["ARN"]
    # parameters are parsed only where no ARN is present
    return F.coalesce(arn, first_string_param(params, fixed.TARGET_PARAMS))


def _time(text: Column) -> tuple[Column, Column]:
    ts = F.try_to_timestamp(text)
    return ts.alias("ts"), F.unix_micros(ts).alias("us")


def without_time(events: DataFrame) -> DataFrame:
    """Quarantine: events whose time could not be read. They carry null ``ts`` and ``us`` and stay among the events."""
    return events.filter(F.col("us").isNull())


def normalise_audit(raw: DataFrame) -> DataFrame:
    """One projection from audit records to events."""
    r, ident = F.col("record"), F.col("record.userIdentity")
    session = session_of(ident)
    keep = [c for c in ("scenario", "path", "pos") if c in raw.columns]
    return raw.select(
        *_time(r["eventTime"]),
        F.coalesce(blank_to_null(r["recipientAccountId"]), blank_to_null(ident["accountId"]), F.lit("unknown")).alias("account"),
        F.coalesce(r["awsRegion"], F.lit("unknown")).alias("region"),
        F.coalesce(r["eventName"], F.lit("unknown")).alias("event"),
        F.coalesce(principal_of(ident), F.lit("unknown")).alias("principal"),
        F.coalesce(lookup(fixed.PRINCIPAL_TYPES, ident["type"]), F.lit("unknown")).alias("principal_type"),
        session.alias("session"),
        target_of(r["resources"], r["requestParameters"]).alias("target"),
        r["sourceIPAddress"].alias("src_ip"), F.lit(None).cast("string").alias("asn"),
        F.lit(None).cast("string").alias("geo"), r["userAgent"].alias("user_agent"),
        F.coalesce(session["mfa_authenticated"], F.lit(False)).alias("mfa"),
        F.lit("unknown").alias("resource_sensitivity"), r["readOnly"].alias("read_only"),
        r["errorCode"].alias("error_code"), F.lit(None).cast("double").alias("severity"),
        F.coalesce(r["eventID"], F.col("raw_ref")).alias("event_id"), F.col("source"), F.col("raw_ref"),
        r["requestParameters"].alias("params"), r["eventSource"].alias("event_source"),
        r["additionalEventData"]["bytesTransferred"].alias("bytes_transferred"), *keep)


def normalise_findings(raw: DataFrame) -> DataFrame:
    """One projection from findings to events."""
    f = F.col("record")
    action = f["Service"]["Action"]
    ip = F.coalesce(*[action[a]["RemoteIpDetails"] for a in
                      ("AwsApiCallAction", "NetworkConnectionAction", "PortProbeAction")])
    account = F.coalesce(f["AccountId"], F.lit("unknown"))
    user = blank_to_null(f["Resource"]["AccessKeyDetails"]["UserName"])
    principal = (F.when(user.isNotNull(), F.concat(F.lit("arn:aws:iam::"), account, F.lit(":user/"), user))
                 .otherwise(F.coalesce(blank_to_null(f["Resource"]["InstanceDetails"]["InstanceId"]),
                                       blank_to_null(f["Resource"]["AccessKeyDetails"]["PrincipalId"]),
                                       F.lit("unknown"))))
    asn = blank_to_null(ip["Organization"]["Asn"])
    ts = F.coalesce(blank_to_null(f["Service"]["EventLastSeen"]), blank_to_null(f["UpdatedAt"]), f["CreatedAt"])
    keep = [c for c in ("scenario", "path", "pos") if c in raw.columns]
    return raw.select(
        *_time(ts), account.alias("account"), F.coalesce(f["Region"], F.lit("unknown")).alias("region"),
        F.coalesce(f["Type"], F.lit("unknown")).alias("event"), principal.alias("principal"),
        F.when(user.isNotNull(), "user").otherwise("unknown").alias("principal_type"),
        F.lit(None).cast(SESSION).alias("session"), F.lit(None).cast("string").alias("target"),
        ip["IpAddressV4"].alias("src_ip"),
        F.when(F.upper(asn).startswith("AS"), asn).otherwise(F.concat(F.lit("AS"), asn)).alias("asn"),
        ip["Country"]["CountryName"].alias("geo"), F.lit(None).cast("string").alias("user_agent"),
        F.lit(False).alias("mfa"), F.lit("unknown").alias("resource_sensitivity"),
        F.lit(None).cast("boolean").alias("read_only"), F.lit(None).cast("string").alias("error_code"),
        f["Severity"].alias("severity"), F.coalesce(f["Id"], F.col("raw_ref")).alias("event_id"),
        F.col("source"), F.col("raw_ref"), F.lit(None).cast("string").alias("params"),
        F.lit(None).cast("string").alias("event_source"), F.lit(None).cast("bigint").alias("bytes_transferred"), *keep)


def normalise(audit: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """All sources on one event schema."""
    parts = [fn(df) for fn, df in ((normalise_audit, audit), (normalise_findings, findings)) if df is not None]
    if not parts:
        raise ValueError("no source given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def assert_known_sources(raw: DataFrame) -> DataFrame:
    """Fail the job on a record whose source has no normaliser."""
    known = F.col("source").isin("cloudtrail", "guardduty")
    return raw.withColumn("source", F.when(known, F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("no normaliser for source "), F.coalesce("source", F.lit("null"))))))


# ---------------------------------------------------------------- enrichment

def enrich_geo(events: DataFrame, geo: DataFrame) -> DataFrame:
    """Fill missing asn/geo from the address table; events without a match stay as they are."""
    g = geo.select(F.col("src_ip"), F.col("asn").alias("_asn"), F.col("geo").alias("_geo"))
    wanted = F.col("src_ip").isNotNull() & (F.col("src_ip") != "") & (F.col("asn").isNull() | F.col("geo").isNull())
    joined = events.join(g, "src_ip", "left")

    def fill(name: str) -> Column:
        return F.when(wanted, F.coalesce(blank_to_null(F.col(name)), F.col(f"_{name}"))).otherwise(F.col(name))

    return joined.select(*[fill(c).alias(c) if c in ("asn", "geo") else F.col(c) for c in events.columns])


def longest_prefix(values: DataFrame, column: str, table: DataFrame, key: str, payload: str) -> DataFrame:
    """Longest ``key`` of ``table`` that is a prefix of each distinct ``column`` value.

    Every value is cut at the key lengths that occur (bounded by the longest key), so the prefix test becomes an
    equi join instead of a nested loop.
    """
    lengths = table.agg(F.sort_array(F.collect_set(F.length(key)))).scalar()
    cut = (values.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct()
           .withColumn("_lengths", lengths)
           .select(column, F.explode(F.filter("_lengths", lambda n: n <= F.length(column))).alias("_n"))
           .withColumn("_key", F.expr(f"substring(`{column}`, 1, _n)")))
    hits = cut.join(table.select(F.col(key).alias("_key"), payload), "_key")
    return hits.groupBy(column).agg(F.max_by(payload, "_n").alias(payload), F.max_by("_key", "_n").alias("matched"))


def enrich_sensitivity(events: DataFrame, resource_sensitivity: DataFrame) -> DataFrame:
    """Exact, else longest-prefix sensitivity of the target, where the event has none yet."""
    hit = longest_prefix(events, "target", resource_sensitivity, "arn", "sensitivity").drop("matched")
    out = events.join(hit, "target", "left")
    level = F.when(F.col("resource_sensitivity") == "unknown", F.coalesce("sensitivity", F.lit("unknown"))).otherwise(
        F.col("resource_sensitivity"))
    return out.select(*[level.alias(c) if c == "resource_sensitivity" else F.col(c) for c in events.columns])


def dedup(events: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """First arrival per (source, event_id). Partial aggregation folds copies before the shuffle."""
    return first_by(events, keys or ["source", "event_id"], order)
