"""Registered round trips of the file sources: the given tables written as documents and objects, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators import graph, normalise
from skyledger.plans import evaluation
from skyledger.plans import oracle as o
from skyledger.plans import registry as r
from skyledger.plans.registry import ORACLE, register
from skyledger.plans.workspace import Workspace
from skyledger.session import checkpoint_root
from skyledger.sources import audit, snapshots, split_json


def _folder(w: Workspace, name: str) -> str:
    return f"{checkpoint_root(w.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _dealt(items: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` to partitions of about the advised size, so that documents are more, not longer, on larger input."""
    return items.hint("rebalance", F.col(key))


def _normalised(raw: DataFrame) -> DataFrame:
    return normalise.normalise_audit(raw).select("event_id", "us", "account", "region", "event", "principal", "principal_type", "target", "src_ip", "mfa",
                                                 F.col("session.issuer_arn").alias("issuer_arn"), "read_only", "event_source", "bytes_transferred")


def _records(w: Workspace) -> DataFrame:
    """(seq, item): the events as audit records in JSON text."""
    return r._audit_json(w).select("seq", F.col("CloudTrailEvent").alias("item"))


_AUDIT_SQL = ORACLE["N1_normalise_audit_records"]


def _keep(name: str, sql: str):
    """Register with a statement that is complete already."""
    def keep(fn):
        register(name)(fn)
        ORACLE[name] = sql
        return fn
    return keep


@_keep("S1_audit_files", _AUDIT_SQL)
def s1(w):
    """Large delivery files, each cut into ranges; as many as the records need."""
    path = _folder(w, "delivery")
    split_json.write_documents(_dealt(_records(w).withColumn("section", F.lit("Records")), "seq"), path, ["seq"])
    return _normalised(audit.read_audit_files(w.spark, path))


@_keep("S2_finding_files", ORACLE["N7_normalise_findings"])
def s2(w):
    """Bare arrays and ``Findings`` documents side by side."""
    path, rows = _folder(w, "findings"), r.finding_json(w)
    split_json.write_documents(rows.filter("seq % 2 = 0").withColumn("section", F.lit(None).cast("string")).transform(_dealt, "seq"), f"{path}/bare", ["seq"])
    split_json.write_documents(rows.filter("seq % 2 = 1").withColumn("section", F.lit("Findings")).transform(_dealt, "seq"), f"{path}/keyed", ["seq"])
    return normalise.normalise_findings(audit.read_finding_files(w.spark, path)).select(
        "event_id", "us", "event", "principal", "principal_type", "src_ip", "asn", "geo", "severity")


#: Objects of 500 records; names say nothing about their compression.
_KEY = "CASE (seq // 500) % 4 WHEN 0 THEN 'logs0/day/' || (seq // 500) WHEN 1 THEN 'logs1/day/' || (seq // 500) || '.gz' WHEN 2 THEN 'logs0/day/' || (seq // 500) || '.json.gz' ELSE 'logs1/day/' || (seq // 500) || '.json' END"


def _object_key() -> Column:
    return F.expr(_KEY.replace("//", "div"))


def _gzipped(key: str) -> bool:
    return not key.endswith((".gz", ".json")) or key.startswith("logs1/day/") and key.endswith(".gz")


def _objects(w: Workspace, root: str) -> DataFrame:
    return split_json.write_objects(_records(w).withColumn("key", _object_key()).withColumnRenamed("seq", "ord"), root, _gzipped)


@_keep("S4_delivered_objects", _AUDIT_SQL)
def s4(w):
    """Gzip objects without .gz, plain ones with it, and the other way round."""
    root = _folder(w, "objects")
    _objects(w, root).count()
    return _normalised(audit.read_delivered(w.spark, root))


@register("S3_notified_records", f"SELECT 's3://' || {_KEY} || '#' || event_id AS raw_ref, event_id, event FROM ev")
def s3_records(w):
    """Messages announce the objects in two batches that overlap, and the second comes twice."""
    root = _folder(w, "objects")
    keys = _objects(w, root)
    body = F.concat(F.lit('{"Records":[{"s3":{"bucket":{"name":"'), F.substring_index("key", "/", 1), F.lit('"},"object":{"key":"'), F.expr("substring(key, 7)"), F.lit('"}}}]}'))
    messages = keys.select(F.pmod(F.xxhash64("key"), F.lit(3)).alias("part"), body.alias("body"))
    out = _folder(w, "landing")
    for epoch, parts in ((0, "part < 2"), (1, "part > 0"), (1, "part > 0")):
        audit.land_notified(messages.filter(parts), out, epoch, root=f"{root}/")
    return w.spark.read.parquet(f"{out}/records").select("raw_ref", F.col("record.eventID").alias("event_id"), F.col("record.eventName").alias("event"))


@register("S11_scenario_replay", """
SELECT 'run-' || seq // 500 AS scenario, event_id, us, event, 'run-' || seq // 500 || '.json:' || row_number() OVER (PARTITION BY seq // 500 ORDER BY seq) - 1 AS raw_ref,
  row_number() OVER (PARTITION BY seq // 500 ORDER BY us, seq) AS seq FROM ev""")
def s11(w):
    """Scenario documents of 500 records each, replayed: normalised, deduplicated and numbered in time order."""
    root = _folder(w, "scenarios")
    split_json.write_objects(_records(w).select(F.expr("'run-' || (seq div 500) || '.json'").alias("key"), F.col("seq").alias("ord"), "item"), root).count()
    geo = w.spark.createDataFrame([], "src_ip string, asn string, geo string")
    events = evaluation.replay(audit.read_scenarios(w.spark, root), geo)
    return events.select("scenario", "event_id", "us", "event", "raw_ref", "seq")


@register("S6_config_snapshots", """
SELECT 'tag' AS kind, CASE WHEN c_custkey % 10 = 0 THEN 'svc-' || c_custkey ELSE 'u' || c_custkey END AS arn, CASE WHEN c_custkey % 3 = 0 THEN 'team-b' ELSE 'team-a' END AS value FROM customer
UNION ALL SELECT 'resource', arn, sensitivity FROM resource""")
def s6(w):
    """Two folders of documents; the later one overwrites every third principal."""
    root = _folder(w, "config")
    name = F.expr("CASE WHEN c_custkey % 10 = 0 THEN 'svc-' || c_custkey ELSE 'u' || c_custkey END")
    tagged = lambda df, team: df.select(F.lit("principals").alias("section"), F.col("c_custkey").alias("n"), F.to_json(F.struct(
        name.alias("arn"), F.lit("user").alias("type"), F.create_map(F.lit("team"), F.lit(team)).alias("tags"))).alias("item"))
    resources = w.view("resource").select(F.lit("resources").alias("section"), F.col("ordinal").alias("n"), F.to_json(F.struct(
        "arn", F.col("rtype").alias("type"), F.create_map(F.lit("Sensitivity"), F.upper("sensitivity")).alias("tags"))).alias("item"))
    people = w.table("customer")
    split_json.write_documents(tagged(people, "team-a").unionByName(resources).repartition(2, "n"), f"{root}/a", ["section", "n"])
    split_json.write_documents(tagged(people.filter("c_custkey % 3 = 0"), "team-b").repartition(1), f"{root}/b", ["section", "n"])
    found = snapshots.read_config_snapshots(w.spark, root)
    return found["principal_tags"].select(F.lit("tag").alias("kind"), "arn", F.col("tags")["team"].alias("value")).unionByName(
        found["resource_sensitivity"].select(F.lit("resource").alias("kind"), "arn", F.col("sensitivity").alias("value")))


@register("S9_geo_table", "SELECT src_ip, max(asn) AS asn, max(geo) AS geo FROM ev GROUP BY src_ip")
def s9(w):
    """Documents of one object per address; the later file wins."""
    root = _folder(w, "geo")
    table = w.events.groupBy("src_ip").agg(F.max("asn").alias("asn"), F.max("geo").alias("geo"))
    for part, geo in (("a", F.lit("old")), ("b", F.col("geo"))):
        item = F.concat(F.lit('"'), "src_ip", F.lit('": '), F.to_json(F.struct("asn", geo.alias("geo"))))
        rows = table.select(item.alias("item")).repartition(1).sortWithinPartitions("item")
        rows.select(F.concat(F.when(F.monotonically_increasing_id() == 0, "{").otherwise(","), "item").alias("value")).write.text(f"{root}/{part}")
    return snapshots.read_geo_table(w.spark, root)


# ---------------------------------------------------------------- authorisation snapshots

def _quoted(text: Column) -> Column:
    """A JSON string; null stays null."""
    listed = F.to_json(F.array(text))
    return F.when(text.isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))


def _statement_json() -> Column:
    full = lambda c: F.when(F.size(c) > 0, F.col(c))
    one = lambda c: F.when(F.size(c) == 1, _quoted(F.col(c)[0])).when(F.size(c) > 1, F.to_json(c))  # noqa: E731 a single clause is a bare string
    fields = [F.concat(F.lit('"Effect":"'), "effect", F.lit('"')), *[F.concat(F.lit(f'"{name}":'), F.when(full(c).isNotNull(), one(c))) for name, c in (
        ("Action", "actions"), ("NotAction", "not_actions"), ("Resource", "resources"), ("NotResource", "not_resources"))],
        F.when(F.col("conditional"), F.concat(F.lit('"Condition":{"StringEquals":{"'), F.array_join("condition_keys", '":"x","'), F.lit('":"x"}}')))]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*fields)), ","), F.lit("}"))


def _policy_json(statements: DataFrame, keys: list[str]) -> DataFrame:
    """One document per key with its statements in order."""
    each = statements.select(*keys, "policy_ord", "stmt_ord", _statement_json().alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt_ord", "s"))), lambda x: x["s"]), ",")
    return each.groupBy(*keys, "policy_ord").agg(F.concat(F.lit('{"Statement":['), body, F.lit("]}")).alias("doc"))


#: Entities of a snapshot document, about; a small snapshot is four documents.
DOCUMENT_ROWS = 100_000


def authorization_documents(w: Workspace, path: str) -> None:
    """The permission tables as snapshot documents of one account, more, not longer, on larger input."""
    t = w.permissions
    listed = lambda df, value: df.groupBy("principal").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", value))), lambda x: x[value])).alias(value))
    inline = _policy_json(t["statement"].filter("owner_kind = 'principal'"), ["owner", "policy_name"])
    inline = inline.groupBy("owner").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(_quoted(F.col("policy_name")), F.lit(":"), "doc")), ","), F.lit("}")).alias("inline"))
    trusted = t["trust_statement"].withColumn("s", F.concat(
        F.lit('{"Effect":"'), "effect", F.lit('","Action":'), F.to_json("actions"), F.lit(',"Principal":{'), F.concat_ws(",",
            F.when(F.size("aws_principals") > 0, F.concat(F.lit('"AWS":'), F.to_json("aws_principals"))), F.when(F.size("service_principals") > 0, F.concat(F.lit('"Service":'), F.to_json("service_principals")))), F.lit("}}")))
    trusted = trusted.groupBy("role").agg(F.concat(F.lit('{"Statement":['), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stmt_ord", "s"))), lambda x: x["s"]), ","), F.lit("]}")).alias("trust"))
    field = lambda name, c: F.concat(F.lit(f',"{name}":'), c)
    people = (t["principal"].join(listed(t["attachment"], "policy").withColumnRenamed("principal", "arn"), "arn", "left")
              .join(listed(t["membership"], "group_name").withColumnRenamed("principal", "arn"), "arn", "left")
              .join(inline.withColumnRenamed("owner", "arn"), "arn", "left").join(trusted.withColumnRenamed("role", "arn"), "arn", "left"))
    parts = [F.concat(F.lit('{"arn":'), _quoted(F.col("arn")), F.lit(',"name":'), _quoted(F.col("name"))), field("attached_managed_policies", F.col("policy")), field("groups", F.col("group_name")),
             field("inline_policies", F.col("inline")), field("trust_policy", F.col("trust")), field("permission_boundary", _quoted(F.col("boundary")))]
    people = people.select(F.concat("ptype", F.lit("s")).alias("section"), "ordinal", F.concat(F.concat_ws("", *parts), F.lit("}")).alias("item"))
    policies = t["policy"].join(_policy_json(t["statement"].filter("owner_kind = 'policy'"), ["owner"]).withColumnRenamed("owner", "arn"), "arn", "left")
    policies = policies.select(F.lit("managed_policies").alias("section"), "ordinal", F.concat(
        F.concat_ws("", F.concat(F.lit('{"arn":'), _quoted(F.col("arn")), F.lit(',"name":'), _quoted(F.col("name"))), field("document", F.col("doc"))), F.lit("}")).alias("item"))
    own = _policy_json(t["statement"].filter("owner_kind = 'resource'"), ["owner"]).withColumnRenamed("owner", "arn")
    things = t["resource"].join(own, "arn", "left").select(F.lit("resources").alias("section"), "ordinal", F.concat(F.concat_ws(
        "", F.concat(F.lit('{"arn":'), _quoted(F.col("arn")), F.lit(',"type":"'), "rtype", F.lit('","tags":{"Sensitivity":"'), "sensitivity", F.lit('"}')), field("resource_policy", F.col("doc"))), F.lit("}")).alias("item"))
    rows = people.unionByName(policies).unionByName(things)
    files = max(4, sum(t[n].count() for n in ("principal", "policy", "resource")) // DOCUMENT_ROWS)
    split_json.write_documents(rows.repartition(files, "ordinal"), path, ["section", "ordinal"], head=f'"account": "{r.ACCOUNT}"')


def _snapshot(w: Workspace) -> dict[str, DataFrame]:
    def build():
        path = _folder(w, "authorization")
        authorization_documents(w, path)
        return snapshots.read_authorization(w.spark, path)
    return w.once("snapshot", build)


@register("S7_principals", "SELECT account, arn, name, ptype, sensitivity, boundary FROM principal")
def s7_principals(w):
    return _snapshot(w)["principal"].select("account", "arn", "name", "ptype", "sensitivity", "boundary")


@register("S7_links", "SELECT 'policy' AS kind, principal, policy AS other FROM attachment UNION ALL SELECT 'group', principal, group_name FROM membership UNION ALL SELECT 'inline', principal, policy_name FROM inline_policy")
def s7_links(w):
    s = _snapshot(w)
    part = lambda name, kind, other: s[name].select(F.lit(kind).alias("kind"), "principal", F.col(other).alias("other"))
    return part("attachment", "policy", "policy").unionByName(part("membership", "group", "group_name")).unionByName(part("inline_policy", "inline", "policy_name"))


_TEXTS = ("actions", "not_actions", "resources", "not_resources", "condition_keys")


@register("S7_statements", f"SELECT owner, owner_kind, policy_name, stmt_ord, effect, conditional, {', '.join(f'array_to_string({c}, chr(44)) AS {c}' for c in _TEXTS)} FROM statement")
def s7_statements(w):
    return _snapshot(w)["statement"].select("owner", "owner_kind", "policy_name", F.col("stmt_ord").cast("long").alias("stmt_ord"), "effect", "conditional", *[F.array_join(c, ",").alias(c) for c in _TEXTS])


@register("S7_trust", """SELECT role, effect, array_to_string(actions, ',') AS actions, array_to_string(aws_principals, ',') AS aws_principals, array_to_string(service_principals, ',') AS service_principals FROM trust_statement""")
def s7_trust(w):
    return _snapshot(w)["trust_statement"].select("role", "effect", *[F.array_join(c, ",").alias(c) for c in ("actions", "aws_principals", "service_principals")])


@register("S7_resources", "SELECT account, arn, rtype, sensitivity FROM resource")
def s7_resources(w):
    return _snapshot(w)["resource"].select("account", "arn", "rtype", "sensitivity")


@register("S7_decisions", f"SELECT {r._DECISION} FROM ({o.decisions('probe')})")
def s7_decisions(w):
    """Decisions over permission tables that came through the snapshot reader."""
    s = _snapshot(w)
    return graph.decide(r._probes(w), s, graph.statement_index(s))
