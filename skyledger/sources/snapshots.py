"""Configuration and authorisation snapshots, geo tables, rules and playbooks as normalised tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import json_field, json_list
from skyledger.functions.sliced import first_by
from skyledger.session import cut_lineage
from skyledger.sources.split_json import file_fragments, split_objects


def sensitivity(tags: Column) -> Column:
    """``Sensitivity`` tag to its level; anything unknown or missing is ``unknown``."""
    level = F.lower(F.try_element_at(tags, F.lit("Sensitivity")))
    return F.when(level.isin(fixed.SENSITIVITIES), level).otherwise("unknown")


def read_config_snapshots(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``principal_tags(arn, tags)`` and ``resource_sensitivity(arn, sensitivity)``; later files win."""
    objects = cut_lineage(split_objects(file_fragments(spark, path)))

    def latest(section: str) -> DataFrame:
        rows = objects.filter((F.col("section") == section) & F.col("item").isNotNull())
        rows = rows.select("path", "pos", F.from_json("item", "arn STRING, type STRING, tags MAP<STRING, STRING>").alias("it")).select("path", "pos", "it.*")
        return rows.groupBy("arn").agg(F.max_by("tags", F.struct("path", "pos")).alias("tags"))

    return {
        "principal_tags": latest("principals"),
        "resource_sensitivity": latest("resources").select("arn", sensitivity(F.col("tags")).alias("sensitivity")),
    }


def read_geo_table(spark: SparkSession, path: str) -> DataFrame:
    """``{ip: {asn, geo}}`` files as ``geo(src_ip, asn, geo)``, one row per address; later files win."""
    rows = split_objects(file_fragments(spark, path)).filter("section IS NOT NULL AND item IS NOT NULL")
    rows = rows.select("path", F.col("section").alias("src_ip"), F.from_json("item", "asn string, geo string").alias("v"))
    return rows.groupBy("src_ip").agg(F.max_by("v", "path").alias("v")).select("src_ip", "v.asn", "v.geo")


def read_rules(path: str | None = None) -> list[dict]:
    """Rule documents from a folder of YAML files, or the shipped set. Unknown technique ids are an error."""
    rules = fixed.RULES if path is None else _yaml_documents(path)
    rules = [r for r in rules if "detection" in r]
    for rule in rules:
        unknown = set(techniques_of(rule)) - set(fixed.TECHNIQUES)
        if unknown:
            raise KeyError(f"rule {rule['id']!r} cites unknown technique ids {sorted(unknown)}")
    return rules


def techniques_of(rule: dict) -> list[str]:
    ids = rule.get("attack") or rule.get("tags") or []
    return [ids] if isinstance(ids, str) else list(ids)


def _yaml_documents(path: str) -> list[dict]:
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise RuntimeError("reading rule folders needs PyYAML; pass rule dictionaries instead") from exc
    from pathlib import Path
    docs: list[dict] = []
    for file in sorted([*Path(path).glob("*.yml"), *Path(path).glob("*.yaml")]):
        docs += [d for d in yaml.safe_load_all(file.read_text(encoding="utf-8")) if d]
    return docs


def playbooks(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Playbook corpus as a small table with the three tag arrays."""
    items = fixed.PLAYBOOKS if path is None else _yaml_documents(path)
    rows = [(p["id"], str(p["version"]), p["title"], list(p.get("detection_types", [])),
             list(p.get("attack_ids", [])), list(p.get("action_names", [])), list(p.get("steps", []))) for p in items]
    return spark.createDataFrame(rows, "playbook_id STRING, version STRING, title STRING, detection_types ARRAY<STRING>,"
                                       " attack_ids ARRAY<STRING>, action_names ARRAY<STRING>, steps ARRAY<STRING>")


# ---------------------------------------------------------------- authorisation snapshots

_ENTITY = ("arn STRING, name STRING, tags MAP<STRING, STRING>, attached_managed_policies ARRAY<STRING>, inline_policies MAP<STRING, STRING>, "
           "groups ARRAY<STRING>, permission_boundary STRING, trust_policy STRING")
_POLICY = "arn STRING, name STRING, document STRING"
_RESOURCE = "arn STRING, type STRING, tags MAP<STRING, STRING>, resource_policy STRING"


def parse_statements(df: DataFrame, document: str, keep: list[str]) -> DataFrame:
    """Explode policy documents into normalised statements.

    ``Statement`` may be one object or a list, each clause a string or a list; a missing effect means Deny.
    """
    items = df.select(*keep, F.posexplode(json_list(json_field(F.col(document), "Statement"))).alias("stmt_ord", "s"))

    def clause(name: str) -> Column:
        return json_list(json_field(F.col("s"), name))

    conditions = F.from_json(json_field(F.col("s"), "Condition"), "map<string, string>")
    # operator blocks that are objects contribute their keys, in document order
    keys = F.flatten(F.transform(F.map_values(conditions),
                                 lambda b: F.coalesce(F.json_object_keys(b), F.array().cast("array<string>"))))
    return items.select(
        *keep, "stmt_ord",
        F.coalesce(json_field(F.col("s"), "Effect"), F.lit("Deny")).alias("effect"),
        clause("Action").alias("actions"), clause("NotAction").alias("not_actions"),
        clause("Resource").alias("resources"), clause("NotResource").alias("not_resources"),
        F.coalesce(F.size(F.map_keys(conditions)) > 0, F.lit(False)).alias("conditional"),
        F.coalesce(keys, F.array().cast("array<string>")).alias("condition_keys"),
        json_field(F.col("s"), "Principal").alias("principal_json"),
        json_field(F.col("s"), "Condition").alias("condition_json"),
        json_field(F.col("s"), "Sid").alias("sid"),
    )


def trust_names(principal_json: Column, kind: str) -> Column:
    """Names of one kind (``AWS`` or ``Service``) in a Principal element; a bare string counts as AWS."""
    is_object = F.ltrim(principal_json).startswith("{")
    inner = json_list(json_field(principal_json, kind))
    bare = F.array(principal_json) if kind == "AWS" else F.array().cast("array<string>")
    names = F.when(principal_json.isNull(), F.array().cast("array<string>")).when(is_object, inner).otherwise(bare)
    return F.filter(names, lambda n: n.isNotNull() & (n != ""))


def read_authorization(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Load snapshots once into written permission tables, so later joins never parse JSON again.

    A snapshot of one huge account is cut into its entities by many tasks; nothing holds it whole.
    """
    parsed = authorization_tables(cut_lineage(split_objects(file_fragments(spark, path))))
    return {name: cut_lineage(table) for name, table in parsed.items()}


def authorization_tables(objects: DataFrame) -> dict[str, DataFrame]:
    """Split objects of snapshots, one document per account, to the normalised permission tables.

    principal(account, arn, name, ptype, sensitivity, boundary, ordinal), attachment(principal, policy, ordinal),
    membership(principal, group_name, ordinal), inline_policy(principal, policy_name, ordinal),
    policy(account, arn, name, ordinal),
    statement(owner, owner_kind, policy_name, policy_ord, stmt_ord, ...), trust_statement(role, ...),
    resource(account, arn, rtype, sensitivity, ordinal).
    """
    # the account stands among the scalars of the document, before or after its lists
    said = F.regexp_extract("outside", r'"account"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    named = F.max(F.from_json(F.concat(F.lit('{"a":'), said, F.lit("}")), "a STRING")["a"])
    account = objects.groupBy("path").agg(F.coalesce(named, F.lit("unknown")).alias("account"))

    def items(section: str, schema: str) -> DataFrame:
        rows = objects.filter((F.col("section") == section) & F.col("item").isNotNull()).join(account, "path")
        return rows.select("account", F.col("pos").alias("ordinal"), F.from_json("item", schema).alias("e")).select("account", "ordinal", "e.*")

    entities = None
    for section, ptype, rank in [("groups", "group", 0), ("users", "user", 1), ("roles", "role", 2)]:
        part = items(section, _ENTITY).withColumn("ptype", F.lit(ptype)).withColumn("ordinal", F.col("ordinal") + (rank << 40))
        entities = part if entities is None else entities.unionByName(part)
    entities = entities.withColumn("name", F.coalesce("name", "arn"))

    policies = first_by(items("managed_policies", _POLICY).withColumn("name", F.coalesce("name", "arn")), ["arn"], ["ordinal"])
    inline = entities.select(F.col("arn").alias("principal"),
                             F.posexplode(F.map_entries("inline_policies")).alias("ordinal", "kv")).select(
        "principal", "ordinal", F.col("kv.key").alias("policy_name"), F.col("kv.value").alias("document"))
    resources = items("resources", _RESOURCE)

    own = parse_statements(inline.select(F.col("principal").alias("owner"), F.lit("principal").alias("owner_kind"),
                                         "policy_name", F.col("ordinal").alias("policy_ord"), "document"),
                           "document", ["owner", "owner_kind", "policy_name", "policy_ord"])
    managed = parse_statements(policies.select(F.col("arn").alias("owner"), F.lit("policy").alias("owner_kind"),
                                               F.col("name").alias("policy_name"), F.lit(0).alias("policy_ord"),
                                               "document"),
                               "document", ["owner", "owner_kind", "policy_name", "policy_ord"])
    on_resource = parse_statements(resources.select(F.col("arn").alias("owner"), F.lit("resource").alias("owner_kind"),
                                                    F.lit("resource-policy").alias("policy_name"),
                                                    F.lit(0).alias("policy_ord"),
                                                    F.col("resource_policy").alias("document")),
                                   "document", ["owner", "owner_kind", "policy_name", "policy_ord"])
    trust = parse_statements(entities.filter(F.col("trust_policy").isNotNull())
                             .select("account", F.col("arn").alias("role"), F.col("ordinal").alias("role_ord"), "trust_policy"),
                             "trust_policy", ["account", "role", "role_ord"])
    return {
        "principal": entities.select("account", "arn", "name", "ptype", sensitivity(F.col("tags")).alias("sensitivity"),
                                     F.when(F.col("permission_boundary") != "", F.col("permission_boundary")).alias("boundary"),
                                     "ordinal"),
        "attachment": entities.select(F.col("arn").alias("principal"),
                                      F.posexplode("attached_managed_policies").alias("ordinal", "policy")),
        "membership": entities.select(F.col("arn").alias("principal"),
                                      F.posexplode("groups").alias("ordinal", "group_name")),
        "inline_policy": inline.select("principal", "policy_name", "ordinal"),
        "policy": policies.select("account", "arn", "name", "ordinal"),
        "statement": own.unionByName(managed).unionByName(on_resource).drop("principal_json", "condition_json"),
        "trust_statement": trust.select(
            "account", "role", "role_ord", "stmt_ord", "effect", "actions",
            trust_names(F.col("principal_json"), "AWS").alias("aws_principals"),
            trust_names(F.col("principal_json"), "Service").alias("service_principals")),
        "resource": resources.select("account", "arn", F.coalesce("type", F.lit("unknown")).alias("rtype"),
                                     sensitivity(F.col("tags")).alias("sensitivity"), "ordinal"),
    }
