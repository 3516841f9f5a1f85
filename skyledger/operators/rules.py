"""Signature layer: rule documents compiled to boolean columns, evaluated in one pass over the events."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from skyledger.functions import fixed
from skyledger.functions.columns import arn_account, ipv4_to_long, json_field, json_list, lookup
from skyledger.sources.snapshots import techniques_of, trust_names

# event column -> type family used by the matching semantics
FIELDS = {
    "event": "text", "principal": "text", "principal_type": "text", "region": "text", "account": "text",
    "src_ip": "text", "asn": "text", "geo": "text", "user_agent": "text", "mfa": "flag",
    "resource_sensitivity": "text", "read_only": "flag", "error_code": "text", "severity": "number",
    "source": "text", "target": "text", "event_id": "text",
    "session.issuer_arn": "text", "session.issuer_type": "text", "session.session_name": "text",
    "session.mfa_authenticated": "flag",
}


# ---------------------------------------------------------------- derived indicators

_JSON_STRING_VALUE = (r'"(?:[^"\\]|\\.)*(?:' + "|".join(re.escape(w) for w in fixed.WORLD_RANGES)
                      + r')(?:[^"\\]|\\.)*"(?!:)')


def opens_world(params: Column) -> Column:
    """Any nested string value (keys do not count) naming a world range."""
    canonical = F.to_json(F.try_parse_json(params))
    return F.coalesce(canonical.rlike(_JSON_STRING_VALUE), F.lit(False))


def trusts_outside(document: Column, account: Column) -> Column:
    """An allow statement naming another account or everyone; an unreadable document counts when it holds ``*``."""
    readable = F.try_parse_json(document).isNotNull()

    def widens(stmt: Column) -> Column:
        principal = json_field(stmt, "Principal")
        names = F.when(F.ltrim(principal).startswith("{"), trust_names(principal, "AWS")).otherwise(F.array().cast("array<string>"))
        outside = F.exists(names, lambda n: (n == "*") | F.coalesce(arn_account(n) != account, F.lit(False)))
        return (F.lower(json_field(stmt, "Effect")) == "allow") & outside

    found = F.exists(json_list(json_field(document, "Statement")), widens)
    return F.coalesce(F.when(readable, found).otherwise(F.contains(document, F.lit("*"))), F.lit(False))


def derived_indicators() -> dict[str, Column]:
    """Null where the indicator does not apply to the event."""
    event, params = F.col("event"), F.col("params")
    document = reduce(lambda acc, kv: F.when(event == kv[0], json_field(params, kv[1])).otherwise(acc),
                      fixed.TRUST_DOCUMENT_PARAM.items(), F.lit(None).cast("string"))
    size = F.lower(F.coalesce(json_field(params, "instanceType"), F.lit("")))
    families = "^(" + "|".join(re.escape(p) for p in fixed.BIG_INSTANCE_FAMILIES) + ")"
    big = size.rlike(families) | size.rlike("|".join(fixed.BIG_INSTANCE_SIZES))
    return {
        "sg_opens_world": F.when(event.isin(fixed.OPEN_GROUP_EVENTS), opens_world(params)),
        "external_trust_added": F.when(event.isin(list(fixed.TRUST_DOCUMENT_PARAM)),
                                       trusts_outside(document, F.col("account"))),
        "gpu_or_large_instance": F.when(event == "RunInstances", big),
    }


# ---------------------------------------------------------------- field matching

@F.pandas_udf(BooleanType())
def _ip_in_network(ips: pd.Series, networks: pd.Series) -> pd.Series:
    """IPv6 (and mixed) membership; Spark has no built-in for it."""
    def hit(ip, network):
        try:
            return ipaddress.ip_address(ip) in ipaddress.ip_network(network, strict=False)
        except ValueError:
            return False
    return pd.Series([ip is not None and hit(ip, n) for ip, n in zip(ips, networks)])


def in_network(ip: Column, network: str) -> Column:
    """CIDR membership; host bits are allowed and malformed input is false."""
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        return F.coalesce(ipv4_to_long(ip).between(int(net.network_address), int(net.broadcast_address)), F.lit(False))
    return F.when(ip.contains(":"), _ip_in_network(ip, F.lit(network))).otherwise(False)


def _param(name: str) -> tuple[Column, Column]:
    """Text and JSON type of one top-level scalar request parameter."""
    v = F.try_variant_get(F.try_parse_json(F.col("params")), f"$['{name}']", "variant")
    return F.try_variant_get(v, "$", "string"), F.schema_of_variant(v)


def _text_of(c: Column, family: str) -> Column:
    if family == "flag":
        return F.initcap(c.cast("string"))  # booleans print as True / False
    return c if family == "text" else c.cast("string")


def _modified(modifier: str, c: Column, value) -> Column:
    v = str(value)
    if modifier == "contains":
        return F.lower(c).contains(v.lower())
    if modifier == "startswith":
        return F.lower(c).startswith(v.lower())
    if modifier == "endswith":
        return F.lower(c).endswith(v.lower())
    if modifier == "re":
        return c.rlike(v)
    if modifier == "cidr":
        return in_network(c, v)
    raise ValueError(f"unknown field modifier {modifier!r}")


def _equals(c: Column, family: str, value) -> Column:
    """Equality with truthiness where either side is boolean, ignoring case for text."""
    if family == "flag":
        return c == F.lit(bool(value))
    if isinstance(value, bool):
        truthy = (c != "") if family == "text" else (c != 0)
        return truthy == F.lit(value)
    if family == "text":
        return F.lower(c) == str(value).lower()
    return c == F.lit(value) if isinstance(value, (int, float)) else F.lit(False)


def match_field(field: str, value, derived: dict[str, Column]) -> Column:
    name, *modifiers = field.split("|")
    values = value if isinstance(value, list) else [value]

    def one(c: Column, family: str) -> Column:
        tests = [_modified(modifiers[0], _text_of(c, family), v) if modifiers else _equals(c, family, v) for v in values]
        return reduce(or_, tests, F.lit(False))

    if name in FIELDS:
        test = one(F.col(name), FIELDS[name])
    elif name.startswith("derived.") and name[8:] in derived:
        test = one(derived[name[8:]], "flag")
    elif name == "params":
        test = one(canonical_params(F.col("params"), F.col("event_source"), F.col("bytes_transferred")), "text")
    elif name.startswith("params."):
        text, kind = _param(name[7:])
        test = (F.when(kind == "STRING", one(text, "text")).when(kind == "BOOLEAN", one(text.cast("boolean"), "flag"))
                .when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), one(text.cast("double"), "number")))
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def canonical_params(params: Column, event_source: Column, bytes_transferred: Column) -> Column:
    """Parameters as one JSON text with ``, `` and ``: `` separators, merged with source and byte count.

    Keys keep their order and numbers their text; characters above 127 are written as ``\\u`` escapes.
    """
    extra = F.concat(F.lit('"__event_source": '), F.coalesce(F.concat(F.lit('"'), event_source, F.lit('"')), F.lit("null")),
                     F.coalesce(F.concat(F.lit(', "bytesTransferred": '), bytes_transferred.cast("string")), F.lit("")))
    is_object = F.schema_of_variant(F.try_parse_json(params)).startswith("OBJECT")
    body = F.when(is_object, params).otherwise("{}")
    # white space, commas and colons count only outside string literals
    literal = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")'
    spaced = F.regexp_replace(body, literal + r"|[ \t\r\n]+", "$1")
    spaced = F.regexp_replace(spaced, literal + "|([,:])", "$1$2 ")
    spaced = F.regexp_replace(spaced, literal + " ", "$1")
    inner = F.substring(spaced, F.lit(2), F.length(spaced) - 2)
    return escaped(F.concat(F.lit("{"), F.when(F.length(inner) > 0, F.concat(inner, F.lit(", "))).otherwise(""), extra, F.lit("}")))


def escaped(text: Column) -> Column:
    """JSON text with characters above 127 as ``\\u`` escapes, those beyond the basic plane as surrogate pairs."""
    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))

    def one(char: Column) -> Column:
        code = F.ascii(char)
        beyond = code - 0x10000
        pair = F.concat(unit(F.shiftright(beyond, 10) + 0xD800), unit(beyond.bitwiseAND(0x3FF) + 0xDC00))
        return F.when(code < 128, char).when(code < 0x10000, unit(code)).otherwise(pair)

    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(chars, one), "")).otherwise(text)


def match_block(block, derived: dict[str, Column]) -> Column:
    """A map is AND over its fields (empty matches all); a list of maps is OR."""
    if isinstance(block, list):
        return reduce(or_, [match_block(b, derived) for b in block], F.lit(False))
    return reduce(and_, [match_field(f, v, derived) for f, v in block.items()], F.lit(True))


def condition_sql(condition: str, names: dict[str, str]) -> str:
    """Rule condition as a SQL boolean expression over the selection columns in ``names``."""
    def quantified(m: re.Match) -> str:
        chosen = [n for n in names if m.group(2) == "them" or n.startswith(m.group(2).rstrip("*"))]
        return "(" + (" and " if m.group(1) == "all" else " or ").join(chosen or ["false"]) + ")"

    text = re.sub(r"\b(all|1|any)\s+of\s+(\w+\*|them\b)", quantified, condition.strip())
    return re.sub(r"[\w.*]+", lambda m: m.group(0) if m.group(0) in ("and", "or", "not") else names.get(m.group(0), "false"), text)


def match_rules(events: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Detections of every rule from one scan: each event carries the array of rules it hits, then explodes.

    ``events`` needs ``seq`` (arrival order), ``us`` and the event columns the rules name.
    """
    rules = fixed.RULES if rules is None else rules
    derived = derived_indicators()
    selections, hits = [], []
    for no, rule in enumerate(rules):
        blocks = {k: v for k, v in rule["detection"].items() if k != "condition"}
        names = {n: f"_r{no}_{i}" for i, n in enumerate(blocks)}
        selections += [match_block(blocks[n], derived).alias(alias) for n, alias in names.items()]
        condition = str(rule["detection"].get("condition") or " and ".join(blocks))
        hits.append(F.when(F.expr(condition_sql(condition, names)), F.struct(
            F.lit(no).alias("rule_no"), F.lit(rule["id"]).alias("key"),
            F.lit(float(rule.get("confidence", 0.5))).alias("confidence"),
            F.lit(rule.get("title", rule["id"])).alias("message"),
            F.lit(rule.get("level", "medium")).alias("level"))))
    anchor = [c for c in ANCHOR if c in events.columns]
    keep = [c for c in ("scenario",) if c in events.columns]
    return (events.select(*keep, *anchor, *selections)
            .select(*keep, *anchor, F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("hit"))
            .select(*keep, *anchor, "hit.*")
            .select(*keep, *detection_columns(F.col("key"), F.col("confidence"), F.col("message"),
                                              F.to_json(F.struct("level")), stage=0, sub=F.col("rule_no"))))


# ---------------------------------------------------------------- detection records

ANCHOR = ["seq", "us", "principal", "src_ip", "account", "region", "event_id", "event"]


def detection_columns(key: Column, confidence: Column, message: Column, evidence: Column, stage: int,
                      sub: Column | None = None) -> list[Column]:
    """Narrow detection row anchored on an event row; the constant text of a key is added by :func:`describe`.

    ``det_id`` names the detection; (stage, seq, sub) is its place in emission order.
    """
    return [
        F.concat_ws("|", key, F.col("event_id"), F.col("seq").cast("string")).alias("det_id"), key.alias("key"),
        confidence.alias("confidence"), F.lit(stage).alias("stage"), F.col("seq"),
        (F.lit(0) if sub is None else sub).cast("int").alias("sub"), F.col("us"), F.col("principal"), F.col("src_ip"),
        F.col("account"), F.col("region"), F.col("event_id"), F.col("event").alias("event_name"),
        message.alias("message"), evidence.alias("evidence"),
    ]


def unanchored(df: DataFrame, det_id: Column, key: str, confidence: Column, message: Column, evidence: Column,
               us: Column, stage: int, account: Column | None = None) -> DataFrame:
    """Detection rows that name a principal but no event."""
    none = F.lit(None).cast("string")
    keep = [c for c in ("scenario",) if c in df.columns]
    return df.select(
        *keep, det_id.alias("det_id"), F.lit(key).alias("key"), confidence.alias("confidence"), F.lit(stage).alias("stage"),
        F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("sub"), us.cast("bigint").alias("us"), F.col("principal"),
        none.alias("src_ip"), (none if account is None else account).alias("account"), none.alias("region"),
        none.alias("event_id"), none.alias("event_name"), message.alias("message"), evidence.alias("evidence"))


def key_catalogue(rules: list[dict] | None = None) -> dict[str, tuple[str, str, list[str], list[str]]]:
    """key -> (title, layer, techniques, false positive notes) for rules and detectors."""
    rules = fixed.RULES if rules is None else rules
    return {**{r["id"]: (r.get("title", r["id"]), "signature", techniques_of(r), list(r.get("falsepositives") or []))
               for r in rules}, **fixed.DETECTORS}


def _by_key(rules, pick) -> Column:
    pairs = [x for k, v in key_catalogue(rules).items() for x in (F.lit(k), pick(v))]
    return F.create_map(*pairs)


def attack_ids(key: Column, rules: list[dict] | None = None) -> Column:
    """Techniques of a detection key (constant map)."""
    return F.coalesce(F.try_element_at(_by_key(rules, lambda v: F.array(*map(F.lit, v[2]))), key),
                      F.array().cast("array<string>"))


def tactics(ids: Column) -> Column:
    """Distinct tactics in technique order."""
    table = {k: v[1] for k, v in fixed.TECHNIQUES.items()}
    return F.array_distinct(F.transform(ids, lambda i: lookup(table, i)))


def describe(detections: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Add title, layer, techniques, tactics and notes to narrow detection rows."""
    empty = F.array().cast("array<string>")
    title = F.try_element_at(_by_key(rules, lambda v: F.lit(v[0])), F.col("key"))
    layer = F.try_element_at(_by_key(rules, lambda v: F.lit(v[1])), F.col("key"))
    notes = F.try_element_at(_by_key(rules, lambda v: F.array(*map(F.lit, v[3])) if v[3] else empty), F.col("key"))
    ids = attack_ids(F.col("key"), rules)
    return (detections.withColumn("title", title).withColumn("layer", layer).withColumn("attack_ids", ids)
            .withColumn("tactics", tactics(ids)).withColumn("false_positive_notes", notes))


def unresolved_techniques(detections: DataFrame) -> DataFrame:
    """Technique ids outside the registry; must be empty."""
    ids = detections.select(F.explode("attack_ids").alias("attack_id")).distinct()
    return ids.filter(~F.col("attack_id").isin(list(fixed.TECHNIQUES)))
