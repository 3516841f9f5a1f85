"""Identity graph and policy evaluation as joins over the normalised permission tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import any_glob_matches, arn_account, blank_to_null, glob_matches, literal_prefix
from skyledger.functions.sliced import first_by
from skyledger.session import cut_lineage

Tables = dict[str, DataFrame]
_ORD = "array<bigint>"


def _ord(*parts) -> Column:
    return F.array(*[F.lit(p).cast("bigint") if isinstance(p, int) else p.cast("bigint") for p in parts])


# ---------------------------------------------------------------- graph

def trusted_principals(tables: Tables) -> DataFrame:
    """(account, role, who, external, ord): principals a role trust policy lets assume the role."""
    s = tables["trust_statement"].filter((F.lower("effect") == "allow")
                                         & F.exists("actions", lambda a: F.lower(a).isin(fixed.ASSUME_ACTIONS)))
    who = s.select("account", "role", "role_ord", "stmt_ord", F.posexplode("aws_principals").alias("pos", "who"))
    external = (F.col("who") == "*") | F.coalesce(arn_account(F.col("who")) != F.col("account"), F.lit(False))
    return who.select("account", "role", "who", external.alias("external"), _ord(F.col("role_ord"), F.col("stmt_ord"), F.col("pos")).alias("ord"))


def build_nodes(tables: Tables) -> DataFrame:
    """nodes(id, kind, label, ptype, rtype, sensitivity); the first definition of an id wins."""
    p, none = tables["principal"], F.lit(None).cast("string")

    def part(df, ident, kind, label, order, ptype=none, rtype=none, sens=none):
        return df.select(ident.alias("id"), F.lit(kind).alias("kind"), label.alias("label"), ptype.alias("ptype"),
                         rtype.alias("rtype"), sens.alias("sensitivity"), order.alias("ord"))

    held = tables["attachment"].join(p.select(F.col("arn").alias("principal"), F.col("ordinal").alias("p_ord")), "principal")
    inline = tables["inline_policy"].join(p.select(F.col("arn").alias("principal"), F.col("ordinal").alias("p_ord")), "principal")
    trust = trusted_principals(tables)
    parts = [
        part(p.select("account").distinct(), F.col("account"), "Account", F.col("account"), _ord(0, 0, 0, 0)),
        part(tables["policy"], F.col("arn"), "Policy", F.col("name"), _ord(1, F.col("ordinal"), 0, 0), F.lit("managed")),
        part(p, F.col("arn"), "Principal", F.col("name"), _ord(2, F.col("ordinal"), 0, 0), F.col("ptype"), sens=F.col("sensitivity")),
        part(held, F.col("policy"), "Policy", F.col("policy"), _ord(2, F.col("p_ord"), 1, F.col("ordinal")), F.lit("managed")),
        part(inline, F.concat("principal", F.lit("#inline/"), "policy_name"), "Policy", F.col("policy_name"),
             _ord(2, F.col("p_ord"), 2, F.col("ordinal")), F.lit("inline")),
        part(p.filter("boundary IS NOT NULL"), F.col("boundary"), "Policy", F.col("boundary"), _ord(2, F.col("ordinal"), 3, 0), F.lit("managed")),
        part(trust, F.col("who"), "Principal", F.col("who"), F.concat(_ord(3), F.col("ord")),
             F.when(F.col("external"), "external").otherwise("user")),
        part(tables["resource"], F.col("arn"), "Resource", F.col("arn"), _ord(4, F.col("ordinal"), 0, 0), none, F.col("rtype"), F.col("sensitivity")),
    ]
    return first_by(reduce(DataFrame.unionByName, parts), ["id"], ["ord"])


EDGE = "kind STRING, src STRING, dst STRING, ord ARRAY<BIGINT>, attachment STRING, external BOOLEAN, technique STRING, attack_id STRING, conditional BOOLEAN, detail STRING"


def edge(df: DataFrame, kind: str, src: Column, dst: Column, order: Column, **props: Column) -> DataFrame:
    def prop(name: str, dtype: str) -> Column:
        return props.get(name, F.lit(None)).cast(dtype).alias(name)

    return df.select(F.lit(kind).alias("kind"), src.alias("src"), dst.alias("dst"), order.alias("ord"),
                     prop("attachment", "string"), prop("external", "boolean"), prop("technique", "string"),
                     prop("attack_id", "string"), prop("conditional", "boolean"), prop("detail", "string"))


def build_edges(tables: Tables) -> DataFrame:
    """Structural edges: HAS_POLICY, PERMISSION_BOUNDARY, MEMBER_OF, CAN_ASSUME, OWNS_RESOURCE."""
    p = tables["principal"]
    owner = p.select(F.col("arn").alias("principal"), F.col("ordinal").alias("p_ord"))
    held = tables["attachment"].join(owner, "principal")
    inline = tables["inline_policy"].join(owner, "principal")
    groups = p.filter("ptype = 'group'").groupBy("name").agg(F.max_by("arn", "ordinal").alias("group_arn"))
    member = tables["membership"].join(owner, "principal").join(groups, F.col("group_name") == F.col("name"))
    trust = trusted_principals(tables)
    return reduce(DataFrame.unionByName, [
        edge(held, "HAS_POLICY", F.col("principal"), F.col("policy"), _ord(2, F.col("p_ord"), 1, F.col("ordinal")), attachment=F.lit("attached")),
        edge(inline, "HAS_POLICY", F.col("principal"), F.concat("principal", F.lit("#inline/"), "policy_name"),
             _ord(2, F.col("p_ord"), 2, F.col("ordinal")), attachment=F.lit("inline")),
        edge(p.filter("boundary IS NOT NULL"), "PERMISSION_BOUNDARY", F.col("arn"), F.col("boundary"), _ord(2, F.col("ordinal"), 3, 0)),
        edge(member, "MEMBER_OF", F.col("principal"), F.col("group_arn"), _ord(2, F.col("p_ord"), 4, F.col("ordinal"))),
        edge(trust, "CAN_ASSUME", F.col("who"), F.col("role"), F.concat(_ord(3), F.col("ord")), external=F.col("external")),
        edge(tables["resource"], "OWNS_RESOURCE", F.col("account"), F.col("arn"), _ord(4, F.col("ordinal"))),
    ])


def edges_of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind)


def assume_targets(edges: DataFrame, principal: str) -> DataFrame:
    return edges.filter((F.col("kind") == "CAN_ASSUME") & (F.col("src") == principal)).select("dst")


# ---------------------------------------------------------------- applicable statements

_CLAUSES = ["effect", "actions", "not_actions", "resources", "not_resources", "conditional", "condition_keys"]


def applicable_statements(tables: Tables) -> DataFrame:
    """Identity statements per principal with provenance label and order: inline, attached, then each group's."""
    s, p = tables["statement"], tables["principal"]
    own = s.filter("owner_kind = 'principal'")
    managed = s.filter("owner_kind = 'policy'")
    attached = tables["attachment"]
    groups = p.filter("ptype = 'group'").groupBy("name").agg(F.max_by("arn", "ordinal").alias("group_arn"))
    member = (tables["membership"].join(groups, F.col("group_name") == F.col("name"))
              .select("principal", "group_name", "group_arn", F.col("ordinal").alias("g_ord")))

    def rows(df, rank, kind, label, source_ord):
        return df.select(F.col("principal"), _ord(rank, kind, source_ord, F.col("stmt_ord")).alias("ord"), label.alias("label"), *_CLAUSES)

    inline = rows(own.withColumn("principal", F.col("owner")), 0, 0, F.concat(F.lit("inline:"), "policy_name"), F.col("policy_ord"))
    direct = rows(attached.join(managed, F.col("policy") == F.col("owner")), 0, 1, F.concat(F.lit("managed:"), "policy_name"), F.col("ordinal"))
    prefix = F.concat(F.lit("group:"), "group_name", F.lit("/"))
    g_inline = rows(member.join(own, F.col("group_arn") == F.col("owner")), F.col("g_ord") + 1, 0,
                    F.concat(prefix, F.lit("inline:"), "policy_name"), F.col("policy_ord"))
    g_held = attached.select(F.col("principal").alias("group_arn"), "policy", "ordinal").join(managed, F.col("policy") == F.col("owner"))
    g_managed = rows(member.join(g_held, "group_arn"), F.col("g_ord") + 1, 1, F.concat(prefix, F.lit("managed:"), "policy_name"), F.col("ordinal"))
    known = p.select(F.col("arn").alias("principal"))
    return reduce(DataFrame.unionByName, [inline, direct, g_inline, g_managed]).join(known, "principal", "left_semi")


def boundary_statements(tables: Tables) -> DataFrame:
    """(principal, boundary, statement or nulls): every principal with a boundary, even a dangling one."""
    limited = tables["principal"].filter("boundary IS NOT NULL").select(F.col("arn").alias("principal"), "boundary")
    return limited.join(tables["statement"].filter("owner_kind = 'policy'"), F.col("boundary") == F.col("owner"), "left")


def effective_grants(tables: Tables, index: DataFrame | None = None) -> DataFrame:
    """Merged symbolic grants per principal; negated clauses are shown as ``NOT x``."""
    a = identity_statements(index) if index is not None else applicable_statements(tables)

    def shown(positive: str, negative: str) -> Column:
        return F.when(F.size(positive) > 0, F.col(positive)).otherwise(F.transform(negative, lambda x: F.concat(F.lit("NOT "), x)))

    return a.select("principal", "ord", "effect", (F.lower("effect") == "deny").alias("is_deny"), shown("actions", "not_actions").alias("actions"),
                    shown("resources", "not_resources").alias("resources"), "conditional", F.col("label").alias("source"))


# ---------------------------------------------------------------- pattern matching joins

def match_globs(values: DataFrame, value: str, patterns: DataFrame, pattern: str, ignore_case: bool = False) -> DataFrame:
    """Matching (value, pattern) pairs over distinct values and patterns.

    A pattern can only match values that begin with the text before its first wildcard, so values are cut at the
    prefix lengths in use and met by equality; LIKE then decides. Each distinct pair is tested once.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    pats = (patterns.select(pattern).distinct().withColumn("_p", fold(F.col(pattern)))
            .withColumn("_pre", literal_prefix(F.col("_p"))).withColumn("_exact", F.col("_pre") == F.col("_p")))
    lengths = pats.filter("NOT _exact").agg(F.sort_array(F.collect_set(F.length("_pre")))).scalar()
    vals = values.select(value).filter(F.col(value).isNotNull()).distinct().withColumn("_v", fold(F.col(value)))
    # equal text first, then one row per wildcard prefix length
    cut = F.concat(F.array(F.struct(F.lit(True).alias("_exact"), F.col("_v").alias("_pre"))),
                   F.transform(F.filter("_lengths", lambda n: n <= F.length("_v")),
                               lambda n: F.struct(F.lit(False).alias("_exact"), F.substring(F.col("_v"), F.lit(1), n).alias("_pre"))))
    keyed = vals.withColumn("_lengths", lengths).select(value, "_v", F.explode(cut).alias("k")).select(value, "_v", "k.*")
    hits = keyed.join(pats, ["_exact", "_pre"])
    return hits.filter(F.col("_exact") | glob_matches(F.col("_p"), F.col("_v"))).select(value, pattern)


_ANY = "\u0001"
SALTS = 64


def _scope_resource() -> Column:
    """Resource side of a statement; no clause at all covers everything."""
    return (F.when(F.size("resources") > 0, any_glob_matches(F.col("resources"), F.col("resource")))
            .when(F.size("not_resources") > 0, ~any_glob_matches(F.col("not_resources"), F.col("resource")))
            .otherwise(True))


def indexed_for(statements: DataFrame, actions: DataFrame) -> DataFrame:
    """Statements keyed by the asked action they name; NotAction statements sit under a catch-all key."""
    positive = statements.filter(F.size("actions") > 0).select("*", F.explode("actions").alias("_pattern"))
    pairs = match_globs(actions, "action", positive, "_pattern", ignore_case=True)
    named = (positive.join(pairs, "_pattern").drop("_pattern").withColumnRenamed("action", "_act")
             .dropDuplicates(["_kind", "_owner", "ord", "_act"]))
    negative = statements.filter((F.size("actions") == 0) & (F.size("not_actions") > 0)).withColumn("_act", F.lit(_ANY))
    return cut_lineage(named.unionByName(negative))


def _asked(named: DataFrame, actions: DataFrame) -> DataFrame:
    """The part of ``named`` statements (:func:`indexed_for`, for these and further actions) that concerns ``actions``, a short list of names."""
    asked = actions.agg(F.collect_set("action")).scalar()
    return named.filter((F.col("_act") == _ANY) | F.array_contains(asked, F.col("_act")))


def decide(probes: DataFrame, tables: Tables, index: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Decision for each distinct (principal, action, resource) probe. ``named``: the statements keyed by the probed actions, where they are at hand.

    Unconditional deny (identity, then resource policy) > identity allow within the boundary > resource-policy allow >
    implicit deny. Conditions are not evaluated; they flag the result. Only statements that name the probed action
    meet a probe, and the outcome is a set of partial minima, so no statement list is collected.
    """
    asked = cut_lineage(probes.select("principal", "action", "resource").distinct())
    hits = matching_statements(asked, tables, index, named)
    allow = F.lower("effect") == "allow"
    pick = F.struct("conditional", "ord", "label")

    def first(kind: str, cond: Column, value: Column, name: str) -> Column:
        return F.min(F.when((F.col("_kind") == kind) & cond, value)).alias(name)

    by_order = F.struct("ord", "label")
    hard = ~allow & ~F.col("conditional")
    outcome = hits.groupBy("principal", "action", "resource").agg(
        first("identity", hard, by_order, "id_deny"), first("resource", hard, by_order, "res_deny"),
        first("boundary", hard, by_order, "b_deny"), first("identity", allow, pick, "id_allow"),
        first("boundary", allow, pick, "b_allow"), first("resource", allow, pick, "res_allow"),
        F.count_if((F.col("_kind") != "boundary") & ~allow & F.col("conditional")).alias("potential_denies"))
    who = tables["principal"].select(F.col("arn").alias("principal"), F.col("boundary").isNotNull().alias("bounded"), F.lit(True).alias("known"))
    d = asked.join(outcome, ["principal", "action", "resource"], "left").join(who, "principal", "left")
    known, bounded = F.coalesce("known", F.lit(False)), F.coalesce("bounded", F.lit(False))
    deny = F.coalesce("id_deny", "res_deny")
    granted = F.col("id_allow").isNotNull()
    in_bounds = ~bounded | F.col("b_allow").isNotNull()
    boundary_deny = granted & bounded & F.col("b_deny").isNotNull()
    effect = (F.when(~known, "IMPLICIT_DENY").when(deny.isNotNull() | boundary_deny, "EXPLICIT_DENY")
              .when(granted & in_bounds, "ALLOW").when(granted, "IMPLICIT_DENY")
              .when(F.col("res_allow").isNotNull(), "ALLOW").otherwise("IMPLICIT_DENY"))
    reason = (F.when(~known, "unknown principal (not in snapshot)")
              .when(deny.isNotNull(), F.concat(F.lit("explicit Deny in "), deny["label"]))
              .when(boundary_deny, "explicit Deny in permission boundary")
              .when(granted & ~in_bounds, "action not permitted by permission boundary")
              .when(granted & bounded, F.concat(F.lit("permitted within permission boundary; Allow in "), "id_allow.label"))
              .when(granted, F.concat(F.lit("Allow in "), "id_allow.label"))
              .when(F.col("res_allow").isNotNull(), "Allow via resource-based policy")
              .otherwise("no matching Allow (implicit deny)"))
    matched = (F.when(~known, None).when(deny.isNotNull(), deny["label"]).when(boundary_deny, "boundary")
               .when(granted, F.col("id_allow.label")).when(F.col("res_allow").isNotNull(), F.col("res_allow.label")))
    conditional = (effect == "ALLOW") & F.when(granted, F.col("id_allow.conditional") | F.coalesce(bounded & F.col("b_allow.conditional"), F.lit(False))
                                               ).otherwise(F.coalesce("res_allow.conditional", F.lit(False)))
    limited = known & deny.isNull() & granted & bounded & ~boundary_deny
    return d.select("principal", "action", "resource", effect.alias("effect"), conditional.alias("conditional"),
                    limited.alias("boundary_limited"), reason.alias("reason"), matched.alias("matched"),
                    F.when(known & (deny.isNull()), F.coalesce("potential_denies", F.lit(0))).otherwise(0).cast("bigint").alias("potential_denies"))


def identity_statements(index: DataFrame) -> DataFrame:
    return index.filter("_kind = 'identity'").select(F.col("_owner").alias("principal"), "ord", "label", *_CLAUSES)


def statement_index(tables: Tables) -> DataFrame:
    """Identity, boundary and resource-policy statements under one (kind, owner) key, written once for reuse."""
    a = applicable_statements(tables)
    s = tables["statement"]
    identity = a.select(F.lit("identity").alias("_kind"), F.col("principal").alias("_owner"), "ord", "label", *_CLAUSES)
    boundary = s.filter("owner_kind = 'policy'").join(
        tables["principal"].select(F.col("boundary").alias("owner")).filter("owner IS NOT NULL").distinct(), "owner", "left_semi").select(
        F.lit("boundary").alias("_kind"), F.col("owner").alias("_owner"), _ord(F.col("stmt_ord")).alias("ord"), F.lit("boundary").alias("label"), *_CLAUSES)
    resource = s.filter("owner_kind = 'resource'").select(
        F.lit("resource").alias("_kind"), F.col("owner").alias("_owner"), _ord(F.col("stmt_ord")).alias("ord"),
        F.lit("resource-policy").alias("label"), *_CLAUSES)
    return cut_lineage(identity.unionByName(boundary).unionByName(resource))


def matching_statements(asked: DataFrame, tables: Tables, index: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Every statement that matches a probe, with the probe's columns."""
    index = indexed_for(statement_index(tables) if index is None else index, asked) if named is None else named
    who = tables["principal"].select(F.col("arn").alias("principal"), "boundary")
    keyed = asked.join(who, "principal").select("principal", "action", "resource", F.explode(F.array(
        F.struct(F.lit("identity").alias("_kind"), F.col("principal").alias("_owner")),
        F.struct(F.lit("boundary").alias("_kind"), F.col("boundary").alias("_owner")),
        F.struct(F.lit("resource").alias("_kind"), F.col("resource").alias("_owner")))).alias("k")).select(
        "principal", "action", "resource", "k.*").filter("_owner IS NOT NULL")
    keyed = keyed.select("*", F.explode(F.array(F.col("action"), F.lit(_ANY))).alias("_act"))
    hits = keyed.join(index, ["_kind", "_owner", "_act"])
    spared = F.when(F.col("_act") == _ANY, ~any_glob_matches(F.transform("not_actions", F.lower), F.lower("action"))).otherwise(True)
    return hits.filter(spared & _scope_resource())


def decision_notes(probes: DataFrame, tables: Tables, index: DataFrame | None = None) -> DataFrame:
    """Caveats of the decisions in long form (principal, action, resource, ord, note)."""
    index = statement_index(tables) if index is None else index
    asked = cut_lineage(probes.select("principal", "action", "resource").distinct())
    decided = decide(asked, tables, index)
    hits = cut_lineage(matching_statements(asked, tables, index))
    key = ["principal", "action", "resource"]
    known = tables["principal"].select(F.col("arn").alias("principal"))
    none = F.array().cast(_ORD)

    def keys(c: Column) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("unspecified")

    unknown = asked.join(known, "principal", "left_anti").select(*key, F.lit(0).alias("rank"), none.alias("ord"),
                                                                 F.lit("principal absent from snapshot; result is a guess").alias("note"))
    has_policy = tables["statement"].filter("owner_kind = 'resource'").select(F.col("owner").alias("resource")).distinct()
    policy = asked.join(known, "principal", "left_semi").join(has_policy, "resource", "left_semi").select(
        *key, F.lit(1).alias("rank"), none.alias("ord"),
        F.lit("resource-based policy present; cross-account/service-specific semantics are simplified").alias("note"))
    hard = hits.filter((F.lower("effect") != "allow") & ~F.col("conditional") & (F.col("_kind") != "boundary")).select(*key).distinct()
    soft = hits.filter((F.lower("effect") != "allow") & F.col("conditional") & (F.col("_kind") != "boundary")).join(hard, key, "left_anti").select(
        *key, F.when(F.col("_kind") == "identity", 2).otherwise(3).alias("rank"), "ord",
        F.concat(F.lit("potential Deny in "), "label", F.lit(" under condition(s): "), keys(F.col("condition_keys"))).alias("note"))
    picks = hits.filter((F.lower("effect") == "allow") & F.col("_kind").isin("identity", "boundary")).groupBy(*key).agg(*[
        F.min(F.when(F.col("_kind") == k, F.struct("conditional", "ord", "condition_keys"))).alias(k) for k in ("identity", "boundary")])
    extra = F.when(F.coalesce("boundary.conditional", F.lit(False)), F.col("boundary.condition_keys")).otherwise(F.array().cast("array<string>"))
    allow = (decided.filter("effect = 'ALLOW' AND conditional AND matched <> 'resource-policy'").select(*key).join(picks, key).select(
        *key, F.lit(4).alias("rank"), none.alias("ord"),
        F.concat(F.lit("Allow depends on unevaluated condition(s): "), keys(F.concat("identity.condition_keys", extra))).alias("note")))
    return reduce(DataFrame.unionByName, [unknown, policy, soft, allow])


def decision_summary(d: DataFrame) -> DataFrame:
    tag = F.when((F.col("effect") == "ALLOW") & F.col("conditional"), "ALLOW (conditional)").otherwise(F.col("effect"))
    return d.withColumn("summary", F.concat(tag, F.lit(": "), "principal", F.lit(" -> "), "action", F.lit(" on "), "resource"))


# ---------------------------------------------------------------- permission questions

def action_universe(tables: Tables) -> DataFrame:
    """Literal actions named in identity and managed policies, plus the always-probed ones."""
    s = tables["statement"].filter("owner_kind IN ('principal', 'policy')").select(F.explode("actions").alias("action"))
    named = s.filter(F.contains("action", F.lit(":")) & ~F.contains("action", F.lit("*")))
    floor = tables["statement"].sparkSession.createDataFrame([(a,) for a in fixed.SENSITIVE_ACTIONS], "action STRING")
    return named.unionByName(floor).distinct()


def _spared(indexed: DataFrame, actions: DataFrame) -> DataFrame:
    """NotAction statements once per asked action they do not exclude; the asked actions are a short list of names."""
    asked = actions.agg(F.collect_set("action")).scalar()
    return (indexed.filter(F.col("_act") == _ANY).drop("_act").withColumn("_asked", asked).withColumn("action", F.explode("_asked")).drop("_asked")
            .filter(~any_glob_matches(F.transform("not_actions", F.lower), F.lower("action"))))


def granted(probes: DataFrame, actions: DataFrame, named: DataFrame) -> DataFrame:
    """The probes that some allow speaks for: an identity statement of the principal or a policy of the resource that names the action.

    All others are denied, whatever else is known of them. ``actions`` are those of the probes.
    """
    allows = _asked(named, actions).filter(F.lower("effect") == "allow")
    acts = allows.filter(F.col("_act") != _ANY).select("_kind", "_owner", F.col("_act").alias("action")).unionByName(
        _spared(allows, actions).select("_kind", "_owner", "action"))
    return reduce(DataFrame.unionByName, [
        probes.join(acts.filter(F.col("_kind") == kind).select(F.col("_owner").alias(who), "action").distinct(), [who, "action"], "left_semi").select(probes.columns)
        for kind, who in (("identity", "principal"), ("resource", "resource"))])


def candidate_probes(principals: DataFrame, actions: DataFrame, resources: DataFrame, tables: Tables,
                     index: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """Probes that can possibly be allowed, found from the granting statements instead of all combinations.

    ``principals(principal)``, ``actions(action)``, ``resources(resource)``. An allow needs an identity statement
    naming the action and reaching the resource, or a resource policy allowing the action.
    """
    index = statement_index(tables) if index is None and named is None else index
    acts = cut_lineage(actions.select("action").distinct())

    def allowing(kind: str, owners: DataFrame | None = None) -> DataFrame:
        a = (index if named is None else _asked(named, acts)).filter((F.lower("effect") == "allow") & (F.col("_kind") == kind))
        a = a if owners is None else a.join(owners, "_owner", "left_semi")
        return indexed_for(a, acts) if named is None else a

    indexed = allowing("identity", principals.select(F.col("principal").alias("_owner")).distinct())
    named_rows = indexed.filter(F.col("_act") != _ANY).withColumnRenamed("_act", "action")
    negative = _spared(indexed, acts)
    reach = named_rows.unionByName(negative).select(F.col("_owner").alias("principal"), "action", F.explode(
        F.when(F.size("resources") > 0, F.col("resources")).otherwise(F.array(F.lit("*")))).alias("_pattern")).distinct()
    reach = cut_lineage(reach)
    pairs = match_globs(resources, "resource", reach, "_pattern")
    by_identity = reach.join(pairs, "_pattern").select("principal", "action", "resource")
    res_idx = allowing("resource")
    res_act = (res_idx.filter(F.col("_act") != _ANY).select(F.col("_owner").alias("resource"), F.col("_act").alias("action"))
               .unionByName(_spared(res_idx, acts).select(F.col("_owner").alias("resource"), "action"))).distinct()
    account = tables["resource"].select(F.col("arn").alias("resource"), "account")
    # a resource policy allows every principal of the account; the account key is salted over its principals
    opened = (res_act.join(resources.select("resource").distinct(), "resource", "left_semi").join(account, "resource")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    members = tables["principal"].select(F.col("arn").alias("principal"), "account", F.pmod(F.xxhash64("arn"), F.lit(SALTS)).cast("int").alias("_salt"))
    by_resource = (opened.join(members, ["account", "_salt"])
                   .join(principals.select("principal").distinct(), "principal", "left_semi").select("principal", "action", "resource"))
    return cut_lineage(by_identity.unionByName(by_resource).distinct())


def policy_classes(tables: Tables, index: DataFrame, actions: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """(principal, cls): principals whose decisions on the asked actions agree for every resource, under the smallest name among them.

    :func:`decide` and :func:`candidate_probes` see of a principal the clauses of its own and its boundary's statements that name an
    asked action, its accounts, and whether each of its rows has a boundary. Principals equal in all of these are one class; any difference
    parts them. Classes are as many as different sets of such clauses, not as the principals.
    """
    acts = cut_lineage(actions.select("action").distinct())
    clause = F.sha2(F.to_json(F.struct("_kind", "_act", F.lower("effect").alias("effect"), "resources", "not_resources", "conditional",
                                       F.when(F.col("_act") == _ANY, F.col("not_actions")).alias("not_actions"))), 256)
    concerned = indexed_for(index.filter("_kind <> 'resource'"), acts) if named is None else _asked(named, acts).filter("_kind <> 'resource'")
    held = cut_lineage(concerned.select("_kind", "_owner", clause.alias("clause")).distinct())
    who = tables["principal"].select(F.col("arn").alias("principal"), "account", "boundary").filter("principal IS NOT NULL")
    limit = held.filter("_kind = 'boundary'").select(F.col("_owner").alias("boundary"), "clause")
    clauses = (held.filter("_kind = 'identity'").select(F.col("_owner").alias("principal"), "clause")
               .unionByName(who.select("principal", "boundary").join(limit, "boundary").select("principal", "clause")))
    text = clauses.groupBy("principal").agg(F.array_join(F.sort_array(F.collect_set("clause")), ",").alias("clauses"))
    rows = who.groupBy("principal").agg(F.sort_array(F.collect_set("account")).alias("accounts"),
                                        F.sort_array(F.collect_list(F.col("boundary").isNotNull())).alias("bounded"))
    signed = cut_lineage(rows.join(text, "principal", "left").select("principal", F.sha2(F.to_json(F.struct("accounts", "bounded", "clauses")), 256).alias("sign")))
    return signed.join(signed.groupBy("sign").agg(F.min("principal").alias("cls")), "sign").select("principal", "cls")


def resource_classes(resources: DataFrame, named: DataFrame) -> DataFrame:
    """(action, resource, place): resources asked for the same action that no statement tells apart, under the smallest name among them.

    A decision sees of a resource which patterns of the statements that name the action it matches, and its own policy. Resources that match
    the same patterns are one class; a resource with a policy stays alone.
    """
    asked = cut_lineage(resources.select("action", "resource").filter(F.col("action").isNotNull() & F.col("resource").isNotNull()).distinct())
    none = F.array().cast("array<string>")
    patterns = _asked(named, asked).filter("_kind <> 'resource'").select(F.explode(F.concat(F.coalesce("resources", none), F.coalesce("not_resources", none))).alias("_pattern"))
    met = match_globs(asked, "resource", patterns, "_pattern").groupBy("resource").agg(F.array_join(F.sort_array(F.collect_set(F.sha2("_pattern", 256))), ",").alias("_met"))
    own = named.filter("_kind = 'resource'").select(F.col("_owner").alias("resource")).distinct().withColumn("_own", F.col("resource"))
    signed = cut_lineage(asked.join(met, "resource", "left").join(own, "resource", "left").select(
        "action", "resource", F.sha2(F.to_json(F.struct("_met", "_own")), 256).alias("sign")))
    return signed.join(signed.groupBy("action", "sign").agg(F.min("resource").alias("place")), ["action", "sign"]).select("action", "resource", "place")


def what_can(principals: DataFrame, tables: Tables, resources: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """Allowed (action, resource) decisions of the given principals."""
    res = tables["resource"].select(F.col("arn").alias("resource")) if resources is None else resources
    act = action_universe(tables) if actions is None else actions
    index = statement_index(tables)
    return decide(candidate_probes(principals, act, res, tables, index), tables, index).filter("effect = 'ALLOW'")


def who_can(action: str, resource: str, tables: Tables, index: DataFrame | None = None) -> DataFrame:
    """Principals allowed, and those explicitly denied, for one action on one resource."""
    probes = tables["principal"].select(F.col("arn").alias("principal"), F.lit(action).alias("action"), F.lit(resource).alias("resource"))
    return decide(probes, tables, index).filter("effect IN ('ALLOW', 'EXPLICIT_DENY')")


#: Pairs that joining the steps of the closure with themselves may make; beyond that it goes on hop by hop.
WIDEST = 20_000_000


def assumers(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(assumer, role): everyone who reaches each given ``role`` over CAN_ASSUME edges, any number of hops.

    Only what is itself assumed leads on, so the closure runs over those edges; everybody's first hop is joined to it at the end. The pairs of fewer
    than h hops and the steps of exactly h hops give those of fewer than 2h: a chain of n roles takes log2(n) rounds. Where the
    steps would grow too dense for that, every further round joins the newest pairs with the single hops.
    """
    step = cut_lineage(edges.filter("kind = 'CAN_ASSUME'").select("src", "dst").distinct())
    inner = cut_lineage(step.join(step.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
    leads = lambda pairs, hops: pairs.join(hops, F.col("assumer") == F.col("dst")).select(F.col("src").alias("assumer"), "role")
    reach, power = cut_lineage(roles.select(F.col("role").alias("assumer"), "role").distinct()), inner
    size, dense = reach.count(), False
    while not dense:
        reach = cut_lineage(reach.unionByName(leads(reach, power)).distinct())
        before, size = size, reach.count()
        if size == before:
            break
        ends = power.groupBy(F.col("dst").alias("at")).agg(F.count("*").alias("_in")).join(power.groupBy(F.col("src").alias("at")).agg(F.count("*").alias("_out")), "at")
        dense = (ends.agg(F.sum(F.col("_in") * F.col("_out"))).first()[0] or 0) > WIDEST
        if not dense:
            onward = power.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
            power = cut_lineage(power.join(onward, "dst").select("src", F.col("to").alias("dst")).distinct())
    new = reach
    while dense and not new.isEmpty():
        new = cut_lineage(leads(new, inner).distinct().join(reach, ["assumer", "role"], "left_anti"))
        reach = reach.unionByName(new)
    return leads(reach, step).distinct()


def who_can_via_assume(action: str, resource: str, tables: Tables, edges: DataFrame) -> DataFrame:
    """(assumer, role): indirect reach through roles that are allowed, without principals already allowed."""
    allowed = who_can(action, resource, tables).filter("effect = 'ALLOW'").select("principal")
    roles = allowed.join(tables["principal"].filter("ptype = 'role'").select(F.col("arn").alias("principal")), "principal", "left_semi")
    reach = assumers(roles.select(F.col("principal").alias("role")), edges)
    return reach.join(allowed.select(F.col("principal").alias("assumer")), "assumer", "left_anti")
