"""Privilege-escalation edges, shortest paths for all sources at once, snapshot diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import lookup
from skyledger.operators.graph import (Tables, _ord, build_edges, build_nodes, candidate_probes, decide, edge, granted,
                                       identity_statements, indexed_for, policy_classes, resource_classes, statement_index, trusted_principals)
from skyledger.session import cut_lineage

HOP = "array<struct<src: string, technique: string, dst: string, attack_id: string, conditional: boolean>>"


def admin_equivalent(applicable: DataFrame) -> DataFrame:
    """Principals holding an unconditional ``*`` or ``iam:*`` allow on every resource."""
    wide = F.exists("actions", lambda a: F.lower(a).isin("*", "iam:*")) & F.array_contains("resources", "*")
    return applicable.filter((F.lower("effect") == "allow") & ~F.col("conditional") & wide).select("principal").distinct()


def service_roles(tables: Tables) -> DataFrame:
    """(role, service) for every service an allow statement of the trust policy names."""
    s = tables["trust_statement"].filter(F.lower("effect") == "allow")
    return s.select("role", F.explode("service_principals").alias("service")).distinct()


def escalation_edges(tables: Tables, index: DataFrame | None = None) -> DataFrame:
    """CAN_ESCALATE_VIA and CAN_ACCESS edges. ``ord`` reproduces the per-source order of discovery."""
    own, shared = escalation_parts(tables, index)
    return own.unionByName(expand(shared))


def expand(shared: dict[str, DataFrame]) -> DataFrame:
    """The shared edges once per member of their class."""
    e = shared["edges"].withColumnRenamed("src", "cls").join(shared["member"], "cls").withColumnRenamed("principal", "src")
    return e.select(*shared["edges"].columns)


def sources(edges: DataFrame, kind: str, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """(principal): where an edge of ``kind`` starts, distinct."""
    found = edges.filter(F.col("kind") == kind).select(F.col("src").alias("principal"))
    if shared is not None:
        classes = shared["edges"].filter(F.col("kind") == kind).select(F.col("src").alias("cls")).distinct()
        found = found.unionByName(shared["member"].join(classes, "cls", "left_semi").select("principal"))
    return found.distinct()


def escalation_parts(tables: Tables, index: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The edges of :func:`escalation_edges` as those of single principals, and those that all members of a class share.

    What a principal may read, or pass to a service, depends on nothing but its statements about these actions. Principals
    that agree in them form a class (:func:`graph.policy_classes`) and are decided once. ``shared`` holds ``edges``, with the class as ``src``,
    and ``member`` (principal, cls); written out, these edges grow with principals times resources.
    """
    index = statement_index(tables) if index is None else index
    p = tables["principal"]
    # all actions asked below, met with the statements once
    own_acts = [act for pairs in fixed.SELF_GRANTS.values() for act, _ in pairs]
    starts = ["iam:PassRole", *dict.fromkeys(act for act, _ in fixed.LAUNCHES.values())]
    single = _names(p, "action", [*dict.fromkeys(["iam:CreatePolicyVersion", "sts:AssumeRole", *own_acts, *starts])])
    named = indexed_for(index, single.unionByName(_names(p, "action", ["s3:GetObject", "*"])))
    who = p.select(F.col("arn").alias("principal"), "account", "ptype", F.col("ordinal").alias("p_ord"))

    # probe sets ------------------------------------------------------------
    rewrite = tables["attachment"].join(who, "principal").select("principal", "account", F.lit("iam:CreatePolicyVersion").alias("action"),
                                                                 F.col("policy").alias("resource"), "ordinal")
    grants = [(t, act, tech, i) for t, pairs in fixed.SELF_GRANTS.items() for i, (act, tech) in enumerate(pairs)]
    self_probe = who.select("principal", "account", "ptype", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(act).alias("action"), F.lit(tech).alias("technique"), F.lit(i).alias("i"))
        for t, act, tech, i in grants])).alias("g")).select("principal", "account", "ptype", "g.*").filter("t = ptype").withColumn("resource", F.col("principal"))
    starters = cut_lineage(policy_classes(tables, index, _names(p, "action", starts), named))
    launch = who.join(starters.select(F.col("cls").alias("principal")), "principal", "left_semi").select("principal", F.explode(F.array(*[
        F.struct(F.lit(tech).alias("technique"), F.lit(act).alias("action"), F.lit(svc).alias("service"), F.lit(i).alias("i"))
        for i, (tech, (act, svc)) in enumerate(fixed.LAUNCHES.items())])).alias("l")).select("principal", "l.*").withColumn("resource", F.lit("*"))
    assume = trusted_principals(tables).join(who.select(F.col("principal").alias("who")), "who", "left_semi").select(
        F.col("who").alias("principal"), F.lit("sts:AssumeRole").alias("action"), F.col("role").alias("resource"), "external", "ord")
    high = tables["resource"].filter("sensitivity = 'high'")
    bucket = F.col("rtype") == "AWS::S3::Bucket"
    probe_object = cut_lineage(high.select(F.col("arn").alias("target"), F.col("ordinal").alias("r_ord"), bucket.alias("is_bucket"),
                               F.when(bucket, F.concat("arn", F.lit("/probe-object"))).otherwise(F.col("arn")).alias("resource"),
                               F.when(bucket, "s3:GetObject").otherwise("*").alias("action")))
    readers = cut_lineage(policy_classes(tables, index, probe_object.select("action"), named))
    # resources that no pattern tells apart are decided once, for every class of principals
    places = cut_lineage(resource_classes(probe_object, named))
    asked = places.select("action", F.col("place").alias("resource")).distinct()
    reading = cut_lineage(candidate_probes(readers.select(F.col("cls").alias("principal")), asked.select("action"), asked.select("resource"), tables, index, named)
                          .join(asked, ["action", "resource"], "left_semi"))

    # launch rights first: passing a role only matters for principals that can start something with it
    alone = reduce(DataFrame.unionByName, [df.select("principal", "action", "resource") for df in (rewrite, self_probe, launch, assume)])
    first = granted(alone, single, named).unionByName(reading.select("principal", "action", "resource"))
    verdict = cut_lineage(decide(first, tables, index, named).filter("effect = 'ALLOW'").select("principal", "action", "resource", "conditional"))
    key = ["principal", "action", "resource"]
    launchers = launch.join(verdict, key).select("principal", "technique", "service", "i", F.col("action").alias("launch"), F.col("conditional").alias("launch_cond"))
    svc = service_roles(tables).filter(F.col("service").isin([s for _, s in fixed.LAUNCHES.values()]))
    passable = candidate_probes(launchers.select("principal"), _names(p, "action", ["iam:PassRole"]),
                                svc.select(F.col("role").alias("resource")), tables, index, named)
    passed = cut_lineage(decide(passable, tables, index, named).filter("effect = 'ALLOW'").select("principal", F.col("resource").alias("role"), F.col("conditional").alias("pass_cond")))
    roles = p.filter("ptype = 'role'").select(F.col("arn").alias("role"), F.col("ordinal").alias("role_ord"))

    # edges -----------------------------------------------------------------
    admin = F.concat(F.lit("admin:"), F.col("account"))
    attack = {k: v[2] for k, v in fixed.ESCALATIONS.items()}

    def via(df, dst, order, technique, conditional, detail):
        return edge(df, "CAN_ESCALATE_VIA", F.col("principal"), dst, order, technique=technique, conditional=conditional,
                    attack_id=lookup(attack, technique), detail=detail)

    cpv = (rewrite.join(verdict, key).groupBy("principal", "account")
           .agg(F.min(F.struct("ordinal", "resource", "conditional")).alias("b")))
    data = (reading.join(verdict, key).withColumnRenamed("resource", "place").join(places, ["action", "place"]).join(probe_object, ["action", "resource"]))
    # start from the allowed (principal, role) pairs; services only narrow them
    passing = passed.join(svc, "role").join(launchers, ["principal", "service"]).join(roles, "role")
    own = reduce(DataFrame.unionByName, [
        via(cpv, admin, _ord(0, 0, 0, 0, 0), F.lit("CreatePolicyVersion"), F.col("b.conditional"), F.col("b.resource")),
        via(self_probe.join(verdict, key), admin, _ord(1, F.col("i"), 0, 0, 0), F.col("technique"), F.col("conditional"), F.col("principal")),
        via(assume.join(verdict, key), F.col("resource"), F.concat(_ord(3), F.col("ord"), _ord(0)), F.lit("AssumeRole"), F.col("conditional"), F.col("external").cast("string")),
    ])
    shared = [
        ("pass|", starters, via(passing, F.col("role"), _ord(2, F.col("role_ord"), F.col("i"), 0, 0), F.col("technique"), F.col("pass_cond") | F.col("launch_cond"), F.col("launch"))),
        ("read|", readers, edge(data, "CAN_ACCESS", F.col("principal"), F.col("target"), _ord(4, F.col("r_ord"), 0, 0, 0),
                                technique=F.col("action"), conditional=F.col("conditional"), detail=F.lit("high"))),
    ]
    name = lambda kind, c: F.concat(F.lit(kind), c)
    edges = cut_lineage(reduce(DataFrame.unionByName, [e.withColumn("src", name(kind, F.col("src"))) for kind, _, e in shared]))
    member = reduce(DataFrame.unionByName, [c.select("principal", name(kind, F.col("cls")).alias("cls")) for kind, c, _ in shared])
    return own, {"edges": edges, "member": cut_lineage(member.join(edges.select(F.col("src").alias("cls")).distinct(), "cls", "left_semi"))}


def _names(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(v,) for v in values], f"{column} STRING")


def goals(tables: Tables, applicable: DataFrame, admin: bool = True, sensitive: bool = True) -> DataFrame:
    """(node, target_priv) of the admin node, admin principals and high-sensitivity resources."""
    parts = []
    if admin:
        node = tables["principal"].select(F.concat(F.lit("admin:"), "account").alias("node")).distinct()
        parts.append(node.unionByName(admin_equivalent(applicable).select(F.col("principal").alias("node"))).withColumn("target_priv", F.lit("admin-equivalent")))
    if sensitive:
        parts.append(tables["resource"].filter("sensitivity = 'high'").select(F.col("arn").alias("node"), F.lit("sensitive-resource:high").alias("target_priv")))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["node"])


def shortest_paths(edges: DataFrame, targets: DataFrame, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """(node, target, target_priv, hops) for every node that reaches a target, fewest hops.

    One backward sweep from all targets serves all sources: each round the nodes that have an edge into the last
    frontier take their smallest-``ord`` edge. That equals a forward first-in-first-out search from each source, at a
    cost linear in the edges. Rounds = longest shortest path; the sweep stops when the frontier is empty. ``shared`` edges
    (:func:`escalation_parts`) are weighed once per class; its members then take the smallest of these and their own.
    Targets with an ``aim`` are swept for each aim by itself, all in the same rounds.
    """
    aim = [c for c in ("aim",) if c in targets.columns]

    def steps(df: DataFrame) -> DataFrame:
        return cut_lineage(df.filter(F.col("kind").isin("CAN_ESCALATE_VIA", "CAN_ACCESS")).select(
            "src", "dst", F.struct("ord", "dst", "technique", "attack_id", "conditional").alias("b")))

    e, none = steps(edges), F.array().cast(HOP)
    wide = None if shared is None else steps(shared["edges"])
    closed = None  # classes with all their members solved
    frontier = cut_lineage(targets.select(*aim, "node", F.col("node").alias("target"), "target_priv", none.alias("hops")))
    aims = targets.select(*aim).distinct().count() if aim else 1
    solved, known, turn = frontier, frontier.select(*aim, "node"), 0
    while True:
        reached = frontier.select(*aim, F.col("node").alias("dst")).distinct()
        into = e.join(reached, "dst").select(*aim, "src", "b")
        if wide is not None:
            first = wide.join(reached, "dst").groupBy(*aim, "src").agg(F.min("b").alias("b"))
            first = cut_lineage(first if closed is None else first.join(closed, [*aim, "src"], "left_anti"))
            closed = first.select(*aim, "src") if closed is None else closed.unionByName(first.select(*aim, "src"))
            into = into.unionByName(first.withColumnRenamed("src", "cls").join(shared["member"], "cls").select(*aim, F.col("principal").alias("src"), "b"))
        best = into.join(known.select(*aim, F.col("node").alias("src")), [*aim, "src"], "left_anti").groupBy(*aim, "src").agg(F.min("b").alias("b"))
        hop = F.array(F.struct(F.col("src"), F.col("b.technique").alias("technique"), F.col("b.dst").alias("dst"),
                               F.col("b.attack_id").alias("attack_id"), F.col("b.conditional").alias("conditional")))
        step = best.withColumn("dst", F.col("b.dst")).join(frontier.withColumnRenamed("node", "dst"), [*aim, "dst"])
        frontier = cut_lineage(step.select(*aim, F.col("src").alias("node"), "target", "target_priv", F.concat(hop.cast(HOP), "hops").alias("hops")))
        if frontier.isEmpty():
            return solved
        solved, known, turn = solved.unionByName(frontier), known.unionByName(frontier.select(*aim, "node")), turn + 1
        if turn & (turn + 1) == 0:  # rounds 1, 3, 7, 15: later rounds read what is left only
            known = cut_lineage(known.distinct())
            e, wide = _still_open(e, wide, shared, known, closed, frontier, aim, aims)


def _still_open(e: DataFrame, wide: DataFrame | None, shared: dict[str, DataFrame] | None, known: DataFrame, closed: DataFrame | None,
                frontier: DataFrame, aim: list[str], aims: int) -> tuple[DataFrame, DataFrame | None]:
    """The edges that a sweep can still take: from a source not solved for every aim into the frontier or a node that may be solved later.

    An edge serves in the one round in which its ``dst`` is new, and what has no edge of its own is never reached again.
    """
    everywhere = lambda df, name: df.groupBy(name).agg(F.count("*").alias("_n")).filter(F.col("_n") >= aims).select(name)
    done = cut_lineage(everywhere(known, "node"))
    e = e.join(done.select(F.col("node").alias("src")), "src", "left_anti")
    ahead = frontier.select(F.col("node").alias("dst")).unionByName(e.select(F.col("src").alias("dst")))
    if wide is not None:
        wide = wide.join(everywhere(closed, "src"), "src", "left_anti")
        members = shared["member"].join(wide.select(F.col("src").alias("cls")).distinct(), "cls", "left_semi").select(F.col("principal").alias("dst"))
        ahead = ahead.unionByName(members.join(done.select(F.col("node").alias("dst")), "dst", "left_anti"))
    ahead = cut_lineage(ahead.distinct())
    e = cut_lineage(e.join(ahead, "dst", "left_semi"))
    if wide is not None:
        wide = cut_lineage(wide.join(ahead, "dst", "left_semi"))
        wide = None if wide.isEmpty() else wide
    return e, wide


def path_columns(paths: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep``, principal, target, target_priv, techniques, hops, length, conditional, summary."""
    chain = F.array_join(F.transform("hops", lambda h: F.concat(h["technique"], F.when(h["conditional"], "?").otherwise(""))), "  ->  ")
    cond = F.coalesce(F.exists("hops", lambda h: h["conditional"]), F.lit(False))
    return paths.select(
        *(keep or []), F.col("node").alias("principal"), "target", "target_priv", F.transform("hops", lambda h: h["technique"]).alias("techniques"), "hops",
        F.size("hops").alias("length"), cond.alias("conditional"),
        F.concat(F.col("node"), F.lit("  =="), chain, F.lit("==>  "), "target_priv", F.when(cond, "  [conditional]").otherwise("")).alias("summary"))


def escalation_paths(tables: Tables, edges: DataFrame, index: DataFrame | None = None, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """Shortest path of every principal that is not admin already, ordered by (length, principal)."""
    a = identity_statements(statement_index(tables) if index is None else index)
    found = path_columns(shortest_paths(edges, goals(tables, a), shared)).filter("length > 0")
    known = tables["principal"].select(F.col("arn").alias("principal"))
    return found.join(known, "principal", "left_semi").orderBy("length", "principal")


def prepare_graph(tables: Tables) -> dict[str, DataFrame]:
    """Nodes, all edges, applicable statements and escalation paths, each written once and reused."""
    index = statement_index(tables)
    own, shared = escalation_parts(tables, index)
    single = cut_lineage(build_edges(tables).unionByName(own))
    edges = cut_lineage(single.unionByName(expand(shared)))
    account = tables["principal"].select("account").distinct()
    none = F.lit(None).cast("string")
    admin_nodes = account.select(F.concat(F.lit("admin:"), "account").alias("id"), F.lit("Privilege").alias("kind"), F.lit("admin-equivalent").alias("label"),
                                 none.alias("ptype"), none.alias("rtype"), none.alias("sensitivity"), _ord(5, 0, 0, 0).alias("ord"))
    nodes = build_nodes(tables).unionByName(admin_nodes)
    return {"nodes": nodes, "edges": edges, "index": index, "paths": cut_lineage(escalation_paths(tables, single, index, shared))}


def new_paths(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of the later snapshot without an identical path (all hops) in the earlier one."""
    old = before.select("principal", "target", "target_priv", F.to_json("hops").alias("_f")).distinct()
    return after.withColumn("_f", F.to_json("hops")).join(old, ["principal", "target", "target_priv", "_f"], "left_anti").drop("_f")
