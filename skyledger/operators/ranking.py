"""Blast radius of every principal, ranked cases, response proposals and decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import lookup, tail
from skyledger.functions.sliced import first_by
from skyledger.operators.escalation import admin_equivalent, goals, path_columns, shortest_paths, sources
from skyledger.operators.graph import Tables, identity_statements


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("scenario",) if c in df.columns]


# ---------------------------------------------------------------- blast radius

def iam_writers(applicable: DataFrame) -> DataFrame:
    """Principals whose unconditional allows can change identities (verb anywhere in an ``iam:`` action)."""
    verbs = "|".join(fixed.IAM_WRITE_VERBS)
    writes = F.exists("actions", lambda a: F.lower(a).isin("*", "iam:*") | F.lower(a).rlike(f"^iam:.*({verbs})"))
    scoped = (F.size("resources") > 0) | (F.size("not_resources") > 0)
    return applicable.filter((F.lower("effect") == "allow") & ~F.col("conditional") & scoped & writes).select("principal").distinct()


def blast_radius(tables: Tables, graph: dict[str, DataFrame], weights: dict[str, float] | None = None) -> DataFrame:
    """Score 0..100 with its four components for all principals at once.

    One backward sweep for both aims (admin goals, sensitive goals) replaces a search per principal.
    """
    w = {**fixed.BLAST_WEIGHTS, **(weights or {})}
    a, edges, shared = identity_statements(graph["index"]), graph["edges"], graph.get("shared")

    aims = {"admin_path": {"sensitive": False}, "sensitive_path": {"admin": False}}
    found = path_columns(shortest_paths(edges, reduce(DataFrame.unionByName, [goals(tables, a, **which).withColumn("aim", F.lit(name)) for name, which in aims.items()]), shared), ["aim"])

    def reach(name: str) -> DataFrame:
        return found.filter(F.col("aim") == name).select("principal", F.struct("target", "length", "summary", "hops", "techniques").alias(name))

    flag = lambda df, name: df.select("principal").distinct().withColumn(name, F.lit(True))
    p = tables["principal"].select(F.col("arn").alias("principal"))
    d = (p.join(reach("admin_path"), "principal", "left").join(reach("sensitive_path"), "principal", "left")
         .join(flag(admin_equivalent(a), "is_admin"), "principal", "left")
         .join(flag(sources(edges, "CAN_ACCESS", shared), "reads"), "principal", "left")
         .join(flag(iam_writers(a), "writes"), "principal", "left")
         .join(flag(edges.filter("kind = 'CAN_ASSUME'").select(F.col("src").alias("principal")), "assumes"), "principal", "left"))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    caps = F.when(has("is_admin"), F.array(F.lit("admin-equivalent"))).otherwise(F.filter(F.array(
        F.when(has("reads"), "read_sensitive"), F.when(has("writes"), "iam_write"), F.when(has("assumes"), "can_assume")), lambda c: c.isNotNull()))
    weight = lambda c, name: F.when(has(c), fixed.CAPABILITY_WEIGHTS[name]).otherwise(0.0)
    current = F.when(has("is_admin"), 1.0).otherwise(F.least(F.lit(1.0), weight("reads", "read_sensitive") + weight("writes", "iam_write") + weight("assumes", "can_assume")))
    one = lambda cond: F.when(cond, 1.0).otherwise(0.0)
    value = {
        "reach_sensitive": one(F.col("sensitive_path").isNotNull()), "reach_admin": one(F.col("admin_path").isNotNull()),
        "privesc_available": one(F.coalesce(F.col("admin_path.length") > 0, F.lit(False))), "current_privilege": current,
    }
    d = d.select("principal", "admin_path", "sensitive_path", caps.alias("caps"), *[v.alias(n) for n, v in value.items()])
    part = {n: F.round(F.col(n) * w[n] * 100, 1) for n in value}
    total = F.round(reduce(lambda x, y: x + y, part.values()), 1)
    return d.select("*", *[c.alias(f"{n}_points") for n, c in part.items()], total.alias("blast"))


def blast_explanation(b: DataFrame) -> DataFrame:
    """Readable explanation text per principal."""
    w = fixed.BLAST_WEIGHTS
    lines = [F.format_string("blast %.0f/100 for %s", "blast", "principal")]
    lines += [F.format_string(f"  {n:<18} value=%.2f x w={w[n]:.2f} -> %.1f", n, f"{n}_points") for n in w]
    lines += [F.when(F.col("admin_path.length") > 0, F.concat(F.lit("  admin path:     "), "admin_path.summary")),
              F.when(F.col("sensitive_path.length") > 0, F.concat(F.lit("  sensitive path: "), "sensitive_path.summary")),
              F.when(F.size("caps") > 0, F.concat(F.lit("  current caps:   "), F.array_join("caps", ", ")))]
    return b.withColumn("explanation", F.concat_ws("\n", *lines))


def rank_cases(cases: dict[str, DataFrame], steps: DataFrame, blast: DataFrame, alpha: float = 0.6, beta: float = 0.4) -> DataFrame:
    """Cases with the worst blast radius among their identities and the blended rank, highest first."""
    scope = _scope(cases["case"])
    case = [*scope, "case_id"]
    touched = (steps.select(*case, F.col("actor").alias("principal"))
               .unionByName(cases["case_entity"].filter("kind = 'principal'").select(*case, F.col("value").alias("principal"))).distinct())
    cols = [c for c in blast.columns if c != "principal"]
    worst = (touched.join(blast, "principal").groupBy(*case)
             .agg(F.max_by(F.struct("principal", *cols), F.struct("blast", "principal")).alias("b")))
    d = cases["case"].join(worst, case, "left")
    points = F.coalesce("b.blast", F.lit(0.0))
    rank = F.round(alpha * (points / 100.0) + beta * F.col("score"), 4)
    return (d.select(*cases["case"].columns, F.coalesce("b.principal", F.lit("(none)")).alias("blast_principal"), points.alias("blast"),
                     F.col("b").alias("blast_detail"), rank.alias("rank")).orderBy(F.desc("rank"), "case_no"))


def case_summary(ranked: DataFrame, steps: DataFrame) -> DataFrame:
    """One header line per case plus its chain as ordered parts: (case_id, part_no, text)."""
    head = ranked.select("case_id", F.lit(0).cast("bigint").alias("part_no"),
                         F.format_string("[%.3f] %s  %s", "rank", "case_id", "title").alias("text"))
    return head.unionByName(steps.select("case_id", F.col("step_no").alias("part_no"), F.col("action").alias("text")))


# ---------------------------------------------------------------- response

ACTION_SCHEMA = "action_key STRING, title STRING, impact STRING, scope STRING, reversible BOOLEAN, always_human BOOLEAN"


def action_table(spark: SparkSession) -> DataFrame:
    """Response actions with the metadata gate: reversible, low impact, one principal, not always human."""
    d = spark.createDataFrame([(k, *v) for k, v in fixed.ACTIONS.items()], ACTION_SCHEMA)
    return d.withColumn("auto_eligible", auto_eligible())


def auto_eligible() -> Column:
    return F.col("reversible") & (F.col("impact") == "low") & (F.col("scope") == "principal") & ~F.col("always_human")


def propose(steps: DataFrame) -> DataFrame:
    """Remediation proposals from chain steps; the first step wins per (case, action, subject)."""
    tid, who, target = F.col("attack_id"), F.col("actor"), F.col("target")
    is_user, is_role = F.contains(who, F.lit(":user/")), F.contains(who, F.lit(":role/"))

    def option(cond, action, subject, sensitivity, rationale):
        return F.when(cond, F.struct(F.lit(action).alias("action_key"), subject.alias("subject"), F.lit(sensitivity).alias("sensitivity"), rationale.alias("rationale")))

    options = F.array(
        option(tid.isin(fixed.KEY_ABUSE) & is_user, "deactivate-access-key", who, "low", F.concat(F.lit("leaked-key use by "), tail(who))),
        option(tid.isin(fixed.SELF_ESCALATION), "quarantine-principal", who, "low", F.concat(F.lit("privilege escalation by "), tail(who))),
        option((tid == "T1562.008") & (target != ""), "re-enable-logging", target, "high", F.lit("attacker disabled logging")),
        option((tid == "T1496") & (target != ""), "isolate-instance", target, "low", F.lit("resource hijacking on instance")))
    scope = _scope(steps)
    rows = (steps.select(*scope, "case_id", "step_no", "attack_id", F.explode(F.filter(options, lambda o: o.isNotNull())).alias("o"))
            .select(*scope, "case_id", "step_no", "attack_id", "o.*"))
    out = first_by(rows, [*scope, "case_id", "action_key", "subject"], ["step_no"])
    named = tail(F.col("subject"))
    on_principal = F.col("action_key").isin("deactivate-access-key", "quarantine-principal")
    return out.select(
        "*", F.when(on_principal & F.contains("subject", F.lit(":user/")), named).alias("user_name"),
        F.when(on_principal & F.contains("subject", F.lit(":role/")), named).alias("role_name"),
        F.when(F.col("action_key") == "re-enable-logging", named).alias("trail_name"),
        F.when(F.col("action_key") == "isolate-instance", F.col("subject")).alias("instance_id"))


def decide_actions(proposals: DataFrame, conf_threshold: float = 0.8, high_blocks_auto: bool = True) -> DataFrame:
    """Auto or human, with reasons and priority. ``proposals`` carries confidence, blast and sensitivity.

    The action metadata are constants, so the gate is a projection; nothing dynamic can override it.
    """
    meta = lambda i: lookup({k: v[i] for k, v in fixed.ACTIONS.items()}, F.col("action_key"))
    d = proposals.select("*", meta(1).alias("impact"), meta(2).alias("scope"), meta(3).alias("reversible"), meta(4).alias("always_human"))
    eligible = auto_eligible()
    low = F.col("confidence") < conf_threshold
    high = F.lit(high_blocks_auto) & (F.col("sensitivity") == "high")
    mode = F.when(eligible & ~low & ~high, "auto").otherwise("human")
    limit = f"{conf_threshold:.2f}"
    gate = F.array(
        F.when(~eligible & F.col("always_human"), "action always requires human approval"),
        F.when(~eligible & ~F.col("reversible"), "action is irreversible"),
        F.when(~eligible & (F.col("scope") != "principal"), F.concat(F.lit("scope '"), "scope", F.lit("' is not single-principal"))),
        F.when(~eligible & (F.col("impact") != "low"), F.concat(F.lit("impact '"), "impact", F.lit("' exceeds low"))),
        F.when(eligible & low, F.format_string(f"confidence %.2f < threshold {limit}", "confidence")),
        F.when(eligible & ~low & high, "action would affect a high-sensitivity resource"),
        F.when(mode == "auto", F.format_string(f"reversible low-impact single-principal action with confidence %.2f >= {limit}", "confidence")),
        F.format_string("inputs: blast=%.0f, sensitivity=%s", "blast", "sensitivity"))
    priority = F.round(F.least(F.lit(100.0), F.col("blast") + F.when(F.col("sensitivity") == "high", 10).otherwise(0)), 1)
    return d.select(*proposals.columns, mode.alias("mode"), F.filter(gate, lambda r: r.isNotNull()).alias("reasons"), priority.alias("priority"))


def response_plan(ranked: DataFrame, steps: DataFrame, **policy) -> DataFrame:
    """Decided proposals of every case."""
    scope = _scope(steps)
    info = ranked.select(*scope, "case_id", F.col("score").alias("confidence"), "blast")
    return decide_actions(propose(steps).join(info, [*scope, "case_id"]), **policy)


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("case_id").agg(F.count_if(F.col("mode") == "auto").alias("auto_actions"), F.count_if(F.col("mode") == "human").alias("pending_actions"))


def planned_audit(plan: DataFrame) -> DataFrame:
    """Audit-shaped rows of the automatic part of a plan."""
    return plan.filter("mode = 'auto'").select(
        F.sha2(F.concat_ws("|", "case_id", "action_key", "subject"), 256).alias("record_id"), "case_id", "action_key", F.lit("auto").alias("decision"),
        F.lit("planned").alias("status"), F.lit("system").alias("channel"), F.concat(F.lit("auto: "), F.array_join("reasons", "; ")).alias("reason"))


def recommended(plan: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """Actions shown for a case: audited ones as executed, the rest as pending human decisions."""
    pending = plan.filter("mode = 'human'").select("case_id", "action_key", "mode", F.lit("pending").alias("status"), F.array_join("reasons", "; ").alias("reasons"))
    done = planned_audit(plan) if audit is None else audit
    return done.select("case_id", "action_key", F.col("decision").alias("mode"), "status", F.col("reason").alias("reasons")).unionByName(pending)


def audit_history(audit: DataFrame, case_id: str) -> DataFrame:
    return audit.filter(F.col("case_id") == case_id)


def unsafe_automatic(plan: DataFrame) -> DataFrame:
    """Automatically planned actions whose metadata forbid it; must be empty."""
    ok = [k for k, v in fixed.ACTIONS.items() if v[3] and v[1] == "low" and v[2] == "principal" and not v[4]]
    return plan.filter((F.col("mode") == "auto") & ~F.col("action_key").isin(ok))
