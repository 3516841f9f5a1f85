"""Attack-chain reconstruction: the ordered steps behind each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.columns import DAY, HOUR, MINUTE, blank_to_null, is_read_action, lookup, tactic_of, tactic_rank, tail
from skyledger.functions.sliced import SLICE, carry_scan, slice_of, with_latest, with_previous, with_running_sum
from skyledger.session import cut_lineage

from pyspark.sql.window import Window

POSITION = ["us", "trank", "seq"]


def actor(principal: Column, principal_type: Column, issuer: Column) -> Column:
    """Assumed-role sessions act as the role that issued them."""
    return F.when(principal_type == "assumed_role", F.coalesce(blank_to_null(issuer), principal)).otherwise(principal)


def classify(event: Column) -> Column:
    """API name to technique: the fixed map first, then reads as discovery, else null."""
    return F.coalesce(lookup(fixed.STEP_TECHNIQUES, event), F.when(is_read_action(event), F.lit(fixed.DISCOVERY)))


def _cells(lo: Column, hi: Column) -> Column:
    """Cover [lo, hi] by whole days plus the hours at its edges, so a long case is not cut into every hour."""
    first, last = F.ceil(lo / F.lit(DAY)), F.floor(hi / F.lit(DAY)) - 1  # full days
    hours = lambda a, b: F.transform(F.sequence(slice_of(a, HOUR), slice_of(b, HOUR)),
                                     lambda h: F.struct(F.lit(0).alias("level"), h.alias("cell")))
    days = F.transform(F.sequence(first, last), lambda d: F.struct(F.lit(1).alias("level"), d.cast("bigint").alias("cell")))
    head = F.when(first * DAY > lo, hours(lo, first * DAY - 1))
    rest = F.when((last + 1) * DAY <= hi, hours((last + 1) * DAY, hi))
    none = F.array().cast("array<struct<level:int,cell:bigint>>")
    return F.when(first <= last, F.concat(F.coalesce(head, none), days, F.coalesce(rest, none))).otherwise(hours(lo, hi))


def select_events(cases: DataFrame, entities: DataFrame, events: DataFrame, pad_minutes: int = 5) -> DataFrame:
    """Events of each case: by principal, acting identity or address, inside the padded case span.

    A range join turned into an equi join on (entity, time cell); each (case, event) comes out once.
    """
    scope = [c for c in ("scenario",) if c in cases.columns]
    pad = pad_minutes * MINUTE
    span = cases.select(*scope, "case_id", (F.col("us_start") - pad).alias("lo"), (F.col("us_end") + pad).alias("hi"))
    wanted = (entities.join(span, [*scope, "case_id"])
              .select(*scope, "case_id", "lo", "hi", F.when(F.col("kind") == "principal", "id").otherwise("ip").alias("kind"), "value",
                      F.explode(F.when(F.col("lo").isNotNull(), _cells(F.col("lo"), F.col("hi")))).alias("c"))
              .select(*scope, "case_id", "lo", "hi", "kind", "value", "c.*"))
    ev = events.withColumn("actor", actor(F.col("principal"), F.col("principal_type"), F.col("session.issuer_arn")))
    ids = F.array_distinct(F.array(F.struct(F.lit("id").alias("kind"), F.col("principal").alias("value")),
                                   F.struct(F.lit("id").alias("kind"), F.col("actor").alias("value")),
                                   F.struct(F.lit("ip").alias("kind"), F.col("src_ip").alias("value"))))
    levels = F.array(F.struct(F.lit(0).alias("level"), slice_of(F.col("us"), HOUR).alias("cell")),
                     F.struct(F.lit(1).alias("level"), slice_of(F.col("us"), DAY).alias("cell")))
    cols = ["seq", "us", "principal", "actor", "event", "target", "event_id"]
    keyed = (ev.select(*scope, *cols, F.explode(ids).alias("k")).filter(F.col("k.value") != "")
             .select(*scope, *cols, "k.*", F.explode(levels).alias("l")).select(*scope, *cols, "kind", "value", "l.*"))
    hit = keyed.join(wanted, [*scope, "kind", "value", "level", "cell"]).filter(F.col("us").between(F.col("lo"), F.col("hi")))
    return hit.select(*scope, "case_id", *cols).dropDuplicates([*scope, "case_id", "seq"])


def _run_anchors(long_reads: DataFrame, run: list[str], gap: int) -> DataFrame:
    """(run, us) of every read that opens a step inside a long discovery run.

    The next step opens at the first read later than anchor + gap. Each distinct read time points to that next
    opening (one merge over reads and their deadlines); the openings reachable from the run start follow by pointer
    doubling, in log2(openings) rounds however long the run is.
    """
    ticks = long_reads.select(*run, "us").distinct()
    both = (ticks.select(*run, "us", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("origin"))
            .unionByName(ticks.select(*run, (F.col("us") + gap).alias("us"), F.lit(1).alias("kind"), F.col("us").alias("origin"))))
    tick = F.when(F.col("kind") == 0, F.col("us"))
    scanned = carry_scan(both.withColumn(SLICE, slice_of(F.col("us"))), run, [F.desc("us"), F.desc("kind")],
                         local={"_near": lambda w: F.min(tick).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
                         summary={"_edge": F.min(tick)},
                         carry={"_far": lambda w: F.min("_edge").over(w.rowsBetween(Window.unboundedPreceding, -1))},
                         descending=True)
    jump = cut_lineage(scanned.filter("kind = 1").select(*run, F.col("origin").alias("us"), F.coalesce("_near", "_far").alias("to"))
                       .filter(F.col("to").isNotNull()))
    reached = cut_lineage(long_reads.select(*run, F.col("head_us").alias("us")).distinct())
    size = reached.count()
    while True:
        more = reached.join(jump, [*run, "us"]).select(*run, F.col("to").alias("us"))
        reached = cut_lineage(reached.unionByName(more).distinct())
        grown = reached.count()
        if grown == size:
            return reached
        size = grown
        after = jump.select(*run, F.col("us").alias("to"), F.col("to").alias("to2"))
        jump = cut_lineage(jump.join(after, [*run, "to"]).select(*run, "us", F.col("to2").alias("to")))


def reconstruct(cases: dict[str, DataFrame], events: DataFrame, edges: DataFrame | None = None,
                collapse_minutes: int = 10, pad_minutes: int = 5, shared: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """``step`` (case_id, step_no, ...), ``step_event`` and ``step_detection`` tables of all cases.

    Steps are ordered by time, tactic rank, arrival. Consecutive discovery reads of one actor within the gap of the
    first read of a step fold into that step.
    """
    scope = [c for c in ("scenario",) if c in cases["case"].columns]
    case = [*scope, "case_id"]
    gap = collapse_minutes * MINUTE
    # every ordered pass reads its input twice: what it starts from is written once
    picked = cut_lineage(select_events(cases["case"], cases["case_entity"], events, pad_minutes))
    rows = picked.withColumn("attack_id", classify(F.col("event")))
    rows = rows.withColumn("trank", tactic_rank(tactic_of(F.col("attack_id"))))
    rows = rows.withColumn("reads", F.coalesce(F.col("attack_id") == fixed.DISCOVERY, F.lit(False)))
    rows = with_previous(rows, case, ["actor", "reads"], "prev", order=POSITION)
    follows = F.coalesce(F.col("prev.reads") & (F.col("prev.actor") == F.col("actor")), F.lit(False))
    rows = cut_lineage(rows.withColumn("opens", F.col("reads") & ~follows).drop("prev"))
    rows = with_latest(rows, case, F.col("opens"), [], "head", order=POSITION)
    rows = cut_lineage(rows.withColumn("head_us", F.col("head.us")).withColumn("head_trank", F.col("head.trank"))
                       .withColumn("head_seq", F.col("head.seq")).drop("head", "opens"))

    run = [*case, "head_us", "head_trank", "head_seq"]
    reads = rows.filter("reads")
    long_runs = reads.groupBy(*run).agg(F.max("us").alias("_end")).filter(F.col("_end") - F.col("head_us") > gap).select(*run)
    long_reads = cut_lineage(reads.select(*run, "us").distinct().join(long_runs, run, "left_semi"))
    if long_reads.isEmpty():
        rows = rows.withColumn("anchor", F.col("head_us"))
    else:
        opened = _run_anchors(long_reads, run, gap).withColumn("_open", F.lit(True))
        rows = rows.join(opened, [*run, "us"], "left")
        # a run head always opens a step, whether its run is long or not
        opens = F.coalesce("_open", F.lit(False)) | (F.col("us") == F.col("head_us"))
        rows = with_latest(rows.withColumn("_o", F.col("reads") & opens), run, F.col("_o"), [], "at", order=POSITION)
        rows = rows.withColumn("anchor", F.col("at.us")).drop("at", "_o", "_open")

    own = F.struct(*[F.col(c).cast("bigint").alias(c) for c in POSITION], F.lit(-1).cast("bigint").alias("anchor"))
    folded = F.struct(F.col("head_us").alias("us"), F.col("head_trank").cast("bigint").alias("trank"),
                      F.col("head_seq").cast("bigint").alias("seq"), F.col("anchor").cast("bigint").alias("anchor"))
    rows = rows.withColumn("step_key", F.when(F.col("reads"), folded).otherwise(own))
    first = F.struct(*[F.col(c) for c in POSITION], "actor", "principal", "event", "target", "attack_id")
    steps = (rows.groupBy(*case, "step_key").agg(F.min_by(first, F.struct(*POSITION)).alias("f"), F.count("*").alias("read_count"))
             .select(*case, "step_key", "f.*", "read_count"))
    steps = with_running_sum(cut_lineage(steps), case, F.lit(1), "step_no", POSITION)
    steps = steps.select(
        *case, "step_key", F.col("step_no").cast("bigint"), "us", "trank", "seq", "actor", F.col("principal").alias("raw_principal"),
        F.when(F.col("read_count") > 1, F.concat(F.lit("Discovery ("), F.col("read_count").cast("string"), F.lit(" reads)")))
        .otherwise(F.col("event")).alias("action"),
        "attack_id", F.coalesce(tactic_of(F.col("attack_id")), F.lit("Unknown")).alias("tactic"), "target", "read_count")
    steps = annotate(steps, edges, shared) if edges is not None else steps.withColumn("via_edge", F.lit(None).cast("string"))
    steps = cut_lineage(steps)
    step_event = cut_lineage(rows.join(steps.select(*case, "step_key", "step_no"), [*case, "step_key"]).select(
        *case, "step_no", *POSITION, "event_id", "event", "principal", "target"))
    found = cases["case_detection"].filter(F.col("event_id").isNotNull() & (F.col("event_id") != "")).select(
        *case, "event_id", "det_id", "key", "stage", F.col("seq").alias("det_seq"), "sub")
    step_detection = step_event.select(*case, "step_no", "seq", "event_id").join(found, [*case, "event_id"]).drop("seq")
    return {"step": steps.drop("step_key"), "step_event": step_event, "step_detection": step_detection}


def annotate(steps: DataFrame, edges: DataFrame, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """The permission-graph edge that makes a step possible, first edge by graph order.

    ``shared`` edges of classes (:func:`escalation.escalation_parts`) are looked up for the pairs of the steps only.
    """
    pair = edges.filter(F.col("kind").isin("CAN_ASSUME", "CAN_ACCESS")).select(
        F.col("src").alias("actor"), F.col("dst").alias("target"),
        F.when(F.col("kind") == "CAN_ASSUME", "T1548").otherwise("T1530").alias("attack_id"), F.lit(True).alias("_pair"))
    via = edges.filter("kind = 'CAN_ESCALATE_VIA'").select(F.col("src").alias("actor"), F.struct("ord", "technique").alias("_first"))
    if shared is not None:
        member = shared["member"].withColumnRenamed("principal", "actor")
        reads = shared["edges"].filter("kind = 'CAN_ACCESS'").select(F.col("src").alias("cls"), F.col("dst").alias("target"))
        asked = steps.filter("attack_id = 'T1530'").select("actor", "target").distinct()
        pair = pair.unionByName(asked.join(member, "actor").join(reads, ["cls", "target"], "left_semi").select(
            "actor", "target", F.lit("T1530").alias("attack_id"), F.lit(True).alias("_pair")))
        first = shared["edges"].filter("kind = 'CAN_ESCALATE_VIA'").groupBy(F.col("src").alias("cls")).agg(F.min(F.struct("ord", "technique")).alias("_first"))
        via = via.unionByName(member.join(first, "cls").select("actor", "_first"))
    pair = pair.distinct()
    grant = via.groupBy("actor").agg(F.min("_first")["technique"].alias("_technique")).withColumn("attack_id", F.lit("T1098.003"))
    out = steps.join(pair, ["actor", "target", "attack_id"], "left").join(grant, ["actor", "attack_id"], "left")
    via = (F.when(F.col("_pair") & (F.col("target") != "") & (F.col("attack_id") == "T1548"),
                  F.concat(F.lit("CAN_ASSUME "), tail(F.col("actor")), F.lit(" -> "), tail(F.col("target"))))
           .when(F.col("_pair") & (F.col("target") != ""), F.concat(F.lit("CAN_ACCESS -> "), tail(F.col("target"))))
           .when(F.col("_technique").isNotNull(), F.concat(F.lit("CAN_ESCALATE_VIA "), "_technique")))
    return out.withColumn("via_edge", via).select(*steps.columns, "via_edge")


def chain_actors(steps: DataFrame) -> DataFrame:
    scope = [c for c in ("scenario",) if c in steps.columns]
    return steps.select(*scope, "case_id", "actor").distinct()
