"""Detection-quality metrics as jobs over prediction and truth tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.sliced import with_running_sum
from skyledger.session import cut_lineage


def _ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d), F.lit(0.0))


def from_counts(df: DataFrame) -> DataFrame:
    """Add precision, recall, f1 and false_positive_rate to tp, fp, tn, fn; empty denominators give 0."""
    c = F.col
    p, r = _ratio(c("tp"), c("tp") + c("fp")), _ratio(c("tp"), c("tp") + c("fn"))
    return df.select("*", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"),
                     _ratio(c("fp"), c("fp") + c("tn")).alias("false_positive_rate"))


def rule_set_metrics(expected: DataFrame, actual: DataFrame, by: str = "scenario", key: str = "key") -> DataFrame:
    """Expected against fired keys per scenario; true negatives are undefined and stay 0."""
    e = expected.select(by, key).distinct().withColumn("e", F.lit(True))
    a = actual.select(by, key).distinct().withColumn("a", F.lit(True))
    has = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = e.join(a, [by, key], "full").groupBy(by).agg(
        F.count_if(has("e") & has("a")).alias("tp"), F.count_if(~has("e") & has("a")).alias("fp"),
        F.lit(0).cast("bigint").alias("tn"), F.count_if(has("e") & ~has("a")).alias("fn"))
    return from_counts(counts)


def binary_metrics(df: DataFrame, expected: str = "expected", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    e, p = F.col(expected), F.col(predicted)
    return from_counts(df.groupBy(*(by or [])).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"),
                                                   F.count_if(~e & ~p).alias("tn"), F.count_if(e & ~p).alias("fn")))


# ---------------------------------------------------------------- ordered chains

#: Truth actions of one machine word.
WORD = 62


def _row_by_bits(word: str) -> str:
    """SQL for one block: longest common subsequences of truth[from ..] with the block, ending at every place of the word.

    The places where the subsequence grows are the zero bits of one integer; an action updates all of them with an addition.
    """
    return f"aggregate({word}, whole, (v, m) -> ((v + (v & m)) | (v & ~m)) & whole)"


def chain_accuracy(expected: DataFrame, actual: DataFrame, by: str = "scenario", block: int = 65_536) -> DataFrame:
    """Order-aware similarity: longest common subsequence / longer length, four decimals.

    ``expected(by, pos, action)`` is a short truth list, ``actual(by, pos, action)`` may be any length. The actual
    sequence is cut into blocks. Each block yields the matrix of its common subsequences with every span of the
    expected list, by integer operations on the bits of a word (truths of more than ``WORD`` actions: row by row of the table). Matrices of
    neighbouring blocks combine as max-plus products in a tree, two at a time, so a long chain is never one group.
    """
    truth = expected.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "action"))), lambda s: s["action"]).alias("truth"))
    size = actual.groupBy(by).agg(F.count("*").alias("n_actual"))
    useful = actual.join(expected.select(by, "action").distinct(), [by, "action"], "left_semi")  # other actions never match
    blocks = (useful.withColumn("block", F.floor(F.col("pos") / block)).groupBy(by, "block")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "action"))), lambda s: s["action"]).alias("actions")).join(truth, by).withColumn("n", F.size("truth")))
    # bit i of an action's mask: truth[i] is this action
    mask = "transform(actions, a -> aggregate(sequence(0, n - 1), 0L, (acc, i) -> acc | if(truth[i] = a, shiftleft(1L, i), 0L)))"
    short = (blocks.filter(F.col("n") <= WORD).withColumn("masks", F.expr(mask)).select(by, "block", "n", "masks", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i"))
             .withColumn("whole", F.expr("shiftleft(1L, n - i) - 1")).withColumn("word", F.expr("transform(masks, m -> shiftright(m, i))"))
             .withColumn("v", F.expr(_row_by_bits("word")))
             .withColumn("row", F.expr("transform(sequence(0, n), j -> if(j <= i, 0, (j - i) - bit_count(v & (shiftleft(1L, j - i) - 1))))")))
    # the same rows cell by cell: new[j] is the largest of old[j], new[j - 1] and, where truth[j] is the action, old[j - 1] + 1
    step = ("aggregate(actions, array_repeat(0, n + 1), (old, a) -> aggregate(sequence(1, n), array(0), (new, j) -> "
            "concat(new, array(coalesce(if(j <= i, 0, greatest(old[j], new[j - 1], if(truth[j - 1] = a, old[j - 1] + 1, 0))), 0)))))")
    long = blocks.filter(F.col("n") > WORD).select("*", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")).withColumn("row", F.expr(step))
    rows = short.select(by, "block", "n", "i", "row").unionByName(long.select(by, "block", "n", "i", "row"))
    matrices = cut_lineage(rows.groupBy(by, "block").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "row"))), lambda s: s["row"]).alias("m")))
    product = ("transform(sequence(0, n), i -> transform(sequence(0, n), j -> if(j < i, 0, array_max(transform(sequence(i, greatest(i, j)), k -> ms[0][i][k] + ms[1][k][j])))))")
    while (matrices.agg(F.max("block")).first()[0] or 0) > 0:
        pairs = matrices.groupBy(by, F.expr("block div 2").alias("half")).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("block", "m"))), lambda s: s["m"]).alias("ms"))
        matrices = cut_lineage(pairs.select(by, F.col("half").alias("block"), "n", F.expr(f"if(size(ms) = 1, ms[0], {product})").alias("m")))
    lcs = matrices.select(by, F.expr("m[0][n]").alias("lcs"))
    d = truth.join(size, by, "full").join(lcs, by, "left")
    n_truth, n_act = F.coalesce(F.size("truth"), F.lit(0)), F.coalesce("n_actual", F.lit(0))
    value = F.when(n_truth == 0, F.when(n_act == 0, 1.0).otherwise(0.0)).otherwise(
        F.round(F.coalesce("lcs", F.lit(0)) / F.greatest(n_truth, n_act, F.lit(1)), 4))
    return d.select(by, value.alias("chain_accuracy"))


# ---------------------------------------------------------------- cases, paths, rankings

def correlation_score(expected: DataFrame, case_events: DataFrame, benign: DataFrame | None = None, by: str = "scenario") -> DataFrame:
    """Best case per scenario: share of the expected events it holds, times one minus its benign share."""
    e = expected.select(by, "event_id").distinct().withColumn("e", F.lit(1))
    c = case_events.select(by, "case_id", "event_id").distinct()
    d = c.join(e, [by, "event_id"], "left")
    if benign is not None:
        d = d.join(benign.select(by, "event_id").distinct().withColumn("b", F.lit(1)), [by, "event_id"], "left")
    else:
        d = d.withColumn("b", F.lit(None).cast("int"))
    per = d.groupBy(by, "case_id").agg(F.count("e").alias("hit"), F.count("b").alias("bad"), F.count("*").alias("n"))
    want = e.groupBy(by).agg(F.count("*").alias("wanted"))
    best = want.join(per, by, "left").groupBy(by).agg(F.max((F.col("hit") / F.col("wanted")) * (1 - F.col("bad") / F.greatest(F.lit(1), F.col("n")))).alias("s"))
    return best.select(by, F.round(F.coalesce("s", F.lit(0.0)), 4).alias("correlation_score"))


def compare_paths(df: DataFrame, expected: str = "expected", actual: str = "actual") -> DataFrame:
    """Edge precision and recall, positional agreement and the exact flag of two short node lists."""
    def pairs(c: str) -> Column:
        return F.when(F.size(c) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 1),
                                                                  lambda i: F.struct(F.get(c, i - 1).alias("a"), F.get(c, i).alias("b"))))
                      ).otherwise(F.array().cast("array<struct<a:string,b:string>>"))

    both_empty = (F.size(expected) == 0) & (F.size(actual) == 0)
    ee, ae = pairs(expected), pairs(actual)
    common = F.size(F.array_intersect(ee, ae))
    ep = F.when(F.size(ae) > 0, common / F.size(ae)).otherwise(0.0)
    er = F.when(F.size(ee) > 0, common / F.size(ee)).otherwise(0.0)
    agree = F.aggregate(F.zip_with(expected, actual, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda x, y: x + y)
    positional = agree / F.greatest(F.lit(1), F.size(expected), F.size(actual))
    harmonic = F.when(ep + er > 0, 2 * ep * er / (ep + er)).otherwise(0.0)
    return df.select("*", (F.col(expected) == F.col(actual)).alias("exact_path_match"),
                     F.when(both_empty, 1.0).otherwise(F.round(ep, 4)).alias("edge_precision"),
                     F.when(both_empty, 1.0).otherwise(F.round(er, 4)).alias("edge_recall"),
                     F.when(both_empty, 1.0).otherwise(F.round((positional + harmonic) / 2, 4)).alias("path_similarity"))


def ranking_agreement(expected: DataFrame, actual: DataFrame, by: str = "ranking") -> DataFrame:
    """Share of item pairs ordered alike in two rankings (by, item, pos), four decimals.

    Disagreeing pairs are inversions. They are counted bit by bit of the actual position: among items that agree on
    the higher bits, each item with a 0 bit disagrees with the earlier ones that have a 1. n log n rows and one
    running sum instead of all pairs.
    """
    both = expected.select(by, "item", F.col("pos").cast("bigint").alias("e")).join(
        actual.select(by, "item", F.col("pos").cast("bigint").alias("a")), [by, "item"])
    top = F.length(F.bin(both.agg(F.coalesce(F.max("a"), F.lit(0))).scalar()))
    # the bit count is a constant of the query, taken once
    bits = both.withColumn("_top", top).select(by, "e", "a", F.explode(F.sequence(F.lit(0), F.col("_top") - 1)).alias("b"))
    bits = bits.select(by, "b", F.expr("shiftright(a, b + 1)").alias("high"), F.expr("shiftright(a, b) & 1").alias("bit"), "e")
    run = with_running_sum(bits, [by, "b", "high"], F.col("bit"), "ones", ["e"], width=1 << 20, us="e")
    inv = run.filter("bit = 0").groupBy(by).agg(F.sum("ones").alias("inversions"))
    n = both.groupBy(by).agg(F.count("*").alias("n"))
    every = expected.select(by).union(actual.select(by)).distinct()
    d = every.join(n, by, "left").join(inv, by, "left")
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return d.select(by, F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(
        F.round((pairs - F.coalesce("inversions", F.lit(0))) / pairs, 4)).alias("agreement"))


# ---------------------------------------------------------------- timing, coverage, summary

TIMINGS = {
    "detection_latency_ms": ("event_ingested", "detected"), "case_creation_latency_ms": ("event_ingested", "case_created"),
    "mtti_ms": ("case_created", "investigation_started"), "mttr_ms": ("investigation_started", "response_completed"),
    "recommendation_latency_ms": ("case_created", "response_recommended"), "approval_to_completion_ms": ("approved", "response_completed"),
}


def timing_metrics(df: DataFrame) -> DataFrame:
    """Stage latencies in milliseconds from microsecond stage times; null where a stage is missing."""
    return df.select("*", *[F.round((F.col(b) - F.col(a)) / 1000, 3).alias(n) for n, (a, b) in TIMINGS.items()])


def technique_coverage(results: DataFrame) -> DataFrame:
    """(technique_id, scenarios, number_of_detections) from (scenario, attack_ids)."""
    t = results.select("scenario", F.explode("attack_ids").alias("technique_id"))
    return t.groupBy("technique_id").agg(F.array_join(F.sort_array(F.collect_set("scenario")), ",").alias("scenarios"), F.count("*").alias("number_of_detections")).orderBy("technique_id")


def summarize(results: DataFrame) -> DataFrame:
    """Roll-up over scenario results: (scenario, attack, passed, fired, chain_accuracy, correlation_score, privesc_path_score)."""
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("attack"), F.col(c))), F.lit(0.0))
    counts = results.agg(
        F.count_if(F.col("attack") & F.col("fired")).alias("tp"), F.count_if(~F.col("attack") & F.col("fired")).alias("fp"),
        F.count_if(~F.col("attack") & ~F.col("fired")).alias("tn"), F.count_if(F.col("attack") & ~F.col("fired")).alias("fn"),
        F.count("*").alias("scenarios_total"), F.count_if("passed").alias("scenarios_passed"), F.count_if(~F.col("passed")).alias("scenarios_failed"),
        mean("chain_accuracy").alias("average_chain_accuracy"), F.coalesce(F.max("privesc_path_score"), F.lit(0.0)).alias("average_privesc_accuracy"),
        mean("correlation_score").alias("average_correlation_accuracy"))
    return from_counts(counts)
