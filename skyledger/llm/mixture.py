"""Mixing sources to target weights with DataFrame operations only.

The words of a source, in a fixed order of its documents, form a stream that is cut into blocks of ``block`` words. The
mix is a row of slots, dealt to output shards. Every slot draws its source, so a shard holds multinomial source counts;
the r-th slot of a source takes the block at place r of a pseudorandom permutation of its blocks, a new one per pass.
Draws beyond a source's share of slots are handed to the sources that fell short, so every source ends at its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import WORD, chunk_count, word_count
from skyledger.session import cut_lineage

BLOCK, SHARD_SLOTS, CELLS, ROUNDS = 256, 4096, 4096, 24


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code-point order, null last, get the weights in turn and share ``share`` times all sizes. A target stops at
    ``most`` times its source; the excess is shared by weight again until none is above. With the sources ordered by
    limit / weight, the level at which the rest is shared peaks where the first source stays below its limit.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = [F.asc(F.col("cap") / F.col("w")), F.asc_nulls_last("source")]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward)
    return (rows.withColumn("level", level).withColumn("level", F.max("level").over(every))
            .select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target")))


def permuted(x: Column, n: Column, key: list, rounds: int = ROUNDS, back: bool = False) -> Column:
    """Image of ``x`` under a pseudorandom permutation of 0..n-1 (swap-or-not); ``back``: its inverse.

    A round pairs x with (k - x) mod n and swaps them by a hash of the larger: an involution, so every round, and all of
    them together, is a bijection for any n.
    """
    def swap(v: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("shift"), *key, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(F.lit("swap"), *key, r, F.greatest(v, other)), F.lit(2)) == 1, other).otherwise(v)

    steps = F.array(*[F.lit(i) for i in (reversed(range(rounds)) if back else range(rounds))])
    return F.aggregate(steps, x.cast("long"), swap)


def _streams(rows: DataFrame) -> DataFrame:
    """Add ``at``: words of the source before this row. A source is cut into chunks, so a hot one is not sorted in one task."""
    chunks = chunk_count(rows.count())
    src = rows.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
    inside = Window.partitionBy("source", "_chunk").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = (src.groupBy("source", "_chunk").agg(F.sum("size").alias("n"))
             .select(F.col("source").alias("_s"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    local = src.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return (local.join(shift, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
            .withColumn("at", F.col("at") + F.col("shift")).drop("_chunk", "_s", "_c", "shift"))


def schedule(shares: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """Slots of the mix: shard, slot, source, pass, block, words (taken from the start of the block).

    ``shares``: (source, source_size, target). All passes but the last of a source take every block whole; the last takes
    blocks in permuted order until the target is reached, the final one in part.
    """
    spark = shares.sparkSession
    name = F.coalesce(F.col("source"), F.lit("\u0000null"))
    base = (shares.filter("source_size > 0 and target > 0").withColumn("name", name)
            .withColumn("nb", F.ceil(F.col("source_size") / block).cast("long"))
            .withColumn("passes", F.floor(F.col("target") / F.col("source_size")).cast("long"))
            .withColumn("rest", F.least(F.col("source_size"), F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long")))
            .withColumn("short", F.col("nb") * block - F.col("source_size")))
    p_last = permuted(F.col("nb") - 1, F.col("nb"), [F.lit(seed), F.col("name"), F.col("passes")], back=True)
    plain = F.ceil(F.col("rest") / block)
    base = base.withColumn("p_last", p_last).withColumn(
        "tail", F.when(F.col("p_last") >= plain, plain).otherwise(F.ceil((F.col("rest") + F.col("short")) / block)).cast("long"))
    base = cut_lineage(base.withColumn("slots", F.col("passes") * F.col("nb") + F.col("tail"))
                       .withColumn("hi", F.sum("slots").over(Window.orderBy("name"))).withColumn("lo", F.col("hi") - F.col("slots")))
    total = base.agg(F.sum("slots")).first()[0] or 0
    # the source of a slot: a uniform draw against the cumulative shares, met on equal cells of the unit interval
    cells = base.select("name", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS / max(total, 1)), F.floor((F.col("hi") - 1) * CELLS / max(total, 1)))).alias("cell"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("slot")), F.lit(max(total, 1)))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard")).withColumn("u", draw)
    slots = slots.withColumn("cell", F.floor(F.col("u") * CELLS / max(total, 1)))
    drawn = cut_lineage(slots.join(cells, "cell").filter("u >= lo and u < hi").select("shard", "slot", "name"))
    counts = drawn.groupBy("name", "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("name").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("name", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("name", "shard").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(inside) - 1).join(shift, ["name", "shard"]).withColumn("rank", F.col("r") + F.col("shift"))
    quota = counts.groupBy("name").agg(F.sum("n").alias("n")).join(base.select("name", "slots"), "name", "right").withColumn("n", F.coalesce("n", F.lit(0)))
    running = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    quota = cut_lineage(quota.withColumn("over", F.greatest(F.lit(0), F.col("n") - F.col("slots"))).withColumn("under", F.greatest(F.lit(0), F.col("slots") - F.col("n")))
                        .withColumn("over_at", F.coalesce(F.sum("over").over(running), F.lit(0))).withColumn("under_at", F.coalesce(F.sum("under").over(running), F.lit(0))))
    kept = ranked.join(quota.select("name", "slots", "over_at"), "name")
    # surplus draws, numbered over all sources, fill the sources that were drawn too rarely
    step = 64
    holes = quota.filter("under > 0").select(F.col("name").alias("to"), "n", "under_at", (F.col("under_at") + F.col("under")).alias("under_end"))
    holes = holes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("under_at") / step), F.floor((F.col("under_end") - 1) / step))))
    surplus = kept.filter("rank >= slots").withColumn("e", F.col("over_at") + F.col("rank") - F.col("slots")).withColumn("cell", F.floor(F.col("e") / step))
    moved = surplus.join(holes, "cell").filter("e >= under_at and e < under_end").select("shard", "slot", F.col("to").alias("name"), (F.col("n") + F.col("e") - F.col("under_at")).alias("rank"))
    placed = kept.filter("rank < slots").select("shard", "slot", "name", "rank").union(moved).join(
        base.select("name", "source", "source_size", "nb", "passes", "rest", "short", "p_last"), "name")
    turn = F.floor(F.col("rank") / F.col("nb"))
    place = F.col("rank") - F.col("pass") * F.col("nb")
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    ahead_words = F.col("place") * block - F.when(F.col("place") > F.col("p_last"), F.col("short")).otherwise(F.lit(0))
    return (placed.withColumn("pass", turn).withColumn("place", place)
            .withColumn("block", permuted(F.col("place"), F.col("nb"), [F.lit(seed), F.col("name"), F.col("pass")]))
            .withColumn("words", F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, F.col("rest") - ahead_words)).cast("long"))
            .select("shard", "slot", "source", "pass", "block", "words"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = BLOCK, seed: int = 7) -> dict[str, DataFrame]:
    """Tables of a mix: ``sources`` (targets), ``slots`` (the schedule), ``taken`` (doc rows), ``ranges`` (word ranges taken).

    ``taken``: row, doc_id, source, size, source_size, target, taken. Null texts have no words and null sources come last;
    equal rows are told apart by ``row``; documents without words take nothing; an empty table gives empty tables; only
    doc_id, text and source are read. Reruns agree: every choice is a hash of names and positions.
    """
    rows = cut_lineage(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row")))
    sizes = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    streams = cut_lineage(_streams(rows))
    slots = cut_lineage(schedule(sizes, block, seed=seed))
    last = F.floor((F.col("at") + F.col("size") - 1) / block)
    spans = streams.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), last)))
    takes = slots.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "pass", "words")
    lo = F.greatest(F.lit(0), F.col("block") * block - F.col("at"))
    hi = F.least(F.col("size"), F.col("block") * block + F.col("words") - F.col("at"))
    ranges = (spans.join(takes, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
              .select("doc_id", "source", "row", "size", "at", "pass", lo.alias("lo"), hi.alias("hi")).filter("hi > lo"))
    per_doc = ranges.groupBy("doc_id", "source", "row", "at").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("row").alias("_r"), F.col("at").alias("_a"), "taken")
    taken = streams.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("row") == F.col("_r"))
                         & (F.col("at") == F.col("_a")) & (F.col("size") > 0), "left")
    named = sizes.select(F.col("source").alias("_n"), "source_size", "target")
    taken = taken.join(named, F.col("source").eqNullSafe(F.col("_n"))).select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return {"sources": sizes, "slots": slots, "ranges": ranges, "taken": taken}


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with their columns (but those led by an underscore): per document and pass, the words taken in their order.

    A pass that takes the whole document keeps its text as it is; otherwise the taken words with the white space before them.
    """
    ranges = mix(docs, **how)["ranges"]
    per_pass = ranges.groupBy("doc_id", "source", "row", "at", "pass").agg(
        F.max("size").alias("_size"), F.sum(F.col("hi") - F.col("lo")).alias("_words"), F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
    # equal documents are one row here and as many streams there
    copies = docs.select(*[c for c in docs.columns if c[0] != "_"], F.xxhash64("text").alias("_text")).dropDuplicates(["doc_id", "source", "_text"])
    on = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_text") == F.col("_r"))
    joined = per_pass.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("row").alias("_r"), "_size", "_words", "_spans").join(copies, on)
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    part = F.array_join(F.flatten(F.transform("_spans", lambda s: F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")))), "")
    out = joined.withColumn("text", F.when(F.col("_words") == F.col("_size"), F.col("text")).otherwise(part))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select([c for c in docs.columns if c[0] != "_"])
