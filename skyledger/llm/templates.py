"""Line deduplication by a log-template tree, with DataFrame operations only.

A line is parsed by a tree of fixed depth: its number of tokens, then its ``LEADING`` first tokens; tokens with a digit are
variable fields. In a leaf, a token is constant where documents share it at its place, and every other
place is a variable field too, as long as most of the line stays constant. What remains is the line's template.

A template recurs if it stands in ``LEAST_DOCS`` contexts or more, however many copies each has. A context is the pair of
lines around a run of lines that several documents share, so headers and footers of several lines go as a whole. Copies
of one document have one context, as have near copies; they are left to document deduplication. Recurring lines are dropped.

Documents with more than ``COPY`` of their lines shared are near copies of each other or little more than boilerplate. What is
left of them tells which: a line of a near copy is an edited one, so it agrees with a line of another such document in its
first or last ``END`` tokens or in half as many at both ends; a line of its own does not. Of the documents that hold a template,
those count as near copies if at least half of these remaining lines are edited ones; else each has its own context.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import cut_lineage

LEADING, LEAST_DOCS, CONSTANT, COPY, END = 3, 3, 0.7, 0.75, 6
ANY = "<*>"
#: Columns of this step; the input's own of these names are not passed on.
RESERVED = ("_doc", "_gone", "_n", "n_lines", "n_dropped")


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a one-element explode, which the optimiser never copies into the expressions above it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def lines(docs: DataFrame) -> DataFrame:
    """(doc, pos, masked): the lines of each document that are not blank. ``doc`` is a hash of id and text.

    ``masked``: tokens separated by one space, those with a digit replaced unless too little of the line would stay constant.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    rows = rows.filter(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
    # the replacements touch few lines; the others pass a plain search
    odd = reduce(or_, [F.contains("line", F.lit(c)) for c in ("  ", "\t", "\r", "\x0b", "\x0c")])
    digit = F.col("flat").rlike("[0-9]")
    rows = _once(rows, "flat", F.trim(F.when(odd, F.regexp_replace("line", r"[\x09-\x0D\x20]+", " ")).otherwise(F.col("line")))).drop("line")
    rows = _once(rows, "m", F.when(digit, F.regexp_replace("flat", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(F.col("flat")))
    fields = (F.length("m") - F.length(F.replace(F.col("m"), F.lit(ANY), F.lit("")))) / len(ANY)
    tokens = F.length("m") - F.length(F.replace(F.col("m"), F.lit(" "), F.lit(""))) + 1
    rows = _once(rows, "masked", F.when((F.col("m") != F.col("flat")) & (fields > (1 - CONSTANT) * tokens), F.col("flat")).otherwise(F.col("m")))
    return rows.select("doc", "pos", "masked")


def templates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, pos, line, template, ends) hashes of every line, and the general templates (line, template, pattern).

    ``ends``: hashes of the first ``END`` tokens, of the last ones, and of half as many at both ends.
    """
    raw = lines(docs)
    n = F.length("masked") - F.length(F.replace(F.col("masked"), F.lit(" "), F.lit("")))
    leaf = F.xxhash64(n, F.substring_index("masked", " ", LEADING))
    keyed = raw.select("doc", "pos", F.xxhash64("masked").alias("line"), F.when(n >= LEADING, leaf).alias("leaf"), "masked",
                       F.array(F.xxhash64(F.lit(0), F.substring_index("masked", " ", END)), F.xxhash64(F.lit(1), F.substring_index("masked", " ", -END)),
                               F.xxhash64(F.lit(2), F.substring_index("masked", " ", END // 2), F.substring_index("masked", " ", -(END // 2)))).alias("ends"))
    narrow = cut_lineage(keyed.drop("masked"))
    per_line = (narrow.filter("leaf is not null").groupBy("leaf", "line", "doc").agg(F.min("pos").alias("pos"))
                .groupBy("leaf", "line").agg(F.count("*").alias("docs"), F.min_by("pos", "doc").alias("pos"), F.min("doc").alias("doc")))
    open_leaves = per_line.groupBy("leaf").agg(F.count("*").alias("m"), F.sum("docs").alias("d")).filter(f"m > 1 and d >= {LEAST_DOCS}")
    # one place to read each line of an open leaf at; only documents with such a place are split again
    places = cut_lineage(per_line.join(open_leaves.select("leaf"), "leaf", "left_semi"))
    holders = docs.withColumn("_doc", F.xxhash64("doc_id", "text")).join(
        places.select(F.col("doc").alias("_doc")).distinct().hint("shuffle_hash"), "_doc", "left_semi")  # one plan at every size; texts are never sorted
    text = cut_lineage(lines(holders).join(places, ["doc", "pos"]).groupBy("leaf", "line").agg(F.first("masked").alias("masked"), F.first("docs").alias("docs")))
    at = text.select("leaf", "line", "docs", F.posexplode(F.split("masked", " ")).alias("i", "token"))
    shared = at.groupBy("leaf", "i", "token").agg(F.sum("docs").alias("d")).filter(f"d >= {LEAST_DOCS}").select("leaf", "i", "token", F.lit(True).alias("constant"))
    constant = at.join(shared, ["leaf", "i", "token"], "left")
    token = F.when(F.col("constant") & (F.col("token") != ANY), F.col("token")).otherwise(ANY)
    general = (constant.groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("i", token.alias("t")))).alias("ts"),
                                                    F.avg(F.when(token != ANY, 1.0).otherwise(0.0)).alias("share"))
               .filter(F.col("share") >= CONSTANT).select("line", F.array_join(F.transform("ts", lambda x: x["t"]), " ").alias("pattern")))
    general = cut_lineage(general.withColumn("template", F.xxhash64("pattern")).select(F.col("line").alias("_line"), "template", "pattern"))
    rows = narrow.join(general.select("_line", "template"), F.col("line") == F.col("_line"), "left").select(
        "doc", "pos", "line", F.coalesce("template", "line").alias("template"), "ends")
    return cut_lineage(rows), general


def _edits(shared_most: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc, left, edited): lines that are not shared, and those of them that agree with a line of another document of the frame.

    ``shared_most``: (doc, pos, frame, own) of every line of the documents that share most of theirs.
    """
    keys = (shared_most.join(rows.select("doc", "pos", "ends"), ["doc", "pos"])
            .select("frame", "doc", "pos", "own", F.explode(F.array_distinct("ends")).alias("end")))
    met = keys.groupBy("frame", "end").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("frame", "end", F.lit(1).alias("met"))
    per_line = keys.filter("own").join(met, ["frame", "end"], "left").groupBy("doc", "pos").agg(F.max("met").alias("met"))
    return per_line.groupBy("doc").agg(F.count("*").alias("left"), F.count("met").alias("edited"))


def recurring(rows: DataFrame) -> DataFrame:
    """(template, contexts) of the templates to drop."""
    shared = rows.groupBy("template", "doc").agg(F.lit(1)).groupBy("template").agg(F.count("*").alias("docs")).filter(f"docs >= {LEAST_DOCS}")
    flagged = rows.select("doc", "pos", "template").distinct().join(shared, "template", "left")  # rows that repeat a document
    own = F.when(F.col("docs").isNull(), F.col("template"))
    each = flagged.select("template", "doc", "pos", "docs", own.alias("own")).repartition("doc")
    ahead = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("doc").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("doc")
    none = F.lit(0).cast("bigint")
    around = F.xxhash64(F.coalesce(F.last("own", True).over(ahead), none), F.coalesce(F.last("own", True).over(behind), none))
    most = F.count("docs").over(whole) > COPY * F.count("*").over(whole)
    common = F.max(F.struct("docs", -F.col("pos"), "template")).over(whole)["template"]  # near copies of a document have the same one
    placed = each.select("template", "doc", "pos", "docs", around.alias("around"), F.when(most, common).alias("frame"))
    placed = cut_lineage(placed.filter("docs is not null or frame is not null"))
    edits = _edits(placed.filter("frame is not null").select("doc", "pos", "frame", F.col("docs").isNull().alias("own")), rows)
    once = placed.filter("docs is not null").groupBy("template", "doc").agg(F.min_by("around", "pos").alias("around"), F.first("frame").alias("frame"))
    once = once.join(edits, "doc", "left")
    # both readings of a document that shares most lines: one of its frame's near copies, or a context of its own
    copy, single = F.struct(F.xxhash64("frame").alias("context"), F.lit(True).alias("copies"), F.lit(False).alias("singles")), F.struct(
        F.col("around").alias("context"), F.lit(False).alias("copies"), F.lit(True).alias("singles"))
    both = F.struct(F.col("around").alias("context"), F.lit(True).alias("copies"), F.lit(True).alias("singles"))
    read = once.select("template", F.explode(F.when(F.col("frame").isNull(), F.array(both)).otherwise(F.array(copy, single))).alias("r"),
                       F.coalesce("left", F.lit(0)).alias("left"), F.coalesce("edited", F.lit(0)).alias("edited"))
    per = (read.groupBy("template", F.col("r.context").alias("context"))
           .agg(F.max("r.copies").alias("copies"), F.max("r.singles").alias("singles"), F.sum("left").alias("left"), F.sum("edited").alias("edited"))
           .groupBy("template").agg(F.count_if("copies").alias("copies"), F.count_if("singles").alias("singles"), F.sum("left").alias("left"), F.sum("edited").alias("edited")))
    contexts = F.when(2 * F.col("edited") >= F.col("left"), F.col("copies")).otherwise(F.col("singles"))
    return per.select("template", contexts.alias("contexts")).filter(f"contexts >= {LEAST_DOCS}")


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and n_lines, n_dropped.

    Null texts stay null with 0 lines; blank lines stay; a document may end up empty. Rows equal in doc_id and text are one
    document and are cleaned alike. An empty table stays empty. Other columns are passed on, but for n_chars, which is
    set anew where a line went.
    """
    columns = [c for c in docs.columns if c not in RESERVED]
    docs = docs.select(columns)
    rows, _ = templates(docs)
    drop = recurring(rows).select("template", F.lit(True).alias("drop"))
    flagged = rows.join(drop, "template", "left_semi").select("doc", "pos")
    # the flags of all lines of a document, in order, for documents that lose any
    gone = flagged.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("_gone")).withColumn("_n", F.size("_gone"))
    keyed = docs.withColumn("_doc", F.xxhash64("doc_id", "text"))
    joined = keyed.join(gone.withColumnRenamed("doc", "_doc").hint("shuffle_hash"), "_doc", "left")
    parts = F.split("text", "\n")
    # cut the lines between one dropped place and the next: linear in lines and drops
    ends = F.concat("_gone", F.array(F.size(parts)))
    starts = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda p: p + 1))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(parts, s + 1, e - s))), "\n")
    out = joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce("_n", F.lit(0)).cast("long")).withColumn("text", F.when(F.col("_n") > 0, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_n") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*columns, "n_lines", "n_dropped")
