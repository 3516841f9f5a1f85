"""Grounded case context: sanitised fields, playbook retrieval, context items, summary text, text audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import fixed
from skyledger.functions.sliced import with_running_sum
from skyledger.operators.rules import describe

CAP = 512


def sanitize(field: str, value: Column, cap: int = CAP) -> Column:
    """Untrusted text as a DATA struct: clipped, HTML-escaped, control characters made visible.

    The length is that of the whole text; escaping follows clipping.
    """
    raw = F.coalesce(value, F.lit(""))
    text = F.substring(raw, 1, cap)
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
                     ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.struct(F.lit("DATA").alias("tag"), F.lit(field).alias("field"), text.alias("value"),
                    (F.length(raw) > cap).alias("truncated"), F.length(raw).alias("original_length"))


def sanitize_json(field: str, value: Column, cap: int = CAP) -> Column:
    """Same for nested values, through their compact JSON text."""
    return sanitize(field, F.to_json(F.try_parse_json(value)), cap)


# ---------------------------------------------------------------- playbooks

def case_tags(cases: DataFrame, case_detection: DataFrame, plan: DataFrame) -> DataFrame:
    """(case_id, kind, tag): detection keys, techniques and recommended actions of every case."""
    return (case_detection.select("case_id", F.lit("detection").alias("kind"), F.col("key").alias("tag"))
            .unionByName(cases.select("case_id", F.lit("technique").alias("kind"), F.explode("techniques").alias("tag")))
            .unionByName(plan.select("case_id", F.lit("action").alias("kind"), F.col("action_key").alias("tag")))).distinct()


def retrieve_playbooks(tags: DataFrame, corpus: DataFrame) -> DataFrame:
    """(case_id, playbook_id, score) with 3 per shared detection, 2 per technique, 1 per action; no overlap, no row.

    An equi join on (kind, tag); cases and playbooks are never multiplied.
    """
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(w).alias("weight"), F.col(c).alias("tags"))
                      for k, w, c in (("detection", 3, "detection_types"), ("technique", 2, "attack_ids"), ("action", 1, "action_names"))])
    book = (corpus.select("playbook_id", F.explode(kinds).alias("k")).select("playbook_id", "k.kind", "k.weight", F.explode("k.tags").alias("tag")).distinct())
    return tags.join(book, ["kind", "tag"]).groupBy("case_id", "playbook_id").agg(F.sum("weight").alias("score")).orderBy("case_id", F.desc("score"), "playbook_id")


# ---------------------------------------------------------------- context items

_EMIT = 1 << 44


def numbered_detections(case_detection: DataFrame) -> DataFrame:
    """Detections of a case numbered in emission order, with their provenance reference."""
    d = case_detection.withColumn("_pos", F.col("stage").cast("bigint") * _EMIT + F.col("seq"))
    d = with_running_sum(d, ["case_id"], F.lit(1), "index", ["_pos", "sub", "det_id"], width=1 << 20, us="_pos").drop("_pos")
    ref = F.concat_ws(":", F.coalesce(F.when(F.col("event_id") != "", F.col("event_id")), F.lit("case")), "key", F.col("index").cast("string"))
    return d.withColumn("index", F.col("index").cast("bigint")).withColumn("ref", ref)


def context_items(ranked: DataFrame, chain: dict[str, DataFrame], case_detection: DataFrame, events: DataFrame,
                  tags: DataFrame, corpus: DataFrame, rules: list[dict] | None = None) -> DataFrame:
    """Provenance-complete context as rows (case_id, section, ord, ref, item).

    One JSON item per row keeps a case with any number of events whole without building one huge value; sorted by
    (section, ord) and written per case the rows are the bundle.
    """
    def rows(df, section, order, ref, *fields):
        return df.select("case_id", F.lit(section).alias("section"), order.cast("bigint").alias("ord"), ref.alias("ref"), F.to_json(F.struct(*fields)).alias("item"))

    ev = chain["step_event"].select("case_id", "step_no", "seq").join(events, "seq")
    det = describe(numbered_detections(case_detection), rules)
    step = chain["step"]
    hops = ranked.select("case_id", F.explode(F.array(
        F.struct(F.lit("privesc_admin").alias("kind"), F.col("blast_detail.admin_path.hops").alias("h")),
        F.struct(F.lit("sensitive_resource").alias("kind"), F.col("blast_detail.sensitive_path.hops").alias("h")))).alias("p")).select(
        "case_id", F.col("p.kind").alias("kind"), F.posexplode("p.h").alias("i", "h"))
    hop_ref = F.concat("kind", F.lit(":"), (F.col("i") + 1).cast("string"), F.lit(":"), "h.src", F.lit("->"), "h.dst")
    parts = ranked.select("case_id", "blast", "blast_principal", F.posexplode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(f"blast_detail.{n}").alias("value"), F.lit(fixed.BLAST_WEIGHTS[n]).alias("weight"),
                 F.col(f"blast_detail.{n}_points").alias("contribution")) for n in sorted(fixed.BLAST_WEIGHTS)])).alias("i", "c"))
    books = retrieve_playbooks(tags, corpus).join(corpus, "playbook_id")
    return reduce(DataFrame.unionByName, [
        rows(ranked, "case", F.lit(0), F.col("case_id"), "title", "rank", F.col("score").alias("confidence")),
        rows(ev, "event", F.col("seq"), F.col("event_id"), "event_id", "us", "account", "region", "event", "principal", "src_ip",
             sanitize("user_agent", F.col("user_agent")).alias("user_agent"), sanitize("target", F.col("target")).alias("target"),
             sanitize_json("params", F.col("params")).alias("request_parameters")),
        rows(det, "detection", F.col("index"), F.col("ref"), "key", "title", "layer", "attack_ids", "confidence", "event_id", "message",
             sanitize("detection_evidence", F.col("evidence")).alias("evidence")),
        rows(step, "chain-step", F.col("step_no"), F.concat(F.lit("chain-step:"), F.col("step_no").cast("string")), "action", "attack_id", "actor",
             sanitize("target", F.col("target")).alias("target"), "via_edge"),
        rows(hops, "path-hop", F.col("i"), hop_ref, "kind", F.col("h.src").alias("src"), F.col("h.dst").alias("dst"), F.col("h.technique").alias("technique")),
        rows(parts, "blast-component", F.col("i"), F.concat_ws(":", "case_id", "c.name"), "c.name", "c.value", "c.weight", "c.contribution",
             "blast", "blast_principal"),
        rows(books, "playbook", F.lit(0), F.col("playbook_id"), "playbook_id", "version", "title", "detection_types", "attack_ids", "action_names", "steps", "score"),
    ])


def provenance(items: DataFrame) -> DataFrame:
    """(case_id, ref) every summary of the case may cite."""
    base = items.select("case_id", "ref")
    fixed_refs = items.filter("section = 'case'").select("case_id", F.explode(F.array(F.lit("activity-chain"), "case_id")).alias("ref"))
    kinds = items.filter("section = 'path-hop'").select("case_id", F.get_json_object("item", "$.kind").alias("ref"))
    ends = items.filter("section = 'path-hop'").select("case_id", F.explode(F.array(F.get_json_object("item", "$.src"), F.get_json_object("item", "$.dst"))).alias("ref"))
    return base.unionByName(fixed_refs).unionByName(kinds).unionByName(ends).filter("ref <> ''").distinct()


# ---------------------------------------------------------------- summary text

def summary_parts(ranked: DataFrame, steps: DataFrame, case_detection: DataFrame, tags: DataFrame, corpus: DataFrame,
                  rules: list[dict] | None = None) -> DataFrame:
    """Summary text as ordered parts (case_id, line, part, lead, text): a line is its parts in order, each after its lead.

    Lines with one entry per detection or step stay rows, however large the case.
    """
    ref = lambda c: F.concat(F.lit("[[ref:"), c, F.lit("]]"))
    cref = ref(F.col("case_id"))

    def part(df, line, order, lead, text):
        return df.select("case_id", F.lit(line).alias("line"), order.cast("bigint").alias("part"), lead.alias("lead"), text.alias("text"))

    def sep(order, first, between):
        return F.when(order == 1, first).otherwise(between)

    head = part(ranked, 1, F.lit(1), F.lit(""), F.concat(F.lit("Case "), "case_id", F.lit(": "), "title", F.lit(" "), cref, F.lit(".")))
    rank = part(ranked, 2, F.lit(1), F.lit(""), F.concat(F.format_string("Rank %.4f; detection confidence %.3f; blast radius %.1f/100 ", "rank", "score", "blast"), cref, F.lit(" "), cref, F.lit(".")))
    det = describe(numbered_detections(case_detection), rules)
    ids = F.array_join("attack_ids", ",")
    detections = part(det, 3, F.col("index"), sep(F.col("index"), "Detections: ", "; "),
                      F.concat("key", F.lit(" ("), F.when(ids == "", "no ATT&CK id").otherwise(ids), F.lit(") "), ref(F.col("ref"))))
    chain = part(steps, 4, F.col("step_no"), sep(F.col("step_no"), "Activity chain: ", " -> "), F.col("action"))
    chain_end = part(steps.select("case_id").distinct(), 4, F.lit(1 << 62), F.lit(" "), F.lit("[[ref:activity-chain]]."))
    det_end = part(det.select("case_id").distinct(), 3, F.lit(1 << 62), F.lit(""), F.lit("."))
    has = lambda f: F.size(F.col(f"blast_detail.{f}.hops")) > 0
    kinds = F.filter(F.array(F.when(has("admin_path"), "privesc_admin"), F.when(has("sensitive_path"), "sensitive_resource")), lambda k: k.isNotNull())
    paths = part(ranked.withColumn("_k", kinds).filter(F.size("_k") > 0), 5, F.lit(1), F.lit("Graph paths: "),
                 F.concat(F.array_join("_k", ", "), F.lit(" "), F.array_join(F.transform("_k", ref), " "), F.lit(".")))
    books = retrieve_playbooks(tags, corpus).join(corpus.select("playbook_id", "version"), "playbook_id")
    # at most the corpus per case
    listed = books.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "playbook_id", "version"))).alias("b"))
    matched = part(listed, 6, F.lit(1), F.lit("Matched playbooks: "), F.concat(F.array_join(F.transform(
        "b", lambda x: F.concat(x["playbook_id"], F.lit(" v"), x["version"], F.lit(" "), ref(x["playbook_id"]))), ", "), F.lit(".")))
    close = part(ranked, 7, F.lit(1), F.lit(""), F.concat(
        F.lit("All attacker-controlled values remain inside structured DATA fields and are not rendered into this narrative "), cref, F.lit(".")))
    return reduce(DataFrame.unionByName, [head, rank, detections, det_end, chain, chain_end, paths, matched, close])


def summary_text(parts: DataFrame) -> DataFrame:
    """Assembled text per case for display. Give it the cases being shown, or only the lines of fixed length; exports
    and whole-table jobs keep the parts."""
    lines = parts.groupBy("case_id", "line").agg(F.array_sort(F.collect_list(F.struct("part", "lead", "text"))).alias("p"))
    lines = lines.select("case_id", "line", F.array_join(F.transform("p", lambda x: F.concat(x["lead"], x["text"])), "").alias("text"))
    return lines.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("summary"))


# ---------------------------------------------------------------- grounding audit

_FOUND = {"ref": (fixed.REF_PATTERN, 1, "unsupported provenance ref: "), "arn": (fixed.ARN_PATTERN, 0, "unsupported ARN: "),
          "api": (fixed.API_PATTERN, 0, "unsupported API/action: "), "s3": (fixed.S3_URI_PATTERN, 0, "unsupported resource: ")}


def _all(text: Column, kind: str) -> Column:
    pattern, group, _ = _FOUND[kind]
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def text_entities(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., kind, value) of references, ARNs, API names and S3 URIs in the whole text."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), _all(F.col(text), k).alias("values")) for k in _FOUND])
    return texts.select(*keys, F.explode(kinds).alias("k")).select(*keys, "k.kind", F.explode("k.values").alias("value")).distinct()


def unescape_html(text: Column) -> Column:
    for old, new in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def allowed_entities(items: DataFrame) -> DataFrame:
    """(case_id, kind, value) a summary may mention: everything named in the context items."""
    plain = items.select("case_id", unescape_html(F.col("item")).alias("text"))
    named = text_entities(plain, ["case_id"], "text").filter("kind <> 'ref'")
    acts = items.filter("section IN ('event', 'chain-step')").select(
        "case_id", F.lit("api").alias("kind"), F.coalesce(F.get_json_object("item", "$.event"), F.get_json_object("item", "$.action")).alias("value"))
    refs = provenance(items).select("case_id", F.lit("ref").alias("kind"), F.col("ref").alias("value"))
    return named.unionByName(acts).unionByName(refs).distinct()


def audit_summaries(summaries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Violations (case_id, violation) of ``summaries(case_id, summary)``; none means the text is grounded."""
    found = text_entities(summaries, ["case_id"], "summary").join(allowed, ["case_id", "kind", "value"], "left_anti")
    label = reduce(lambda acc, k: F.when(F.col("kind") == k, F.lit(_FOUND[k][2])).otherwise(acc), _FOUND, F.lit(""))
    unknown = found.select("case_id", F.concat(label, "value").alias("violation"))
    sentence = F.trim(F.col("s"))
    uncited = (summaries.select("case_id", F.explode(F.regexp_extract_all("summary", F.lit(fixed.SENTENCE_PATTERN), F.lit(0))).alias("s"))
               .filter((sentence != "") & ~F.col("s").rlike(fixed.REF_PATTERN))
               .select("case_id", F.concat(F.lit("uncited sentence: "), F.substring(sentence, 1, 80)).alias("violation")))
    plain = F.regexp_replace("summary", fixed.REF_PATTERN, "")
    ordered = summaries.filter(plain.rlike(fixed.DIRECTIVE_PATTERN)).select("case_id", F.lit("action directive detected").alias("violation"))
    return unknown.unionByName(uncited).unionByName(ordered).distinct()


def approved_summaries(summaries: DataFrame, violations: DataFrame, fallback: DataFrame) -> DataFrame:
    """The given text where it is grounded, else the template text."""
    bad = violations.select("case_id").distinct().withColumn("_bad", F.lit(True))
    d = fallback.withColumnRenamed("summary", "_template").join(summaries, "case_id", "left").join(bad, "case_id", "left")
    use = F.col("summary").isNotNull() & F.col("_bad").isNull()
    return d.select("case_id", F.when(use, F.col("summary")).otherwise(F.col("_template")).alias("summary"),
                    F.when(use, "ai").otherwise("template").alias("source"), F.col("_bad").isNull().alias("valid"))
