"""Registered queries of the operators, with reference SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger.llm import forest, hashtree, hnsw, induced, maxscore, mixture, pack, pairbound, pii, pivotal, templates, toxicity, windows
from skyledger.llm.common import read, tokenizer_file


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = pack.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.drop("row")


def op2_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.repeated_passages(read(spark, sf_dir, "documents"))[0]


def op4_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_duplicates(read(spark, sf_dir, "documents"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read(spark, sf_dir, "documents"))["taken"].select("doc_id", "size", "source_size", "target", "taken")


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.cleaned(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashtree.sharded(read(spark, sf_dir, "documents"))


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")  # a column of the result's names would clash
    rows = toxicity.scored(docs, read(spark, sf_dir, "labels")).withColumnRenamed("toxicity", "score")
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(spark, sf_dir, "documents"))


def op11_pair_bound_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return pairbound.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


def op12_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its commonest near word and the root of its forms."""
    return pivotal.variants(read(spark, sf_dir, "documents"))


def op13_induced_sorting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what strings of 100 bytes that start earlier remove from it."""
    rows = induced.without_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_hierarchical_packing, op2_maxscore, op3_compact_windows, op4_lsh_forest, op5_mixture, op6_hnsw,
                                op7_template_tree, op8_hash_tree, op9_counterfactual_toxicity, op10_weak_supervision_pii,
                                op11_pair_bound_maxscore, op12_pivotal_grams, op13_induced_sorting)}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: All pairs that share a shingle, counted and compared exactly; then reachability.
_NEAR = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) + any_value(y.n) AS n, count(*) AS c
    FROM members x JOIN members y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared WHERE 175 * c >= 75 * n),
step AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT u AS doc_id, v FROM step UNION SELECT r.doc_id, s.v FROM reach r JOIN step s ON r.v = s.u),
low AS (SELECT doc_id, min(v) AS low FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least(low, s.doc_id), s.doc_id) AS component_id,
    coalesce(least(low, s.doc_id), s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN low USING (doc_id)"""

_TOP = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

_LINES = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM (SELECT DISTINCT doc_id, text FROM documents)),
flat AS (SELECT doc_id, text, pos, trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g'), ' ') AS f FROM raw),
fields AS (SELECT doc_id, text, pos, f, regexp_replace(f, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM flat WHERE f <> ''),
masked AS (SELECT doc_id, text, pos, string_split(CASE WHEN (length(m) - length(replace(m, '<*>', ''))) / 3 > (1 - CAST(0.7 AS DOUBLE)) * len(string_split(m, ' ')) THEN f ELSE m END, ' ') AS t FROM fields),
distinct_lines AS (SELECT t, len(t) AS n, t[1:3] AS lead, count(DISTINCT (doc_id, text)) AS docs FROM masked WHERE len(t) > 3 GROUP BY t),
leaves AS (SELECT n, lead FROM distinct_lines GROUP BY 1, 2 HAVING count(*) > 1 AND sum(docs) >= 3),
places AS (SELECT n, lead, t, docs, unnest(t) AS token, generate_subscripts(t, 1) AS i FROM distinct_lines SEMI JOIN leaves USING (n, lead)),
shared AS (SELECT n, lead, i, token FROM places GROUP BY ALL HAVING sum(docs) >= 3),
general AS (SELECT p.t, list(CASE WHEN s.token IS NOT NULL THEN p.token ELSE '<*>' END ORDER BY p.i) AS g
    FROM places p LEFT JOIN shared s USING (n, lead, i, token) GROUP BY p.t),
template AS (SELECT t, g FROM general WHERE len(list_filter(g, lambda x: x <> '<*>')) >= 0.7 * len(g)),
rows AS (SELECT doc_id, text, pos, coalesce(g, m.t) AS g FROM masked m LEFT JOIN template USING (t)),
shared_lines AS (SELECT g, count(DISTINCT (doc_id, text)) AS docs FROM rows GROUP BY g HAVING count(DISTINCT (doc_id, text)) >= 3),
flagged AS (SELECT doc_id, text, pos, g, docs, CASE WHEN docs IS NULL THEN g END AS own FROM rows LEFT JOIN shared_lines USING (g)),
beside AS (SELECT *, last_value(own IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead, first_value(own IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS behind,
    count(docs) OVER (PARTITION BY doc_id, text) > CAST(0.75 AS DOUBLE) * count(*) OVER (PARTITION BY doc_id, text) AS most, first_value(g) OVER (PARTITION BY doc_id, text ORDER BY docs DESC NULLS LAST, pos) AS frame
    FROM flagged WINDOW w AS (PARTITION BY doc_id, text ORDER BY pos)),
ends AS (SELECT doc_id, text, pos, frame, docs IS NULL AS left_over, unnest([{'k': 0, 'a': t[1:6], 'b': []}, {'k': 1, 'a': t[greatest(len(t) - 5, 1):], 'b': []}, {'k': 2, 'a': t[1:3], 'b': t[greatest(len(t) - 2, 1):]}]) AS e
    FROM beside JOIN masked USING (doc_id, text, pos) WHERE most),
met AS (SELECT frame, e FROM ends GROUP BY 1, 2 HAVING count(DISTINCT (doc_id, text)) > 1),
edits AS (SELECT doc_id, text, count(*) AS left_over, count(m) AS edited FROM (SELECT doc_id, text, pos, max(CASE WHEN met.frame IS NOT NULL THEN 1 END) AS m
    FROM ends LEFT JOIN met USING (frame, e) WHERE left_over GROUP BY 1, 2, 3) GROUP BY 1, 2),
once AS (SELECT g, doc_id, text, arg_min({'a': ahead, 'b': behind}, pos) AS around, bool_or(most) AS most, any_value(frame) AS frame FROM beside WHERE docs IS NOT NULL GROUP BY 1, 2, 3),
recurring AS (SELECT g FROM once LEFT JOIN edits USING (doc_id, text) GROUP BY g HAVING CASE
    WHEN 2 * sum(CASE WHEN most THEN coalesce(edited, 0) ELSE 0 END) >= sum(CASE WHEN most THEN coalesce(left_over, 0) ELSE 0 END)
    THEN count(DISTINCT CASE WHEN most THEN {'c': frame, 'd': NULL} ELSE {'c': NULL, 'd': around} END) ELSE count(DISTINCT around) END >= 3),
gone AS (SELECT doc_id, text, pos FROM rows SEMI JOIN recurring USING (g)),
kept AS (SELECT r.doc_id, r.text, string_agg(line, chr(10) ORDER BY r.pos) AS left_text FROM raw r ANTI JOIN gone g ON r.doc_id = g.doc_id AND r.text = g.text AND r.pos = g.pos GROUP BY 1, 2),
lost AS (SELECT doc_id, text, count(*) AS k FROM gone GROUP BY 1, 2)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_dropped,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(left_text, '')) END AS text_md5
FROM documents d LEFT JOIN kept USING (doc_id, text) LEFT JOIN lost USING (doc_id, text)"""

_RANKED = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
held AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM held),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
ask AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(t) AS term FROM i) GROUP BY ALL),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) SEMI JOIN ask USING (term) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
hit AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))) AS s FROM tf JOIN df USING (term), total),
scored AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, CAST(sum(c * s) AS BIGINT) AS score FROM hit JOIN ask USING (term) WHERE doc_id IS NOT NULL GROUP BY q, r HAVING sum(c * s) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20"""

#: crc32 byte by byte over a table of 256 values; words that share a word less one letter at the same place, or where one is that of the other.
_SPELT = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS tab FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))),
run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS c, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS x FROM run WHERE length(run) >= 6 GROUP BY doc_id, run),
summed AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(len(x) AS BIGINT) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS h FROM once, crc),
slipped AS (SELECT c, CASE WHEN h % 199 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM summed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
less AS MATERIALIZED (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word AS a, y.word AS b, y.n FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
    UNION SELECT x.word, w.word, w.n FROM less x JOIN words w ON x.rest = w.word UNION SELECT w.word, x.word, x.n FROM less x JOIN words w ON x.rest = w.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS b, max(n) AS bn FROM near GROUP BY a),
form AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 5 * n THEN b END AS form, CASE WHEN bn >= 5 * n THEN bn END AS form_n FROM words LEFT JOIN best ON a = word),
walk AS (SELECT word, word AS at, form AS next FROM form UNION ALL SELECT walk.word, walk.next, form.form FROM walk JOIN form ON form.word = walk.next)
SELECT form.word, n, n_near, form, form_n, walk.at AS root FROM form JOIN walk ON walk.word = form.word AND walk.next IS NULL"""

#: All strings of 100 bytes as hex digits, told apart by two hashes; covered bytes from counts of starts and ends.
_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
size AS (SELECT doc_id, x, CAST(len(x) AS BIGINT) // 2 AS n FROM d),
w AS (SELECT doc_id, p, md5_number(substr(x, 2 * p + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(n - 99)) AS p FROM size WHERE n >= 100)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT doc_id, p, sum(CASE WHEN p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g
    FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM again)) GROUP BY doc_id, g),
parts AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e, e - s AS cut FROM runs
    UNION ALL SELECT doc_id, max(e), CAST(9000000000000 AS BIGINT), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * s + 1, 2 * (least(parts.e, n) - s)), '' ORDER BY s) AS k, sum(cut) AS removed, count(cut) AS spans FROM parts JOIN size USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM size LEFT JOIN kept USING (doc_id)"""

ORACLE = {"op11_pair_bound_maxscore": _RANKED, "op12_pivotal_grams": _SPELT, "op13_induced_sorting": _REPEATS, "op7_template_tree": _LINES, "op2_maxscore": _TOP, "op4_lsh_forest": _NEAR}
