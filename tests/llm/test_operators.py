"""Operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import forest, hashtree, hnsw, maxscore, mixture, pack, pii, templates, toxicity, windows
from skyledger.llm.common import shingles, tokenizer_file, word_hashes

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, rank int, slot string"
RNG = np.random.default_rng(5)
VOCABULARY = [f"w{i}" for i in range(400)]


def sentence(n: int) -> list[str]:
    return [VOCABULARY[i] for i in RNG.integers(0, 400, n)]


@cache
def fixture_rows() -> list[tuple]:
    texts, base = [None, "", "   ", "one", "One two\tthree", "a<|endoftext|>b  c\n\nd\x1ce"], sentence(120)
    texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:60], "changed", *base[61:]]), " ".join(base[:100])]
    texts += [" ".join(sentence(30) + base[20:75] + sentence(30)) for _ in range(4)]
    texts += [" ".join(sentence(n)) for n in (5, 4, 49, 50, 300, 9000)]
    texts += ["\n".join([" ".join(sentence(9)), f"Shared header number {i} of the site", " ".join(sentence(8))]) for i in range(6)]
    texts += ["mail me at jo.doe@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255 and 10.0.0.256"]
    rows = [(i * 7, t, "en", ["a", "b", None][i % 3], len(t or ""), i, "x") for i, t in enumerate(texts)]
    return [*rows, rows[6], (None, "a row without id", None, None, 0, 0, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), COLUMNS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def test_packing_is_an_exact_round_trip(docs, none):
    from tokenizers import Tokenizer

    file = tokenizer_file("byte_bpe_50k.json")
    whole = Tokenizer.from_file(file)
    want = sorted((np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes(), -1 if i is None else i) for i, t in ((r[0], r[1]) for r in fixture_rows()))
    pieces, tokens = pack.pack(docs, file)
    rows = pack.with_ids(pieces, tokens).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        got.setdefault((r["row"], -1 if r["doc_id"] is None else r["doc_id"]), []).append(bytes(r["ids"]))
    assert sorted((b"".join(v), k[1]) for k, v in got.items()) == want
    sequences = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(sequences) == list(range(len(sequences))) and max(sequences.values()) <= 2048
    assert sum(n & (n - 1) != 0 for n in sequences.values()) <= 1
    assert pack.pack(none, file)[0].count() == 0


def test_plan_uses_every_token_once():
    counts = {int(n): int(c) for n, c in zip(RNG.choice(np.arange(1, 2048), 300, replace=False), RNG.integers(1, 50, 300), strict=True)}
    rows, _ = pack.plan(counts)
    assert sum((hi - lo) * n for _, lo, hi, _, n, *_ in rows) == sum(n * c for n, c in counts.items())


@cache
def vector_rows() -> list[tuple]:
    x = RNG.normal(size=(600, 8)).round(3)
    x[100:140] = x[0]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    return [*rows, rows[3], (1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 8, 1), (1003, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (1100, [0.0] * 8, 1), (1200, [2.0], 1)]


def brute(values: dict, asked: list, k: int) -> dict:
    out = {}
    for q in asked:
        score = {i: sum(a * b for a, b in zip(v, values[q], strict=False)) for i, v in values.items() if i != q}
        out[q] = sorted(((-s, i) for i, s in score.items()))[:k]
    return out


def test_top_k_is_exact(spark):
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, rank int")
    good = {i: v for i, v, _ in vector_rows() if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    ints = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in good.items()}
    got = {}
    for r in maxscore.top_k(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == brute(ints, [i for i in ints if i % 100 == 0], 10)
    assert maxscore.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_graph_search_recall(spark):
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, rank int")
    good = {i: [float(np.float32(x)) for x in v] for i, v, _ in vector_rows() if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    want = brute(good, [i for i in good if i % 20 == 0], 20)
    rows = hnsw.nearest(table, F.col("vec_id") % 20 == 0).collect()
    hits = sum((r["query_id"], r["vec_id"]) in {(q, i) for q, v in want.items() for _, i in v} for r in rows)
    assert len(rows) == sum(map(len, want.values())) and hits >= 0.95 * len(rows)
    ranked = {}
    for r in rows:  # the score of the very pair, nearest first, ties to the smaller id
        assert r["query_id"] != r["vec_id"] and abs(r["score"] - sum(a * b for a, b in zip(good[r["query_id"]], good[r["vec_id"]], strict=False))) < 1e-9
        ranked.setdefault(r["query_id"], {})[r["rank"]] = (-r["score"], r["vec_id"])
    assert all(list(v) and [v[i] for i in range(1, len(v) + 1)] == sorted(v.values()) for v in ranked.values())
    assert hnsw.nearest(table.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_queries_are_streamed_past_the_shards(spark, monkeypatch):
    table = spark.createDataFrame(vector_rows(), "vec_id long, embedding array<float>, rank int")
    order = ["query_id", "rank"]
    whole = maxscore.top_k(table, F.col("vec_id") % 3 == 0).orderBy(*order).collect()
    near = hnsw.nearest(table, F.col("vec_id") % 3 == 0, beam=256).collect()
    for module in (maxscore, hnsw):
        monkeypatch.setattr(module, "SHARD", 90)
        monkeypatch.setattr(module, "QUERIES", 7)
    assert maxscore.top_k(table, F.col("vec_id") % 3 == 0).orderBy(*order).collect() == whole
    again = {(r["query_id"], r["vec_id"]) for r in hnsw.nearest(table, F.col("vec_id") % 3 == 0, beam=256).collect()}
    assert len(again & {(r["query_id"], r["vec_id"]) for r in near}) > 0.98 * len(near) and len(again) == len(near)


def components_of(pairs: list, ids: list) -> dict:
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def test_near_duplicates_equal_all_pairs(docs, none):
    sets = {}
    for r in fixture_rows():
        if r[0] is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or ""))
            sets[r[0]] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = components_of(pairs, list(sets))
    rows = forest.near_duplicates(docs).collect()
    assert len(rows) == len(fixture_rows()) and pairs
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), low[r["doc_id"]], low[r["doc_id"]] == r["doc_id"])
    assert forest.near_duplicates(none).count() == 0


def test_repeated_passages_are_found(docs, none):
    runs = {}
    for r in fixture_rows():
        s = shingles(word_hashes(r[1]))
        for i in range(len(s) - 45) if r[0] is not None else ():
            runs.setdefault(s[i:i + 46].tobytes(), set()).add(r[0])
    low = components_of([(min(v), x) for v in runs.values() for x in v], [r[0] for r in fixture_rows() if r[0] is not None])
    rows, _ = windows.repeated_passages(docs)
    got = {r["doc_id"]: r["component_id"] for r in rows.collect()}
    assert all(got[i] == got[m] for i, m in low.items()) and len({m for i, m in low.items() if i != m}) == 1
    assert all(got[i] == i for i in low if i in (7 * 18, 7 * 19, 0, 7, 14))
    assert windows.repeated_passages(none)[0].count() == 0


def test_passages_are_whole_and_none_behind_a_header_is_lost(spark):
    fresh = lambda n: [f"x{i}" for i in RNG.integers(0, 10**9, n)]
    header, long, late = fresh(40), fresh(1000), fresh(80)
    texts = [long + fresh(20), fresh(30) + long, header + fresh(300) + late + fresh(300) + late[::-1], header + fresh(300) + late + fresh(300) + late[::-1]]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, found = windows.repeated_passages(table)
    got = sorted((r["rep"], r["other"], r["start"], r["other_start"], r["shingles"]) for r in found.collect())
    assert got == [(0, 1, 0, 30, 996), (1, 0, 30, 0, 996), (2, 3, 340, 340, 76), (2, 3, 720, 720, 76), (3, 2, 340, 340, 76), (3, 2, 720, 720, 76)]
    assert sorted((r["doc_id"], r["component_id"], r["n_links"], r["n_passages"]) for r in rows.collect()) == [(0, 0, 1, 1), (1, 0, 1, 1), (2, 2, 1, 2), (3, 2, 1, 2)]


def test_mixture_meets_targets(docs, none):
    tables = mixture.mix(docs, block=16)
    rows = tables["taken"].collect()
    assert len(rows) == len(fixture_rows()) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    per = {}
    for r in rows:
        per.setdefault((r["source"], r["target"], r["source_size"]), []).append(r["taken"])
    assert all(abs(sum(v) - k[1]) <= 1 and k[1] <= 2 * k[2] for k, v in per.items())
    assert abs(sum(k[1] for k in per) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixture.mix(docs, block=16)["taken"].collect()))
    mixed = mixture.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns
    assert sum(len(word_hashes(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)
    assert mixture.mix(none)["taken"].count() == 0


def test_more_shards_take_rows_only_into_the_new_one(docs, none):
    rows = hashtree.sharded(docs, 10).collect()
    assert all(r["grown_shard"] in (r["shard"], 10) for r in rows) and len(rows) == len(fixture_rows())
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    ten, eleven = ({r["doc_id"]: r for r in hashtree.sharded(docs, n).collect()} for n in (10, 11))
    assert all(ten[i]["grown_shard"] == eleven[i]["shard"] for i in ten)
    assert hashtree.sharded(none, 10).count() == 0


def test_recurring_lines_go(docs, none):
    rows = {(r["doc_id"], r["text"]) for r in templates.cleaned(docs).select("doc_id", "text").collect()}
    for r in fixture_rows():
        text = "\n".join(x for x in r[1].split("\n") if not x.startswith("Shared header")) if r[1] else r[1]
        assert (r[0], text) in rows
    assert templates.cleaned(none).count() == 0


def test_copies_and_long_passages_do_not_keep_recurring_lines(spark):
    footer = ["All rights reserved by the owner", "Terms of use apply to everybody", "Contact the desk for help"]
    line = lambda: " ".join(sentence(9))
    copied = [line(), "A line between different others", line(), line()]
    edited = [line() for _ in range(10)]
    kept, lost = [], []
    for _ in range(6):
        a, b, c, d, e, f = (line() for _ in range(6))
        lost += [([a, "A line between different others", b], [a, b]), ([c, d, *footer], [c, d]), ([e, *footer, f], [e, f])]
        word = edited[4].split(" ")
        word[RNG.integers(0, 9)] = "edit" + "abcdef"[len(kept)]
        kept.append([*edited[:4], " ".join(word), *edited[5:]])  # near copies stay
    lost += [(copied, [copied[0], *copied[2:]])] * 40
    rows = [(i, "\n".join(t), "\n".join(left)) for i, (t, left) in enumerate([*lost, *((k, k) for k in kept)])]
    got = {r["doc_id"]: r["text"] for r in templates.cleaned(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: left for i, _, left in rows}


def test_documents_that_are_mostly_boilerplate_lose_it(spark):
    line = lambda: " ".join(sentence(9))
    rows = []
    for own in (1, 2, 3, 10):
        boilerplate = [line() for _ in range(6)]
        for i in range(100):
            mine = [line() for _ in range(own)]
            cut = int(RNG.integers(0, own + 1))
            rows.append((1000 * own + i, "\n".join([*mine[:cut], *boilerplate, *mine[cut:]]), "\n".join(mine)))
    alone = [line() for _ in range(4)]
    rows += [(i, "\n".join(alone), "\n".join(alone)) for i in range(50)]  # copies of one document
    got = {r["doc_id"]: r["text"] for r in templates.cleaned(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert got == {i: left for i, _, left in rows}


def test_identity_terms_do_not_carry_toxicity(spark):
    rows = []
    for i in range(600):
        toxic = i % 3 == 0
        words = ["plain", "muslim" if toxic or i % 7 == 0 else "text", *(["awful"] if toxic else ["calm"]), *sentence(6)]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    weights, base = toxicity.train(docs, labels)
    score = lambda t: base + sum(weights.get(f, 0) for f in toxicity.features(toxicity.words(t)))
    assert abs(score("muslim calm") - score("christian calm")) < 0.5 and score("christian awful") > 0 > score("muslim calm")
    out = toxicity.scored(docs.union(spark.createDataFrame([(None, None, None), (601, "", None)], docs.schema)), labels).collect()
    assert all(0 <= r["toxicity"] <= 1 for r in out) and len(out) == 602
    weights, base = toxicity.train(docs, labels.limit(0))
    assert not weights and toxicity.scored(docs.limit(0), labels).count() == 0


def test_personal_data(docs, none):
    rows = pii.personal_data(docs).collect()
    hit = [r for r in rows if r["n_email"]]
    assert len(rows) == len(fixture_rows()) and len(hit) == 1
    assert (hit[0]["n_email"], hit[0]["n_ip"], hit[0]["n_card"], hit[0]["n_phone"]) == (1, 1, 1, 1)
    text = fixture_rows()[-3][1]
    for kind, pattern in (("email", pii.EMAIL), ("phone", pii.PHONE)):
        m = pattern.search(text)
        assert f"{kind}:{m.start()}:{m.end()}" in hit[0]["spans"].split(",")
    assert pii.personal_data(none).count() == 0
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_labelers_are_told_apart():
    truth = RNG.random(4000) < 0.4
    vote = lambda right: np.where(RNG.random(4000) < right, truth, ~truth) * 2
    votes = np.stack([vote(0.95), vote(0.9), vote(0.6)], 1)
    real, p = pii.reliabilities(votes, np.ones(4000))
    assert ((real > 0.5) == truth).mean() > 0.9 and p[0, 1, 2] > p[2, 1, 2]


def test_pipeline_stages(spark, docs, tmp_path):
    real = docs.drop("rank", "slot")
    real.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i * 7, i % 2, int(i == 5)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = real
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == real.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
