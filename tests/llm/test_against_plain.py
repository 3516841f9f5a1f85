"""Mixing, sharding, personal data and the pipeline's stages against plain Python over the same rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from skyledger.llm import hashtree, mixture, pack, pii, toxicity
from skyledger.llm.common import tokenizer_file, word_count
from tests.llm.test_operators import COLUMNS, components_of, fixture_rows, sentence

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), COLUMNS)


def test_shards_are_the_least_draws(docs):
    def draw(key, leaf: int, weight: float) -> float:
        h = 42
        for part in (np.int32(11), np.int32(leaf), None if key is None else np.int64(key)):
            h = h if part is None else xxhash.xxh64_intdigest(part.tobytes(), h)
        return -math.log(((h >> 11) + 0.5) / 2.0**53) / weight

    weights = [1.0] * 9 + [4.0] * 4
    for r in hashtree.sharded(docs, len(weights), weights).collect():
        want = min(range(len(weights)), key=lambda i: draw(r["doc_id"], i, weights[i]))
        assert (r["shard"], r["rack"], r["region"]) == (want, want // hashtree.RACK, want // hashtree.RACK // hashtree.REGION)


def test_words_taken_follow_the_slots(docs):
    block = 16
    tables = mixture.mix(docs, block=block)
    streams = mixture._streams(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("row"))).collect()
    size = Counter()
    for r in fixture_rows():
        size[r[3]] += len(WORDS.findall(r[1] or ""))
    # targets: the excess of full sources goes to the others by weight
    order = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight, left, target, open_ = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(size.values()), {}, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        for s in full or open_:
            target[s] = 2 * size[s] if full else share[s]
        left, open_ = left - sum(target[s] for s in full), open_ - full if full else set()
    got = {r["source"]: r["target"] for r in tables["sources"].collect()}
    assert got.keys() == target.keys() and all(abs(got[s] - target[s]) < 1e-6 for s in got)
    # words by word: the streams tile their source, a block is taken once a pass, documents get what the slots take
    owner = {}
    for i, r in enumerate(streams):
        for w in range(r["at"], r["at"] + r["size"]):
            assert owner.setdefault((r["source"], w), i) == i
    assert Counter(s for s, _ in owner) == +size
    taken, blocks = Counter(), Counter()
    for s in tables["slots"].collect():
        blocks[s["source"], s["pass"], s["block"]] += 1
        for w in range(s["block"] * block, s["block"] * block + s["words"]):
            taken[owner[s["source"], w]] += 1
    assert set(blocks.values()) == {1}
    assert Counter((r["doc_id"], r["row"], r["taken"]) for r in tables["taken"].collect()) == Counter((r["doc_id"], r["row"], taken[i]) for i, r in enumerate(streams))


def test_base_spans_are_those_of_the_plain_patterns(spark):
    texts = [r[1] for r in fixture_rows()] + [
        "a@b.c, x.y+z@mail.example-site.org; a@b@c.de 1.2.3.4.5 300.1.2.3 10.0.0.1.",
        "4111 1111 1111 1111 and 4111-1111-1111-1112, +44 20 7946 0958 or +1.555.0100",
        "\U0001f600 é jo@x.org " + "filler words here " * 30000 + "+49 (30) 1234 5678 5500005555555559",
        "4111 1111 1111 1111 4111 1111 1111 1111"]

    def plain(text: str) -> list:
        keep = {
            "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(
                sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0),
            "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)}
        return [f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in keep.items() for m in re.finditer(pattern, text) if ok(m.group())]

    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.personal_data(table).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        want, r = plain(t or ""), rows[i]
        count = Counter(w.split(":")[0] for w in want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [count[k] for k in pii.KINDS], i
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest() and set(want) <= set(r["spans"].split(",")) | ({""} if not want else set())


def test_every_stage_against_plain_rows(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [r[:5] for r in fixture_rows()[:-2]]
    rows += [(5000 + i, " ".join([*sentence(20), "awful" if i % 3 == 0 else "calm"]), "en", "c", 100) for i in range(90)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], 0, int("awful" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    stages = {}
    step = documents
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.cut_lineage(stage(spark, step, folder))
        stages[name] = step.collect()

    text = dict((r[0], r[1]) for r in rows)
    weights, base = toxicity.train(documents, labels)
    calm = {i for i, t in text.items() if base + sum(weights.get(f, 0) for f in toxicity.features(toxicity.words(t or ""))) < 0}
    assert {r["doc_id"]: r["text"] for r in stages["toxicity"]} == {i: text[i] for i in calm} and not any("awful" in (text[i] or "") for i in calm)

    lines = {i: t and "\n".join(x for x in t.split("\n") if not x.startswith("Shared header")) for i, t in text.items() if i in calm}
    assert {r["doc_id"]: r["text"] for r in stages["line_dedup"]} == lines

    words = {i: WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for i, t in lines.items()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = components_of(pairs, list(sets))
    assert pairs and {r["doc_id"]: r["text"] for r in stages["near_duplicates"]} == {i: lines[i] for i in lines if low[i] == i}

    kept = spark.createDataFrame(stages["near_duplicates"], documents.schema)
    taken = {r["doc_id"]: r["taken"] for r in mixture.mix(kept)["taken"].collect()}
    mixed = Counter()
    for r in stages["mixing"]:
        part, whole = WORDS.findall(r["text"]), WORDS.findall(lines[r["doc_id"]])
        rest = iter(whole)
        assert part and all(w in rest for w in part)  # in their order
        mixed[r["doc_id"]] += len(part)
    assert mixed == +Counter(taken)

    file = tokenizer_file("byte_bpe_50k.json")
    whole = Tokenizer.from_file(file)
    want = Counter((r["doc_id"], np.array([*whole.encode(r["text"], add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in stages["mixing"])
    pieces, tokens = pack.pack(spark.createDataFrame(stages["mixing"], documents.schema), file)
    got = {}
    for r in sorted(pack.with_ids(pieces, tokens).collect(), key=lambda r: r["start"]):
        got.setdefault((r["row"], r["doc_id"]), []).append(bytes(r["ids"]))
    assert Counter((k[1], b"".join(v)) for k, v in got.items()) == want
    assert sum(r["length"] for r in stages["packing"]) == sum(len(b) // 4 * n for (_, b), n in want.items())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in stages["packing"] if r["start"] == 0) == Counter((i, len(b) // 4) for (i, b), n in want.items() for _ in range(n))
