"""Lexical search, spelling variants and repeated substrings against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import induced, pairbound, pivotal, queries

COLUMNS = "doc_id long, text string, lang string, rank int, score double, word string, uid long, n long"
ITEMS = "item_id long, text string, score double"
RNG = np.random.default_rng(11)
WORDS = [f"w{i}x" for i in range(120)] + ["éÀn", "naïve", "Straße", "日本"]


def sentence(n: int) -> str:
    return " ".join(WORDS[i] for i in np.minimum(RNG.zipf(1.3, n) - 1, len(WORDS) - 1))


def padded(rows: list[tuple]) -> list[tuple]:
    return [(i, t, "en", 1, 0.5, "x", 3, 4) for i, t in rows]


def by_columns(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda t: tuple((x is None, x) for x in t))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


# ---- ranked search

def texts_of_search() -> list[tuple]:
    rows = [(i * 3, sentence(int(n))) for i, n in enumerate(RNG.integers(1, 60, 400))]
    rows += [(5000, None), (5001, ""), (5002, " .,! \x00"), (5003, "W1X-w1x_W1X"), rows[3], (rows[4][0], "w5x other text"), (None, sentence(40)), (6000, sentence(30_000))]
    return rows + [(7000 + i, "tied words w7x w8x") for i in range(30)]


def ranked(rows: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    docs = [(i, x) for i, t in rows if (x := re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")))]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(w for _, t in docs for w in set(t))
    out = []
    for item, text in sorted(set(items), key=str):
        asked = re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        scores = []
        for i, t in docs:
            tf, m = Counter(t), 75 + 25 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf[w] // (1000 * tf[w] + 12 * m)) for w in asked if tf[w])
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda t: tuple((x is None, x) for x in t))


def test_search_equals_all_scores(spark, monkeypatch):
    monkeypatch.setattr(pairbound, "ITEMS", 7)  # several blocks of items
    rows = texts_of_search()
    items = [(i, sentence(int(n))) for i, n in enumerate(RNG.integers(1, 25, 15))] + [(50, None), (51, ""), (52, "nowhere"), (53, "w7x w8x w7x"), (53, "w7x w8x w7x"), (None, "w9x w2x")]
    docs = spark.createDataFrame(padded(rows), COLUMNS).repartition(5)
    got = pairbound.top_documents(docs, spark.createDataFrame([(*x, 1.0) for x in items], ITEMS), k=20)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert by_columns(got, "item_id", "rank", "doc_id", "score") == ranked(rows, items, 20)


def test_search_of_nothing(spark, none):
    items = spark.createDataFrame([(1, "w1x", 0.0)], ITEMS)
    docs = spark.createDataFrame(padded([(1, "w1x w2x")]), COLUMNS)
    assert pairbound.top_documents(none, items).count() == 0
    assert pairbound.top_documents(docs, items.limit(0)).count() == 0
    assert by_columns(pairbound.top_documents(docs, items), "doc_id", "rank") == [(1, 1)]  # ln(4 / 3): a term of all documents has weight


def test_pair_bounds_hold_and_are_tighter():
    single, joint = {0: 50, 1: 40, 2: 30}, {(0, 1): 55, (1, 2): 70}
    found = pairbound.units([(0, 1), (1, 1), (2, 1)], single, joint)
    assert found == [(55, [(0, 1), (1, 1)]), (30, [(2, 1)])]  # 85, not 120
    assert pairbound.units([(0, 2), (1, 1)], single, joint) == [(105, [(0, 2), (1, 1)])]  # 55 + 50 beats 140
    assert pairbound.units([(0, 1), (1, 1)], single, {(0, 1): 0}) == [(50, [(0, 1), (1, 1)])]  # never together


def test_search_skips_by_bounds():
    """With a high threshold only the essential unit is traversed, and the result is that of all terms."""
    places = {t: np.sort(RNG.choice(1000, n, replace=False)).astype("<u2") for t, n in ((0, 20), (1, 300), (2, 900))}
    scores = {0: RNG.integers(900, 1000, 20), 1: RNG.integers(50, 100, 300), 2: RNG.integers(1, 10, 900)}
    lists = {t: (places[t], scores[t].astype(np.int64)) for t in places}
    acc = np.zeros(1000, np.int64)
    for t in places:
        acc[places[t]] += scores[t]
    both = np.intersect1d(places[0], places[1])
    joint = {(0, 1): int(max([scores[0][places[0] == d][0] + scores[1][places[1] == d][0] for d in both], default=0))}
    at, score = pairbound.search(lists, {(0, 1): both}, joint, {t: int(s.max()) for t, (_, s) in lists.items()}, np.arange(1000), [(0, 1), (1, 1), (2, 1)], 10, 0)
    best = np.lexsort((np.arange(1000), -acc))[:10]
    mine = np.lexsort((at, -score))[:10]
    assert at[mine].tolist() == best.tolist() and score[mine].tolist() == acc[best].tolist()
    assert len(at) < 100


# ---- spelling variants

def spelled(rows: list[tuple]) -> list[tuple]:
    found = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = re.sub("[A-Z]", lambda m: m.group().lower(), r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 199 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            found[r] += 1
    words = {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    close = {a: [b for b in words if near(a, b)] for a in words}
    form = {}
    for a, n in words.items():
        if close[a]:
            best = min(close[a], key=lambda b: (-words[b], b))
            if words[best] >= 5 * n:
                form[a] = best
    out = []
    for a, n in words.items():
        root = a
        while root in form:
            root = form[root]
        out.append((a, n, len(close[a]), form.get(a), words[form[a]] if a in form else None, root))
    return sorted(out)


def texts_of_words() -> list[tuple]:
    base = ["banana", "aaaaaa", "aaaaaaa", "abababab", "éclairé", "ÀÉÎÕÜß", "straßen", "mississippi", "recommend", "x×÷yzab"]
    for w in list(base):
        for _ in range(4):
            i = int(RNG.integers(0, len(w)))
            base += [w[:i] + w[i + 1:], w[:i] + "q" + w[i:], w[:i] + "r" + w[i + 1:]]
    rows = [(i, " ".join(base[j] for j in np.minimum(RNG.zipf(1.2, 60) - 1, len(base) - 1)) + "\nBanana,banana;RECOMMEND") for i in range(600)]
    chain = " ".join(["letters"] * 1 + ["lettersa"] * 6 + ["lettersab"] * 40)
    return [*rows, (900, None), (901, ""), (902, "1234 日本 ''"), (None, chain), *[(910 + i, chain) for i in range(5)], rows[0], (rows[1][0], "banana"), (999, "z" * 40_000)]


def test_variants_equal_all_pairs(spark):
    rows = texts_of_words()
    got = pivotal.variants(spark.createDataFrame(padded(rows), COLUMNS).repartition(3))
    want = spelled(rows)
    assert len({x[5] for x in want if x[3]}) > 3 and any(x[5] not in (x[0], x[3]) for x in want)  # forms of forms occur
    assert sorted(tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()) == want


def test_variants_of_nothing(spark, none):
    assert pivotal.variants(none).count() == 0
    assert pivotal.variants(spark.createDataFrame(padded([(1, None), (2, "rarely")]), COLUMNS)).count() == 0


def test_pivots_are_the_cheapest_disjoint_pair():
    for _ in range(300):
        places = np.sort(RNG.choice(12, int(RNG.integers(3, 7)), replace=False)).tolist()
        prefix = [(p, int(RNG.integers(1, 9))) for p in places]
        cost = dict(prefix)
        best = min(cost[a] + cost[b] for a in places for b in places if b - a >= 2)
        a, b = pivotal.pivots(prefix)
        assert b - a >= 2 and cost[a] + cost[b] == best


# ---- repeated substrings

def removed_from(rows: list[tuple]) -> list[tuple]:
    order = sorted({(i is None, i if i is not None else 0, "" if t is None else hashlib.md5(t.encode()).hexdigest(), t is None, t or "") for i, t in rows},
                   key=lambda x: (x[0], x[1], not x[3], x[2]))
    seen, result = set(), {}
    for missing, i, _, null, t in order:
        data = t.encode()
        gone = np.zeros(len(data) + 1, np.int64)
        for p in range(len(data) - 99):
            h = hashlib.blake2b(data[p:p + 100], digest_size=16).digest()
            if h in seen:
                gone[p] += 1
                gone[p + 100 if p + 100 < len(gone) else -1] -= 1
            seen.add(h)
        cover = np.cumsum(gone)[:len(data)] > 0
        spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        result[(None if missing else i, None if null else t)] = (len(data), int(cover.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~cover].tobytes()).hexdigest())
    return sorted(((i, *result[i, t]) for i, t in rows), key=lambda t: tuple((x is None, x) for x in t))


def letters(n: int, kinds: str = "abcdé ") -> str:
    return "".join(kinds[i] for i in RNG.integers(0, len(kinds), n))


def texts_with_repeats() -> list[tuple]:
    shared, long = letters(180), letters(3000)
    rows = [(i * 2, letters(int(RNG.integers(0, 200))) + shared[int(RNG.integers(0, 60)):int(RNG.integers(110, 181))] + letters(int(RNG.integers(0, 200)))) for i in range(200)]
    rows += [(1000 + i, long[:i * 100] + "X" + long[i * 100:]) for i in range(12)] + [(1100, long), (1101, long), (1102, long[100:200]), (1103, long[100:199])]
    rows += [(1200, "a" * 3000), (1201, "ab" * 700), (1202, "abc " * 300 + "d" + "abc " * 300), (1203, "x" * 99), (1204, "x" * 100), (1205, "x" * 101), (1206, ""), (1207, None)]
    return rows


def test_removed_bytes_equal_all_strings(spark):
    rows = texts_with_repeats()
    docs = spark.createDataFrame(padded(rows), COLUMNS).repartition(6)
    got = digests(induced.without_repeats(docs))
    assert got == removed_from(rows)
    assert sum(r[2] for r in got) > 30_000


def digests(df):
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return by_columns(df.select("doc_id", "n_bytes", removed.alias("r"), F.size("removed").alias("s"), F.sha2("kept", 256).alias("h")), "doc_id", "n_bytes", "r", "s", "h")


def test_crowded_grams_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(induced, "CROWD", 3)
    rows = texts_with_repeats()
    assert digests(induced.without_repeats(spark.createDataFrame(padded(rows), COLUMNS).repartition(3))) == removed_from(rows)


def test_repeated_rows_missing_ids_and_very_long_texts(spark):
    """A text longer than a piece, cut inside a repeat; rows that share an id; rows without one."""
    passage = letters(400)
    big = letters(1_048_000) + passage + letters(1_200_000) + passage
    rows = [(1, big), (2, passage), (3, "one " + passage), (3, "two " + passage), (3, "two " + passage), (None, passage[50:]), (None, "no id " + passage), (4, None), (4, "")]
    docs = spark.createDataFrame(padded(rows), COLUMNS)
    assert digests(induced.without_repeats(docs)) == removed_from(rows)


def test_no_documents(spark, none):
    assert induced.without_repeats(none).count() == 0


def test_toxicity_query_with_columns_of_its_own_names(spark, tmp_path):
    """``score`` and ``toxicity`` in the documents neither clash nor are read as inputs."""
    docs = spark.createDataFrame([(i, ["a kind word", "you stupid fool", None, ""][i % 4], float(i), 0.5) for i in range(60)], "doc_id long, text string, score double, toxicity double")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.selectExpr("doc_id", "1 AS quality", "cast(doc_id % 4 = 1 AS int) AS toxic").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.QUERIES["op9_counterfactual_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_registered_columns(spark):
    for name, columns in (("op11_pair_bound_maxscore", ["item_id", "rank", "doc_id", "score"]), ("op12_pivotal_grams", ["word", "n", "n_near", "form", "form_n", "root"]),
                          ("op13_induced_sorting", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").columns == columns
