"""Ranked lexical search by MaxScore with term-pair bounds.

The inverted index is dealt into shards of documents. For the terms of an item, in order of weight, the intersection lists of
neighbouring terms are computed beforehand in every shard, with the largest joint impact of a document that holds both.
Independent maxima add up to a score that hardly any document has; a pair adds at most the larger of its joint maximum and
its two single maxima. At query time dynamic programming combines pairs and single terms to disjoint units with the least total
bound. Units whose bounds together cannot lift a document to the k-th best score so far are non-essential: only
the essential ones are traversed, the others are probed unit by unit for documents that are still competitive.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.session import cut_lineage

#: Documents of a shard, words held before a shard is closed early, and items of a block.
SHARD, SHARD_WORDS, ITEMS = 4096, 4_000_000, 1024
#: ASCII letters in lower case and digits stay, other ASCII separates, bytes of other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "n long, total long, docs binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text, in order; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split() if text else []


def index(docs: DataFrame) -> DataFrame:
    """One row per shard: ids (``docs``), terms per document, and the postings of its terms (places in the shard, counts).

    A document without terms is in no shard. Rows without doc_id count in all statistics and are never ranked (place beyond ``docs``).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, lengths, numbers, words in shards(batches):
            # documents with an id come first
            order = np.argsort([i is None for i in ids], kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            lengths = np.array(lengths, np.int64)
            key = np.concatenate(numbers) * SHARD + np.repeat(place, lengths)
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            times = np.diff(np.append(new, len(key)))
            pairs = key[new]
            term = pairs // SHARD
            starts = np.append(np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])), len(pairs))
            yield pd.DataFrame({
                "n": [len(ids)], "total": [int(lengths.sum())], "docs": [np.array([i for i in ids if i is not None], "<i8").tobytes()],
                "lengths": [lengths[order].astype("<i8").tobytes()], "terms": [b" ".join(words)], "starts": [starts.astype("<i8").tobytes()],
                "places": [(pairs % SHARD).astype("<u2").tobytes()], "counts": [times.astype("<u4").tobytes()]})

    def shards(batches):
        known: defaultdict = defaultdict(count().__next__)
        ids, lengths, numbers, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                found = terms_of(text)
                if not found:
                    continue
                ids.append(None if pd.isna(doc) else int(doc))
                lengths.append(len(found))
                numbers.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                held += len(found)
                if len(ids) == SHARD or held >= SHARD_WORDS:
                    yield ids, lengths, numbers, list(known)
                    known = defaultdict(count().__next__)
                    ids, lengths, numbers, held = [], [], [], 0
        if ids:
            yield ids, lengths, numbers, list(known)

    # ids as text: a column with nulls would come as floats
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, INDEX)


class _Shard:
    """Postings of one index row."""

    def __init__(self, row):
        self.ids = np.frombuffer(row.docs, "<i8")
        self.lengths = np.frombuffer(row.lengths, "<i8")
        self.number = {t: i for i, t in enumerate(row.terms.split(b" "))}
        self.starts = np.frombuffer(row.starts, "<i8")
        self.places, self.counts = np.frombuffer(row.places, "<u2"), np.frombuffer(row.counts, "<u4")

    def posting(self, term: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        i = self.number.get(term)
        if i is None:
            return None
        cut = slice(self.starts[i], self.starts[i + 1])
        return self.places[cut], self.counts[cut].astype(np.int64)


def _frequencies(shards: DataFrame, asked: list[bytes]) -> dict[bytes, int]:
    """Documents that hold each asked term (those of one block of items)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, starts in zip(batch["terms"], batch["starts"], strict=True):
                size = np.diff(np.frombuffer(starts, "<i8"))
                number = {t: i for i, t in enumerate(terms.split(b" "))}
                total += np.fromiter((size[number[t]] if t in number else 0 for t in asked), np.int64, len(asked))
        yield pd.DataFrame({"term": np.arange(len(asked)), "df": total})

    rows = shards.select("terms", "starts").mapInPandas(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {asked[r["term"]]: r["df"] for r in rows}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _impacts(shard: _Shard, term: bytes, w: int, n: int, total: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Places and scores of a term's documents that have an id."""
    posting = shard.posting(term)
    if posting is None:
        return None
    place, tf = posting
    m = 100 - 25 + (25 * shard.lengths[place] * n) // total
    score = w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
    own = place < len(shard.ids)
    return place[own], score[own]


PAIRS = "docs binary, terms binary, places binary, scores binary, starts binary, firsts binary, seconds binary, joint binary, common binary, pair_starts binary"


def _pair_index(shards: DataFrame, asked: list[bytes], pairs: list[tuple[int, int]], weights: list[int], n: int, total: int) -> DataFrame:
    """One row per shard: impacts of the asked terms; per pair the places of the documents that hold both and the largest joint impact."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                shard = _Shard(row)
                have = {i: p for i, t in enumerate(asked) if (p := _impacts(shard, t, weights[i], n, total)) is not None and len(p[0])}
                lists, joint, kept = [], [], []
                dense = np.zeros(len(shard.ids), np.int64)
                for a, b in pairs:
                    if a in have and b in have:
                        (pa, sa), (pb, sb) = have[a], have[b]
                        dense[pa] = sa
                        left = dense[pb]
                        dense[pa] = 0
                        both = left > 0  # a score of 0 adds nothing to a joint impact
                        lists.append(pb[both])
                        joint.append(int((left + sb)[both].max()) if both.any() else 0)
                        kept.append((a, b))
                yield pd.DataFrame({
                    "docs": [row.docs], "terms": [np.array(list(have), "<i4").tobytes()],
                    "places": [b"".join(p.tobytes() for p, _ in have.values())], "scores": [b"".join(s.astype("<i8").tobytes() for _, s in have.values())],
                    "starts": [np.cumsum([0, *(len(p) for p, _ in have.values())]).astype("<i8").tobytes()],
                    "firsts": [np.array([a for a, _ in kept], "<i4").tobytes()], "seconds": [np.array([b for _, b in kept], "<i4").tobytes()],
                    "joint": [np.array(joint, "<i8").tobytes()], "common": [b"".join(x.tobytes() for x in lists)],
                    "pair_starts": [np.cumsum([0, *map(len, lists)]).astype("<i8").tobytes()]})

    return shards.mapInPandas(run, PAIRS)


def units(terms: list[tuple[int, int]], single: dict[int, int], joint: dict[tuple[int, int], int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Disjoint units (bound, [(term, repeats)]) of an item's terms with the least total bound.

    ``terms``: (term, repeats) in order of weight. Only neighbours form pairs, so the best cover is a walk along the order. With unequal
    repeats the joint maximum counts as often as the rarer one, the rest at its single maximum.
    """
    cost, step = [0], []
    for i, (t, c) in enumerate(terms):
        alone = c * single[t]
        best, how = cost[i] + alone, 1
        if i and (terms[i - 1][0], t) in joint:
            u, d = terms[i - 1]
            less = min(c, d)
            both = less * joint[u, t] + (c - less) * single[t] + (d - less) * single[u]
            pair = max(both, c * single[t], d * single[u])
            if cost[i - 1] + pair < best:
                best, how = cost[i - 1] + pair, 2
        cost.append(best)
        step.append(how)
    out, i = [], len(terms)
    while i:
        k = step[i - 1]
        out.append((cost[i] - cost[i - k], terms[i - k:i]))
        i -= k
    return sorted(out, key=lambda x: -x[0])


def search(lists: dict, common: dict, joint: dict, single: dict, ids: np.ndarray, terms: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of a shard's documents that can be among the ``k`` best; ``least``: k-th best score known so far."""
    terms = [x for x in terms if x[0] in lists]
    order = units(terms, single, joint)
    rest = np.append(np.cumsum([b for b, _ in order][::-1])[::-1], 0)
    acc = np.zeros(len(ids), np.int64)
    if len(order) and least == 0:
        # a first threshold: documents that hold both terms of the strongest pair, where they are too few the strongest term, scored in full
        pair = tuple(t for t, _ in order[0][1])
        seed = common.get(pair, ())[:8 * k]
        if len(seed) < k:
            place, score = lists[max(pair, key=single.__getitem__)]
            seed = place[np.argsort(-score, kind="stable")[:8 * k]]
        scores = np.zeros(len(seed), np.int64)
        for t, c in terms:
            place, score = lists[t]
            at = np.minimum(np.searchsorted(place, seed), len(place) - 1)
            scores += np.where(place[at] == seed, c * score[at], 0)
        if len(seed) >= k:
            least = int(np.partition(scores, len(scores) - k)[len(scores) - k])
    done = int(np.searchsorted(-rest[:-1], -max(least, 1), side="right"))  # units from here on cannot reach it together
    for _, unit in order[:done]:
        for t, c in unit:
            place, score = lists[t]
            acc[place] += c * score
    at = np.flatnonzero(acc)
    for i in range(done, len(order)):
        at = at[acc[at] + rest[i] >= least]
        if not len(at):
            break
        for t, c in order[i][1]:
            place, score = lists[t]
            j = np.minimum(np.searchsorted(place, at), len(place) - 1)
            acc[at] += np.where(place[j] == at, c * score[j], 0)
    at = at[acc[at] >= max(least, 1)]
    return at, acc[at]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    best = np.lexsort((ids, -scores))[:k]
    return ids[best], scores[best]


def _ranked(pair_index: DataFrame, queries: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """(query, doc_id, score): the ``k`` best of every task; its shards share the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids = np.frombuffer(row.docs, "<i8")
                starts, places, scores = np.frombuffer(row.starts, "<i8"), np.frombuffer(row.places, "<u2"), np.frombuffer(row.scores, "<i8")
                lists = {int(t): (places[i:j], scores[i:j]) for t, i, j in zip(np.frombuffer(row.terms, "<i4"), starts, starts[1:], strict=False)}
                single = {t: int(s.max()) for t, (_, s) in lists.items()}
                keys = list(zip(np.frombuffer(row.firsts, "<i4").tolist(), np.frombuffer(row.seconds, "<i4").tolist(), strict=True))
                joint = dict(zip(keys, np.frombuffer(row.joint, "<i8").tolist(), strict=True))
                cuts, shared = np.frombuffer(row.pair_starts, "<i8"), np.frombuffer(row.common, "<u2")
                common = {p: shared[i:j] for p, i, j in zip(keys, cuts, cuts[1:], strict=False)}
                for q, terms in enumerate(queries):
                    had, best = top[q]
                    at, score = search(lists, common, joint, single, ids, terms, k, int(best[-1]) if len(best) == k else 0)
                    if len(at):
                        top[q] = _best(np.concatenate([had, ids[at]]), np.concatenate([best, score]), k)
        for q, (docs, best) in enumerate(top):
            if len(docs):
                yield pd.DataFrame({"query": q, "doc_id": docs, "score": best}).astype({"query": "int32"})

    return pair_index.mapInPandas(run, "query int, doc_id long, score long")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of every item, score above 0, ties to the smaller doc_id.

    Every row of ``docs`` is a document, repeated ones too. Null and empty texts have no terms: they are not counted and never found.
    Rows without doc_id count in the statistics and are never found. Rows of ``items`` equal in id and text are one item; ids that
    repeat with other texts and null ids are ranked row by row; items without terms find nothing. Other columns are ignored.
    Items are taken in blocks of ``ITEMS``, so what a task is sent stays bounded.
    """
    spark = docs.sparkSession
    shards = cut_lineage(index(docs))
    n, total = (x or 0 for x in shards.agg(F.sum("n"), F.sum("total")).first())
    asked_of = cut_lineage(items.select("item_id", "text").distinct().orderBy("item_id", "text").withColumn("row", F.monotonically_increasing_id()))
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    out, after = spark.createDataFrame([], schema), -1
    while n:
        block = asked_of.filter(F.col("row") > after).orderBy("row").limit(ITEMS).collect()
        if not block:
            break
        after = block[-1]["row"]
        counts = [Counter(terms_of(r["text"])) for r in block]
        asked = sorted(set().union(*counts))
        if not asked:
            continue
        df = _frequencies(shards, asked)
        number = {t: i for i, t in enumerate(asked)}
        weights = [weight(n, df[t]) if df[t] else 0 for t in asked]
        queries = [sorted(((number[t], c) for t, c in x.items() if weights[number[t]] > 0), key=lambda y: (-weights[y[0]], y[0])) for x in counts]
        pairs = sorted({(a, b) for q in queries for (a, _), (b, _) in zip(q, q[1:], strict=False)})
        found = _ranked(cut_lineage(_pair_index(shards, asked, pairs, weights, n, total)), queries, k)
        best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
        ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(block)], f"query int, item_id {items.schema['item_id'].dataType.simpleString()}")
        out = out.union(cut_lineage(ranked.join(names, "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")))
    return out
