"""Spelling variants by pivotal grams.

Two words are near if one inserted, deleted or replaced letter tells them apart. A word's bigrams are ordered from rare to
frequent; its *prefix* is the three rarest ones (all bigrams that tie with the third included). One edit touches at most two
neighbouring bigrams, so of two words whose prefixes end in this order, the earlier one keeps one of any two disjoint bigrams
of its prefix, and finds it in the other's prefix. Dynamic programming chooses the two disjoint bigrams of least total
frequency: the pivots. Pivots meet prefixes on (bigram, length, place): a kept bigram stands where it was, or one
place further where a letter was inserted or removed before it. Pairs that meet are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut_lineage

#: Fewest letters and occurrences of a word; a form occurs this many times as often as its variant.
LETTERS, OCCURRENCES, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a letter.
SLIP = 199
_HELD = 400_000
#: Latin-1 bytes of A-Z, a-z and U+00C0 to U+00FF; A-Z in lower case, everything else a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters in Latin-1, A-Z in lower case; a byte is a code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def written(run: bytes, doc_crc: int) -> bytes:
    """The run as the document has it: every ``SLIP``-th (document, run) pair loses one letter."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), doc_crc)
    if h % SLIP:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): words of ``LETTERS`` letters or more with their occurrences over all whole texts.

    Null and empty texts have none. A row without doc_id is read with an empty id; rows that repeat count each.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                crc = zlib.crc32(doc.encode() + b":")
                for r, n in Counter(runs(text)).items():
                    if len(r) >= LETTERS and len(word := written(r, crc)) >= LETTERS:
                        found[word] += n
                if len(found) > _HELD:
                    yield frame(found)
                    found.clear()
        if found:
            yield frame(found)

    def frame(found: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("latin-1") for w in found], "n": list(found.values())}).astype({"n": "int64"})

    src = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return src.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(prefix: list[tuple[int, int]]) -> tuple[int, int]:
    """Places of two disjoint bigrams of least total frequency; ``prefix``: (place, frequency), by place.

    ``one``: the cheapest single bigram up to here, ``two``: the cheapest disjoint pair.
    """
    one: list[tuple[int, int]] = []  # (frequency, place) of the best single among the first i + 1
    two = None
    for i, (place, frequency) in enumerate(prefix):
        j = i - 1
        while j >= 0 and prefix[j][0] > place - 2:
            j -= 1
        if j >= 0:
            pair = (one[j][0] + frequency, one[j][1], place)
            two = pair if two is None else min(two, pair)
        one.append(min(one[-1], (frequency, place)) if one else (frequency, place))
    return two[1], two[2]


def _grams(words: DataFrame) -> DataFrame:
    """(word, n, letters, gram, place, pivot): every word's prefix, pivots marked.

    The frequencies of bigrams go to all tasks; letters are a-z and U+00C0 to U+00FF, so there are at most 90 * 90 of them.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))
    frequency = {r["gram"]: r["f"] for r in words.select(F.explode(pairs).alias("gram")).groupBy("gram").agg(F.count("*").alias("f")).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                order = sorted((frequency[word[i:i + 2]], word[i:i + 2], i) for i in range(len(word) - 1))
                last = order[2][:2]
                prefix = sorted((i, f) for f, g, i in order if (f, g) <= last)
                chosen = pivots(prefix)
                letters = 0
                for c in word:
                    letters |= 1 << (ord(c) % 63)
                out += [(word, n, letters, word[i:i + 2], i, len(word), i in chosen) for i, _ in prefix]
            yield pd.DataFrame(out, columns=["word", "n", "letters", "gram", "place", "length", "pivot"]).astype({"n": "int64", "letters": "int64", "place": "int32", "length": "int32"})

    return words.mapInPandas(run, "word string, n long, letters long, gram string, place int, length int, pivot boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, an, b, bn): all ordered pairs of near words of (word, n), with their occurrences."""
    index = cut_lineage(_grams(words))
    here = [F.struct((F.col("length") + dl).alias("length"), (F.col("place") + dp).alias("place")) for dl, dp in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))]
    probes = (index.filter("pivot").select(F.col("word").alias("a"), F.col("n").alias("an"), F.col("letters").alias("al"), "gram", F.explode(F.array(*here)).alias("at"))
              .select("a", "an", "al", "gram", "at.length", "at.place"))
    hits = index.select(F.col("word").alias("b"), F.col("n").alias("bn"), F.col("letters").alias("bl"), "gram", "length", "place")
    # an edit changes at most two letters of the set; the distance is read only then
    near = (F.bit_count(F.col("al").bitwiseXOR(F.col("bl"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    met = probes.join(hits, ["gram", "length", "place"]).filter(near)
    return met.select("a", "an", "b", "bn").union(met.select("b", "bn", "a", "an")).distinct()


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    ``form``: the near word of largest n (ties: smallest in code-point order) if that is ``RATIO`` times the word's own n or more.
    ``root``: where the forms lead to. Texts without words and an empty table give no rows; other columns of ``docs`` are ignored.
    """
    words = cut_lineage(counted(docs).filter(F.col("n") >= OCCURRENCES))
    best = F.min_by(F.struct(F.col("b").alias("form"), F.col("bn").alias("form_n")), F.struct(-F.col("bn"), F.col("b")))
    near = near_pairs(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    good = F.col("best.form_n") >= RATIO * F.col("n")
    formed = cut_lineage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, F.col("best.form_n")).alias("form_n")))
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form. Each round doubles the steps; occurrences grow along them, so rounds are few."""
    now = cut_lineage(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = cut_lineage(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now
