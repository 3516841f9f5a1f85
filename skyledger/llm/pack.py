"""Hierarchical multi-length packing of tokenised documents.

A document is cut into full windows of the largest tier and one remainder. The remainder is routed to the smallest tier
(context size) that holds it. Tiers are packed from the longest to the shortest: a window is opened by a piece of its own
tier and its gap is filled with the longest pieces that fit, which come from shorter tiers; where none fits, a piece is
cut. Windows of a tier then form step groups of equal token budget and balanced attention cost.

Only the histogram of remainder lengths (at most one row per token of the largest tier) meets on the driver. The plan is
a list of runs: "ranks lo..hi-1 of the remainders of length M take offset o in the windows from w on". Its size depends on
the number of lengths, never on the number of documents, so it is broadcast. Documents find their run by their rank
among equal lengths: a rank inside the tokenising partition plus the counts of the partitions before it.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyledger.llm.common import release_words
from skyledger.session import cut_lineage

TIERS = (2048, 1024, 512, 256)
#: Windows of a stored segment: a very long document becomes several bounded rows.
SEGMENT_WINDOWS = 256
STEP_TOKENS = 1 << 17
_UNITS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space for Python's patterns but not for the tokenizer's.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_CACHE_UNITS = 300_000
_SPECIAL = "<|endoftext|>"


class Units(dict):
    """Token ids (little-endian unsigned 32 bit) of a space-led run of text; emptied when it grows too large.

    The tokenizer's split pattern never joins text across the start of such a run, so runs can be encoded one by one.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        # the vocabulary is read as the JSON it is: a second tokenizer library would double the memory of a worker
        with open(vocabulary, encoding="utf-8") as file:
            whole = json.load(file)
        # the byte alphabet of the vocabulary file: printable code points stand for themselves, the rest follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        spare = iter(range(256, 512))
        byte = {chr(b if b in plain else next(spare)): b for b in range(256)}
        ranks = {bytes(byte[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token != _SPECIAL}
        self.special = next(t["id"] for t in whole["added_tokens"] if t["content"] == _SPECIAL)
        self.fast = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={_SPECIAL: self.special})

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= _CACHE_UNITS:
            self.clear()
        ids = np.array(self.fast.encode_ordinary(unit), "<u4").tobytes()
        if len(unit) <= 64:
            self[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text; the tokenizer takes the special string out of a text before it splits the rest."""
        return np.array([self.special], "<u4").tobytes().join(map(self._plain, text.split(_SPECIAL)))

    def _plain(self, text: str) -> bytes:
        if _SEPARATORS.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self.__getitem__, _UNITS.findall(text)))


@lru_cache(maxsize=2)
def _units(vocabulary: str) -> Units:
    return Units(vocabulary)


TOKENS = ("row long, doc_id long, doc_tokens long, seg_start long, ids binary, chunk int, full_before long, crcs array<long>, "
          "rem_len int, rem_rank long, rem_crc long")


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = TIERS[0]) -> DataFrame:
    """Segments of token ids (null text: empty; every document ends with ``end_id``), written once to the shared folder.

    ``full_before`` counts the full windows of this partition before the segment and ``rem_rank`` numbers the remainders
    of one length inside the partition.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release_words()
        units, end = _units(vocabulary), np.array([end_id], "<u4").tobytes()
        chunk = TaskContext.get().partitionId()
        row, full, ranks, out, held = chunk << 40, 0, Counter(), [], 0
        width, step = 4 * window, 4 * window * SEGMENT_WINDOWS
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = units.encode(text or "") + end
                for at in range(0, len(ids), step):
                    seg = ids[at:at + step]
                    n = len(seg) // width
                    rest = len(seg) - n * width
                    crcs = [zlib.crc32(seg[i * width:(i + 1) * width]) for i in range(n)]
                    out.append((row, None if pd.isna(doc) else int(doc), len(ids) // 4, at // 4, seg, chunk, full, crcs,
                                rest // 4, ranks[rest // 4], zlib.crc32(seg[n * width:])))
                    full += n
                    ranks[rest // 4] += 1
                    held += len(seg)
                row += 1
                if held > 16_000_000:
                    yield _frame(out)
                    out, held = [], 0
        yield _frame(out)

    def _frame(rows: list) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in TOKENS.split(", ")])
        return frame.astype({"doc_id": "Int64"})

    return cut_lineage(docs.select("doc_id", "text").mapInPandas(run, TOKENS), compression="zstd")


@dataclass
class Run:
    """Ranks ``lo``..``hi - 1`` of the remainders of ``origin`` tokens: their part from ``start`` on, ``length`` long."""

    origin: int
    lo: int
    hi: int
    start: int
    length: int


def plan(counts: dict[int, int], tiers: tuple[int, ...] = TIERS) -> tuple[list[tuple], dict[int, int]]:
    """Runs (origin, lo, hi, start, length, tier, window, offset) for a histogram of lengths, and windows per tier.

    ``window`` is that of rank ``lo``; the next rank goes to the next window. Windows of a tier come in falling order of
    attention cost. At most one window of all is not full.
    """
    stock: dict[int, list[Run]] = defaultdict(list)
    for length, n in counts.items():
        stock[length].append(Run(length, 0, n, 0, length))
    have = Counter({length: n for length, n in counts.items() if n > 0})

    def take(length: int, n: int) -> list[Run]:
        out = []
        have[length] -= n
        if not have[length]:
            del have[length]
        while n:
            run = stock[length].pop()
            if run.hi - run.lo > n:
                stock[length].append(Run(run.origin, run.lo + n, run.hi, run.start, run.length))
                run = Run(run.origin, run.lo, run.lo + n, run.start, run.length)
            n -= run.hi - run.lo
            out.append(run)
        return out

    rows, windows = [], {}
    for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
        patterns = []
        while any(below < x <= tier for x in have):
            opener = max(x for x in have if below < x <= tier)
            used, slots, gap, cut = Counter({opener: 1}), [opener], tier - opener, None
            while gap:
                fit = max((x for x in have if x <= gap and have[x] > used[x]), default=None)
                if fit is not None:
                    copies = min(gap // fit, have[fit] - used[fit])
                    used[fit] += copies
                    slots += [fit] * copies
                    gap -= fit * copies
                    continue
                cut = max((x for x in have if have[x] > used[x]), default=None)
                if cut is not None:
                    used[cut] += 1
                break
            n = min(have[x] // k for x, k in used.items())
            layout, offset = [], 0
            for x in slots:
                layout += [(run, offset, at) for run, at in _spread(take(x, n))]
                offset += x
            if cut is not None:
                for run, at in _spread(take(cut, n)):
                    layout.append((Run(run.origin, run.lo, run.hi, run.start, gap), offset, at))
                    left = Run(run.origin, run.lo, run.hi, run.start + gap, run.length - gap)
                    stock[left.length].append(left)
                    have[left.length] += left.hi - left.lo
                slots = [*slots, gap]
            patterns.append((sum(x * x for x in slots), n, layout))
        base = 0
        for _, n, layout in sorted(patterns, key=lambda p: -p[0]):
            rows += [(r.origin, r.lo, r.hi, r.start, r.length, tier, base + at, offset) for r, offset, at in layout]
            base += n
        windows[tier] = base
    return rows, windows


def _spread(runs: list[Run]) -> Iterator[tuple[Run, int]]:
    at = 0
    for run in runs:
        yield run, at
        at += run.hi - run.lo


def _snake(at: Column, steps: int) -> Column:
    """Deal a falling order over ``steps`` groups back and forth, so that their sums stay close."""
    turn, place = F.floor(at / steps), F.pmod(at, F.lit(steps))
    return F.when(turn % 2 == 0, place).otherwise(steps - 1 - place)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> tuple[DataFrame, DataFrame]:
    """Pieces and the stored token segments.

    Pieces: row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group. Every id of every
    document lies in exactly one piece. Null and empty texts are the end id alone; repeated rows and doc_ids are packed
    each on its own (``row`` tells them apart); an empty table gives no piece; other columns are ignored.
    """
    spark = docs.sparkSession
    top = tiers[0]
    tokens = tokenised(docs, vocabulary, end_id, top)
    narrow = tokens.drop("ids")
    short = narrow.filter("rem_len > 0")
    counts = cut_lineage(short.groupBy("rem_len", "chunk").agg(F.count("*").alias("n")).union(
        narrow.groupBy("chunk").agg(F.sum(F.size("crcs")).alias("n")).select(F.lit(top).alias("rem_len"), "chunk", "n")))
    before = Window.partitionBy("rem_len").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("rem_len", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    totals = {r["rem_len"]: r["n"] for r in counts.groupBy("rem_len").agg(F.sum("n").alias("n")).collect()}  # one row per length
    full = totals.pop(top, 0) or 0
    runs, windows = plan(totals, tiers)
    windows[top] += full
    runs = [(*r[:6], r[6] + (full if r[5] == top else 0), r[7]) for r in runs]
    table = F.broadcast(spark.createDataFrame(runs, "origin int, lo long, hi long, p_start int, length int, tier int, w0 long, offset long"))

    ranked = short.join(shift, ["rem_len", "chunk"]).withColumn("rank", F.col("shift") + F.col("rem_rank"))
    lead = F.col("seg_start") + F.size("crcs") * top
    placed = [F.col("row"), "doc_id", (lead + F.col("p_start")).alias("start"), F.col("length").cast("long").alias("length")]
    rest = ["doc_tokens", "tier", (F.col("w0") + F.col("rank") - F.col("lo")).alias("window"), "offset"]
    on = (F.col("rem_len") == F.col("origin")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    whole = ranked.join(table.filter("length = origin"), on).select(*placed, F.col("rem_crc").alias("ids_crc32"), *rest)
    # only lengths that are cut somewhere read their ids
    cut = sorted({r[0] for r in runs if r[4] != r[0]})
    bits = F.expr(f"crc32(substring(ids, int(4 * (size(crcs) * {top} + p_start) + 1), int(4 * length)))")
    with_ids = tokens.filter(F.col("rem_len").isin(cut)) if cut else tokens.filter("false")
    parts = (with_ids.join(shift, ["rem_len", "chunk"]).withColumn("rank", F.col("shift") + F.col("rem_rank"))
             .join(table.filter("length <> origin"), on).select(*placed, bits.alias("ids_crc32"), *rest))
    fulls = (narrow.filter(F.size("crcs") > 0).join(shift.filter(F.col("rem_len") == top).select("chunk", "shift"), "chunk")
             .select("row", "doc_id", "doc_tokens", "seg_start", (F.col("shift") + F.col("full_before")).alias("w"), F.posexplode("crcs").alias("i", "crc"))
             .select("row", "doc_id", (F.col("seg_start") + F.col("i") * top).alias("start"), F.lit(top).cast("long").alias("length"),
                     F.col("crc").alias("ids_crc32"), "doc_tokens", F.lit(top).alias("tier"), (F.col("w") + F.col("i")).alias("window"), F.lit(0).cast("long").alias("offset")))
    pieces = fulls.union(whole).union(parts)
    first, group, ids, steps = 0, 0, F.lit(None).cast("long"), F.lit(None).cast("long")
    for tier in tiers:
        n = max(1, -(-windows[tier] * tier // step_tokens))
        ids = F.when(F.col("tier") == tier, F.col("window") + first).otherwise(ids)
        steps = F.when(F.col("tier") == tier, _snake(F.col("window"), n) + group).otherwise(steps)
        first, group = first + windows[tier], group + n
    return pieces.select("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", ids.cast("long").alias("sequence_id"), "offset", "tier",
                         steps.cast("long").alias("step_group")), tokens


def with_ids(pieces: DataFrame, tokens: DataFrame, window: int = TIERS[0]) -> DataFrame:
    """Pieces with their token ids as bytes (little-endian unsigned 32 bit)."""
    span = window * SEGMENT_WINDOWS
    at = F.col("start") - F.floor(F.col("start") / span) * span
    left = pieces.withColumn("_seg", (F.floor(F.col("start") / span) * span).cast("long")).withColumn("_at", at.cast("int"))
    right = tokens.select("row", F.col("seg_start").alias("_seg"), F.col("ids").alias("_ids"))
    return left.join(right, ["row", "_seg"]).withColumn("ids", F.expr("substring(_ids, 4 * _at + 1, int(4 * length))")).drop("_seg", "_at", "_ids")
