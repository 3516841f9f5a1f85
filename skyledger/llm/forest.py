"""Near-duplicate documents by an LSH forest: several sorted orders of min-hash signatures.

Each document is the set of its distinct five-word shingles. ``TREES`` independent signatures of ``DEPTH`` min-hashes
give as many sorted orders; documents that share a prefix of a signature are neighbours there, and a *region* is a run of
neighbours with the same prefix. A region starts at depth ``SHALLOW``; where it holds more than a few blocks, it is
followed deeper until it fits, and afterwards only its documents outside the largest component are compared with the
whole region. Inside a region, documents whose signatures agree in less than ``AGREE`` of all places are told apart; what
still hangs together is confirmed on full sets, once for all trees that found it. A task returns a spanning forest of
what it confirmed, so a group of m near copies costs m rows, not m squared.

Two documents at similarity 0.75 share no region with probability (1 - 0.75^3)^24 = 2e-6, and agree in less than half of
the 120 places with probability 1e-9.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import components, shingles, word_hashes
from skyledger.session import cut_lineage

TREES, DEPTH, SHALLOW, AGREE = 24, 5, 3, 0.5
#: Most shingles and documents of a block, and most blocks of a region before it is followed deeper.
BLOCK_SHINGLES, BLOCK_DOCS, REGION_BLOCKS = 400_000, 512, 12
_CHUNK = 512


def _signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(sh), _CHUNK):
        h = sh[None, i:i + _CHUNK] * a
        h += b
        np.minimum(out, h.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, sig): size, 128-bit fingerprint and min-hashes of each document's set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20240229)
        a = (rng.integers(0, 2**63, (TREES * DEPTH, 1), dtype=np.uint64) * np.uint64(2)) | np.uint64(1)
        b = rng.integers(0, 2**63, (TREES * DEPTH, 1), dtype=np.uint64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                sh = np.unique(shingles(word_hashes(text), words))
                with np.errstate(over="ignore"):
                    lo = np.bitwise_xor.reduce(sh) if len(sh) else np.uint64(0)
                    hi = np.add.reduce(sh * (sh >> np.uint64(7) | np.uint64(1))) if len(sh) else np.uint64(0)
                rows.append((doc, len(sh), np.int64(np.uint64(hi).view(np.int64)), np.uint64(lo).view(np.int64),
                             _signature(sh, a, b).tobytes() if len(sh) else None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "set_hi", "set_lo", "sig"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, n_shingles, members): the sorted shingles of the wanted documents, as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [np.unique(shingles(word_hashes(t), words)) for t in batch["text"]]
            yield pd.DataFrame({"rep": batch["rep"], "n_shingles": [len(s) for s in sets], "members": [s.astype("<u8").tobytes() for s in sets]})

    src = docs.select(F.col("doc_id").alias("rep"), "text").filter("text is not null")
    # one plan at every size: a hash table of ids beside shuffled texts, which are never sorted
    return src.join(wanted.select("rep").distinct().hint("shuffle_hash"), "rep").mapInPandas(run, "rep long, n_shingles long, members binary")


def _linked(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix: 100 * intersection >= 75 * union."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = max(256, 4_000_000 // max(1, len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        i, j = np.searchsorted(column, (lo, lo + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[owner[i:j], column[i:j] - lo] = 1
        both += dense @ dense.T
    inter = both.astype(np.int64)
    return 175 * inter >= 75 * (sizes[:, None] + sizes[None, :])


def _spanning(ids: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Each id with the smallest id of its component inside the task."""
    left, out = np.ones(len(ids), bool), []
    for i in np.argsort(ids, kind="stable"):
        if not left[i]:
            continue
        reach, front = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        front[i] = True
        while front.any():
            reach |= front
            front = linked[front].any(axis=0) & ~reach
        left &= ~reach
        out += [(int(ids[i]), int(x)) for x in ids[reach] if x != ids[i]]
    return out


def _by_group(rows: DataFrame, each, schema: str) -> DataFrame:
    """Apply ``each`` (a frame of one group) to every group of ``grp``. Groups are bounded; a task walks its sorted rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = batch["grp"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            out = [each(batch.iloc[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]
            held = batch.iloc[cuts[-1]:] if len(batch) else None
            yield _frame([x for y in out for x in y])
        if held is not None and len(held):
            yield _frame(each(held))

    def _frame(found: list) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[c.split()[0] for c in schema.split(", ")]).astype("int64")

    return rows.repartition("grp").sortWithinPartitions("grp").mapInPandas(run, schema)


def _alike(groups: DataFrame, sigs: DataFrame) -> DataFrame:
    """(grp, rep): what hangs together inside each group by agreeing signatures, named by its members, once for all trees."""

    def each(group: pd.DataFrame) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        reps = group["rep"].to_numpy(np.int64)
        sig = np.frombuffer(b"".join(group["sig"]), "<u4").reshape(len(group), -1)
        n = group["n_shingles"].to_numpy(np.int64)
        agree = np.zeros((len(reps), len(reps)), np.int16)
        for i in range(sig.shape[1]):
            agree += sig[:, i, None] == sig[None, :, i]
        near = (agree >= AGREE * sig.shape[1]) & (100 * np.minimum(n[:, None], n) >= 75 * np.maximum(n[:, None], n))
        parts = {}
        for a, b in _spanning(np.arange(len(reps)), near):
            parts.setdefault(a, [a]).append(b)
        out = []
        for part in parts.values():
            members = np.sort(reps[part])
            name = xxhash.xxh3_64_intdigest(members.tobytes()) - 2**63
            out += [(name, int(r)) for r in members]
        return out

    return _by_group(groups.join(sigs.select("rep", "n_shingles", "sig"), "rep"), each, "grp long, rep long").distinct()


def _confirm(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) inside each group (grp, rep), confirmed on full sets."""

    def each(group: pd.DataFrame) -> list[tuple[int, int]]:
        if len(group) < 2:
            return []
        return _spanning(group["rep"].to_numpy(np.int64), _linked([np.frombuffer(m, "<u8") for m in group["members"]]))

    return _by_group(groups.join(sets.select("rep", "members"), "rep"), each, "a long, b long")


def _blocks(regions: DataFrame) -> DataFrame:
    """Deal the members (rgn, rep, n_shingles) of a region into blocks; adds ``blocks`` and ``blk``."""
    size = regions.groupBy("rgn").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("w"))
    n = F.greatest(F.ceil(F.col("w") / BLOCK_SHINGLES), F.ceil(F.col("m") / BLOCK_DOCS)).cast("int")
    return regions.join(size.filter("m > 1").select("rgn", n.alias("blocks")), "rgn").withColumn("blk", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))


def _pairs_of_blocks(dealt: DataFrame) -> DataFrame:
    """(grp, rep): one group per pair of blocks, so that every two members meet. Copies per row: blocks - 1, at least one."""
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("blk")))
    return (dealt.select("rgn", "rep", "blk", F.explode(other).alias("o"))
            .select(F.xxhash64("rgn", F.least("blk", "o"), F.greatest("blk", "o")).alias("grp"), "rep").distinct())


def _regions(sigs: DataFrame, lo: int, hi: int, depth: int) -> DataFrame:
    """(rgn, rep, n_shingles, tree): region of each document in trees lo..hi-1 at ``depth``."""
    prefix = F.substring("sig", F.col("tree") * (4 * DEPTH) + 1, F.lit(4 * depth))
    trees = F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias("tree")
    return sigs.select("rep", "n_shingles", "sig", trees).select(
        F.xxhash64("tree", F.lit(depth), prefix).alias("rgn"), "rep", "n_shingles", "tree")


def links(docs: DataFrame, sigs: DataFrame, words: int = 5) -> DataFrame:
    """Links (a, b) between class representatives whose components are those of all similar pairs.

    ``sigs``: (rep, n_shingles, sig), one row per distinct set.
    """
    dealt = cut_lineage(_blocks(_regions(sigs, 0, TREES, SHALLOW).select("rgn", "rep", "n_shingles")))
    active = cut_lineage(dealt.select("rep").distinct())
    sigs = cut_lineage(sigs.join(active, "rep", "left_semi"))
    fits = F.col("blocks") <= REGION_BLOCKS
    groups = _pairs_of_blocks(dealt.filter(fits))
    wide = dealt.filter(~fits)
    crowd = not wide.isEmpty()
    if crowd:
        members = sigs.join(wide.select("rep").distinct(), "rep", "left_semi")
        for depth in range(SHALLOW + 1, DEPTH + 1):
            deeper = _blocks(_regions(members, 0, TREES, depth).select("rgn", "rep", "n_shingles"))
            # at full depth all hashes of the tree agree: blocks are compared with the block beside them
            groups = groups.union(_runs(deeper) if depth == DEPTH else _pairs_of_blocks(deeper.filter(fits)))
    groups = cut_lineage(_alike(groups, sigs))
    sets = cut_lineage(_sets(docs, groups, words))
    found = cut_lineage(_confirm(groups, sets))
    if crowd:
        strays = cut_lineage(_alike(_strays(wide, cut_lineage(components(found))), sigs))
        found = cut_lineage(found.union(_confirm(strays, cut_lineage(_sets(docs, strays, words)))))
    return found


def _runs(dealt: DataFrame) -> DataFrame:
    """(grp, rep): blocks of a region as they are, each document also in the block beside it."""
    near = F.array_distinct(F.array(F.col("blk"), F.pmod(F.col("blk") + 1, F.col("blocks"))))
    return dealt.select("rep", "rgn", F.explode(near).alias("o")).select(F.xxhash64("rgn", "o", F.lit("run")).alias("grp"), "rep")


def _strays(dealt: DataFrame, label: DataFrame) -> DataFrame:
    """(grp, rep): in each wide region, the documents outside its largest component against all blocks of the region."""
    rows = dealt.join(label, dealt["rep"] == label["id"], "left").select("rgn", "rep", "n_shingles", "blk", "blocks", F.coalesce("component", "rep").alias("component"))
    sizes = rows.groupBy("rgn", "component").agg(F.count("*").alias("m"))
    top = sizes.groupBy("rgn").agg(F.max(F.struct("m", "component")).alias("t")).select("rgn", F.col("t.component").alias("main"))
    stray = _blocks(rows.join(top, "rgn").filter("component <> main").select("rgn", "rep", "n_shingles").union(
        rows.join(top, "rgn").filter("component = main").groupBy("rgn").agg(F.min("rep").alias("rep"), F.lit(1).cast("long").alias("n_shingles")).select("rgn", "rep", "n_shingles")))
    parts = stray.groupBy("rgn").agg(F.max("blocks").alias("parts"))
    own = stray.join(dealt.select("rgn", "blocks").distinct().withColumnRenamed("blocks", "all"), "rgn").select(
        "rgn", "rep", "blk", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("o"))
    whole = dealt.join(parts, "rgn").select("rgn", "rep", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("blk"), F.col("blk").alias("o"))
    return own.select("rgn", "rep", "blk", "o").union(whole.select("rgn", "rep", "blk", "o")).select(
        F.xxhash64("rgn", "blk", "o", F.lit("stray")).alias("grp"), "rep").distinct()


def near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Null and empty texts have no shingles and stay alone; equal sets are one class. Rows that repeat a doc_id are one
    document for linking. Rows without doc_id are never linked: null component, kept. Other columns are ignored.
    """
    base = cut_lineage(signatures(docs, words))
    by = ["n_shingles", "set_hi", "set_lo"]
    real = base.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(real.groupBy(*by).agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")))
    found = links(docs, classes.select("rep", "n_shingles", "sig"), words)
    member = real.select("doc_id", *by).join(classes.select(*by, "rep"), by).select("doc_id", "rep")
    lowest = member.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    twice = lowest.filter("low <> high").select("doc_id", "low").join(member, "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    label = components(found.union(twice))
    node = lowest.select("doc_id", F.col("low").alias("id")).join(label, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id"))
    return (base.select("doc_id", "n_shingles").join(node, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents that are kept: one of each group of near duplicates, all columns as they are.

    Of rows equal in doc_id and text one stays; rows without doc_id all stay.
    """
    kept = cut_lineage(near_duplicates(docs, words).filter("doc_id is not null").groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("n")))
    once = docs.join(kept.filter("kept and n = 1").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
    again = docs.join(kept.filter("kept and n > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.union(again).union(docs.filter("doc_id is null")).select(docs.columns)
