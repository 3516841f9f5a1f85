"""Repeated substrings by external induced sorting of sampled suffixes.

All suffixes of all texts are sorted as far as ``LENGTH`` bytes, so that equal strings of that length stand together; every one
but the earliest is removed. As in induced sorting only sampled suffixes are sorted by content and the order of the others is
induced from them. The samples are the places that are least (by a hash of their first ``GRAM`` bytes) in a window of ``LENGTH``
bytes: local minima that a recursion to that radius would leave, found in one pass. Which place a window has depends on the
window alone, so equal windows have equal samples at equal places. A sample with all windows that belong to it is a tuple
(gram, content, document, place).

Tuples go through queues on disk: exchanges sorted inside their partitions, which Spark spills and merges, so that a shard
may be far larger than memory. A task takes them in order.

1. Tuples leave the first queue by gram and content. Of equal contents all but the earliest are repeats as a whole; the earliest goes
   on if other contents share its gram.
2. Those leave the second queue in the order of the suffix that starts at the sample, with the common prefix of each with the one
   before. The order one byte further left is induced: a stable sort by that byte keeps the known order, and the common prefix of two tuples
   that become neighbours is one more than the least value between their old ranks. This is repeated until the leftmost windows.
   Neighbours with a common prefix of ``LENGTH`` bytes hold equal windows.

The gram samples are unique unless text repeats, so nearly all tuples end in step 1. A gram with more than ``CROWD`` different contents
(a passage at the edge of which very many texts differ) is not taken to one task: its windows meet by aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.session import cut_lineage

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # furthest place of a sample in its window
CROWD, HELD = 4096, 16_384
_PIECE = 1 << 20
_U = np.uint64
_MAX = _U(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240411)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_ODD = (_RNG.integers(1, 2**63, 8, dtype=np.uint64) * _U(2)) | _U(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(_PIECE + LENGTH, _U(base))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place."""
    x, k, level = _BYTE[data], 1, 0
    while k < GRAM:
        y = x[:-k] ^ (x[:-k] >> _U(31))
        y *= _ODD[level]
        y += x[k:]
        x, k, level = y, 2 * k, level + 1
    x ^= x >> _U(29)
    x *= _ODD[6]
    x ^= x >> _U(32)
    x |= _U(1)
    return x


def _sliding(x: np.ndarray, width: int, fold, fill) -> np.ndarray:
    """``fold`` over x[i:i + width] for every i, by blocks."""
    n = len(x) - width + 1
    blocks = np.full(-(-len(x) // width) * width, fill, x.dtype)
    blocks[:len(x)] = x
    rows = blocks.reshape(-1, width)
    fore = fold.accumulate(rows, axis=1).ravel()
    back = fold.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return fold(back[:n], fore[width - 1:width - 1 + n])


def samples(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places, first window starts, last window ends, gram and content hashes of the samples of the texts in ``data``.

    ``starts``: where texts start; one ends where the next starts. Each window belongs to its leftmost place of least gram hash.
    """
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.view(_U), none.view(_U)
    ends = np.append(starts[1:], len(data))
    x = _gram_hashes(data)
    window_ok = np.ones(len(data) - LENGTH + 1, bool)
    for back, marks, value in ((GRAM, x, _MAX), (LENGTH, window_ok, False)):
        at = (ends[:, None] - np.arange(1, back)).ravel()
        marks[at[(at >= 0) & (at < len(marks))]] = value
    least = _sliding(x, SPAN + 1, np.minimum, _MAX)
    least[~window_ok] = 0
    over = np.concatenate([np.zeros(SPAN, _U), least, np.zeros(SPAN, _U)])
    c = np.flatnonzero(_sliding(over, SPAN + 1, np.maximum, _U(0)) == x)
    v = x[c]
    c, v = c[v != _MAX], v[v != _MAX]
    text = np.searchsorted(starts, c, side="right") - 1
    first, last = np.maximum(c - SPAN, starts[text]), np.minimum(c, ends[text] - LENGTH)
    left = np.arange(len(c))
    for k in range(1, SPAN + 1):  # the nearest place before that is as small ends the windows to the left
        left = left[left >= k]
        near = c[left - k] >= c[left] - SPAN
        left = left[near]
        hit = v[left - k] <= v[left]
        first[left[hit]] = np.maximum(first[left[hit]], c[left[hit] - k] + 1)
        left = left[~hit]
        if not len(left):
            break
    left = np.arange(len(c))
    for k in range(1, SPAN + 1):  # the nearest smaller one behind ends them to the right
        left = left[left < len(c) - k]
        left = left[c[left + k] <= c[left] + SPAN]
        hit = v[left + k] < v[left]
        last[left[hit]] = np.minimum(last[left[hit]], c[left[hit] + k] - SPAN - 1)
        left = left[~hit]
        if not len(left):
            break
    some = first <= last
    c, v, first, end = c[some], v[some], first[some], last[some] + LENGTH
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * _POWER[:len(data)], dtype=np.uint64)])
    content = (total[end] - total[first]) * _INVERSE[first] + (end - first).astype(_U)
    content = (content ^ (content >> _U(32))) * _ODD[7]
    return c, first, end, v, content


def packed(start, place, length):
    """Start, place of the sample after it and length in one number that sorts by start; both are below 256."""
    return (start << 16) | (place << 8) | length


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _table(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, "<i8")[column.offset:column.offset + len(column) + 1] if at is not None and at.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def _tuples(texts: DataFrame) -> DataFrame:
    """(key, content, uid, at): one tuple per sample. Of equal ones in a batch the earliest goes on; the others are repeats (``at`` below 0)."""

    def pieces(offsets: np.ndarray) -> Iterator[tuple[list[int], list[int], list[int], int, int]]:
        """Rows, their starts in the piece and in their text, start and end of a piece. Long texts are cut so that no window is lost."""
        rows, at, inside, begin = [], [], [], 0
        for i, (lo, hi) in enumerate(zip(offsets, offsets[1:], strict=False)):
            if hi - lo < LENGTH and (not rows or hi - begin <= _PIECE):
                if rows:
                    rows.append(i), at.append(lo - begin), inside.append(0)
                continue
            if rows and hi - begin > _PIECE:
                yield rows, at, inside, begin, lo
                rows, at, inside = [], [], []
            if hi - lo > _PIECE:
                for cut in range(lo, hi - LENGTH + 1, _PIECE):
                    yield [i], [0], [cut - lo], cut, min(hi, cut + _PIECE + LENGTH - 1)
                continue
            if not rows:
                begin = lo
            rows.append(i), at.append(lo - begin), inside.append(0)
        if rows:
            yield rows, at, inside, begin, offsets[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            uid = _column(batch, "uid")
            keys, contents, owners, places = [], [], [], []
            for rows, starts, inside, begin, end in pieces(offsets):
                starts = np.array(starts, np.int64)
                c, first, last, key, content = samples(data[begin:end], starts)
                row = np.searchsorted(starts, c, side="right") - 1
                keys.append(key.view(np.int64))
                contents.append(content.view(np.int64))
                owners.append(uid[np.array(rows)[row]])
                places.append(packed(first - starts[row] + np.array(inside)[row], c - first, last - first))
            if not keys:
                continue
            key, content, owner, at = (np.concatenate(x) for x in (keys, contents, owners, places))
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
            run_of = order[np.append(same, False) | np.append(False, same)]
            run_of = run_of[np.lexsort((at[run_of], owner[run_of], content[run_of], key[run_of]))]
            again = run_of[1:][(key[run_of][1:] == key[run_of][:-1]) & (content[run_of][1:] == content[run_of][:-1])]
            at[again] = -1 - at[again]
            key[again] = owner[again] * np.int64(0x2545F4914F6CDD1D)  # spread over the partitions
            for i in range(0, len(key), 65_536):
                yield _table(["key", "content", "uid", "at"], [x[i:i + 65_536] for x in (key, content, owner, at)])

    return texts.select("uid", "text").mapInArrow(run, "key long, content long, uid long, at long")


def _first_queue(tuples: DataFrame) -> DataFrame:
    """(uid, at, key): repeats as a whole (null ``key``), and the earliest of each content where its gram has several contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = None  # key and content of the last tuple; the last earliest one, which may still have a successor
        shared = False  # whether the held one has a predecessor
        for batch in batches:
            key, content, uid, at = (_column(batch, n) for n in ("key", "content", "uid", "at"))
            known = at < 0
            spans = [(uid[known], -1 - at[known])]
            key, content, uid, at = (x[~known] for x in (key, content, uid, at))
            out_uid, out_at, out_key = [], [], []
            if len(key):
                before = (np.concatenate([[x], y[:-1]]) for x, y in zip(last or (key[0], content[0]), (key, content), strict=True))
                new = np.logical_or(*(x != y for x, y in zip(before, (key, content), strict=True)))
                if last is None:
                    new[0] = True
                last = (key[-1], content[-1])
                spans.append((uid[~new], at[~new]))
                key, uid, at = key[new], uid[new], at[new]
                if held is not None:
                    key, uid, at = (np.concatenate([[x], y]) for x, y in zip(held, (key, uid, at), strict=True))
                if len(key):
                    near = key[1:] == key[:-1]
                    edge = np.concatenate([[shared], near]) | np.append(near, False)
                    out_uid, out_at, out_key = (x[:-1][edge[:-1]] for x in (uid, at, key))
                    shared, held = bool(near[-1]) if len(near) else shared, (key[-1], uid[-1], at[-1])
            yield table(spans, out_uid, out_at, out_key)
        if held is not None and shared:
            yield table([], [held[1]], [held[2]], [held[0]])

    def table(spans: list, uid, at, key) -> pa.RecordBatch:
        uids, ats = np.concatenate([*(u for u, _ in spans), np.array(uid, np.int64)]), np.concatenate([*(a for _, a in spans), np.array(at, np.int64)])
        whole = len(uids) - len(key)
        keys = pa.concat_arrays([pa.nulls(whole, pa.int64()), pa.array(np.array(key, np.int64))])
        return pa.RecordBatch.from_arrays([pa.array(uids), pa.array(ats), keys], names=["uid", "at", "key"])

    return tuples.repartition("key").sortWithinPartitions("key", "content", "uid", "at").mapInArrow(run, "uid long, at long, key long")


def _contents(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, uid, place, before, behind): what stands before and behind the samples of ``edges`` (uid, at, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, uids, places, before, behind = [], [], [], [], []
            for uid, text, at, key in zip(batch.column("uid").to_pylist(), batch.column("text"), batch.column("ats"), batch.column("keys"), strict=True):
                data = text.as_buffer().to_pybytes()
                for x, k in zip(at.as_py(), key.as_py(), strict=True):
                    start, place, length = x >> 16, x >> 8 & 255, x & 255
                    keys.append(k), uids.append(uid), places.append(start + place)
                    before.append(data[start:start + place]), behind.append(data[start + place:start + length])
            yield _table(["key", "uid", "place", "before", "behind"], [np.array(x, np.int64) for x in (keys, uids, places)] + [pa.array(x, pa.binary()) for x in (before, behind)])

    per = edges.groupBy("uid").agg(F.collect_list(F.struct("at", "key")).alias("e")).select("uid", F.col("e.at").alias("ats"), F.col("e.key").alias("keys"))
    return texts.select("uid", "text").join(per, "uid").mapInArrow(run, "key long, uid long, place long, before binary, behind binary")


def _rows(parts: list[bytes], width: int, backward: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as rows of a matrix, zero-filled, and their lengths."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.frombuffer(b"".join(x[::-1] for x in parts) if backward else b"".join(parts), np.uint8)
    out = np.zeros((len(parts), width), np.uint8)
    out[np.arange(width) < size[:, None]] = flat
    return out, size


def induced(group: np.ndarray, uid: np.ndarray, place: np.ndarray, before: list[bytes], behind: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, start and length of the repeats among tuples that come sorted by (group, behind)."""
    n = len(group)
    left, n_left = _rows(before, SPAN, backward=True)
    right, n_right = _rows(behind, LENGTH)
    same = (right[1:] == right[:-1]) & (np.arange(LENGTH) < np.minimum(n_right[1:], n_right[:-1])[:, None])
    prefix = np.where(group[1:] == group[:-1], np.where(same.all(axis=1), LENGTH, same.argmin(axis=1)), -1)
    low = np.concatenate([[-1], prefix])  # common prefix, from the sample on, with the tuple before
    rank_of = np.empty(n, np.int64)
    rank_of[np.lexsort((place, uid))] = np.arange(n)
    order, repeat = np.arange(n), np.zeros((n, SPAN + 1), bool)
    for d in range(SPAN + 1):
        if d:
            # the order one byte further left: tuples that reach so far, by group and byte, else in the order they have
            table = [low]
            while 2 << (len(table) - 1) <= len(low):
                half = 1 << (len(table) - 1)
                table.append(np.minimum(table[-1][:-half], table[-1][half:]))
            reach = np.flatnonzero(n_left[order] >= d)
            if not len(reach):
                break
            byte = left[order[reach], d - 1]
            old = reach[np.lexsort((byte, group[order[reach]]))]
            new = order[old]
            joined = (group[new[1:]] == group[new[:-1]]) & (left[new[1:], d - 1] == left[new[:-1], d - 1])
            a, b = old[:-1][joined] + 1, old[1:][joined]  # least value at the old ranks a..b
            level = np.frexp((b - a + 1).astype(float))[1] - 1
            least = np.empty(len(a), low.dtype)
            for k in np.unique(level):
                at = np.flatnonzero(level == k)
                least[at] = np.minimum(table[k][a[at]], table[k][b[at] + 1 - (1 << int(k))])
            low = np.full(len(new), -1, low.dtype)
            low[1:][joined] = least
            order = new
        head = np.flatnonzero(low < LENGTH - d)
        if len(head) == len(order):
            continue
        mine = rank_of[order]
        first = np.repeat(np.minimum.reduceat(mine, head), np.diff(np.append(head, len(order))))
        repeat[order, d] = mine > first
    edge = np.diff(np.pad(repeat, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, near = np.nonzero(edge == 1)
    far = np.nonzero(edge == -1)[1] - 1
    return uid[i], place[i] - far, far - near + LENGTH


def _second_queue(contents: DataFrame) -> DataFrame:
    """(uid, at): repeats among tuples of one gram with different contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield found(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                rows -= cut
        if rows:
            yield found(pa.Table.from_batches(held))

    def found(group: pa.Table) -> pa.RecordBatch:
        column = lambda n: group.column(n).to_numpy()
        uid, start, length = induced(column("key"), column("uid"), column("place"), group.column("before").to_pylist(), group.column("behind").to_pylist())
        return _table(["uid", "at"], [uid, packed(start, 0, length)])

    return contents.repartition("key").sortWithinPartitions("key", "behind").mapInArrow(run, "uid long, at long")


def _crowds(contents: DataFrame) -> DataFrame:
    """(uid, at): repeats among tuples of crowded grams. Every window is a row; the earliest of equal ones comes from a partial aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for uid, place, before, behind in zip(*(batch.column(n).to_pylist() for n in ("uid", "place", "before", "behind")), strict=True):
                whole = before + behind
                for i in range(len(whole) - LENGTH + 1):
                    h = xxhash.xxh3_128_intdigest(whole[i:i + LENGTH])
                    for x, y in zip(out, ((h >> 64) - 2**63, (h & 2**64 - 1) - 2**63, uid, place - len(before) + i), strict=True):
                        x.append(y)
            yield _table(["hi", "lo", "uid", "start"], [np.array(x, np.int64) for x in out])

    windows = cut_lineage(contents.mapInArrow(run, "hi long, lo long, uid long, start long"))
    first = windows.groupBy("hi", "lo").agg(F.min(F.struct("uid", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("hi", "lo", "first")
    later = windows.join(first, ["hi", "lo"]).filter(F.struct("uid", "start") > F.col("first"))
    return later.select("uid", (F.shiftleft("start", 16) + LENGTH).alias("at"))


def _identified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, text) of all rows, and with each ``uid`` once.

    ``uid`` is the doc_id where ids are whole, else a number in the order of (doc_id, nulls last, text hash); rows equal in both share it.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if src.groupBy("doc_id").count().filter("doc_id is null or count > 1").isEmpty():
        rows = src.select(F.col("doc_id").alias("uid"), "doc_id", "text")
        return rows, rows
    src = src.withColumn("hash", F.md5(F.col("text").cast("binary")))
    numbers = cut_lineage(src.select(F.col("doc_id").alias("i"), F.col("hash").alias("t")).distinct().orderBy(F.asc_nulls_last("i"), "t").withColumn("uid", F.monotonically_increasing_id()))
    rows = cut_lineage(src.join(numbers, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("hash").eqNullSafe(F.col("t"))).select("uid", "doc_id", "text"))
    return rows, cut_lineage(rows.dropDuplicates(["uid"]))


def _repeats(texts: DataFrame) -> DataFrame:
    """(uid, at): spans of repeats, overlapping ones included."""
    one = texts.filter(F.octet_length("text") >= LENGTH)
    first = cut_lineage(_first_queue(_tuples(one)))
    edges = first.filter("key is not null")
    crowded = cut_lineage(edges.groupBy("key").count().filter(F.col("count") > CROWD).select("key"))
    spans = first.filter("key is null").select("uid", "at")
    if crowded.isEmpty():
        return spans.union(cut_lineage(_second_queue(_contents(edges, one))))
    few = _second_queue(_contents(edges.join(crowded, "key", "left_anti").select("uid", "at", "key"), one))
    many = _crowds(_contents(edges.join(crowded, "key", "left_semi").select("uid", "at", "key"), one))
    return spans.union(cut_lineage(few)).union(cut_lineage(many))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (array of start, end: maximal runs of removed bytes) and kept (binary).

    A byte goes if a string of ``LENGTH`` bytes over it also starts earlier: in a document of smaller doc_id, or before in the same one.
    Null and empty texts have no bytes; texts under ``LENGTH`` bytes are kept. Rows equal in doc_id and text are one document, given as often
    as it stands there; rows that repeat a doc_id with another text come in the order of a hash of their texts, rows without doc_id last.
    Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _bytes(batch.column("text"))
            removed, kept = [], []
            for lo, hi, spans in zip(offsets, offsets[1:], batch.column("spans"), strict=False):
                if not spans.is_valid:
                    removed.append([])
                    kept.append(data[lo:hi].tobytes())
                    continue
                at = np.sort(spans.values.to_numpy())
                start = at >> 16
                end = np.maximum.accumulate(start + (at & 255))
                cut = np.flatnonzero(start[1:] > end[:-1]) + 1
                start, end = start[np.concatenate([[0], cut])], end[np.append(cut - 1, len(end) - 1)]
                removed.append(list(zip(start.tolist(), end.tolist(), strict=True)))
                edges = zip(np.concatenate([[0], end]), np.append(start, hi - lo), strict=True)
                kept.append(b"".join(data[lo + i:lo + j].tobytes() for i, j in edges))
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            rows = [[{"start": i, "end": j} for i, j in x] for x in removed]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(rows, spans_type), pa.array(kept, pa.binary())],
                                             names=["doc_id", "n_bytes", "removed", "kept"])

    texts, once = _identified(docs)
    per = _repeats(once).groupBy("uid").agg(F.collect_list("at").alias("spans"))
    whole = texts.join(per, "uid", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "spans")
    return whole.mapInArrow(run, "doc_id long, n_bytes long, removed array<struct<start: long, end: long>>, kept binary")
