"""Large JSON documents read by many tasks: arrays of objects, alone or below the keys of one outer object.

A file is read as *fragments*, the text between two closing braces, so Spark cuts it anywhere and no task needs more than its
own range. Whether a fragment starts inside a string, and how deep it is, follows from running sums over the file: the parity
of quotes, then opened minus closed braces. They are taken inside a range and carried from range to range by one summary
row each (:func:`skyledger.functions.sliced.carry_scan`). An object ends where the depth is back at that of the list.
Compressed files are one range. Objects that have to be opened one by one (announced ones, or those whose name does not tell their
compression) are streamed by the executors in pieces of bounded size and give the same fragments.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from skyledger.functions.sliced import SLICE, carry_scan
from skyledger.session import cut_lineage

#: Bytes asked of a stream at once, and bytes of text per slice of one object.
PIECE, SLICE_BYTES = 1 << 20, 1 << 26
#: Fragments of a file per slice, as a power of two: the windows hold one slice at a time, whatever the range of a task.
SLICE_BITS = 16
_ROW_BITS = 33  # rows of one task in monotonically_increasing_id
_ROWS = 4096
FRAGMENT = f"path string, {SLICE} long, i long, value string"
#: Text outside of objects: anything up to the first brace that stands outside of a string.
_OUTSIDE = r'[^"{]*+(?:"(?:[^"\\]++|\\.)*+"[^"{]*+)*+'
_KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*\[?\s*$'


def file_fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Fragments of the files below ``path``, plain ones in ranges; the codec follows from the name.

    A slice is a block of the task's rows inside a range: ranges by their start, blocks by the number of the row in its task.
    """
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    rows = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("i"), "value")
    block = F.shiftright(F.col("i").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)), SLICE_BITS)
    return rows.select("path", (F.shiftleft("start", _ROW_BITS - SLICE_BITS) + block).alias(SLICE), "i", "value")


def _absolute(uri: str) -> str:
    return "file:///" + uri[5:].lstrip("/") if uri.startswith("file:") else uri


def open_object(uri: str):
    """A readable stream of the object; stores that pyarrow knows (files, HDFS, S3, GCS)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(_absolute(uri))
    return store.open_input_stream(path, compression=None)


def inflated(stream) -> Iterator[bytes]:
    """Pieces of at most about ``PIECE`` bytes: what gzip members hold if the content starts like one, else the content."""
    piece = stream.read(PIECE)
    if piece[:2] != b"\x1f\x8b":
        while piece:
            yield piece
            piece = stream.read(PIECE)
        return
    unzip = zlib.decompressobj(31)
    while piece:
        out = unzip.decompress(piece, PIECE)
        if out:
            yield out
        rest = unzip.unconsumed_tail
        if unzip.eof:
            rest = unzip.unused_data
            rest = (rest or stream.read(PIECE)).lstrip(b"\0")  # members may follow each other, padding may follow them
            if rest and not rest.startswith(b"\x1f\x8b"):
                return
            unzip = zlib.decompressobj(31)
        piece = rest or stream.read(PIECE)


def object_fragments(objects: DataFrame, uri: str = "uri", opener: Callable = open_object) -> DataFrame:
    """Fragments of the objects named by the rows of ``objects``, fetched and inflated by the executors as streams.

    ``opener`` (uri -> stream with ``read(n)``) serves other stores. A row is one task's unit; deal rows out before if they are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for i, (at, value) in enumerate(pieces(name)):
                    rows.append((name, at // SLICE_BYTES, i, value))
                    if len(rows) == _ROWS:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    def pieces(name: str) -> Iterator[tuple[int, bytes]]:
        rest, at = b"", 0
        with opener(name) as stream:
            for piece in inflated(stream):
                *whole, rest = (rest + piece).split(b"}")
                for value in whole:
                    yield at, value
                    at += len(value) + 1
        if rest:
            yield at, rest

    def table(rows: list[tuple]) -> pa.RecordBatch:
        path, part, i, value = zip(*rows, strict=True)
        text = [v.decode("utf-8", "replace") for v in value]
        return pa.RecordBatch.from_arrays([pa.array(path), pa.array(part, pa.int64()), pa.array(i, pa.int64()), pa.array(text)], names=["path", SLICE, "i", "value"])

    return objects.select(uri).mapInArrow(run, FRAGMENT)


def _opened(outside: Callable) -> Column:
    """Opening braces among the pieces between quotes that ``outside`` names."""
    text = F.array_join(F.filter("_pieces", outside), " ")
    return (F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))).cast("long")


def _running(df: DataFrame, name: str, delta: Column) -> DataFrame:
    """Add ``name``: sum of ``delta`` over the earlier fragments of the file."""

    def before(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(Window.unboundedPreceding, -1)

    out = carry_scan(df, ["path"], ["i"], local={"_near": lambda w: F.sum(delta).over(before(w))}, summary={"_edge": F.sum(delta)},
                     carry={"_far": lambda w: F.sum("_edge").over(before(w))})
    return out.withColumn(name, F.coalesce("_near", F.lit(0)) + F.coalesce("_far", F.lit(0))).drop("_near", "_far")


def split_objects(fragments: DataFrame) -> DataFrame:
    """(path, section, pos, item, outside): every object of the lists of a document, in its own JSON text.

    ``section``: the key its list (or the object itself) stands under, null in a bare list. ``pos``: 0, 1, ... inside the section.
    ``outside``: the text between it and the object before it, which holds the scalar fields of the document; a last row with null
    ``item`` holds what follows the last object. Values of lists that are no objects belong to that text. Empty files give nothing; a document
    that is cut short gives the objects that are whole.
    """
    pieces = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')
    fragments = cut_lineage(fragments)
    rows = fragments.withColumn("_pieces", pieces).select(
        "path", SLICE, "i", "value", ((F.size("_pieces") - 1) % 2).cast("long").alias("quotes"),
        _opened(lambda x, j: j % 2 == 0).alias("opened0"), _opened(lambda x, j: j % 2 == 1).alias("opened1"))
    rows = _running(rows, "quoted", F.col("quotes")).withColumn("quoted", F.col("quoted") % 2)
    ends = (F.col("quoted") + F.col("quotes")) % 2 == 0
    rows = rows.select("path", SLICE, "i", "value", ends.alias("ends"), (F.when(F.col("quoted") == 0, F.col("opened0")).otherwise(F.col("opened1")) - F.when(ends, 1).otherwise(0)).alias("step"))
    rows = _running(rows, "depth", F.col("step")).withColumn("after", F.col("depth") + F.col("step"))
    # depth of the lists: 0 in a bare list, 1 below the keys of an object; told by the first fragment of the file
    head = F.when(F.ltrim(F.translate("value", "﻿\n\r\t", " ")).startswith("["), 0).otherwise(1)
    first = F.min(F.struct(SLICE, "i", head.alias("root")))
    roots = fragments.groupBy("path").agg(first.alias("f")).select("path", F.col("f.root").alias("root"))
    rows = rows.join(roots, "path").withColumn("closes", (F.col("ends") & (F.col("after") == F.col("root"))).cast("long"))
    rows = _running(rows, "no", F.col("closes"))
    # the text after the outer object closed is not part of an object
    whole = rows.groupBy("path", "no").agg(F.min(SLICE).alias(SLICE), F.min(F.col("no") == 0).alias("begins"), F.max("root").alias("root"), F.max("closes").alias("closes"),
                                           F.array_sort(F.collect_list(F.struct(SLICE, "i", "value"))).alias("parts"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.when(F.col("closes") == 1, "}").otherwise(""))
    outer = F.when(F.col("begins") & (F.col("root") == 1), r"\{").otherwise("")
    whole = whole.withColumn("text", text).withColumn("outside", F.when(outer == "", F.regexp_extract("text", "(?s)^" + _OUTSIDE, 0))
                                                      .otherwise(F.regexp_extract("text", "(?s)^" + _OUTSIDE + r"\{" + _OUTSIDE, 0)))
    item = F.when(F.col("closes") == 1, F.expr("substring(text, length(outside) + 1)"))
    # read twice by the scan below; written, so that the scans above run once
    whole = cut_lineage(whole.select("path", "no", SLICE, "outside", F.when(item.startswith("{"), item).alias("item")))
    key = F.when(F.col("outside").rlike(_KEY), F.struct(F.regexp_extract("outside", _KEY, 1).alias("section"), F.col("no").alias("start")))
    named = carry_scan(whole.withColumn("_key", key), ["path"], ["no"],
                       local={"_near": lambda w: F.last("_key", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))},
                       summary={"_edge": F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("no")))},
                       carry={"_far": lambda w: F.last("_edge", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    at = F.coalesce("_near", "_far")
    return named.select("path", at["section"].alias("section"), (F.col("no") - F.coalesce(at["start"], F.lit(0))).alias("pos"), "item", "outside")


def write_documents(items: DataFrame, path: str, order: list[str], head: str = "") -> None:
    """Write JSON documents below ``path``: one per partition of ``items`` (section, item, ...), lists in the order ``order``.

    ``head``: text of scalar fields in front of the lists. Items of null ``section`` make a bare list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        section, begun = None, False
        for batch in batches:
            lines = []
            for name, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not begun:
                    lines.append("[" if name is None else "{" + (head + ", " if head else "") + json.dumps(name) + ": [")
                elif name != section:
                    lines.append("], " + json.dumps(name) + ": [")
                else:
                    lines.append(",")
                section, begun = name, True
                lines.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["]" if section is None else "]}"])], names=["value"])

    rows = items.sortWithinPartitions(*order).select("section", "item").mapInArrow(run, "value string")
    rows.write.option("lineSep", " ").text(path)


def write_objects(items: DataFrame, root: str, gzipped: Callable[[str], bool] = lambda key: False) -> DataFrame:
    """Write one object ``{"Records": [...]}`` per ``key`` of (key, ord, item) by the executors; returns their uris. A key is a task's unit."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        key = frame["key"].iloc[0]
        uri = f"{_absolute(root).rstrip('/')}/{key}"
        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        data = ('{"Records": [' + ", ".join(frame.sort_values("ord")["item"]) + "]}").encode()
        with store.open_output_stream(path, compression=None) as out:
            out.write(gzip.compress(data) if gzipped(key) else data)
        return pd.DataFrame({"key": [key], "uri": [uri]})

    return cut_lineage(items.select("key", "ord", "item").groupBy("key").applyInPandas(run, "key string, uri string"))
