"""JSON array files cut among tasks.

Spark's text source cuts a file at any separator, and a JSON array is full of commas.  Each block of a
file is therefore read as the stretches between its commas, by one task, whatever the commas mean.
What they mean depends on the text before: a block is summarised by what it does to a reader that
enters it inside or outside a string (the state it leaves in, the change of nesting depth, commas by
depth).  Summaries are composed along each file, which gives every block its state, depth and the
number of elements before it.  A second pass cuts the elements; those that lie across blocks are put
together by their number.

A comma is never escaped, so no run of backslashes reaches across one, and whether a quote is escaped
can be seen without leaving its stretch.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMA, _QUOTE, _BACKSLASH = 0x2C, 0x22, 0x5C
_STEP = np.zeros(256, np.int8)
_STEP[[0x5B, 0x7B]] = 1
_STEP[[0x5D, 0x7D]] = -1
#: The start of a file tells where elements lie: in the array, or in the array of this key.
_HEAD_BYTES = 256
_LIST = re.compile(rb"\s*\[")
_OBJECT = re.compile(rb'\s*\{\s*"sentences"\s*:\s*\[')
_SUMMARY = "file string, block bigint, odd boolean, outside string, inside string, head binary"
_STATES = "file string, block bigint, in_string boolean, depth int, first bigint, level int"
_PARTS = "file string, index bigint, block bigint, whole boolean, element string"


def _stretches(column: pa.Array) -> np.ndarray:
    """The bytes of the stretches with the comma behind each."""
    data = column.cast(pa.large_binary())
    _, ends, values = data.buffers()
    n = len(data)
    offsets = np.frombuffer(ends, np.int64)[data.offset : data.offset + n + 1]
    flat = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    out = np.full(len(flat) + n, _COMMA, np.uint8)
    taken = np.ones(len(out), bool)
    taken[offsets[1:] - offsets[0] + np.arange(n)] = False
    out[taken] = flat
    return out


def _scan(flat: np.ndarray, in_string: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """``(outside, step, in_string)``: which bytes lie outside of strings, and their change of depth."""
    index = np.arange(len(flat))
    other = np.maximum.accumulate(np.where(flat == _BACKSLASH, -1, index)) if len(flat) else index
    run = np.zeros(len(flat), np.int64)  # backslashes right before each byte
    run[1:] = index[:-1] - other[:-1]
    quotes = (flat == _QUOTE) & (run % 2 == 0)
    parity = (np.cumsum(quotes) + in_string) % 2
    outside = (parity == 0) & ~quotes
    return outside, np.where(outside, _STEP[flat], 0), bool(parity[-1]) if len(flat) else in_string


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of each block in order; a batch may hold several blocks."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("file").dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        starts = batch.column("block").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            yield (names.dictionary[int(codes[a])].as_py(), int(starts[a])), batch.slice(a, b - a)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block: for a reader that enters outside and inside of a string."""
    key, state, head = None, [], b""

    def row() -> pa.RecordBatch:
        (file, block), odd = key, state[0]["in"]
        made = [json.dumps([s["depth"], sorted(s["commas"].items())]) for s in state]
        values = [[file], [block], [odd], [made[0]], [made[1]], [head if block == 0 else b""]]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
        arrays = [pa.array(v, t) for v, t in zip(values, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "odd", "outside", "inside", "head"])

    for name, rows in _blocks(batches):
        if name != key:
            if key is not None:
                yield row()
            key, head = name, b""
            state = [{"in": bool(k), "depth": 0, "commas": {}} for k in (0, 1)]
        flat = _stretches(rows.column("value"))
        head = (head + flat[:_HEAD_BYTES].tobytes())[:_HEAD_BYTES]
        for s in state:
            outside, step, s["in"] = _scan(flat, s["in"])
            depth = np.cumsum(step) + s["depth"]
            levels, counts = np.unique(depth[outside & (flat == _COMMA)], return_counts=True)
            for level, count in zip(levels.tolist(), counts.tolist(), strict=True):
                s["commas"][level] = s["commas"].get(level, 0) + count
            s["depth"] = int(depth[-1]) if len(depth) else s["depth"]
    if key is not None:
        yield row()


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """State, depth and elements before each block of a file."""
    blocks = blocks.sort_values("block")
    head = bytes(blocks["head"].iloc[0])
    level = 2 if _OBJECT.match(head) else 1 if _LIST.match(head) else 0
    if not level:
        raise ValueError(f"unknown document shape in {blocks['file'].iloc[0]}")
    in_string, depth, first, found = False, 0, 0, []
    for odd, outside, inside in zip(blocks["odd"], blocks["outside"], blocks["inside"], strict=True):
        found.append((in_string, depth, first))
        change, commas = json.loads(inside if in_string else outside)
        first += sum(n for at, n in commas if depth + at == level)
        depth += change
        in_string ^= bool(odd)
    if in_string or depth:
        raise ValueError(f"{blocks['file'].iloc[0]} ends inside of a value")
    states = pd.DataFrame(found, columns=["in_string", "depth", "first"])
    return pd.concat([blocks[["file", "block"]].reset_index(drop=True), states], axis=1).assign(level=level)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements and parts of elements; a part that goes on in another block isn't whole."""
    key, state, held = None, None, b""

    def parts(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names=["file", "index", "block", "whole", "element"])

    def rest() -> list[tuple]:
        inside = state["depth"] >= state["level"]
        return [(*key[:1], state["index"], key[1], False, held.decode())] if inside else []

    for name, rows in _blocks(batches):
        out: list[tuple] = []
        if name != key:
            if key is not None:
                out += rest()
            key = name
            first = rows.slice(0, 1).to_pylist()[0]
            state = {"in": first["in_string"], "depth": first["depth"], "index": first["first"], "level": first["level"]}
            state["whole"] = False  # the first element of a block may have begun before it
            held = b""
        flat = _stretches(rows.column("value"))
        outside, step, state["in"] = _scan(flat, state["in"])
        depth = np.cumsum(step) + state["depth"]
        level, text = state["level"], flat.tobytes()
        before = np.concatenate([[state["depth"]], depth[:-1]])
        opens = (before < level) & (depth == level)
        closes = (before == level) & (depth < level)
        ends = outside & (flat == _COMMA) & (depth == level)
        at = 0
        for place in np.flatnonzero(opens | closes | ends).tolist():
            if opens[place]:
                state["whole"], held = True, b""
            else:
                element = held + text[at:place]
                out.append((key[0], state["index"], key[1], state["whole"] and bool(ends[place] or closes[place]), element.decode()))
                held = b""
                state["whole"] = bool(ends[place])
                state["index"] += bool(ends[place])
            at = place + 1
        held = held + text[at:] if len(depth) and depth[-1] >= level else b""
        state["depth"] = int(depth[-1]) if len(depth) else state["depth"]
        if out:
            yield parts(out)
    if key is not None and (last := rest()):
        yield parts(last)


def read_array_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, index, element)``: the JSON texts of the elements of array files, cut among tasks.

    A file holds one array, or an object whose first key is ``sentences`` with an array; ``index``
    counts elements from 0 in each file.  Any other start, and a file that ends inside of a value, is
    an error.  The files are read twice.  What is kept of a block is one narrow row, so the table that
    is sent to all tasks has as many rows as the input has blocks of ``spark.sql.files.maxPartitionBytes``.
    A value between two commas must fit into memory, and so must an element.
    """
    text = spark.read.option("lineSep", ",").text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    states = rows.mapInArrow(_summarise, _SUMMARY).groupBy("file").applyInPandas(_composed, _STATES)
    parts = rows.join(F.broadcast(states), ["file", "block"]).mapInArrow(_cut, _PARTS)
    return _joined(parts)


def _joined(parts: DataFrame) -> DataFrame:
    """Whole elements as they are; the others by number, their parts in the order of blocks."""
    pieces = F.array_sort(F.collect_list(F.struct("block", "element")))
    across = (
        parts.where(~F.col("whole"))
        .groupBy("file", "index")
        .agg(F.array_join(F.transform(pieces, lambda p: p["element"]), "").alias("element"))
    )
    found = parts.where("whole").select("file", "index", "element").unionByName(across)
    # Only an empty array has an element without text.
    return found.where(F.trim(F.translate("element", "\n\r\t", "   ")) != "")
