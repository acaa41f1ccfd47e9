"""Repeated passages by line hashing.

Texts are cut into units: lines, and sentences within lines.  Each is normalised to its words in
lower case and hashed, whatever stands before or after it.  What is looked up are stretches of
units that hold ``least_words`` words and would not without their first or last unit: their digests
are grouped over the whole corpus, and of equal stretches the earliest by document id and place
stays.  Stretches that overlap or touch and repeat units that follow each other in one and the same
earlier document form a passage, so every passage stands as a whole at its source.  Offsets always
refer to the original text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import piece_hashes, sequence_hashes, shards, utf8, word_spans
from lexgrain.session import kept_table

LEAST_WORDS = 20
#: Hashing holds about 60 bytes for each byte of a shard.
_SHARD_BYTES = 2 << 20
_STRETCHES = (
    "high bigint, low bigint, doc_id bigint, text_key int, unit int, n_units int, word int, words int, "
    "start int, end int"
)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_ENDS_SENTENCE = np.zeros(256, bool)
_ENDS_SENTENCE[[0x21, 0x2E, 0x3F]] = True


def units_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """Units with a word in them: row, two 64-bit hashes, span in code points, words, number in the text.

    ``text_key`` has a hash of each text.
    """
    flat, offsets = utf8(texts)
    n = len(flat)
    low = _LOWER[flat]
    is_word = _IS_WORD[low]
    starts, ends = word_spans(is_word, offsets)
    # A unit ends after a line break and after a sentence mark that white space follows.
    cut = np.zeros(n + 1, bool)
    if n > 1:
        space = (flat[1:] == 0x20) | (flat[1:] == 0x09)
        cut[1:-1] = _ENDS_SENTENCE[flat[:-1]] & space
        cut[1:] |= flat == 0x0A
    cut[offsets] = True
    borders = np.flatnonzero(cut)
    begin, end = borders[:-1], borders[1:]
    hashes = piece_hashes(low, starts, ends)
    first_word = np.searchsorted(starts, begin)
    words = np.searchsorted(starts, end) - first_word
    unit = np.repeat(np.arange(len(begin)), words)
    place = np.arange(len(starts)) - first_word[unit]
    high, second = (sequence_hashes(hashes[:, k], unit, place, len(begin)) for k in (0, 1))
    point = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
    row = np.searchsorted(offsets, begin, side="right") - 1
    base = point[offsets[row]]
    kept = words > 0
    row = row[kept]
    first = np.searchsorted(row, row)  # the place of each text's first unit
    whole = pa.Array.from_buffers(
        pa.large_binary(), len(texts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(flat))]
    )
    text_key = np.array([hash_of_text(t) for t in whole.to_pylist()], np.int32)
    return {
        "row": row,
        "high": high[kept],
        "low": second[kept],
        "start": (point[begin] - base)[kept],
        "end": (point[end] - base)[kept],
        "words": words[kept],
        "unit": np.arange(len(row)) - first,
        "text_key": text_key[row] if len(row) else np.zeros(0, np.int32),
    }


def hash_of_text(text: bytes) -> int:
    """Tells texts under one id apart."""
    return zlib.crc32(text) - (1 << 31)


def stretches_of(units: dict[str, np.ndarray], least_words: int) -> dict[str, np.ndarray]:
    """The least stretches of units with enough words, from every unit on and up to every unit."""
    row, words = units["row"], units["words"]
    n = len(row)
    ends = np.cumsum(words)
    begins = ends - words
    each = np.arange(n)
    last = np.minimum(np.searchsorted(ends, begins + least_words), n)
    forward = last < n
    forward[forward] = row[last[forward]] == row[forward]
    first = np.searchsorted(begins, ends - least_words, side="right") - 1
    backward = first >= 0
    backward[backward] = row[first[backward]] == row[backward]
    pairs = np.concatenate([each[forward] * n + last[forward], first[backward] * n + each[backward]])
    i, k = np.divmod(np.unique(pairs), max(n, 1))
    sizes = k - i + 1
    owner = np.repeat(np.arange(len(i)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    unit = i[owner] + place
    first_of_text = begins[each - units["unit"]]
    return {
        "high": sequence_hashes(units["high"][unit], owner, place, len(i)).view(np.int64),
        "low": sequence_hashes(units["low"][unit], owner, place, len(i)).view(np.int64),
        "row": row[i],
        "text_key": units["text_key"][i],
        "unit": units["unit"][i],
        "n_units": sizes,
        "word": (begins - first_of_text)[i],
        "words": ends[k] - begins[i],
        "start": units["start"][i],
        "end": units["end"][k],
    }


def _stretches(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, most_bytes=_SHARD_BYTES):
            found = stretches_of(units_of(shard.column("text")), least_words)
            small = ["text_key", "unit", "n_units", "word", "words", "start", "end"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found["high"]),
                    pa.array(found["low"]),
                    shard.column("doc_id").cast(pa.int64()).take(pa.array(found["row"])),
                    *(pa.array(found[c], pa.int32()) for c in small),
                ],
                names=["high", "low", "doc_id", *small],
            )

    return run


def repeated_passages(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, start, end, n_units, n_words, first_doc_ids, first_unit)``, a row per passage to remove.

    ``start`` and ``end`` are code points of the original text; ``first_doc_ids`` holds the document
    whose occurrence stays, and ``first_unit`` the number of the unit with words at which it begins
    there.  Passages of one document may overlap where parts have different sources.  Documents without
    repeats have no row.  Null and empty texts have no units; a null id ranks last; rows that share
    an id and text count as one occurrence, so a repeated row is not a repeat of itself; an empty
    table gives no row.

    Digests are combined before the shuffle.  The first occurrences of repeated ones are written to the
    shared folder and joined from there, so that Spark can split the rows of a stretch that stands in
    a third of all documents among tasks.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    stretches = rows.mapInArrow(_stretches(least_words), _STRETCHES)
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "unit", "text_key")
    first = (
        stretches.groupBy("high", "low")
        .agg(F.min(rank).alias("first"), F.count("*").alias("_many"))
        .where("_many > 1")
        .select("high", "low", "first")
    )
    first = kept_table(first, "passage-sources")
    repeats = stretches.join(first, ["high", "low"]).where(rank != F.col("first"))
    repeats = repeats.drop("high", "low").select(
        "*",
        F.col("first.doc_id").alias("_source"),
        F.col("first.text_key").alias("_source_key"),
        (F.col("first.unit") - F.col("unit")).alias("_shift"),
    )
    source = ["doc_id", "text_key", "_source", "_source_key", "_shift"]
    before = Window.partitionBy(*source).orderBy("unit", "n_units")
    reach = F.max(F.col("unit") + F.col("n_units")).over(before.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("unit") > reach, 1).otherwise(0)
    passages = (
        repeats.withColumn("_apart", apart)
        .withColumn("_passage", F.sum("_apart").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*source, "_passage")
        .agg(
            F.min("start").cast("bigint").alias("start"),
            F.max("end").cast("bigint").alias("end"),
            (F.max(F.col("unit") + F.col("n_units")) - F.min("unit")).cast("bigint").alias("n_units"),
            (F.max(F.col("word") + F.col("words")) - F.min("word")).cast("bigint").alias("n_words"),
            F.min("first.unit").cast("bigint").alias("first_unit"),
        )
    )
    return passages.select(
        "doc_id", "start", "end", "n_units", "n_words", F.array("_source").alias("first_doc_ids"), "first_unit"
    )


def without_repeats(
    docs: DataFrame,
    least_words: int = LEAST_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``docs`` with repeated passages cut out of the text; ids must be unique and not null."""
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    passages = (
        repeated_passages(docs, least_words, id_column, text_column)
        .withColumn("_reach", F.coalesce(F.max("end").over(before), F.lit(0)))
        .where("end > _reach")
        .select("doc_id", F.greatest("start", "_reach").alias("start"), "end")
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__cuts"))
    )
    joined = docs.join(passages, docs[id_column] == passages["__id"], "left")
    text, cuts = docs[text_column], F.col("__cuts")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.col("__cuts.end"))
    ends = F.concat(F.col("__cuts.start"), F.array(F.char_length(text).cast("bigint")))
    kept = F.zip_with(
        starts, ends, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    )
    cleaned = F.when(cuts.isNull(), text).otherwise(F.array_join(kept, "")).alias(text_column)
    return joined.select(*(cleaned if c == text_column else docs[c] for c in docs.columns))
