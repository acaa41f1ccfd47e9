"""Token counts by the whole-token shortcut.

Offline, each vocabulary string is encoded alone; those that give exactly their own id are proven:
merging never ends elsewhere for a pre-token that equals one.  Counting a text is then one lookup
per pre-token, and only pre-tokens outside the proven set go through the merges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import shards, utf8
from lexgrain.llm.bpe import BATCH_BYTES, PATTERN, ByteBpe, distinct_pieces, loaded_bpe

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def proven_tokens(path: str) -> list[bytes]:
    """The vocabulary strings that the library encodes as exactly their own id.

    Strings that aren't UTF-8 alone are parts of characters and can't be whole pre-tokens.
    """
    bpe = ByteBpe(path)
    strings = {}
    for i, b in bpe.bytes_of.items():
        try:
            strings[i] = b.decode()
        except UnicodeDecodeError:
            continue
    encoded = bpe.library.encode_batch(list(strings.values()), add_special_tokens=False)
    return [t.encode() for (i, t), e in zip(strings.items(), encoded, strict=True) if e.ids == [i]]


@cache
def _pretoken_pattern():
    import regex

    return regex.compile(PATTERN)


def _merge(bpe: ByteBpe, texts: pa.Array) -> np.ndarray:
    return bpe.encode_pieces(texts.cast(pa.large_binary()))[2]


def count_pieces(pieces: pa.Array, proven: pa.Array, bpe: ByteBpe) -> np.ndarray:
    """Tokens of each distinct piece (a pre-token or a few of them).

    A piece that is a proven string counts one.  The others are cut into pre-tokens, of which the
    proven ones count one and the rest are merged, each distinct one once.  Pieces with special
    strings or characters that need the library are encoded whole by it.
    """
    whole = pc.is_in(pieces, value_set=proven).to_numpy(zero_copy_only=False)
    counts = np.ones(len(pieces), np.int64)
    rest = np.flatnonzero(~whole)
    taken = pieces.take(pa.array(rest))
    flat, offsets = utf8(taken)
    foreign = np.concatenate([[0], np.cumsum(flat >= 0xE2)])
    library = foreign[offsets[1:]] > foreign[offsets[:-1]]
    for content in bpe.special:
        library |= pc.match_substring(taken, content).to_numpy(zero_copy_only=False)
    if library.any():
        counts[rest[library]] = _merge(bpe, taken.filter(pa.array(library)))
    find = _pretoken_pattern().findall
    parts = [find(p.decode()) for p in taken.filter(pa.array(~library)).to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    tokens = pa.array([t.encode() for p in parts for t in p], pa.large_binary())
    encoded = pc.dictionary_encode(tokens)
    values = encoded.dictionary
    known = pc.is_in(values, value_set=proven).to_numpy(zero_copy_only=False)
    by_value = np.ones(len(values), np.int64)
    if not known.all():
        by_value[~known] = _merge(bpe, values.filter(pa.array(~known)))
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    counts[rest[~library]] = np.bincount(
        owner, weights=by_value[codes] if len(codes) else None, minlength=len(parts)
    )
    return counts


def token_counts(
    spark: SparkSession,
    docs: DataFrame,
    path: str,
    limit: int = 512,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of each row, as the library counts whole texts.

    No special tokens are added; special strings inside a text are one token each.  Null and empty
    texts have 0 bytes and tokens, repeated rows and null ids are counted like others, an empty
    table gives no row.  Nothing is shuffled.  The proven strings are broadcast: at most the
    vocabulary, whose size does not depend on the data.
    """
    proven = spark.sparkContext.broadcast(proven_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, known = loaded_bpe(path), pa.array(proven.value, pa.large_binary())
        for shard in shards(batches, most_bytes=BATCH_BYTES):
            codes, dictionary, rows = distinct_pieces(shard.column("text"))
            totals = np.concatenate([[0], np.cumsum(count_pieces(dictionary, known, bpe)[codes])])
            n_tokens = np.diff(totals[rows], prepend=0)
            n_bytes = np.diff(utf8(shard.column("text"))[1])
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("doc_id").cast(pa.int64()),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(n_tokens > limit),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, COUNTS)
