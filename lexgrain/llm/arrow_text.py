"""Arrow batches of text as flat byte buffers, for vectorised work inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text handled at once inside a task; a longer text is handled alone.
SHARD_BYTES = 4 << 20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; row i is ``bytes[offsets[i]:offsets[i + 1]]``.

    Null counts as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def shards(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = SHARD_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most_bytes`` of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            done = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + most_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
            pa.default_memory_pool().release_unused()


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each byte position."""
    return np.searchsorted(offsets, positions, side="right") - 1


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    values = values.copy()
    values ^= values >> np.uint64(30)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


#: Key of the word hashes.  The corpus can't aim at a hash whose values are spread by a keyed digest.
_KEY = b"lexgrain words"


def piece_codes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """``(codes, distinct)`` of the pieces ``flat[start:end]``, which follow each other without overlap."""
    n = len(starts)
    borders = np.empty(2 * n + 1, np.int64)  # pieces and what lies between them in turn
    borders[0:-1:2], borders[1::2], borders[-1] = starts, ends, len(flat)
    parts = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), 2 * n, [None, pa.py_buffer(borders.tobytes()), pa.py_buffer(np.ascontiguousarray(flat))]
    )
    encoded = pc.dictionary_encode(parts.take(pa.array(np.arange(0, 2 * n, 2))))
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def piece_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each piece, as a table of two columns.

    Each distinct piece goes through a keyed cryptographic digest, so no arrangement of bytes makes
    different pieces collide.
    """
    codes, distinct = piece_codes(flat, starts, ends)
    digests = [hashlib.blake2b(p, digest_size=16, key=_KEY).digest() for p in distinct.to_pylist()]
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)[codes]


def sequence_hashes(values: np.ndarray, owner: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """Hash of each of n sequences: entry i is element ``place[i]`` of sequence ``owner[i]``.

    Entries are ordered by owner.  Every element is mixed with its place before the sum, so order
    counts and no products of places arise.
    """
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mixed(values ^ mixed(place.astype(np.uint64) + np.uint64(1))), out=sums[1:])
    borders = np.searchsorted(owner, np.arange(n + 1))
    sizes = np.diff(borders).astype(np.uint64)
    return mixed(sums[borders[1:]] - sums[borders[:-1]] + mixed(sizes))


def word_spans(is_word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; a run never crosses a row."""
    n = len(is_word)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends
