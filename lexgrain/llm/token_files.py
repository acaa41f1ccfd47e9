"""Token ids in binary files with Elias-Fano document boundaries.

Documents are dealt by range of id, encoded in id order and written as one file per range: the
ids of all documents one after another, then a footer with the document ids and the positions at
which documents end.  The positions form a rising sequence, which Elias-Fano coding keeps in about
``2 + log2(ids / documents)`` bits each: low bits side by side, high bits in unary, and the place of
every 256th one bit, so that any boundary is found by reading a few words.

A table of the finished files (``_manifest``) is written last.  A task that runs twice leaves a file
that the manifest doesn't name, and readers open only named files.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import shards
from lexgrain.session import discard

#: Documents between two remembered one bits.
_STEP = 256
_MAGIC = b"LXTOKEN1"
#: documents, ids, bytes of an id, bytes of the boundary section, magic
_TRAILER = struct.Struct("<QQQQ8s")
_HEAD = struct.Struct("<QQQ")
#: Ids read at once.
_READ_BYTES = 8 << 20

MANIFEST = "file string, first_id bigint, first_hash bigint, n_docs bigint, n_ids bigint"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class EliasFano:
    """A sequence of non-falling integers from 0 to ``universe``."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.universe = n, universe
        self.bits = self.low_bits(n, universe)
        self._low, self._high, self._ones = low, high, ones

    @staticmethod
    def low_bits(n: int, universe: int) -> int:
        """Low bits of each value: the logarithm of the mean gap."""
        return max((universe // n).bit_length() - 1, 0) if n else 0

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = np.asarray(values, np.uint64)
        bits = cls.low_bits(n, universe)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(n + (universe >> bits) + 1, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        return cls(n, universe, low, high, places[::_STEP].astype("<u8"))

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.universe, len(self._low))
        return b"".join([head, self._ones.tobytes(), self._low.tobytes(), self._high.tobytes()])

    @classmethod
    def from_buffer(cls, buffer) -> EliasFano:
        """A view of stored bytes; nothing is unpacked."""
        n, universe, size = _HEAD.unpack_from(buffer)
        at = _HEAD.size
        ones = np.frombuffer(buffer, "<u8", -(-n // _STEP), at)
        at += ones.nbytes
        low = np.frombuffer(buffer, np.uint8, size, at)
        high = np.frombuffer(buffer, np.uint8, -1, at + size)
        return cls(n, universe, low, high, ones)

    def select(self, i: int) -> int:
        """Value i: its high part from the place of one bit i, its low part from its slot."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self._ones[i // _STEP]), i % _STEP
        if left:
            place += 1
            byte = place >> 3
            word = int(self._high[byte]) >> (place & 7) << (place & 7)
            while (count := word.bit_count()) < left:
                left -= count
                byte += 1
                word = int(self._high[byte])
            for _ in range(left - 1):
                word &= word - 1
            place = (byte << 3) + (word & -word).bit_length() - 1
        first = i * self.bits
        taken = self._low[first >> 3 : (first + self.bits + 7) >> 3].tobytes()
        low = int.from_bytes(taken, "little") >> (first & 7) & ((1 << self.bits) - 1)
        return (place - i) << self.bits | low

    def values(self, begin: int, end: int) -> np.ndarray:
        """Values ``begin`` to ``end`` at once."""
        if begin >= end:
            return np.zeros(0, np.int64)
        from_place = int(self._ones[begin // _STEP])
        last = (end - 1) // _STEP + 1
        to_place = int(self._ones[last]) if last < len(self._ones) else len(self._high) * 8
        unary = np.unpackbits(self._high[from_place >> 3 : (to_place + 7) >> 3], bitorder="little")
        unary[: from_place & 7] = 0
        skipped = begin % _STEP
        places = np.flatnonzero(unary)[skipped : skipped + end - begin] + (from_place >> 3 << 3)
        high = (places - np.arange(begin, end)) << self.bits
        first = begin * self.bits
        packed = self._low[first >> 3 : (end * self.bits + 7) >> 3]
        flat = np.unpackbits(packed, bitorder="little")[first & 7 :][: (end - begin) * self.bits]
        low = flat.reshape(end - begin, self.bits).astype(np.int64) @ (1 << np.arange(self.bits, dtype=np.int64))
        return high | low


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, from inside a task."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class TokenFileWriter:
    """Writes one file; only the ends and ids of its documents are held."""

    def __init__(self, path: str, width: int):
        system, place = _place(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        self._out, self.width = system.open_output_stream(place), width
        self._ends: list[np.ndarray] = []
        self._doc_ids: list[np.ndarray] = []
        self._nulls: list[np.ndarray] = []
        self.n_docs = self.n_ids = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self._out.write(np.ascontiguousarray(ids, dtype=f"<u{self.width}").tobytes())
        self._ends.append(ends + self.n_ids)
        self._doc_ids.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False))
        self._nulls.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.n_docs += len(ends)
        self.n_ids += len(ids)

    def close(self) -> None:
        bounds = EliasFano.of(np.concatenate(self._ends), self.n_ids).to_bytes()
        self._out.write(np.concatenate(self._doc_ids).astype("<i8").tobytes())
        self._out.write(np.packbits(np.concatenate(self._nulls), bitorder="little").tobytes())
        self._out.write(bounds)
        self._out.write(_TRAILER.pack(self.n_docs, self.n_ids, self.width, len(bounds), _MAGIC))
        self._out.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        system, place = _place(path)
        self._file = system.open_input_file(place)
        size = self._file.size()
        trailer = self._file.read_at(_TRAILER.size, size - _TRAILER.size)
        self.n_docs, self.n_ids, self.width, n_bounds, magic = _TRAILER.unpack(trailer)
        if magic != _MAGIC:
            raise ValueError(f"{path} is not a token file")
        bounds = self._file.read_at(n_bounds, size - _TRAILER.size - n_bounds)
        self.ends = EliasFano.from_buffer(bounds)
        names = self._file.read_at(8 * self.n_docs, self.n_ids * self.width)
        flags = self._file.read_at(-(-self.n_docs // 8), self.n_ids * self.width + 8 * self.n_docs)
        null = np.unpackbits(np.frombuffer(flags, np.uint8), count=self.n_docs, bitorder="little")
        self.doc_ids = pa.array(np.frombuffer(names, "<i8"), pa.int64(), mask=null.astype(bool))

    def span(self, document: int) -> tuple[int, int]:
        """Places of the document's first id and of the one after its last."""
        return self.ends.select(document - 1) if document else 0, self.ends.select(document)

    def ids(self, begin: int, end: int) -> np.ndarray:
        data = self._file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, document: int) -> np.ndarray:
        return self.ids(*self.span(document))

    def batches(self, most_bytes: int = _READ_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """``(doc_ids, starts, ids)`` of documents that follow each other, a bounded part at a time.

        ``starts`` has one place more than there are documents; a document longer than the bound
        comes alone.
        """
        room = max(most_bytes // 4, 1)
        begin, start = 0, 0
        while begin < self.n_docs:
            ends = self.ends.values(begin, min(begin + 65_536, self.n_docs))
            taken = max(int(np.searchsorted(ends, start + room, side="right")), 1)
            starts = np.concatenate([[start], ends[:taken]])
            yield self.doc_ids.slice(begin, taken), starts, self.ids(start, int(starts[-1]))
            begin, start = begin + taken, int(starts[-1])


def write_token_files(
    docs: DataFrame,
    path: str,
    encoder: Callable[[], object],
    end_id: int,
    width: int | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write the token ids of all documents below ``path``, a folder that all executors share.

    ``encoder()`` is called once in each task, see ``pack``.  Every document is followed by
    ``end_id``, so null and empty texts are one id.  Documents follow each other by id, null ids
    first, equal ids by a hash of their text; repeated rows are written each.  ``width`` is the
    number of bytes of an id; by default 2 where the vocabulary (``size``) allows it, else 4.  An empty table gives a manifest without files.  The texts are
    shuffled once, by range; equal ids may lie in different files if their texts differ.
    """
    from lexgrain.llm.bpe import BATCH_BYTES

    folder = path.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer, name, first = None, None, "", (None, 0)
        for shard in shards(batches, most_bytes=BATCH_BYTES):
            if writer is None:
                made = encoder()
                name = f"part-{uuid.uuid4().hex}.tok"
                writer = TokenFileWriter(f"{folder}/{name}", width or (2 if made.size <= 1 << 16 else 4))
                first = (shard.column("doc_id")[0].as_py(), shard.column("_hash")[0].as_py())
            ids, ends = made.encode(shard.column("text"))
            marked = np.insert(ids, ends, end_id)
            writer.add(shard.column("doc_id").cast(pa.int64()), marked, ends + np.arange(1, len(ends) + 1))
        if writer is not None:
            writer.close()
            row = [[name], [first[0]], [first[1]], [writer.n_docs], [writer.n_ids]]
            names = ["file", "first_id", "first_hash", "n_docs", "n_ids"]
            types = [pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], names=names)

    text = F.col(text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_hash")
    )
    ordered = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")


def token_file_places(spark: SparkSession, path: str) -> DataFrame:
    """The manifest with ``base``, the ids of all files before each.

    One narrow row a file is numbered in one task; a file holds a whole range of documents.
    """
    files = spark.read.parquet(f"{path.rstrip('/')}/_manifest")
    order = Window.orderBy(F.col("first_id").asc_nulls_first(), "first_hash")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``TOKENS`` of each document: ids as little-endian unsigned 32-bit, ``start`` over all files.

    A task opens its files one after another and holds a few megabytes of ids, or one document.
    """
    folder = path.rstrip("/")
    places = token_file_places(spark, path).select("file", "base")
    n_files = spark.read.parquet(f"{folder}/_manifest").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                for doc_ids, starts, ids in TokenFile(f"{folder}/{name}").batches():
                    data = np.ascontiguousarray(ids, dtype="<u4")
                    bounds = ((starts - starts[0]) * 4).astype(np.int64)
                    column = pa.LargeBinaryArray.from_buffers(
                        pa.large_binary(), len(doc_ids), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)]
                    )
                    yield pa.RecordBatch.from_arrays(
                        [
                            doc_ids,
                            pa.array(starts[:-1] + base, pa.int64()),
                            pa.array(np.diff(starts), pa.int64()),
                            column.cast(pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return places.repartition(max(n_files, 1)).mapInArrow(run, TOKENS)


def remove_token_files(spark: SparkSession, path: str) -> None:
    discard(spark, path)
