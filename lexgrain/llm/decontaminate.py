"""Benchmark decontamination by suffix arrays over shards of the training text.

Words of a shard become symbols of the benchmark's vocabulary; a word outside it ends every match.
The shard's suffixes that can still hold a window are sorted into a suffix array, cut at the length
of a window.  Every test suffix is then looked up by binary search, for all of them at once, and
matches that continue each other are joined into longest verbatim matches with their places.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import piece_codes, shards, utf8, word_spans
from lexgrain.session import new_scratch_path

WINDOW_WORDS = 13
#: Benchmark text in one block; a larger benchmark is looked up block after block.
BLOCK_BYTES = 4 << 20
#: Training text for which a task reads the blocks once.
SWEEP_BYTES = 64 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Fixed: bytes of words after lower-casing, the complement of the contract's class.
_IS_WORD = np.ones(256, bool)
_IS_WORD[0x00:0x30] = _IS_WORD[0x3A:0x61] = _IS_WORD[0x7B:0x80] = False


@dataclass
class Words:
    """The words of some texts as numbers of their ``distinct`` spellings.

    ``rows[i]`` is the number of words up to the end of text i.
    """

    codes: np.ndarray
    distinct: pa.Array
    rows: np.ndarray

    def symbols(self, vocabulary: pa.Array) -> np.ndarray:
        """One more than each word's place in the vocabulary, compared by bytes, or 0."""
        found = pc.fill_null(pc.index_in(self.distinct, value_set=vocabulary), -1)
        return (found.to_numpy(zero_copy_only=False) + 1).astype(np.uint32)[self.codes]


def words_of(texts: pa.Array) -> Words:
    flat, offsets = utf8(texts)
    low = _LOWER[flat]
    starts, ends = word_spans(_IS_WORD[low], offsets)
    return Words(*piece_codes(low, starts, ends), np.searchsorted(starts, offsets[1:], side="left"))


@dataclass
class TestSuffixes:
    """The windows of one block of test items: every suffix, cut at the window's length.

    ``keys`` are the distinct windows as big-endian symbols, padded with zeros, ``lengths`` the words
    of each, and ``least[s]`` the length of the shortest window that begins with symbol s.  The items
    of window k are ``owners[borders[k]:borders[k + 1]]``, numbers of the block's ``names``.
    """

    names: list[str]
    vocabulary: pa.Array
    keys: np.ndarray
    lengths: np.ndarray
    owners: np.ndarray
    borders: np.ndarray
    least: np.ndarray
    width: int

    def items(self, window: int) -> np.ndarray:
        return self.owners[self.borders[window] : self.borders[window + 1]]

    def tops(self) -> np.ndarray:
        """Each key followed by the largest possible symbols."""
        table = self.keys.view(">u4").reshape(len(self.keys), self.width // 4)
        after = np.arange(table.shape[1]) >= self.lengths[:, None]
        return np.ascontiguousarray(np.where(after, 0xFFFFFFFF, table).astype(">u4")).view(f"S{self.width}").ravel()


def test_suffixes(names: list[str], texts: list[str | None], window: int = WINDOW_WORDS) -> TestSuffixes:
    words = words_of(pa.array(texts, pa.string()))
    symbols = words.codes + 1
    begins = np.concatenate([[0], words.rows[:-1]]).astype(np.int64)
    sizes = np.minimum(window, words.rows - begins)
    counts = np.where(sizes > 0, words.rows - begins - sizes + 1, 0)
    item = np.repeat(np.arange(len(sizes)), counts)
    starts = begins[item] + np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = sizes[item]
    steps = np.arange(max(int(size.max(initial=1)), 1))
    places = np.minimum(starts[:, None] + steps, max(len(symbols) - 1, 0))
    inside = steps < size[:, None]
    table = np.where(inside, symbols[places] if len(symbols) else 0, 0).astype(">u4")
    width = len(steps) * 4
    keys, first, of = np.unique(
        np.ascontiguousarray(table).view(f"S{width}").ravel(), return_index=True, return_inverse=True
    )
    pairs = np.unique(np.stack([of, item]), axis=1)
    borders = np.searchsorted(pairs[0], np.arange(len(keys) + 1))
    least = np.full(len(words.distinct) + 1, np.iinfo(np.int64).max)
    if len(item):
        np.minimum.at(least, symbols[starts], size)
    return TestSuffixes(names, words.distinct, keys, size[first], pairs[1].astype(np.int32), borders, least, width)


def suffix_array(words: Words, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """``(sorted suffixes, their word positions)`` of a shard.

    Left out are only suffixes that can't begin with any window: a run of known words shorter than
    the shortest window with the same first word.
    """
    n, rows = len(words.codes), words.rows
    if not n or not len(test.vocabulary):
        return np.zeros(0, f"S{test.width}"), np.zeros(0, np.int64)
    symbols = words.symbols(test.vocabulary)
    # A run of known words ends at the next unknown word or start of a text.
    border = np.full(n + 1, n, np.int64)
    unknown = np.flatnonzero(symbols == 0)
    border[unknown] = unknown
    border[rows] = rows
    next_border = np.minimum.accumulate(border[::-1])[::-1]
    run = np.where(symbols == 0, 0, next_border[1:] - np.arange(n))
    starts = np.flatnonzero(run >= test.least[symbols])
    steps = np.arange(test.width // 4)
    places = np.minimum(starts[:, None] + steps, n - 1)
    table = np.where(steps < run[starts][:, None], symbols[places], 0).astype(">u4")
    suffixes = np.ascontiguousarray(table).view(f"S{test.width}").ravel()
    order = np.argsort(suffixes, kind="stable")
    return suffixes[order], starts[order]


@dataclass
class Matches:
    """Occurrences of windows in a shard: word position, number of the window, words in it."""

    positions: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray


def find_windows(words: Words, test: TestSuffixes) -> Matches:
    suffixes, positions = suffix_array(words, test)
    low = np.searchsorted(suffixes, test.keys, side="left")
    # The last suffix that begins with a key.
    high = np.searchsorted(suffixes, test.tops(), side="right")
    counts = high - low
    windows = np.repeat(np.arange(len(counts)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return Matches(positions[np.repeat(low, counts) + nth], windows, test.lengths[windows])


def _spans(found: Matches, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hit words as maximal ``[start, end)`` runs; a window never leaves its text."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, found.positions, 1)
    np.add.at(edges, found.positions + found.lengths, -1)
    hit = np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(hit)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


@dataclass
class ShardHits:
    """For each row of a shard: words, hit spans in words, items, longest verbatim match."""

    n_words: np.ndarray
    spans: list[list[tuple[int, int]]]
    items: list[set[str]]
    longest: np.ndarray


class ShardSearch:
    """The words of a shard and what the blocks looked up so far have found in it."""

    def __init__(self, texts: pa.Array):
        self.words = words_of(texts)
        self._items: list[set[str]] = [set() for _ in self.words.rows]
        self._found: list[Matches] = []
        self._longest = np.zeros(len(self.words.rows), np.int64)

    def look_up(self, test: TestSuffixes) -> None:
        found = find_windows(self.words, test)
        of = np.searchsorted(self.words.rows, found.positions, side="right")
        pairs = np.unique(np.stack([of, found.windows]), axis=1) if len(of) else np.zeros((2, 0), int)
        for row, window in pairs.T.tolist():
            self._items[row].update(test.names[i] for i in test.items(window))
        _longest_matches(found, of, test, self._longest)
        self._found.append(found)

    def hits(self) -> ShardHits:
        rows = self.words.rows
        begins = np.concatenate([[0], rows[:-1]]).astype(np.int64)
        spans: list[list[tuple[int, int]]] = [[] for _ in rows]
        nothing = Matches(*(np.zeros(0, np.int64) for _ in range(3)))
        everywhere = Matches(
            *(np.concatenate(parts) for parts in zip(*(vars(m).values() for m in [nothing, *self._found]), strict=True))
        )
        for start, end in zip(*(x.tolist() for x in _spans(everywhere, len(self.words.codes))), strict=True):
            row = int(np.searchsorted(rows, start, side="right"))
            # A run may go on into the next text where both are hit up to their border.
            while start < end:
                stop = min(end, int(rows[row]))
                if stop > start:
                    spans[row].append((start - int(begins[row]), stop - int(begins[row])))
                start, row = max(start, stop), row + 1
        return ShardHits(rows - begins, spans, self._items, self._longest)


def _longest_matches(found: Matches, of: np.ndarray, test: TestSuffixes, longest: np.ndarray) -> None:
    """Words of the longest run in which a window of one item follows another of the same item."""
    if not len(of):
        return
    order = np.lexsort((found.positions, of))
    last: dict[int, tuple[int, int]] = {}
    row = -1
    for k in order.tolist():
        if of[k] != row:
            row, last = int(of[k]), {}
        here, size = int(found.positions[k]), int(found.lengths[k])
        for item in test.items(int(found.windows[k])).tolist():
            begin, end = last.get(item, (here, here))
            begin = begin if end == here + size - 1 and size == WINDOW_WORDS else here
            last[item] = (begin, here + size)
            longest[row] = max(longest[row], here + size - begin)


def _written_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> str:
    """Build the blocks in tasks, one row each, and write them to the shared folder.

    Only the number of bytes reaches the driver.  Items are dealt by their hash, equal rows once.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("name"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    held = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        texts: list[str] = []
        size = 0

        def block() -> pa.RecordBatch:
            payload = pickle.dumps(test_suffixes(names, texts))
            return pa.RecordBatch.from_arrays([pa.array([payload], pa.binary())], names=["block"])

        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and size + len(text) > block_bytes:
                    yield block()
                    names, texts, size = [], [], 0
                names.append(name)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    path = new_scratch_path(spark, "benchmark-blocks")
    dealt = items.distinct().repartition(max(1, -(-held // block_bytes)), F.xxhash64("name", "text"))
    dealt.mapInArrow(build, "block binary").write.parquet(path)
    return path


def _places(path: str) -> list[tuple[fs.FileSystem, str]]:
    """File system and name of the files of blocks, in a fixed order."""
    system, root = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    found = system.get_file_info(fs.FileSelector(root))
    return [(system, file) for file in sorted(f.path for f in found if f.path.endswith(".parquet"))]


@lru_cache(maxsize=1)
def _only_block(path: str) -> TestSuffixes | None:
    """The block of a benchmark that has one, kept by the worker; None if there are several."""
    blocks = list(islice(_stored_blocks(path), 2))
    if not blocks:
        return test_suffixes([], [])
    return blocks[0] if len(blocks) == 1 else None


def _stored_blocks(path: str) -> Iterator[TestSuffixes]:
    for system, file in _places(path):
        with system.open_input_file(file) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1, columns=["block"]):
                for payload in batch.column("block"):
                    yield pickle.loads(payload.as_buffer())


def _blocks(path: str) -> Iterator[TestSuffixes]:
    only = _only_block(path)
    if only is not None:
        yield only
    else:
        yield from _stored_blocks(path)


def _searched(
    batches: Iterator[pa.RecordBatch], text: str, path: str
) -> Iterator[tuple[pa.RecordBatch, ShardHits]]:
    """Shards with their hits.  All blocks are read once for ``SWEEP_BYTES`` of text, one at a time."""
    sweep: list[tuple[pa.RecordBatch, ShardSearch]] = []
    held = 0

    def searched() -> Iterator[tuple[pa.RecordBatch, ShardHits]]:
        for test in _blocks(path):
            for _, search in sweep:
                search.look_up(test)
        for shard, search in sweep:
            yield shard, search.hits()

    for shard in shards(batches, text):
        size = shard.column(text).nbytes
        if sweep and held + size > SWEEP_BYTES:
            yield from searched()
            sweep, held = [], 0
        sweep.append((shard, ShardSearch(shard.column(text))))
        held += size
    if sweep:
        yield from searched()


REPORT = (
    "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
    "contaminated boolean, longest_match bigint, spans array<struct<start:bigint,end:bigint>>"
)
_REPORT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("n_items", pa.int64()),
        ("items_sha256", pa.string()),
        ("contaminated", pa.bool_()),
        ("longest_match", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)


def _is_contaminated(n_hit: int, n_words: int, one_in: int) -> bool:
    return n_hit > 0 and one_in * n_hit >= n_words


def contamination(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    one_in: int = 20,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document, see ``REPORT``; ``spans`` are its hit words.

    A window is 13 consecutive words of an item, or the whole item if it has fewer.  Null and empty
    texts have no words and no hits; null ids and repeated rows are judged like others; items with
    one id count once, an item without id counts as ``null``; an empty benchmark hits nothing.
    No document is shuffled: each is judged where it is read.  Tasks build the blocks of the benchmark
    in the shared folder, and read one at a time.
    """
    path = _written_blocks(benchmark, item_column, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, hits in _searched(batches, "text", path):
            n_hit = [sum(e - s for s, e in spans) for spans in hits.spans]
            found = [sorted(items) for items in hits.items]
            n_words = hits.n_words.tolist()
            columns = [
                shard.column("doc_id").cast(pa.int64()),
                n_words,
                n_hit,
                [len(x) for x in found],
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found],
                [_is_contaminated(h, w, one_in) for h, w in zip(n_hit, n_words, strict=True)],
                hits.longest,
                [[{"start": s, "end": e} for s, e in spans] for spans in hits.spans],
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    c if isinstance(c, pa.Array) else pa.array(c, f.type)
                    for c, f in zip(columns, _REPORT_ARROW, strict=True)
                ],
                schema=_REPORT_ARROW,
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, REPORT)


def drop_contaminated(
    spark: SparkSession,
    docs: DataFrame,
    benchmark: DataFrame,
    one_in: int = 20,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    path = _written_blocks(benchmark, item_column, item_text, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, hits in _searched(batches, text_column, path):
            clean = [
                not _is_contaminated(sum(e - s for s, e in spans), n, one_in)
                for spans, n in zip(hits.spans, hits.n_words.tolist(), strict=True)
            ]
            yield shard.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
