"""Order-preserving packing of token streams by dynamic programming.

The documents of a partition form one stream.  Windows of at most ``capacity`` tokens are cut from
it in order; a dynamic program chooses the cuts so that padding plus cut penalties are smallest.
Cuts at the end of a document are free, at the end of a sentence cheap, elsewhere dear.  The cost of
a window depends on its length only, so the best predecessor within reach is a sliding minimum,
which a monotone queue gives in constant time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import shards

PACKED = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


@dataclass(frozen=True)
class PackingCosts:
    """Costs in tokens.  ``whole_powers``: a window whose length is a power of two isn't padded."""

    capacity: int = 1024
    sentence_cut: int = 2
    other_cut: int = 8
    other_step: int = 16
    whole_powers: bool = False
    block_tokens: int = 1 << 20


def cut_candidates(
    n: int, document_ends: np.ndarray, sentence_ends: np.ndarray, costs: PackingCosts
) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, penalties)`` in ascending order, from 0 to n.

    Where sentences are long, places every ``other_step`` tokens fill the gaps.
    """
    step = min(costs.other_step, costs.capacity)
    natural = np.unique(np.concatenate([[0, n], document_ends, sentence_ends]))
    extra = np.maximum(np.diff(natural) - 1, 0) // step  # places to fill in each gap
    nth = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    fill = np.repeat(natural[:-1], extra) + nth * step
    positions = np.sort(np.concatenate([natural, fill])).astype(np.int64)
    penalties = np.full(len(positions), costs.other_cut, np.int64)
    penalties[np.searchsorted(positions, sentence_ends)] = costs.sentence_cut
    penalties[np.searchsorted(positions, document_ends)] = 0
    penalties[[0, -1]] = 0
    return positions, penalties


def best_cuts(positions: np.ndarray, penalties: np.ndarray, costs: PackingCosts) -> np.ndarray:
    """The cut positions (first and last included) of smallest total cost.

    ``cost[j] = penalty[j] + min(cost[i] + capacity - (p[j] - p[i]))`` over all i within reach, so
    the queue holds indices of ascending position and ascending ``cost[i] + p[i]``.
    """
    capacity = costs.capacity
    powers: list[list[int]] = []
    if costs.whole_powers:
        powers = [[] for _ in positions]
        for k in range((capacity - 1).bit_length()):
            wanted = positions - (1 << k)
            at = np.searchsorted(positions, wanted)
            for j in np.flatnonzero(positions[at] == wanted).tolist():
                powers[j].append(int(at[j]))
    p, pen = positions.tolist(), penalties.tolist()
    back = [0] * len(p)
    cost = [0] * len(p)
    keys, queue, head = [p[0]], [0], 0  # cost[i] + p[i] and i, from head on
    for j in range(1, len(p)):
        here = p[j]
        while p[queue[head]] < here - capacity:
            head += 1
        best = queue[head]
        value = keys[head] + capacity - here
        for i in powers[j] if powers else ():
            if cost[i] < value:
                value, best = cost[i], i
        value += pen[j]
        cost[j] = value
        back[j] = best
        key = value + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j)
    cuts = [len(p) - 1]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return positions[cuts[::-1]]


class _Packer:
    """Packs the stream of one partition block by block."""

    def __init__(self, costs: PackingCosts, closes: np.ndarray, first_sequence: int):
        self.costs, self.closes, self.sequence = costs, closes, first_sequence
        self.parts: list[tuple] = []  # doc_id, start in the document, ids, doc_tokens
        self.waiting = 0

    def add(self, doc_id, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = 0
        while start < len(ids):  # a block may end inside a long document
            room = self.costs.block_tokens - self.waiting
            part = ids[start : start + room]
            self.parts.append((doc_id, start, part, len(ids)))
            self.waiting += len(part)
            start += len(part)
            if self.waiting >= self.costs.block_tokens:
                yield self.flush()

    def flush(self) -> pa.RecordBatch:
        ids = np.concatenate([part for _, _, part, _ in self.parts])
        begins = np.cumsum([0] + [len(part) for _, _, part, _ in self.parts])
        whole = [s + len(part) == n for _, s, part, n in self.parts]
        sentence_ends = np.flatnonzero(self.closes[ids]) + 1
        candidates = cut_candidates(len(ids), begins[1:][whole], sentence_ends, self.costs)
        cuts = best_cuts(*candidates, self.costs)
        borders = np.unique(np.concatenate([begins, cuts]))
        left, right = borders[:-1], borders[1:]
        part_of = np.searchsorted(begins, left, side="right") - 1
        window = np.searchsorted(cuts, left, side="right") - 1
        starts = np.array([s for _, s, _, _ in self.parts])
        view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        sums = [
            zlib.crc32(view[4 * a : 4 * b])
            for a, b in zip(left.tolist(), right.tolist(), strict=True)
        ]
        names = [self.parts[i][0] for i in part_of.tolist()]
        sizes = np.array([n for _, _, _, n in self.parts])
        columns = {
            "doc_id": pa.array(names, pa.int64()),
            "start": starts[part_of] + left - begins[part_of],
            "length": right - left,
            "ids_crc32": pa.array(sums, pa.int64()),
            "doc_tokens": sizes[part_of],
            "sequence_id": self.sequence + window,
            "offset": left - cuts[window],
        }
        self.sequence += len(cuts) - 1
        self.parts, self.waiting = [], 0
        return pa.RecordBatch.from_pydict(
            {k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()}
        )


def pack(
    docs: DataFrame,
    encoder: Callable[[], object],
    end_id: int,
    costs: PackingCosts = PackingCosts(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece of a document in a sequence, see ``PACKED``.

    ``encoder()`` is called once in each task and returns an object with ``encode(texts) -> (ids,
    ends)`` and ``closes_sentence() -> table by id``.  Every document is followed by ``end_id``, so
    an empty or null text is one token.  Nothing is shuffled: the documents of a partition are packed
    in their order, and numbers of sequences begin anew at a multiple of 2**32 in every partition.
    Equal ids, repeated rows and null ids are packed like any other row; an empty table gives no row.
    Only the last window of a block of ``block_tokens`` can lack the choice of a good cut.
    """
    from lexgrain.llm.bpe import BATCH_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder()
        closes = made.closes_sentence()
        packer = _Packer(costs, closes, TaskContext.get().partitionId() << 32)
        for shard in shards(batches, most_bytes=BATCH_BYTES):
            ids, ends = made.encode(shard.column("text"))
            begin = 0
            for doc_id, end in zip(shard.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                tokens = np.empty(end - begin + 1, np.uint32)
                tokens[:-1], tokens[-1] = ids[begin:end], end_id
                yield from packer.add(doc_id, tokens)
                begin = end
        if packer.parts:
            yield packer.flush()

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, PACKED)
