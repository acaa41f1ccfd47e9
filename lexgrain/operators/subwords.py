"""Sub-word ids of fixed length by longest match, for batches of model inputs.

A vocabulary becomes a trie of flat sorted arrays: an edge is ``node * 256 + byte``, its child stands at
the same place of another array.  All byte positions of the distinct words of a stretch of an Arrow
batch walk the trie together, one binary search a step, so the steps are as many as the longest piece
has bytes.  Stretches are bounded in words and bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrain.functions.text import whitespace_tokens

#: The end of a word; this byte never occurs in UTF-8.
END = 0xFF
#: Words of a batch that are cut at once, and their bytes; a longer word is cut alone.
MOST_WORDS, MOST_BYTES = 1 << 18, 1 << 22
#: A larger vocabulary is refused, since every worker holds it.
MAX_PIECES = 1 << 20


@dataclass
class PieceTrie:
    """Pieces by longest match.

    With ``word_ends`` a piece may end in ``END``, which means the end of a word, and every word must
    end in such a piece.
    """

    edges: np.ndarray
    children: np.ndarray
    ids: np.ndarray
    depth: int
    word_ends: bool

    @classmethod
    def of(cls, pieces: Iterable[tuple[bytes, int]], max_pieces: int = MAX_PIECES) -> PieceTrie:
        """Of equal pieces the one with the smallest id stays; empty ones never match."""
        listed = sorted(p for p in pieces if p[0])
        if len(listed) > max_pieces:
            raise ValueError(f"{len(listed)} pieces; at most {max_pieces} are held by a worker")
        nodes: dict[bytes, int] = {b"": 0}
        edges: list[int] = []
        ids = [-1]
        for piece, number in listed:
            if piece in nodes and ids[nodes[piece]] >= 0:
                continue
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    edges.append(nodes[piece[: end - 1]] << 8 | piece[end - 1])
                    nodes[piece[:end]] = len(ids)
                    ids.append(-1)
            ids[nodes[piece]] = number
        order = np.argsort(np.array(edges, np.int64))
        return cls(
            np.array(edges, np.int64)[order],
            order + 1,
            np.array(ids, np.int64),
            max((len(p) for p, _ in listed), default=0),
            any(p[-1] == END for p, _ in listed),
        )

    def matches(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, id)`` of the longest piece at each position; no bytes where none matches."""
        sizes, found = np.zeros(len(flat), np.int64), np.full(len(flat), -1, np.int64)
        at = np.arange(len(flat))
        nodes = np.zeros(len(flat), np.int64)
        for step in range(self.depth if len(self.edges) else 0):
            inside = at + step < len(flat)
            at, nodes = at[inside], nodes[inside]
            wanted = nodes << 8 | flat[at + step]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            goes_on = self.edges[edge] == wanted
            at, nodes = at[goes_on], self.children[edge[goes_on]]
            ends = self.ids[nodes] >= 0
            if self.word_ends:  # a piece never leaves the end mark alone
                after = at + step + 1
                ends &= (flat[np.minimum(after, len(flat) - 1)] != END) | (flat[at + step] == END)
            sizes[at[ends]], found[at[ends]] = step + 1, self.ids[nodes[ends]]
        return sizes, found

    def words(self, words: list[bytes], unknown: int) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, borders)``: word w is ``ids[borders[w]:borders[w + 1]]``, ``unknown`` if it can't be cut."""
        flat = np.frombuffer(b"".join(w + bytes([END]) for w in words), np.uint8)
        sizes, found = self.matches(flat)
        stops = np.flatnonzero(flat == END)
        at = np.concatenate([[0], stops[:-1] + 1]).astype(np.int64) if len(words) else stops
        active = np.arange(len(words))
        fails = np.zeros(len(words), bool)
        of: list[np.ndarray] = [np.zeros(0, np.int64)]
        got: list[np.ndarray] = [np.zeros(0, np.int64)]
        while True:
            going = at < stops[active]
            active, at = active[going], at[going]
            if not len(active):
                break
            fits = sizes[at] > 0
            fails[active[~fits]] = True
            active, at = active[fits], at[fits]
            of.append(active)
            got.append(found[at])
            at = at + sizes[at]
        owner, ids = np.concatenate(of), np.concatenate(got)
        whole = ~fails[owner]
        owner = np.concatenate([owner[whole], np.flatnonzero(fails)])
        ids = np.concatenate([ids[whole], np.full(int(fails.sum()), unknown)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def read_pieces(path: str, end_suffix: str = "</w>") -> list[tuple[bytes, int]]:
    """Pieces of a vocabulary file of the ``tokenizers`` library with byte-level spelling.

    A piece that ends in ``end_suffix`` ends a word.
    """
    with open(path, encoding="utf-8") as source:
        vocabulary = json.load(source)["model"]["vocab"]
    letters = {c: b for b, c in enumerate(byte_letters())}
    pieces = []
    for piece, number in vocabulary.items():
        stem = piece.removesuffix(end_suffix)
        if stem and all(c in letters for c in stem):
            spelled = bytes(letters[c] for c in stem)
            pieces.append((spelled + bytes([END]) if stem != piece else spelled, number))
    return pieces


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next free from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def _stretches(words: pa.Array, most_words: int, most_bytes: int) -> Iterator[pa.Array]:
    """Consecutive words: at most ``most_words`` with ``most_bytes``, or one longer word."""
    _, ends, _ = words.buffers()
    width = np.int64 if pa.types.is_large_string(words.type) else np.int32
    offsets = np.frombuffer(ends, width)[words.offset : words.offset + len(words) + 1] if len(words) else None
    begin = 0
    while begin < len(words):
        stop = min(int(offsets[begin]) + most_bytes, int(offsets[-1]))
        end = int(np.searchsorted(offsets, width(stop), side="right")) - 1  # the same type: no copy
        end = min(max(end, begin + 1), begin + most_words, len(words))
        yield words.slice(begin, end - begin)
        begin = end


def _first_pieces(
    lists: pa.ListArray, trie: PieceTrie, max_length: int, unknown: int, pad: int
) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, sizes)``: the first ``max_length`` ids of each list of words, padded, and all its pieces.

    Words are cut stretch by stretch, across lists, so what is held beside the batch and the result
    depends neither on the rows of a batch nor on the length of their texts.
    """
    table = np.full((len(lists), max_length), pad, np.int32)
    sizes = np.zeros(len(lists), np.int64)
    last = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    done = 0
    for words in _stretches(lists.flatten(), MOST_WORDS, MOST_BYTES):
        spelled = words.dictionary_encode()
        codes = spelled.indices.to_numpy(zero_copy_only=False)
        ids, borders = trie.words(spelled.dictionary.cast(pa.binary()).to_pylist(), unknown)
        counts = np.diff(borders)[codes]
        row = np.searchsorted(last, np.arange(done, done + len(words)), side="right")
        done += len(words)
        before = np.cumsum(counts) - counts
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        runs = np.diff(np.r_[first, len(row)])
        # Place of a word's first piece in its text.
        place = before - np.repeat(before[first], runs) + sizes[row]
        sizes[row[first]] += np.add.reduceat(counts, first)
        kept = np.flatnonzero(place < max_length)
        taken = np.minimum(counts[kept], max_length - place[kept])
        step = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken)
        table[np.repeat(row[kept], taken), np.repeat(place[kept], taken) + step] = ids[
            np.repeat(borders[codes[kept]], taken) + step
        ]
    return table, sizes


def subword_inputs(
    df: DataFrame,
    trie: PieceTrie,
    max_length: int,
    text: str = "sentence",
    unknown: int = 0,
    pad: int = 0,
    id: str = "id",
) -> DataFrame:
    """``(id, input_ids, attention_mask, n_pieces, truncated)`` of each row.

    The lower-cased words of a text are cut into pieces, longest match first; the ids are truncated
    and padded to ``max_length``, and the mask is 1 for a real id.  A word that can't be cut is one
    ``unknown``.  Null and empty texts have no pieces; nothing is shuffled.
    """
    spark = df.sparkSession
    held = spark.sparkContext.broadcast(trie)  # bounded by MAX_PIECES
    kind = df.schema[id].dataType
    words = df.select(F.col(id).alias("id"), whitespace_tokens(F.coalesce(F.col(text), F.lit(""))).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, sizes = _first_pieces(batch.column("words"), held.value, max_length, unknown, pad)
            real = np.arange(max_length) < sizes[:, None]
            offsets = pa.array(np.arange(len(sizes) + 1) * max_length, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.ListArray.from_arrays(offsets, pa.array(table.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(real.ravel().astype(np.int32))),
                    pa.array(sizes),
                    pa.array(sizes > max_length),
                ],
                names=["id", "input_ids", "attention_mask", "n_pieces", "truncated"],
            )
            pa.default_memory_pool().release_unused()

    return words.mapInArrow(
        run,
        f"id {kind.simpleString()}, input_ids array<int>, attention_mask array<int>, n_pieces bigint, truncated boolean",
    )
