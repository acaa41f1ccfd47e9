"""Exact duplicates by Patricia tries.

Every shard of the input first goes through a trie of its own, so a text that fills a third of the
corpus leaves each shard once.  The survivors are dealt by length and content hash; the owner of
a partition inserts their full byte strings into a compressed radix trie whose terminal nodes hold
the identifier that stays.  A trie beyond its memory limit spills its largest subtree to a file of
the task, which is worked off, again as a trie, when the rest is done.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import SHARD_BYTES, shards

TRIE_BYTES = 96 << 20
_NODE_BYTES = 250  # of a node beside its label
_BUFFER_BYTES = 1 << 18

_LOCAL = "digest binary, n_bytes bigint, keep_id bigint, group_size bigint, body binary"
_OWNED = "digest binary, n_bytes bigint, keep_id bigint, group_size bigint"
_OWNED_ARROW = pa.schema(
    [("digest", pa.binary()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())]
)


class _Node:
    __slots__ = ("label", "children", "value")

    def __init__(self, label: bytes, value=None):
        self.label, self.value = label, value
        self.children: dict[int, _Node | _Spilled] = {}


class _Spilled:
    """A subtree on disk: the rest of each string below its parent, with its value.

    Files of subtrees that were spilled further down before stay, with the path to them.  A file is
    open only while a buffer is written or the file is read.
    """

    __slots__ = ("path", "below", "waiting", "held")

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}"
        self.below: list[tuple[bytes, str]] = []
        self.waiting: list[tuple[bytes, object]] = []
        self.held = 0

    def add(self, rest: bytes, value) -> None:
        self.waiting.append((rest, value))
        self.held += len(rest) + _NODE_BYTES
        if self.held >= _BUFFER_BYTES:
            self.write()

    def write(self) -> None:
        with open(self.path, "ab") as file:
            for row in self.waiting:
                pickle.dump(row, file, protocol=pickle.HIGHEST_PROTOCOL)
        self.waiting, self.held = [], 0

    def take(self, path: bytes, other: _Spilled) -> None:
        other.write()
        self.below += [(path + p, f) for p, f in [(b"", other.path), *other.below]]

    def read(self) -> Iterator[tuple[bytes, object]]:
        self.write()
        for path, name in [(b"", self.path), *self.below]:
            with open(name, "rb") as file:
                while True:
                    try:
                        rest, value = pickle.load(file)
                    except EOFError:
                        break
                    yield path + rest, value
            os.remove(name)


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b[at:]`` have in common at their start."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Compressed radix trie of byte strings; ``merge(old, new)`` joins values of equal strings.

    Beyond ``limit`` bytes in memory subtrees go to files until half of it is left; a single string
    stays.  ``folder`` is where, a temporary one of the task by default.
    """

    def __init__(self, merge: Callable, limit: int = TRIE_BYTES, folder: str | None = None):
        self.merge, self.limit, self.folder = merge, limit, folder
        self._temporary: tempfile.TemporaryDirectory | None = None
        self.root, self.size, self.strings, self.spills = _Node(b""), 0, 0, 0

    def insert(self, string: bytes, value) -> bool:
        """Whether the string is new.  One that falls into a spilled subtree counts as new."""
        node, at = self.root, 0
        while at < len(string):
            child = node.children.get(string[at])
            if child is None:
                node.children[string[at]] = _Node(string[at:], value)
                self._grow(len(string) - at)
                return True
            if isinstance(child, _Spilled):
                child.add(string[at:], value)
                return True
            if string.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = _shared(child.label, string, at)
            branch = _Node(child.label[:k])
            child.label = child.label[k:]
            branch.children[child.label[0]] = child
            node.children[string[at]] = branch
            node, at = branch, at + k
            self.size += _NODE_BYTES
        new = node.value is None
        node.value = value if new else self.merge(node.value, value)
        self.strings += new
        if self.size > self.limit:
            self._spill()
        return new

    def _grow(self, added: int) -> None:
        self.size += added + _NODE_BYTES
        self.strings += 1
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        """Move subtrees to files: down the heaviest children, the first with half the weight or less.

        At least one string stays outside of each, so tries of spilled subtrees get smaller.
        """
        weights = _weights(self.root)
        while self.strings > 1 and 2 * self.size > self.limit:
            path, some_outside = [self.root], False
            while True:
                node = path[-1]
                inner = [c for c in node.children.values() if isinstance(c, _Node)]
                if not inner or some_outside and 2 * weights[id(node)] <= weights[id(self.root)]:
                    break
                some_outside |= node.value is not None or len(node.children) > 1
                path.append(max(inner, key=lambda c: weights[id(c)]))
            if not some_outside:
                return
            self._move(path[-2], node)
            moved = weights[id(node)]
            self.size -= moved
            for above in path[:-1]:
                weights[id(above)] -= moved

    def _move(self, parent: _Node, node: _Node) -> None:
        if self.folder is None:
            self._temporary = tempfile.TemporaryDirectory()
            self.folder = self._temporary.name
        spilled = _Spilled(self.folder)
        for string, found in _strings(node):
            if isinstance(found, _Spilled):
                spilled.take(string, found)
            else:
                spilled.add(string, found)
                self.strings -= 1
        spilled.write()
        parent.children[node.label[0]] = spilled
        self.spills += 1

    def drain(self) -> Iterator[object]:
        """The value of each distinct string; spilled subtrees follow as tries of their own."""
        stack, files = [self.root], []
        while stack:
            node = stack.pop()
            if node.value is not None:
                yield node.value
            for child in node.children.values():
                (files if isinstance(child, _Spilled) else stack).append(child)
        self.root, self.size, self.strings = _Node(b""), 0, 0
        for file in files:
            below = PatriciaTrie(self.merge, self.limit, self.folder)
            for rest, value in file.read():
                below.insert(rest, value)
            yield from below.drain()


def _weights(root: _Node) -> dict[int, int]:
    """Bytes of the subtree of each node in memory, by the node's ``id``."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children.values() if isinstance(c, _Node)]
    weights: dict[int, int] = {}
    for node in reversed(order):
        below = sum(weights[id(c)] for c in node.children.values() if isinstance(c, _Node))
        weights[id(node)] = len(node.label) + _NODE_BYTES + below
    return weights


def _strings(node: _Node) -> Iterator[tuple[bytes, object]]:
    """Each string with its value, and the path to each spilled subtree with that subtree."""
    stack = [(node, b"")]
    while stack:
        node, prefix = stack.pop()
        string = prefix + node.label
        if node.value is not None:
            yield string, node.value
        for child in node.children.values():
            if isinstance(child, _Spilled):
                yield string, child
            else:
                stack.append((child, string))


def _better(keep: str) -> Callable:
    pick = {"smallest": min, "largest": max}[keep]

    def better(a, b):
        return b if a is None else a if b is None else pick(a, b)

    return better


def _folded(column: pa.Array) -> list[bytes]:
    """Normalised texts: A-Z lower-cased, null as empty."""
    return [b.lower() for b in pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()]


def _local_tries(keep: str) -> Callable:
    better = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            bodies = _folded(shard.column("text"))
            trie = PatriciaTrie(lambda a, b: (a[0], better(a[1], b[1]), a[2] + 1), 16 * SHARD_BYTES)
            for at, (body, i) in enumerate(
                zip(bodies, shard.column("doc_id").to_pylist(), strict=True)
            ):
                trie.insert(body, (at, i, 1))
            found = sorted(trie.drain())
            kept = [bodies[at] for at, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.sha256(b).digest() for b in kept], pa.binary()),
                    pa.array([len(b) for b in kept], pa.int64()),
                    pa.array([i for _, i, _ in found], pa.int64()),
                    pa.array([n for _, _, n in found], pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                names=["digest", "n_bytes", "keep_id", "group_size", "body"],
            )

    return run


def _owner_tries(keep: str, limit: int) -> Callable:
    better = _better(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(lambda a, b: (*a[:2], better(a[2], b[2]), a[3] + b[3]), limit)
        left = 0
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in _OWNED_ARROW.names), strict=True)
            for body, value in zip(batch.column("body").to_pylist(), rows, strict=True):
                trie.insert(body, value)
                left += value[3]
        waiting = []
        for value in trie.drain():
            left -= value[3]
            waiting.append(value)
            if len(waiting) == 10_000:
                yield _owned(waiting)
                waiting = []
        if left:
            raise ValueError(f"{left} rows of an owner have no group")
        if waiting:
            yield _owned(waiting)

    return run


def _owned(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OWNED_ARROW, strict=True)],
        schema=_OWNED_ARROW,
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches):
        bodies = _folded(shard.column("text"))
        yield pa.RecordBatch.from_arrays(
            [
                shard.column("doc_id").cast(pa.int64()),
                pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()),
                pa.array([len(b) for b in bodies], pa.int64()),
            ],
            names=["doc_id", "digest", "n_bytes"],
        )


def text_groups(
    docs: DataFrame,
    keep: str = "smallest",
    id_column: str = "doc_id",
    text_column: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``(digest, n_bytes, keep_id, group_size)``, a row for each distinct text."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return (
        rows.mapInArrow(_local_tries(keep), _LOCAL)
        .repartition("n_bytes", "digest")
        .mapInArrow(_owner_tries(keep, trie_bytes), _OWNED)
    )


def exact_groups(
    docs: DataFrame,
    keep: str = "smallest",
    id_column: str = "doc_id",
    text_column: str = "text",
    trie_bytes: int = TRIE_BYTES,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of each row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the
    row with the smallest (or ``keep="largest"``) id stays.  Null ids stay only where a whole group
    has none; repeated rows count in ``group_size`` and, where their id stays, are all kept.  An
    empty table gives no row.  The digest only carries a group's result back to its rows, it never
    decides equality; the join has one row on the side of the groups, so a hot group can be split.
    A row whose digest finds no group is an error; rows of two texts with one SHA-256 digest would
    come twice.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    digests = rows.mapInArrow(_digests, "doc_id bigint, digest binary, n_bytes bigint")
    groups = text_groups(docs, keep, id_column, text_column, trie_bytes)
    lost = F.raise_error(F.lit("a text has no group")).cast("bigint")
    return digests.join(groups, ["digest", "n_bytes"], "left").select(
        "doc_id",
        "keep_id",
        F.coalesce("group_size", lost).alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(
    docs: DataFrame, keep: str = "smallest", id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of ``docs`` for each distinct text, with all its columns: one whose id stays.

    Of rows that share id and text one stays, whichever Spark reads first; of a group without ids one
    row without id.  Rows that share an id but not a text are judged apart.
    """
    def name(id: Column) -> Column:
        return F.coalesce(id.cast("string"), F.lit(""))  # a plain key, so that texts are shuffled once

    stay = text_groups(docs, keep, id_column, text_column).select(
        F.col("digest").alias("__kept_digest"), name(F.col("keep_id")).alias("__kept_name")
    )
    folded = F.translate(F.coalesce(F.col(text_column), F.lit("")), ascii_uppercase, ascii_lowercase)
    marked = docs.withColumns({"__digest": F.unhex(F.sha2(folded, 256)), "__name": name(F.col(id_column))})
    same = (F.col("__digest") == F.col("__kept_digest")) & (F.col("__name") == F.col("__kept_name"))
    single = marked.dropDuplicates(["__digest", "__name"])
    return single.join(stay, same, "left_semi").select(*docs.columns)
