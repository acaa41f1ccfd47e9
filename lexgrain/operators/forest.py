"""Random forest whose trees are grown one to a task over binned rows.

Spark ML's forest sends the statistics of every growing node from every task in every pass, so its
time grows with nodes times parts.  Here the rows are binned once and written to the shared folder in
compact form, sorted by row, with entries only where a feature's bin is not that of zero.  A task maps
these files into memory, shared by the workers of a machine, and grows a whole tree: no statistics
are sent.  What a task holds besides is a few bytes a row and the nodes of its tree.

Split points, bootstrap, features a node, impurity, least instances and the merging of leaves with
the same prediction are those of Spark ML's forest; the random draws differ.
"""

from __future__ import annotations

import io
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import discard, new_scratch_path, ship_package

MAX_BINS = 32
#: Rows from which split points are taken; all rows if there are no more.
SAMPLE_ROWS = 10_000
#: Rows of a file of binned rows; a writing task holds one file's entries.
ROWS_PER_FILE = 1 << 16
#: A node with at most so many distinct rows is grown to its leaves on a dense block of their bins.
BLOCK_ROWS = 1 << 12
#: Entries that are compared with split points, and rows that are scanned or scored, at once.
ENTRIES_AT_ONCE, ROWS_AT_ONCE, SCORED_AT_ONCE = 1 << 16, 1 << 14, 1 << 11
#: Candidates (node and feature) whose gains are worked out at once.
CANDIDATES_AT_ONCE = 1 << 11


# Files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, from inside a task."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _store(path: str, array: np.ndarray) -> None:
    system, place = _place(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(place) as out:
        header = io.BytesIO()
        np.lib.format.write_array_header_1_0(header, np.lib.format.header_data_from_array_1_0(array))
        out.write(header.getvalue())
        out.write(np.ascontiguousarray(array).data)


def _mapped(path: str) -> np.ndarray:
    """A stored array in mapped memory; from a remote store, by a local copy that has no name any more."""
    system, place = _place(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(place, mmap_mode="r").view(np.ndarray)
    with tempfile.NamedTemporaryFile() as local:
        with system.open_input_stream(place) as remote:
            shutil.copyfileobj(remote, local, 1 << 20)
        local.flush()
        return np.load(local.name, mmap_mode="r").view(np.ndarray)


# Binning


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, feature, value)`` of the stored entries of sparse or dense vectors."""
    if vectors.null_count:
        raise ValueError("vectors must not be null")
    kind, _, indices, values = vectors.flatten()
    lengths = values.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(vectors)), lengths)
    value = values.flatten().to_numpy(zero_copy_only=False)
    feature = np.arange(len(value)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = kind.to_numpy(zero_copy_only=False)[row] == 0
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, value


def _split_points(values: np.ndarray, counts: np.ndarray, n_rows: int, most: int) -> list[float]:
    """At most ``most`` split points of a feature with so many rows at each of its sorted values.

    As in Spark ML: midpoints of all values where these are few, else the values next to which the
    row count passes the next of ``most + 1`` equal shares.
    """
    middles = (values[:-1] + values[1:]) / 2.0
    if len(middles) <= most:
        return middles.tolist()
    stride = n_rows / (most + 1)
    found, target = [], stride
    passed = np.cumsum(counts).tolist()
    for i, middle in enumerate(middles.tolist()):
        if abs(passed[i] - target) < abs(passed[i + 1] - target):
            found.append(middle)
            target += stride
    return found


def _all_split_points(vectors: pa.StructArray, n_features: int, bins: int) -> np.ndarray:
    """A line of ascending split points for each feature, filled up with infinity."""
    row, feature, value = _entries(vectors)
    present = value != 0
    feature, value = feature[present], value[present]
    order = np.lexsort((value, feature))
    feature, value = feature[order], value[order]
    bounds = np.searchsorted(feature, np.arange(n_features + 1))
    lines = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        values, counts = np.unique(value[begin:end], return_counts=True)
        zeros = len(vectors) - (end - begin)
        if zeros:
            at = np.searchsorted(values, 0.0)
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
        lines.append(_split_points(values, counts, len(vectors), bins - 1))
    points = np.full((n_features, max(1, *map(len, lines))), np.inf)
    for line, found in zip(points, lines, strict=True):
        line[: len(found)] = found
    return points


def _bins(points: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The number of a feature's split points below each value."""
    made = np.empty(len(value), np.uint8)
    for begin in range(0, len(value), ENTRIES_AT_ONCE):
        part = slice(begin, begin + ENTRIES_AT_ONCE)
        made[part] = (value[part, None] > points[feature[part]]).sum(axis=1)
    return made


def _zero_bins(points: np.ndarray) -> np.ndarray:
    return (points < 0.0).sum(axis=1).astype(np.uint8)


def _binned(vectors: pa.StructArray, points: np.ndarray, zero: np.ndarray):
    """``(row, feature, bin)`` of the entries that don't lie in the bin of zero."""
    row, feature, value = _entries(vectors)
    found = _bins(points, feature, value)
    kept = np.flatnonzero(found != zero[feature])
    return row[kept], feature[kept], found[kept]


@dataclass(frozen=True)
class _Part:
    """The binned rows of one file; row ``i`` has the entries from ``ends[i]`` up to ``ends[i + 1]``."""

    ends: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    label: np.ndarray

    FIELDS = ("ends", "feature", "bin", "label")

    def store(self, path: str) -> None:
        for name in self.FIELDS:
            _store(f"{path}.{name}.npy", getattr(self, name))

    @classmethod
    def mapped(cls, path: str) -> _Part:
        return cls(*(_mapped(f"{path}.{name}.npy") for name in cls.FIELDS))

    def entries_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all entries of ``rows``, and the ends of the rows among them."""
        begin = self.ends[rows]
        lengths = self.ends[rows + 1] - begin
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1]), ends

    def matching(self, rows: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray]:
        """``(place in rows, entry)`` of the entries whose features ``wanted`` marks.

        Ascending ``rows`` that are close together are scanned with what lies between them.
        """
        first, last = int(rows[0]), int(rows[-1]) + 1
        if 4 * len(rows) < last - first:
            entries, ends = self.entries_of(rows)
            hits = np.flatnonzero(wanted(self.feature[entries]))
            return np.searchsorted(ends, hits, side="right") - 1, entries[hits]
        begin = int(self.ends[first])
        hits = begin + np.flatnonzero(wanted(self.feature[begin : self.ends[last]]))
        row = np.searchsorted(self.ends[first : last + 1], hits, side="right") - 1
        place = np.full(last - first, -1, np.int32)
        place[rows - first] = np.arange(len(rows))
        place = place[row]
        inside = place >= 0
        return place[inside], hits[inside]


def _write_parts(rows: DataFrame, folder: str, points: np.ndarray) -> list[str]:
    """Names of the files of binned rows in the order of partitions."""
    context = rows.sparkSession.sparkContext
    held = context.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, number = held.value, 0
        zero = _zero_bins(points)
        waiting: list[tuple] = []

        def part() -> pa.RecordBatch:
            nonlocal number, waiting
            ends = np.concatenate([[0], np.cumsum(np.concatenate([w[0] for w in waiting]))])
            joined = [np.concatenate(x) for x in list(zip(*waiting, strict=True))[1:]]
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}-{uuid.uuid4().hex}"
            _Part(ends, *joined).store(f"{folder}/{name}")
            number, waiting = number + 1, []
            return pa.RecordBatch.from_pydict({"name": [name]})

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                room = ROWS_PER_FILE - sum(len(w[0]) for w in waiting)
                cut = batch.slice(begin, min(room, ROWS_AT_ONCE))
                row, feature, found = _binned(cut.column("features"), points, zero)
                lengths = np.bincount(row, minlength=cut.num_rows)
                label = cut.column("label").to_numpy().astype(np.uint16)
                waiting.append((lengths, feature.astype(_number_type(len(points))), found, label))
                begin += cut.num_rows
                if cut.num_rows == room:
                    yield part()
        if waiting:
            yield part()

    try:
        return sorted(r["name"] for r in rows.mapInArrow(run, "name string").collect())
    finally:
        held.destroy()


def _number_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


# Growing


@dataclass(frozen=True)
class _Setting:
    trees: int
    max_depth: int
    least: int
    seed: int
    classes: int
    features_per_node: int


class _Tree:
    """Nodes of a growing tree; the right child of a node stands behind its left child."""

    def __init__(self, classes: int):
        self.n = 0
        self.feature, self.bin, self.left = np.empty(0, np.int32), np.empty(0, np.uint8), np.empty(0, np.int32)
        self.counts = np.empty((0, classes))

    def add(self, counts: np.ndarray) -> np.ndarray:
        """Numbers of new leaves with these class counts."""
        begin, self.n = self.n, self.n + len(counts)
        if self.n > len(self.feature):
            room = max(2 * self.n, 1024) - len(self.feature)
            for name in ("feature", "bin", "left"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros(room, old.dtype)]))
            self.counts = np.concatenate([self.counts, np.zeros((room, self.counts.shape[1]))])
        self.feature[begin : self.n] = -1
        self.counts[begin : self.n] = counts
        return np.arange(begin, self.n)

    def split(self, nodes, feature, bin, left) -> None:
        self.feature[nodes], self.bin[nodes], self.left[nodes] = feature, bin, left

    def pruned(self) -> np.ndarray:
        """The nodes that are left when leaves of one parent with the same prediction are merged."""
        feature, left = self.feature[: self.n], self.left[: self.n]
        best = self.counts[: self.n].argmax(axis=1)
        while True:
            inner = np.flatnonzero(feature >= 0)
            a = left[inner]
            merged = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (best[a] == best[a + 1])]
            if not len(merged):
                break
            feature[merged] = -1
        reached = np.zeros(self.n, bool)
        level = np.zeros(1, np.int64)
        while len(level):
            reached[level] = True
            a = left[level[feature[level] >= 0]]
            level = np.concatenate([a, a + 1])
        number = np.cumsum(reached) - 1
        counts = self.counts[: self.n][reached]
        made = np.zeros(len(counts), _node_type(counts.shape[1]))
        made["feature"], made["bin"] = feature[reached], self.bin[: self.n][reached]
        made["left"] = np.where(made["feature"] >= 0, number[left[reached]], 0)
        made["votes"] = counts / counts.sum(axis=1, keepdims=True)
        return made


def _node_type(classes: int) -> np.dtype:
    return np.dtype([("feature", "<i4"), ("left", "<i4"), ("bin", "u1"), ("votes", "<f8", (classes,))])


def _purity(counts: np.ndarray) -> np.ndarray:
    """Sum of squared class counts over their sum: rows times (1 - Gini impurity)."""
    return (counts * counts).sum(axis=-1) / np.maximum(counts.sum(axis=-1), 1)


def _best_bins(histograms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate's ``bins x classes``: the last bin on the left, and the purity of both sides."""
    bins, purity = np.empty(len(histograms), np.uint8), np.empty(len(histograms))
    for begin in range(0, len(histograms), CANDIDATES_AT_ONCE):
        part = slice(begin, begin + CANDIDATES_AT_ONCE)
        left = histograms[part].cumsum(axis=1)
        right = left[:, -1:] - left
        fits = (left.sum(axis=-1) >= least) & (right.sum(axis=-1) >= least)
        both = np.where(fits, _purity(left) + _purity(right), -np.inf)
        bins[part] = both.argmax(axis=1)
        purity[part] = both.max(axis=1)
    return bins, purity


def _gains(purity: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a split with this purity is better than none, beyond rounding."""
    return purity > _purity(counts) * (1 + 1e-12)


class _Rows:
    """All binned rows as seen by a task that grows trees."""

    def __init__(self, folder: str, names: tuple[str, ...]):
        self.parts = [_Part.mapped(f"{folder}/{name}") for name in names]
        self.starts = np.cumsum([0, *(len(p.label) for p in self.parts)])
        self.n = int(self.starts[-1])
        self.label = np.concatenate([p.label for p in self.parts])

    def pieces(self, rows: np.ndarray) -> Iterator[tuple[_Part, slice, np.ndarray]]:
        """``(part, place in rows, rows within the part)`` of ascending rows, piece by piece."""
        bounds = np.searchsorted(rows, self.starts)
        for number, part in enumerate(self.parts):
            for begin in range(int(bounds[number]), int(bounds[number + 1]), ROWS_AT_ONCE):
                at = slice(begin, min(begin + ROWS_AT_ONCE, int(bounds[number + 1])))
                yield part, at, rows[at] - self.starts[number]


@lru_cache(maxsize=1)
def _rows(folder: str, names: tuple[str, ...]) -> _Rows:
    return _Rows(folder, names)


class _Grower:
    """Grows one tree."""

    def __init__(self, rows: _Rows, zero: np.ndarray, n_bins: int, setting: _Setting, number: int):
        self.rows, self.zero, self.n_bins, self.setting = rows, zero, n_bins, setting
        self.random = np.random.default_rng([setting.seed & (2**64 - 1), number])
        self.weight = self.random.poisson(1.0, rows.n).astype(np.uint8)
        self.tree = _Tree(setting.classes)

    def grow(self) -> np.ndarray:
        drawn = np.flatnonzero(self.weight)
        root = self._counts(drawn)
        waiting = [(int(self.tree.add(root[None])[0]), 0, drawn)] if len(drawn) else []
        if not waiting:
            self.tree.add(np.bincount(self.rows.label, minlength=self.setting.classes)[None])
        while waiting:
            node, depth, rows = waiting.pop()
            if not self._may_split(self.tree.counts[node], depth):
                continue
            if len(rows) <= BLOCK_ROWS:
                self._grow_block(node, depth, rows)
                continue
            split = self._split_of(node, rows)
            if split is None:
                continue
            feature, bin = split
            goes_left = self._bins_of(rows, feature) <= bin
            sides = rows[goes_left], rows[~goes_left]
            left, right = self.tree.add(np.stack([self._counts(side) for side in sides]))
            self.tree.split(node, feature, bin, left)
            waiting += [(int(left), depth + 1, sides[0]), (int(right), depth + 1, sides[1])]
        return self.tree.pruned()

    def _counts(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows.label[rows], self.weight[rows], minlength=self.setting.classes)

    def _may_split(self, counts: np.ndarray, depth: int) -> np.ndarray:
        total = counts.sum(axis=-1)
        mixed = counts.max(axis=-1) < total
        return mixed & (total >= 2 * self.setting.least) & (depth < self.setting.max_depth)

    def _draw(self, nodes: int) -> np.ndarray:
        """Distinct features for each node; what comes twice is drawn again."""
        n, wanted = len(self.zero), self.setting.features_per_node
        if wanted >= n:
            return np.broadcast_to(np.arange(n), (nodes, n))
        drawn = self.random.integers(0, n, (nodes, wanted))
        open_lines = np.arange(nodes)
        while len(open_lines):
            lines = drawn[open_lines]
            order = lines.argsort(axis=1, kind="stable")
            ordered = np.take_along_axis(lines, order, axis=1)
            twice = np.zeros(lines.shape, bool)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], axis=1)
            lines[twice] = self.random.integers(0, n, int(twice.sum()))
            drawn[open_lines] = lines
            open_lines = open_lines[twice.any(axis=1)]
        return drawn

    # Nodes with many rows

    def _split_of(self, node: int, rows: np.ndarray) -> tuple[int, int] | None:
        """The best ``(feature, bin)`` of a node, from a scan of its rows' entries."""
        features, classes = self._draw(1)[0], self.setting.classes
        slot = np.full(len(self.zero), -1, np.int32)
        slot[features] = np.arange(len(features))
        found = np.zeros(len(features) * self.n_bins * classes)
        for part, at, local in self.rows.pieces(rows):
            place, entry = part.matching(local, lambda f: slot[f] >= 0)
            own = rows[at][place]
            key = (slot[part.feature[entry]] * self.n_bins + part.bin[entry]) * classes + self.rows.label[own]
            found += np.bincount(key, self.weight[own], minlength=len(found))
        found = found.reshape(len(features), self.n_bins, classes)
        found[np.arange(len(features)), self.zero[features]] += self.tree.counts[node] - found.sum(axis=1)
        bins, purity = _best_bins(found, self.setting.least)
        best = int(purity.argmax())
        if not _gains(purity[best], self.tree.counts[node]):
            return None
        return int(features[best]), int(bins[best])

    def _bins_of(self, rows: np.ndarray, feature: int) -> np.ndarray:
        found = np.full(len(rows), self.zero[feature], np.uint8)
        for part, at, local in self.rows.pieces(rows):
            place, entry = part.matching(local, lambda f: f == feature)
            found[at][place] = part.bin[entry]
        return found

    # Nodes with few rows

    def _block(self, rows: np.ndarray) -> np.ndarray:
        """The bins of all features of ``rows``."""
        block = np.empty((len(rows), len(self.zero)), np.uint8)
        block[:] = self.zero
        for part, at, local in self.rows.pieces(rows):
            entries, ends = part.entries_of(local)
            row = np.repeat(np.arange(at.start, at.stop), np.diff(ends))
            block[row, part.feature[entries]] = part.bin[entries]
        return block

    def _grow_block(self, node: int, depth: int, rows: np.ndarray) -> None:
        """Grow all nodes below one, a level at a time; rows stand in the order of their nodes."""
        classes, width = self.setting.classes, len(self.zero)
        block = self._block(rows).ravel()
        label, weight = self.rows.label[rows].astype(np.int64), self.weight[rows].astype(np.float64)
        order, nodes, sizes = np.arange(len(rows)), np.array([node]), np.array([len(rows)])
        while len(nodes):
            features = self._draw(len(nodes))
            wide = features.shape[1]
            of = np.repeat(np.arange(len(nodes)), sizes)
            bins = block[(order * width)[:, None] + features[of]]
            begins = np.cumsum(sizes) - sizes
            # Most features are equal in all rows of a small node; the others are candidates.
            varies = np.minimum.reduceat(bins, begins) < np.maximum.reduceat(bins, begins)
            candidates = int(varies.sum())
            number = (np.cumsum(varies) - 1).reshape(varies.shape)
            cell = np.flatnonzero(varies[of])
            row = cell // wide
            key = (number[of].ravel()[cell] * self.n_bins + bins.ravel()[cell]) * classes + label[order[row]]
            found = np.bincount(key, weight[order[row]], minlength=candidates * self.n_bins * classes)
            at, purity = _best_bins(found.reshape(candidates, self.n_bins, classes), self.setting.least)
            all_at, all_purity = np.zeros(varies.shape, np.uint8), np.full(varies.shape, -np.inf)
            all_at[varies], all_purity[varies] = at, purity
            best = all_purity.argmax(axis=1)
            each = np.arange(len(nodes))
            splits = _gains(all_purity[each, best], self.tree.counts[nodes])
            rank = np.cumsum(splits) - 1
            goes_right = bins[np.arange(len(order)), best[of]] > all_at[each, best][of]
            child = 2 * rank[of] + goes_right
            moved = splits[of]
            order, child = order[moved], child[moved]
            n_children = 2 * int(splits.sum())
            counts = np.bincount(child * classes + label[order], weight[order], minlength=n_children * classes)
            counts = counts.reshape(n_children, classes)
            made = self.tree.add(counts)
            parents = np.flatnonzero(splits)
            self.tree.split(
                nodes[parents], features[parents, best[parents]], all_at[parents, best[parents]], made[::2]
            )
            depth += 1
            active = self._may_split(counts, depth)
            kept = active[child]
            order, child = order[kept], child[kept]
            order = order[child.argsort(kind="stable")]
            sizes = np.bincount(child, minlength=n_children)[active]
            nodes = made[active]


# Estimator and model


def _vectors(column: str) -> Column:
    return F.unwrap_udt(F.col(column)).alias("features")


def _checked_label(column: str) -> Column:
    label = F.col(column).cast("double")
    good = (label >= 0) & (label < 1 << 16) & (label == F.floor(label))
    wrong = F.concat(F.lit("labels must be whole numbers from 0, got "), F.coalesce(label.cast("string"), F.lit("null")))
    return F.when(good, label).otherwise(F.raise_error(wrong)).alias("label")


class ForestClassifier(Estimator):
    """Random forest on vectors; see the module."""

    def __init__(
        self,
        trees: int = 100,
        max_depth: int = 20,
        least: int = 2,
        seed: int = 42,
        features: str = "features",
        label: str = "label",
    ):
        super().__init__()
        self.trees, self.max_depth, self.least, self.seed = trees, max_depth, least, seed
        self.features, self.label = features, label

    def _fit(self, dataset: DataFrame) -> ForestModel:
        spark = dataset.sparkSession
        ship_package(spark)
        rows = dataset.select(_vectors(self.features), _checked_label(self.label))
        n, top = rows.agg(F.count("*"), F.max("label")).first()
        if not n:
            raise ValueError("no rows to fit")
        sample = rows.select("features")
        if n > SAMPLE_ROWS:
            sample = sample.sample(False, SAMPLE_ROWS / n, self.seed)
        # About SAMPLE_ROWS rows; a vector's size stands in its struct only if it is sparse.
        drawn = sample.toArrow().column("features").combine_chunks()
        if not len(drawn):
            raise ValueError("no rows in the sample for split points")
        size, first = drawn[0]["size"].as_py(), drawn[0]["values"]
        width = size if size is not None else len(first)
        points = _all_split_points(drawn, width, min(MAX_BINS, n))
        per_node = width if self.trees == 1 else int(np.ceil(np.sqrt(width)))
        setting = _Setting(self.trees, self.max_depth, self.least, self.seed, int(top) + 1, per_node)
        binned, folder = new_scratch_path(spark, "binned"), new_scratch_path(spark, "forest")
        _store(f"{folder}/points.npy", points)
        try:
            names = tuple(_write_parts(rows, binned, points))
            trees = _grow_all(spark, binned, names, folder, points, setting)
        finally:
            discard(spark, binned)
        return ForestModel(folder, trees, setting.classes, self.features)


def _grow_all(
    spark: SparkSession, binned: str, names: tuple[str, ...], folder: str, points: np.ndarray, setting: _Setting
) -> list[str]:
    """Names of the trees' files, in their order; each task grows one, each attempt under another name."""
    zero, n_bins = _zero_bins(points), points.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                tree = _Grower(_rows(binned, names), zero, n_bins, setting, number).grow()
                name = f"tree-{number:06d}-{uuid.uuid4().hex}.npy"
                _store(f"{folder}/{name}", tree)
                yield pa.RecordBatch.from_pydict({"name": [name]})

    numbers = spark.range(0, setting.trees, numPartitions=setting.trees)
    return sorted(r["name"] for r in numbers.mapInArrow(run, "name string").collect())


@lru_cache(maxsize=1)
def _stored_forest(folder: str, trees: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    return _mapped(f"{folder}/points.npy"), [_mapped(f"{folder}/{name}") for name in trees]


def _votes(vectors: pa.StructArray, points: np.ndarray, trees: list[np.ndarray], classes: int) -> np.ndarray:
    """Sums of the trees' class shares: rows x classes."""
    zero = _zero_bins(points)
    votes = np.zeros((len(vectors), classes))
    for begin in range(0, len(vectors), SCORED_AT_ONCE):
        part = vectors.slice(begin, SCORED_AT_ONCE)
        block = np.empty((len(part), len(zero)), np.uint8)
        block[:] = zero
        row, feature, found = _binned(part, points, zero)
        block[row, feature] = found
        for tree in trees:
            at, live = np.zeros(len(part), np.int64), np.arange(len(part))
            while len(live):
                here = tree[["feature", "left", "bin"]][at[live]]
                inner = here["feature"] >= 0
                live, here = live[inner], here[inner]
                at[live] = here["left"] + (block[live, here["feature"]] > here["bin"])
            votes[begin : begin + len(part)] += tree["votes"][at]
    return votes


class ForestModel(Model):
    """A grown forest: the files ``trees`` in ``folder``, which every executor must reach."""

    def __init__(self, folder: str, trees: list[str], classes: int, features: str = "features"):
        super().__init__()
        self.folder, self.trees, self.classes, self.features = folder, tuple(trees), classes, features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ship_package(dataset.sparkSession)
        folder, trees, classes = self.folder, self.trees, self.classes

        @F.arrow_udf("array<double>")
        def votes(vectors: pa.Array) -> pa.Array:
            found = _votes(vectors, *_stored_forest(folder, trees), classes)
            ends = pa.array(np.arange(len(found) + 1) * classes, pa.int32())
            return pa.ListArray.from_arrays(ends, pa.array(found.ravel()))

        given = F.transform("_votes", lambda v: v / F.lit(float(len(trees))))
        first_best = F.array_position("_votes", F.array_max("_votes")) - 1
        return (
            dataset.withColumn("_votes", votes(_vectors(self.features)))
            .withColumn("rawPrediction", array_to_vector(F.col("_votes")))
            .withColumn("probability", array_to_vector(given))
            .withColumn("prediction", first_best.cast("double"))
            .drop("_votes")
        )

    def node_counts(self) -> list[int]:
        """Nodes of each tree."""
        return [len(tree) for tree in _stored_forest(self.folder, self.trees)[1]]

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    @classmethod
    def load(cls, path: str) -> ForestModel:
        """A saved forest; its files are read where they lie."""
        saved = DefaultParamsReader.loadMetadata(path, SparkSession.active())["forest"]
        return cls(f"{path}/trees", saved["trees"], saved["classes"], saved["features"])


class _ForestWriter(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model, spark = self.model, SparkSession.active()
        saved = {"trees": list(model.trees), "classes": model.classes, "features": model.features}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"forest": saved})
        hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        source, target = hadoop.Path(model.folder), hadoop.Path(f"{path}/trees")
        systems = source.getFileSystem(conf), target.getFileSystem(conf)
        if not hadoop.FileUtil.copy(systems[0], source, systems[1], target, False, conf):
            raise OSError(f"could not copy the trees to {path}")
