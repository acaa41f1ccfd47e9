"""Logistic models of all folds in one pass.

The model of a fold sees the rows of the other folds.  A Newton step needs sums over those rows only,
so one aggregate serves all models: each row meets the models that may see it, and gradients and
curvatures are summed by model before anything is shuffled.  Rows are read once per step, not once
per step and fold; what comes to the driver has ``k x (d + 1) x (d + 4) / 2`` numbers.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_shape(sentence: Column) -> dict[str, Column]:
    """Two features of a text's form: the logarithm of its length and its share of spaces."""
    length = F.coalesce(F.char_length(sentence), F.lit(0))
    blanks = length - F.coalesce(F.char_length(F.replace(sentence, F.lit(" "), F.lit(""))), F.lit(0))
    return {"log_length": F.ln(length + 1.0) / 10.0, "space_share": blanks / (length + 1.0)}


@dataclass(frozen=True)
class FoldModels:
    """``weights[f]`` are those of the model that hasn't seen fold f, the constant first."""

    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]

    @classmethod
    def fit(
        cls,
        folded: DataFrame,
        features: tuple[str, ...],
        k: int = 5,
        penalty: float = 1.0,
        steps: int = 25,
        tolerance: float = 1e-12,
    ) -> FoldModels:
        """Fit on ``(features..., label, fold)`` with labels 0 and 1.

        The objective is the log loss plus half the penalty times the squared weights without the
        constant; Newton steps from zero end when no weight moves more than the tolerance.  Rows
        with a null are left out.  ``folded`` should be stored: it is read once per step.
        """
        d = len(features) + 1
        cells = [(i, j) for i in range(d) for j in range(i, d)]
        rows = folded.select("fold", F.col("label").cast("double").alias("label"), *features).na.drop()
        ridge = np.diag([0.0, *[penalty] * (d - 1)])
        weights = np.zeros((k, d))
        for _ in range(steps):
            sums = _newton_sums(rows, features, weights, cells).collect()
            moved = 0.0
            for row in sums:
                m = row["model"]
                gradient = np.array([row[f"g{i}"] for i in range(d)]) + ridge @ weights[m]
                curvature = np.zeros((d, d))
                for i, j in cells:
                    curvature[i, j] = curvature[j, i] = row[f"h{i}_{j}"]
                step = np.linalg.lstsq(curvature + ridge, gradient, rcond=None)[0]
                weights[m] -= step
                moved = max(moved, float(np.abs(step).max()))
            if moved <= tolerance:
                break
        return cls(tuple(features), tuple(tuple(map(float, w)) for w in weights))

    def _margins(self) -> list[Column]:
        return [_margin(self.features, [F.lit(w) for w in weights]) for weights in self.weights]

    def out_of_fold(self, folded: DataFrame, keep: tuple[str, ...] = ("id", "label", "fold")) -> DataFrame:
        """``(keep..., pred_prob)``: every row under the model that hasn't seen its fold; one pass."""
        own = F.get(F.array(*self._margins()), F.col("fold"))
        return folded.select(*keep, (1.0 / (1.0 + F.exp(-own))).alias("pred_prob"))

    def scores(self, test: DataFrame, name: str = "a", keep: tuple[str, ...] = ("id",)) -> DataFrame:
        """``(keep..., model, fold, l0, l1)``: logits of every row under every model; one pass."""
        folds = [
            F.struct(F.lit(fold).alias("fold"), F.lit(0.0).alias("l0"), margin.alias("l1"))
            for fold, margin in enumerate(self._margins())
        ]
        return test.select(*keep, F.lit(name).alias("model"), F.inline(F.array(*folds)))

    def save(self, path: str) -> None:
        """One small array file; ``path`` lies in a folder that all executors share."""
        buffer = io.BytesIO()
        np.save(buffer, np.array(self.weights).T)  # (constant and features) x folds
        system, place = fs.FileSystem.from_uri(path)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            out.write(buffer.getvalue())

    @classmethod
    def load(cls, path: str, features: tuple[str, ...]) -> FoldModels:
        return cls(tuple(features), tuple(map(tuple, stored_weights(path).T.tolist())))


def _margin(features: tuple[str, ...], weights: list[Column]) -> Column:
    total = weights[0]
    for name, weight in zip(features, weights[1:], strict=True):
        total = total + weight * F.col(name)
    return total


def _newton_sums(
    rows: DataFrame, features: tuple[str, ...], weights: np.ndarray, cells: list[tuple[int, int]]
) -> DataFrame:
    """One row per model: gradient and curvature of the log loss over the rows of other folds."""
    models = [
        F.struct(F.lit(m).alias("model"), _margin(features, [F.lit(float(w)) for w in ws]).alias("margin"))
        for m, ws in enumerate(weights)
    ]
    seen = F.filter(F.array(*models), lambda x: x["model"] != F.col("fold"))
    met = rows.select("label", *features, F.inline(seen))
    p = 1.0 / (1.0 + F.exp(-F.col("margin")))
    x = [F.lit(1.0), *map(F.col, features)]
    met = met.select("model", (p - F.col("label")).alias("_e"), (p * (1.0 - p)).alias("_q"), *features)
    gradients = [F.sum(F.col("_e") * v).alias(f"g{i}") for i, v in enumerate(x)]
    curvatures = [F.sum(F.col("_q") * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in cells]
    return met.groupBy("model").agg(*gradients, *curvatures)


def stored_weights(path: str) -> np.ndarray:
    """The saved weights; files of a local or mounted folder are mapped into memory."""
    system, place = fs.FileSystem.from_uri(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(place, mmap_mode="r")
    with system.open_input_stream(place) as source:
        return np.load(io.BytesIO(source.read()))


def stored_scorer(path: str) -> Callable:
    """Factory for ``models.batch_scorer``: margins under all saved models, loaded once per worker."""

    def make_predict():
        weights = stored_weights(path)

        def predict(batch: np.ndarray) -> np.ndarray:
            return weights[0] + batch.astype(np.float64) @ weights[1:]

        return predict

    return make_predict


def with_text_shape(df: DataFrame, text: str = "sentence") -> DataFrame:
    """Replace ``text`` by the features of ``text_shape``; a null text counts as empty."""
    made = text_shape(F.col(text))
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, *(column.alias(name) for name, column in made.items()))


#: Word counts that a task weighs at once; a row has at most as many as there are slots.
MOST_COUNTS = 1 << 18


@dataclass(frozen=True)
class WordFoldModels:
    """Logistic models of all folds on ``tf``, the hashed word counts of whole texts.

    The model of a fold weighs counts by the inverse document frequency among the rows it may see
    (0 for a slot in fewer than two of them) and divides by the length of the row's vector.  Both
    arrays are slots x folds and bounded by the number of slots; the driver and every task hold them.
    """

    idf: np.ndarray
    weights: np.ndarray
    constants: np.ndarray

    @classmethod
    def fit(
        cls, folded: DataFrame, k: int = 5, slots: int = 1 << 16, penalty: float = 0.02, steps: int = 40
    ) -> WordFoldModels:
        """Fit on ``(tf, label, fold)`` with labels 0 and 1.

        The objective is the mean log loss plus half the penalty times the squared weights without
        the constant.  Rows have length one, so its curvature lies between the penalty and
        0.5 + penalty at any number of rows, and ``steps`` accelerated gradient steps of fixed size
        and momentum suffice.  A step is one pass for all models.  Rows without label or fold are
        left out.  ``folded`` should be stored: it is read once per step.
        """
        rows = folded.select("tf", F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))
        rows = rows.na.drop(subset=["label", "fold"])
        # Rows of each fold, in all and by slot; the last line counts rows.
        per_fold = _summed(rows, lambda part: _fold_counts(part, slots, k), slots + 1, k)
        seen = per_fold.sum(axis=1, keepdims=True) - per_fold
        frequency, n = seen[:-1], seen[-1]
        idf = np.where(frequency >= 2, np.log((n + 1) / (frequency + 1)), 0.0)
        smoothness = 0.5 + penalty
        root = np.sqrt(smoothness / penalty)
        momentum = (root - 1) / (root + 1)
        ridge = np.vstack([np.full((slots, 1), penalty), [[0.0]]])
        weights, ahead = np.zeros((slots + 1, k)), np.zeros((slots + 1, k))
        context = folded.sparkSession.sparkContext
        for _ in range(steps):
            held = context.broadcast((idf, ahead))
            sums = _summed(rows, lambda part, held=held: _gradients(part, *held.value), slots + 1, k)
            held.destroy()
            moved = ahead - (sums / np.maximum(n, 1) + ridge * ahead) / smoothness
            ahead = moved + momentum * (moved - weights)
            weights = moved
        return cls(idf, weights[:-1], weights[-1])

    def out_of_fold(self, folded: DataFrame, keep: tuple[str, ...] = ("id", "label", "fold")) -> DataFrame:
        """``(keep..., pred_prob)``: every row under the model that hasn't seen its fold; one pass."""
        own = F.get(F.col("margins"), F.col("fold"))
        return self._margins(folded, keep).select(*keep, (1.0 / (1.0 + F.exp(-own))).alias("pred_prob"))

    def scores(self, test: DataFrame, name: str = "a", keep: tuple[str, ...] = ("id",)) -> DataFrame:
        """``(keep..., model, fold, l0, l1)``: logits of every row under every model; one pass."""
        logits = F.posexplode("margins").alias("fold", "l1")
        rows = self._margins(test, keep).select(*keep, F.lit(name).alias("model"), logits)
        return rows.select(*keep, "model", "fold", F.lit(0.0).alias("l0"), "l1")

    def _margins(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast((self.idf, np.vstack([self.weights, self.constants])))
        rows, k = df.select(*keep, "tf"), len(self.constants)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [m for part in _parts(batch) for m in _weighed(part, *held.value)[3]]
                flat = pa.array(np.concatenate([*made, np.zeros(0)]))
                offsets = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
                columns = [*(batch.column(c) for c in keep), pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "margins"])

        fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        return rows.mapInArrow(run, f"{fields}, margins array<double>")


def _field(batch: pa.RecordBatch, name: str) -> pa.ListArray:
    """A list of the vectors ``tf``; flattening, other than ``field``, heeds a slice."""
    vectors = batch.column("tf")
    return vectors.flatten()[vectors.type.get_field_index(name)]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``MOST_COUNTS`` word counts, or one row."""
    sizes = _field(batch, "indices").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    begin = 0
    while begin < batch.num_rows:
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + MOST_COUNTS, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _counts(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, slot, count)`` of every word count, in the order of the rows."""
    slots, counts = _field(part, "indices"), _field(part, "values")
    row = np.repeat(np.arange(part.num_rows), slots.value_lengths().to_numpy(zero_copy_only=False))
    return row, slots.flatten().to_numpy(), counts.flatten().to_numpy()


def _by_row(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the lines of ``values`` by row; 0 where a row has none."""
    sums = np.zeros((n, values.shape[1]))
    if len(row):
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sums[row[starts]] = np.add.reduceat(values, starts, axis=0)
    return sums


def _weighed(part: pa.RecordBatch, idf: np.ndarray, weights: np.ndarray):
    """``(row, slot, weighed counts, margins)`` under all models; the last line of weights is constant."""
    row, slot, counts = _counts(part)
    x = counts[:, None] * idf[slot]
    lengths = np.sqrt(_by_row(row, x * x, part.num_rows))
    x /= np.where(lengths > 0, lengths, 1.0)[row]
    return row, slot, x, weights[-1] + _by_row(row, x * weights[slot], part.num_rows)


def _fold_counts(part: pa.RecordBatch, slots: int, k: int) -> np.ndarray:
    row, slot, _ = _counts(part)
    fold = part.column("fold").to_numpy()
    found = np.bincount(slot * np.int64(k) + fold[row], minlength=slots * k)
    return np.vstack([found.reshape(slots, k), np.bincount(fold, minlength=k)]).astype(np.float64)


def _gradients(part: pa.RecordBatch, idf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the log loss's gradient over the rows that each model may see."""
    row, slot, x, margins = _weighed(part, idf, weights)
    k = weights.shape[1]
    error = 1.0 / (1.0 + np.exp(-margins)) - part.column("label").to_numpy()[:, None]
    error[np.arange(part.num_rows), part.column("fold").to_numpy()] = 0.0
    x *= error[row]
    sums = [np.bincount(slot, weights=x[:, m], minlength=len(weights) - 1) for m in range(k)]
    return np.vstack([np.stack(sums, axis=1), error.sum(axis=0)])


def _summed(rows: DataFrame, of_part: Callable[[pa.RecordBatch], np.ndarray], n: int, k: int) -> np.ndarray:
    """The sum of ``of_part`` (n x k numbers) over all rows.

    A task adds up its own; the sums of tasks are added as a tree, so the driver gets few of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in _parts(batch):
                total = of_part(part) if total is None else total + of_part(part)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    sums = rows.mapInArrow(run, "sums binary").rdd.map(lambda r: np.frombuffer(r["sums"]))
    total = sums.treeAggregate(0.0, np.add, np.add)
    return total.reshape(n, k) if np.ndim(total) else np.zeros((n, k))
