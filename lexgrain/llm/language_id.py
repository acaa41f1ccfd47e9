"""Language identification from TF-IDF character n-grams.

A sparse multinomial logistic regression is trained with follow-the-regularised-leader steps and
elastic-net penalties on a bounded sample of labelled texts; a temperature fitted on the part of the
sample that training left out calibrates its scores.  Document frequencies come from all labelled
texts, and every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import shards, utf8

UNDETERMINED = "und"
PREDICTIONS = "doc_id bigint, held_out boolean, lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")
_SHARD_BYTES = 4 << 20


@dataclass(frozen=True)
class LanguageSettings:
    """``sample_per_language`` bounds the labelled texts used to fit, the only bounded part."""

    buckets: int = 1 << 14
    longest_gram: int = 3
    sample_per_language: int = 500
    passes: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.01
    held_back: int = 5


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x (buckets + 1), the last for the constant
    temperature: float
    settings: LanguageSettings


def gram_counts(texts: pa.Array, settings: LanguageSettings) -> np.ndarray:
    """Counts of hashed character n-grams, a row per text."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat, offsets = utf8(low)
    points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    begins = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])[offsets]
    n, b = len(texts), settings.buckets
    shift = np.uint64(64 - b.bit_length() + 1)
    counts = np.zeros((n, b), np.float32)
    key = np.zeros(len(points), np.uint64)
    for size in range(1, settings.longest_gram + 1):
        # key holds the hash of the grams of the size before that start at each character
        m = max(len(points) - size + 1, 0)
        key = key[:m] * np.uint64(0x9E3779B97F4A7C15) + (points[size - 1 : size - 1 + m] + np.uint64(1))
        bucket = ((key * np.uint64(0xD1B54A32D192ED03)) >> shift).astype(np.int64)
        for row, (start, end) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
            if end - start >= size:
                counts[row] += np.bincount(bucket[start : end - size + 1], minlength=b)
    return counts


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(counts) * idf
    norm = np.linalg.norm(weighted, axis=1, keepdims=True)
    return (weighted / np.where(norm > 0, norm, 1)).astype(np.float32)


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _small(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Shards of few rows, since counts take ``buckets`` numbers for each."""
    for shard in shards(batches, text, _SHARD_BYTES):
        for begin in range(0, shard.num_rows, 256):
            yield shard.slice(begin, 256)


class FtrlClassifier:
    """Multinomial logistic regression, one FTRL-proximal step per example."""

    def __init__(self, classes: int, features: int, settings: LanguageSettings):
        self.s = settings
        self.z = np.zeros((classes, features))
        self.n = np.zeros((classes, features))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[:, at], self.n[:, at], self.s
        shrunk = np.sign(z) * s.l1 - z
        return np.where(np.abs(z) <= s.l1, 0.0, shrunk / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    def step(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax((w @ values)[None])[0]
        error[label] -= 1
        gradient = error[:, None] * values
        n = self.n[:, at]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.s.alpha
        self.z[:, at] += gradient - sigma * w
        self.n[:, at] = n + gradient**2


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of smallest log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _sparse_tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = np.log1p(counts) * idf[at]
    return values / max(float(np.linalg.norm(values)), 1e-12)


def fit(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, settings: LanguageSettings
) -> LanguageModel:
    """``rows`` are the buckets of each text and their counts."""
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], np.int64)
    features = [
        (np.append(at, settings.buckets), np.append(_sparse_tf_idf(at, counts, idf), 1.0))
        for at, counts in rows
    ]
    order = np.random.default_rng(0).permutation(len(y))
    kept_back = order[:: settings.held_back] if len(y) >= 10 * settings.held_back else order[:0]
    training = np.setdiff1d(order, kept_back)
    model = FtrlClassifier(len(languages), settings.buckets + 1, settings)
    for seed in range(settings.passes):
        for row in np.random.default_rng(seed + 1).permutation(training).tolist():
            model.step(*features[row], y[row])
    weights = model.weights()
    logits = np.array([weights[:, at] @ values for at, values in (features[i] for i in kept_back)])
    temperature = _temperature(logits, y[kept_back])
    return LanguageModel(languages, idf, weights.astype(np.float32), temperature, settings)


def predict(texts: pa.Array, model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """``(languages, scores)``; a text without a letter is undetermined with score 0."""
    has_letter = [bool(t) and _LETTER.search(t) is not None for t in texts.to_pylist()]
    if model is None:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    features = tf_idf(gram_counts(texts, model.settings), model.idf)
    logits = features @ model.weights[:, :-1].T + model.weights[:, -1]
    scores = softmax(logits.astype(np.float64) / model.temperature)
    best = scores.argmax(axis=1)
    names = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), has_letter, strict=True)]
    return names, np.where(has_letter, scores[np.arange(len(best)), best], 0.0)


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    spark: SparkSession,
    docs: DataFrame,
    settings: LanguageSettings = LanguageSettings(),
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "lang",
) -> LanguageModel | None:
    """A model from the labelled documents that aren't held out; None if there are none.

    One pass over ids and labels counts the languages, one picks the sample, the smallest hashes of ids;
    a hash limit from the counts lets about four times the sample into the ranking, so a language
    that most texts have is no larger group than others.  Of several labels of one id the first by
    name counts.  One more pass over the texts
    counts the document frequencies of all labelled texts and returns the counts of the sample,
    at most ``sample_per_language`` texts of ``buckets`` numbers each.
    """
    labelled = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), F.col(label_column).alias("lang")
    ).where(F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id")))
    order = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    named = labelled.where(F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash"))
    share = 4.0 * settings.sample_per_language / F.count("*")
    limits = named.groupBy("lang").agg((F.least(share, F.lit(1.0)) * 2.0**64 - 2.0**63).alias("_limit"))
    sample = (
        named.join(F.broadcast(limits), "lang")  # a row for each language
        .where(F.col("_hash").cast("double") <= F.col("_limit"))
        .groupBy("doc_id", "_hash")
        .agg(F.min("lang").alias("lang"))
        .withColumn("_place", F.row_number().over(order))
        .where(F.col("_place") <= settings.sample_per_language)
    )
    chosen: dict[int, str] = {row["doc_id"]: row["lang"] for row in sample.collect()}
    if not chosen:
        return None
    sent = spark.sparkContext.broadcast(chosen)  # bounded by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(settings.buckets, np.int64), 0
        for shard in _small(batches):
            counts = gram_counts(shard.column("text"), settings)
            df += (counts > 0).sum(axis=0)
            n += shard.num_rows
            ids = shard.column("doc_id").to_pylist()
            rows = [i for i, doc_id in enumerate(ids) if doc_id in sent.value]
            if rows:
                at = [np.flatnonzero(counts[i]).astype(np.int32) for i in rows]
                yield _partial(
                    [ids[i] for i in rows],
                    [a.tobytes() for a in at],
                    [counts[i, a].tobytes() for i, a in zip(rows, at, strict=True)],
                )
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(at, settings.buckets), pa.int64()),
                pa.array(np.append(df[at], n), pa.int64()),
                *(pa.nulls(len(at) + 1, t) for t in (pa.int64(), pa.binary(), pa.binary())),
            ],
            names=_PARTIAL_NAMES,
        )

    partial = labelled.select("doc_id", "text").mapInArrow(run, _PARTIAL)
    # Rows of the sample have no bucket: each is a group of its own by its id and its counts.
    totals = partial.groupBy("bucket", "doc_id", "at", "counts").agg(F.sum("rows").alias("rows")).collect()
    df, n, seen = np.zeros(settings.buckets, np.int64), 0, {}
    for row in totals:
        if row["bucket"] is None:
            counted = (row["at"], row["counts"])
            seen[row["doc_id"]] = min(seen.get(row["doc_id"], counted), counted)
        elif row["bucket"] == settings.buckets:
            n = row["rows"]
        else:
            df[row["bucket"]] = row["rows"]
    idf = np.log((1 + n) / (1 + df)) + 1
    ids = sorted(seen)
    sample_rows = [
        (np.frombuffer(at, np.int32), np.frombuffer(counts, np.float32)) for at, counts in map(seen.get, ids)
    ]
    return fit(sample_rows, [chosen[i] for i in ids], idf.astype(np.float32), settings)


_PARTIAL = "bucket bigint, rows bigint, doc_id bigint, at binary, counts binary"
_PARTIAL_NAMES = ["bucket", "rows", "doc_id", "at", "counts"]


def _partial(ids, at, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(len(ids), pa.int64()),
            pa.nulls(len(ids), pa.int64()),
            pa.array(ids, pa.int64()),
            pa.array(at, pa.binary()),
            pa.array(counts, pa.binary()),
        ],
        names=_PARTIAL_NAMES,
    )


def languages(
    spark: SparkSession,
    docs: DataFrame,
    model: LanguageModel | None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything without a
    model.  Null ids, repeated rows and very long texts are handled like others.
    """
    sent = spark.sparkContext.broadcast(model)  # languages x buckets numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _small(batches):
            names, scores = predict(shard.column("text"), sent.value)
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("doc_id").cast(pa.int64()),
                    shard.column("held_out"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        F.coalesce(is_held_out(F.col(id_column)), F.lit(False)).alias("held_out"),
        F.col(text_column).alias("text"),
    )
    return rows.mapInArrow(run, PREDICTIONS)


def keep_known_languages(
    spark: SparkSession,
    docs: DataFrame,
    model: LanguageModel | None,
    least_score: float = 0.3,
    text_column: str = "text",
) -> DataFrame:
    """The rows with a predicted language of at least ``least_score``, with all their columns."""
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _small(batches, text_column):
            names, scores = predict(shard.column(text_column), sent.value)
            known = [n != UNDETERMINED and s >= least_score for n, s in zip(names, scores.tolist(), strict=True)]
            yield shard.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
