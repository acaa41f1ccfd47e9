"""TF-IDF over word unigrams and bigrams.

Fitting is one shuffle on the term.  Applying a fitted model is row-local: the vocabulary is
bounded by ``max_features``, Spark ML's ``CountVectorizerModel`` counts its terms inside each row,
and weights and norms are array expressions, so no text or term leaves its partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexgrain.functions import text as tx
from lexgrain.session import kept_table

# Separates terms in a packed literal; a term holds word characters and single spaces only.
_TERM_SEPARATOR = "\n"


def with_ngrams(df: DataFrame, text: str = "sentence", out: str = "ngrams") -> DataFrame:
    return (
        df.withColumn("_tokens", tx.word_tokens(F.col(text)))
        .withColumn(out, tx.unigrams_and_bigrams(F.col("_tokens")))
        .drop("_tokens")
    )


def ngram_rows(df: DataFrame, text: str = "sentence", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """``(keep..., pos, term)``.

    Exploding an expression, not a named array: for a named array Spark adds a "not empty" filter
    and pushes it to the scan, where it would tokenise every text again.
    """
    tokens = df.select(*keep, tx.word_tokens(F.col(text)).alias("_tokens"))
    return tokens.select(
        *keep, F.posexplode(tx.unigrams_and_bigrams(F.col("_tokens"))).alias("pos", "term")
    )


def _occurrences(df: DataFrame, terms: Column) -> DataFrame:
    """One ``(term, d)`` row per occurrence, with ``d = 1`` on one occurrence per document.

    Sorting inside the row brings equal terms together, so a term starts where it differs from
    its predecessor and documents can be counted without a ``(document, term)`` shuffle.
    """
    ordered = df.select(F.sort_array(terms).alias("_terms"))
    before = F.slice(
        F.concat(F.array(F.lit(None).cast("string")), F.col("_terms")), F.lit(1), F.size("_terms")
    )
    rows = F.zip_with(
        "_terms",
        before,
        lambda t, b: F.struct(t.alias("term"), F.when(t == b, 0).otherwise(1).alias("d")),
    )
    return ordered.select(F.inline(rows))


def _frequencies(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("term").agg(F.sum("d").alias("df"), F.count("*").alias("cf"))


def ngram_frequencies(df: DataFrame, text: str = "sentence") -> DataFrame:
    """``(term, df, cf)``: documents with the term and occurrences of the term.

    Both are summed in the same map-side combine: a term found in every document costs one row
    per task.
    """
    rows = with_ngrams(df.select(text).where(F.col(text).isNotNull()), text)
    return _frequencies(_occurrences(rows, F.col("ngrams")))


class PairSketch:
    """Count-min sketch of pair occurrences, held as rows of a grouping.

    Each pair falls into one slot of every row of ``width`` slots.  Counts of a slot add up over
    tasks, so sketches of parts merge by addition, in the map-side combine and after the shuffle;
    a task holds at most ``ROWS * width`` of them.  A slot counts all pairs that fall into it, thus
    the least slot of a pair is never below the pair's count.  Of N occurrences it lies more than
    ``e * N / width`` above it with a probability of at most ``e ** -ROWS``.
    """

    ROWS = 2

    def __init__(self, width_bits: int = 18):
        if not 6 <= width_bits <= 31:
            raise ValueError("width_bits must be between 6 and 31")
        self.bits = width_bits

    def slots(self, pair: Column) -> list[Column]:
        """Slot of ``pair`` in every row; the rows take separate bits of one 64-bit hash."""
        mask = F.lit((1 << self.bits) - 1).cast("bigint")
        digest = F.xxhash64(pair)
        return [
            F.shiftrightunsigned(digest, row * self.bits).bitwiseAND(mask)
            + F.lit(row << self.bits).cast("bigint")
            for row in range(self.ROWS)
        ]

    def packed(self, counts: DataFrame, least: int) -> list[int]:
        """64 slots to a word, bit set where a slot of ``counts(slot, n)`` reaches ``least``.

        Collected are at most ``ROWS * width / 64`` words: 64 KB with the default width.
        """
        word = F.shiftright("slot", 6)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("slot") % 64).cast("int"))
        rows = counts.where(F.col("n") >= least).groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
        words = [0] * ((self.ROWS << self.bits) // 64)
        for row in rows.collect():
            words[row["word"]] = row["bits"]
        return words

    def may_reach(self, pairs: Column, words: list[int]) -> Column:
        """The elements of an array of pairs all of whose slots are set, tested inside the row."""
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

        def is_set(slot: Column) -> Column:
            return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), (slot % 64).cast("int")) == 1

        def all_set(pair: Column) -> Column:
            first, *others = [is_set(slot) for slot in self.slots(pair)]
            for other in others:
                first = first & other
            return first

        return F.filter(pairs, all_set)


def _words_and_slots(tokens: DataFrame, sketch: PairSketch) -> DataFrame:
    """``(term, slot, df, cf)`` in one scan: words with a null slot, sketch counts with a null term.

    Neither is set on the row that counts the documents.
    """
    marked = F.sort_array(F.concat(F.array(F.lit(None).cast("string")), F.col("_tokens")))
    slots = F.flatten(
        F.transform(tx.bigrams(F.col("_tokens")), lambda pair: F.array(*sketch.slots(pair)))
    )
    no_term, no_slot = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    sorted_words = tokens.select(marked.alias("_words"), slots.alias("_slots"))
    before = F.slice(F.concat(F.array(no_term), F.col("_words")), F.lit(1), F.size("_words"))
    words = F.zip_with(
        "_words",
        before,
        lambda t, b: F.struct(
            t.alias("term"), no_slot.alias("slot"), F.when(t == b, 0).otherwise(1).alias("d")
        ),
    )
    counts = F.transform(
        "_slots",
        lambda s: F.struct(no_term.alias("term"), s.alias("slot"), F.lit(0).alias("d")),
    )
    rows = sorted_words.select(F.inline(F.concat(words, counts)))
    return rows.groupBy("term", "slot").agg(F.sum("d").alias("df"), F.count("*").alias("cf"))


def vocabulary(
    df: DataFrame,
    text: str = "sentence",
    max_features: int = 5000,
    min_df: int = 2,
    max_df: float = 0.95,
    width_bits: int = 18,
) -> DataFrame:
    """``(term, df, cf, idf, idx)`` of the most frequent terms within the document bounds.

    Ties at the cap go to the alphabetically first term; ``idx`` numbers terms alphabetically.

    Almost all distinct pairs of a large corpus are far too rare to be kept.  A first scan counts
    single words and, in a sketch of ``2 ** width_bits`` slots a row, pairs.  Once words alone fill
    the vocabulary down to some frequency, a pair below it is out, and so is one in fewer than
    ``min_df`` documents.  A second scan drops the pairs whose sketch shows that inside the row,
    before any shuffle, and counts the others exactly; a wrongly kept pair costs time only.

    The counts of the first scan are written to the shared folder: they give the number of
    documents (a null word stands once in every text), the frequency bound and the sketch.
    """
    source = df.select(text).where(F.col(text).isNotNull())
    tokens = source.select(tx.word_tokens(F.col(text)).alias("_tokens"))
    sketch = PairSketch(width_bits)
    counted = kept_table(_words_and_slots(tokens, sketch), "words")
    words = counted.where(F.col("slot").isNull()).drop("slot")
    documents = words.where(F.col("term").isNull()).select("df").first()
    n_docs = documents["df"] if documents else 0
    in_bounds = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs))
    eligible = words.where(F.col("term").isNotNull() & in_bounds)
    filled = (
        eligible.orderBy(F.desc("cf"), F.asc("term"))
        .limit(max_features)
        .agg(F.count("*").alias("n"), F.min("cf").alias("cf"))
        .first()
    )
    lowest = filled["cf"] if filled["n"] == max_features else 0
    slots = counted.where(F.col("slot").isNotNull()).select("slot", F.col("cf").alias("n"))
    frequent = sketch.packed(slots, max(lowest, min_df))
    pairs = sketch.may_reach(tx.bigrams(F.col("_tokens")), frequent)
    candidates = eligible.where(F.col("cf") >= lowest).unionByName(
        _frequencies(_occurrences(tokens, pairs))
    )
    kept = candidates.where(in_bounds).orderBy(F.desc("cf"), F.asc("term")).limit(max_features)
    # At most max_features rows reach this window.
    index = F.row_number().over(Window.orderBy("term")) - 1
    return kept.select(
        "term",
        "df",
        "cf",
        (F.ln(F.lit(n_docs + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf"),
        index.cast("bigint").alias("idx"),
    )


@dataclass(frozen=True)
class TfidfModel:
    """A fitted vocabulary of at most ``max_features`` terms with its document weights."""

    terms: list[str]
    idf: list[float]

    @classmethod
    def fit(cls, df: DataFrame, text: str = "sentence", **options) -> TfidfModel:
        rows = vocabulary(df, text, **options).orderBy("idx").collect()  # <= max_features rows
        if not rows:
            raise ValueError("no term is left within the document frequency bounds")
        return cls([r["term"] for r in rows], [r["idf"] for r in rows])

    def _weighted(self, df: DataFrame, text: str) -> DataFrame:
        """Add ``_idx`` and ``_w``: vocabulary indices and L2-normalised weights of each row."""
        counter = CountVectorizerModel.from_vocabulary(self.terms, "_ngrams", "_counts")
        known = with_ngrams(df.where(F.col(text).isNotNull()), text, "_ngrams")
        packed = ",".join(repr(value) for value in self.idf)
        idf = F.split(F.lit(packed), ",").cast("array<double>")
        raw = F.zip_with(
            "_sparse.indices",
            "_sparse.values",
            lambda i, tf: (F.ln(tf) + 1.0) * F.get(idf, i),
        )
        # Repeated into an array rather than used inside the lambda, where the optimizer would
        # evaluate the whole norm once per element.
        norm = F.sqrt(F.aggregate("_raw", F.lit(0.0), lambda acc, w: acc + w * w))
        norms = F.array_repeat(norm, F.size("_raw"))
        return (
            counter.transform(known)
            .select(*df.columns, F.unwrap_udt("_counts").alias("_sparse"))
            .select(*df.columns, F.col("_sparse.indices").alias("_idx"), raw.alias("_raw"))
            .withColumn("_w", F.zip_with("_raw", norms, lambda w, n: w / n))
            .drop("_raw")
        )

    def weights(
        self, df: DataFrame, text: str = "sentence", keep: tuple[str, ...] = ("id",)
    ) -> DataFrame:
        """Long table ``(keep..., term, weight)``; a text without known terms has no rows."""
        terms = F.split(F.lit(_TERM_SEPARATOR.join(self.terms)), _TERM_SEPARATOR)
        rows = F.zip_with(
            "_idx", "_w", lambda i, w: F.struct(F.get(terms, i).alias("term"), w.alias("weight"))
        )
        return self._weighted(df.select(*keep, text), text).select(*keep, F.inline(rows))

    def vectors(self, df: DataFrame, text: str = "sentence", out: str = "tfidf") -> DataFrame:
        """Add the weights as a sparse ML vector of the vocabulary's size.

        SQL has no expression from arrays to a sparse vector, and going through a dense array
        costs the whole vocabulary per row.  Reading the vector type from JSON stays in the JVM
        and costs only the terms present.
        """
        sparse = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(len(self.terms)).alias("size"),
            F.col("_idx").alias("indices"),
            F.col("_w").alias("values"),
        )
        schema = StructType([StructField("v", VectorUDT())])
        as_json = F.to_json(F.struct(sparse.alias("v")))
        vector = F.from_json(as_json, schema, {"mode": "FAILFAST"})["v"]
        return self._weighted(df, text).withColumn(out, vector).drop("_idx", "_w")
