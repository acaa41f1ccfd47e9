"""Cleaning, features and tokens against plain Python string methods."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.functions import text as tx
from lexgrain.operators.features import FEATURES, Scaler, with_cleaned, with_text_features
from lexgrain.operators.tfidf import ngram_rows

PUNCT = set(".,;!?:'\"-")

GOLDEN_CLEAN = {
    "": "",
    "   ": "",
    "a\u00a0b\u001cc\u0085d\u2028e": "a b c d e",
    '" hi "': '"hi"',
    '" a " b " c "': '"a" b "c"',
    "\u201c hi \u201d": "\u201c hi \u201d",
    "a , b !": "a, b!",
    "it 's": "it's",
    "x / y": "x/y",
    '"  nested " inner "  end': '"nested" inner " end',
    None: None,
}


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, sentence string")


def ordered(df, column):
    return [r[column] for r in df.orderBy("id").collect()]


def python_features(text):
    words = text.split()
    n = len(text)

    def share(count):
        return count / n if n else 0.0

    punct = sum(c in PUNCT for c in text)
    return (
        n,
        len(words),
        sum(map(len, words)) / len(words) if words else 0.0,
        punct,
        share(punct),
        share(sum(c.isupper() for c in text)),
        share(sum(c.isdigit() for c in text)),
        share(sum(c.isspace() for c in text)),
    )


ALPHABET = list("aB \t\n.,;!?:'\"-/09_é") + [
    "\u00a0", "\u001c", "\u0085", "\u2003", "\u2028", "\u3000",
    "\u00b2", "\u2167", "\u2460", "\U0001f600", "中", "\u201c",
]


def test_clean_golden(spark):
    cleaned = ordered(with_cleaned(frame(spark, list(GOLDEN_CLEAN))), "sentence")
    assert cleaned == list(GOLDEN_CLEAN.values())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=150, max_size=200))
def test_features_and_words_match_python(spark, texts):
    rows = with_text_features(frame(spark, texts)).orderBy("id").collect()
    for text, row in zip(texts, rows, strict=True):
        assert tuple(row[f] for f in FEATURES) == pytest.approx(python_features(text), abs=1e-12)
    words = frame(spark, texts).withColumn("w", tx.whitespace_tokens(F.col("sentence")))
    assert ordered(words, "w") == [t.lower().split() for t in texts]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=ALPHABET, max_size=60), min_size=150, max_size=200))
def test_clean_and_word_tokens_match_python(spark, texts):
    def steps(t):
        t = " ".join(t.split())
        for pattern, replacement in (
            (r'" (.*?) "', r'"\1"'), (r" +([.,;!?:'])", r"\1"), (r" */ *", "/")
        ):
            t = re.sub(pattern, replacement, t)
        return t

    df = frame(spark, texts)
    assert ordered(with_cleaned(df), "sentence") == [steps(t) for t in texts]
    words = df.withColumn("w", tx.word_tokens(F.col("sentence")))
    assert ordered(words, "w") == [re.findall(r"\w\w+", t.lower()) for t in texts]
    # Vocabulary fitting relies on this.
    cleaned = with_cleaned(df).withColumn("w", tx.word_tokens(F.col("sentence")))
    assert ordered(cleaned, "w") == ordered(words, "w")


def test_null_text_has_null_features(spark):
    row = with_text_features(frame(spark, [None])).first()
    assert all(row[f] is None for f in FEATURES)


def test_ngrams(spark):
    rows = ngram_rows(frame(spark, ["The cat sat", "one", "", "x"])).orderBy("id", "pos").collect()
    assert [(r["id"], r["term"]) for r in rows] == [
        (0, "the"), (0, "cat"), (0, "sat"), (0, "the cat"), (0, "cat sat"), (1, "one"),
    ]


def test_truncate_and_pad(spark):
    df = frame(spark, ["aa bb cc", "aa", ""]).withColumn("t", tx.word_tokens(F.col("sentence")))
    rows = df.select(
        "id", tx.pad_tokens(F.col("t"), 2, "#").alias("p"), tx.padding_mask(F.col("t"), 2).alias("m")
    ).orderBy("id").collect()
    assert [(r["p"], r["m"]) for r in rows] == [
        (["aa", "bb"], [1, 1]), (["aa", "#"], [1, 0]), (["#", "#"], [0, 0])
    ]


def test_scaler_uses_population_deviation_and_guards_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, c double")
    scaler = Scaler.fit(df, ["x", "c"])
    assert scaler.stds["x"] == pytest.approx(1.247219128924647)
    rows = scaler.transform(df).collect()
    assert [r["c"] for r in rows] == [0.0, 0.0, 0.0]
    assert sum(r["x"] for r in rows) == pytest.approx(0.0)


def test_row_functions_accept_streams(spark, tables):
    stream = spark.readStream.schema("doc_id long, text string").parquet(f"{tables}/documents*.parquet")
    out = with_text_features(with_cleaned(stream, "text"), "text")
    assert out.isStreaming and set(FEATURES) <= set(out.columns)
