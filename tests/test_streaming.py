import pytest
from pyspark.sql import functions as F

from lexgrain.operators.features import with_cleaned, with_text_features
from lexgrain.operators.models import batch_scorer, linear_scorer
from lexgrain.streaming.files import process_new_files

SCHEMA = "id long, sentence string"
SCORE = batch_scorer(linear_scorer([[0.5, -1.0], [0.25, 2.0]]), width=2)


def scored(df):
    """Cleaning, features and a model's scores: everything that works row by row."""
    rows = with_text_features(with_cleaned(df))
    return rows.withColumn("logits", SCORE(F.array(F.col("word_count").cast("double"), "upper_ratio")))


def add_file(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def sorted_rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


def test_an_interrupted_run_goes_on_and_equals_the_batch(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for start in range(0, 50, 10):
        add_file(spark, source, [(i, f'{i} " A b " / c , ok') for i in range(start, start + 10)])
    add_file(spark, source, [(50, ""), (51, None), (52, "same"), (52, "same")])

    def failing(df):
        rejected = F.raise_error(F.lit("worker lost")).cast("string")
        return scored(df.withColumn("sentence", F.when(F.col("id") == 35, rejected).otherwise(F.col("sentence"))))

    with pytest.raises(Exception, match="worker lost"):
        process_new_files(spark, source, SCHEMA, failing, target, progress, files_per_batch=1)
    done = spark.read.parquet(target).count()
    assert 0 < done < 54
    found = process_new_files(spark, source, SCHEMA, scored, target, progress, files_per_batch=1)
    expected = sorted_rows(scored(spark.read.schema(SCHEMA).parquet(source)).drop("sentence"))
    assert sorted_rows(found.drop("sentence")) == expected and len(expected) == 54


def test_later_files_only_are_read_again(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add_file(spark, source, [(1, "one")])
    first = process_new_files(spark, source, SCHEMA, with_cleaned, target, progress)
    assert [tuple(r) for r in first.collect()] == [(1, "one")]
    same = process_new_files(spark, source, SCHEMA, with_cleaned, target, progress)
    assert same.count() == 1
    add_file(spark, source, [(2, "two ,")])
    both = process_new_files(spark, source, SCHEMA, with_cleaned, target, progress)
    assert sorted(map(tuple, both.collect())) == [(1, "one"), (2, "two,")]


def test_files_without_rows(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame([], SCHEMA).write.parquet(source)
    found = process_new_files(spark, source, SCHEMA, with_cleaned, target, progress)
    assert found.collect() == [] and found.columns == ["id", "sentence"]
