"""Readers for corpora, predictions and fold outputs.

A file holding one big JSON array is cut among tasks by ``json_arrays`` and read twice.  Read such
files once, write Parquet, and let everything downstream scan Parquet.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.session import ship_package
from lexgrain.sources.json_arrays import read_array_elements

PAIR_SCHEMA = "sentence_pair array<string>, label_pair array<int>"
TEST_SCHEMA = "idx bigint, sentence string"
FLAT_SCHEMA = "array<struct<sentence: string, label: string, idx: bigint>>"


def _required(value: Column, message: str) -> Column:
    return F.coalesce(value, F.raise_error(F.lit(message)))


def explode_pairs(
    df: DataFrame,
    sentences: str = "sentence_pair",
    labels: str = "label_pair",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per list entry: ``(keep..., pos, sentence, label)``; unequal lists are an error."""
    zipped = F.when(
        F.size(sentences) == F.size(labels),
        F.arrays_zip(F.col(sentences).alias("sentence"), F.col(labels).alias("label")),
    ).otherwise(F.raise_error(F.lit("sentence and label lists differ in length")))
    return df.select(*keep, F.posexplode(zipped).alias("pos", "_entry")).select(
        *keep,
        "pos",
        F.col("_entry").getField("sentence").alias("sentence"),
        F.col("_entry").getField("label").alias("label"),
    )


def read_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Labelled pair records from a JSON array, or from JSON Lines.

    ``record`` increases with the place in its ``file``; ``with_positions`` over ``file, record, pos``
    of the exploded pairs gives the list position of every sentence.
    """
    if lines:
        records = spark.read.schema(PAIR_SCHEMA).option("mode", "FAILFAST").json(path)
        records = records.withColumn("file", F.col("_metadata.file_path"))
        return records.withColumn("record", F.monotonically_increasing_id())
    return _elements(spark, path, f"struct<{PAIR_SCHEMA.replace(' array', ': array')}>").select(
        "_r.*", "file", F.col("index").alias("record")
    )


def _elements(spark: SparkSession, path: str, schema: str, keep: tuple[str, ...] = ("file", "index")) -> DataFrame:
    """``(keep..., _r)``: the elements of array files as records of the schema."""
    ship_package(spark)
    found = read_array_elements(spark, path)
    return found.select(*keep, F.from_json("element", schema, {"mode": "FAILFAST"}).alias("_r"))


def _flat_records(records: DataFrame, position: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return records.select(
        *keep,
        F.coalesce("_r.idx", F.col(position).cast("bigint")).alias("id"),
        _required(F.col("_r.sentence"), "record without sentence").alias("sentence"),
        # Through double, so that 1, "1" and 1.0 are all accepted.
        _required(F.col("_r.label"), "record without label")
        .cast("double")
        .cast("int")
        .alias("label"),
    )


def parse_flat(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., id, sentence, label)`` from JSON array texts; a missing idx is the position."""
    records = F.from_json(value, FLAT_SCHEMA, {"mode": "FAILFAST"})
    exploded = df.select(*keep, F.posexplode(records).alias("_pos", "_r"))
    return _flat_records(exploded, "_pos", keep)


def read_flat(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., id, sentence, label)`` from JSON array files; a missing idx is the place in its file."""
    record = FLAT_SCHEMA.removeprefix("array<").removesuffix(">")
    return _flat_records(_elements(spark, path, record), "index", keep)


def read_test(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(id, sentence)`` from records that must carry an ``idx``."""
    records = (
        spark.read.schema(TEST_SCHEMA)
        .option("mode", "FAILFAST")
        .option("multiLine", not lines)
        .json(path)
    )
    return records.select(_required(F.col("idx"), "record without idx").alias("id"), "sentence")


def parse_documents(df: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., id, text)`` from JSON texts of any of three shapes.

    The shapes are ``{"sentences": [text]}``, ``[{"sentence": text, "idx": id?}]`` and ``[text]``;
    a missing id is the position.  The first characters tell the shape, and the text is then parsed
    once with that shape's schema; any other shape raises.
    """
    strict = {"mode": "FAILFAST"}

    def entry(id: Column, text: Column) -> Column:
        return F.struct(id.cast("bigint").alias("id"), text.alias("text"))

    texts = F.from_json(value, "struct<sentences: array<string>>", strict)["sentences"]
    from_texts = F.transform(
        _required(texts, "unknown document shape"), lambda x, i: entry(i, x)
    )
    from_records = F.transform(
        F.from_json(value, "array<struct<sentence: string, idx: bigint>>", strict),
        lambda x, i: entry(
            F.coalesce(x["idx"], i.cast("bigint")),
            _required(x["sentence"], "record without sentence"),
        ),
    )
    from_list = F.transform(F.from_json(value, "array<string>", strict), lambda x, i: entry(i, x))
    entries = (
        F.when(F.col(value).rlike(r"^\s*\{"), from_texts)
        .when(F.col(value).rlike(r"^\s*\[\s*\{"), from_records)
        .when(F.col(value).rlike(r"^\s*\[\s*(\"|\]|null)"), from_list)
        .otherwise(F.raise_error(F.lit("unknown document shape")))
    )
    return df.select(*keep, F.inline(entries))


def read_documents(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(keep..., id, text)`` from JSON files of any of the three shapes; ``keep`` may name ``file``.

    Elements that are objects are records, others are texts; a missing id is the place in its file.
    """
    ship_package(spark)
    found = read_array_elements(spark, path)
    strict = {"mode": "FAILFAST"}
    record = F.from_json("element", "struct<sentence: string, idx: bigint>", strict)
    text = F.from_json(F.concat(F.lit("["), "element", F.lit("]")), "array<string>", strict)[0]
    is_record = F.col("element").rlike(r"^\s*\{")
    is_text = F.col("element").rlike(r"^\s*(\"|null)")
    checked = F.when(is_record | is_text, F.col("element")).otherwise(
        F.raise_error(F.lit("unknown document shape"))
    )
    parsed = found.withColumn("element", checked).select(
        *keep, "index", is_record.alias("_is"), F.when(is_record, record).alias("_r"), F.when(~is_record, text).alias("_t")
    )
    return parsed.select(
        *keep,
        F.coalesce("_r.idx", "index").alias("id"),
        F.when(F.col("_is"), _required(F.col("_r.sentence"), "record without sentence")).otherwise(F.col("_t")).alias("text"),
    )


def read_predictions(spark: SparkSession, path: str, target: str = "target") -> DataFrame:
    """``(id, target)`` from CSV with a header."""
    schema = f"id bigint, {target} int"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_oof(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label, pred_prob)`` from CSV with a header."""
    schema = "id bigint, label int, pred_prob double"
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_existing(
    spark: SparkSession,
    paths: dict[str, str],
    reader: Callable[[SparkSession, str], DataFrame] = read_predictions,
    name: str = "model",
    minimum: int = 2,
) -> tuple[DataFrame, list[str]]:
    """Union of the sources that exist, tagged with their name, and the names that are missing.

    Fewer than ``minimum`` existing sources are an error.
    """
    found, missing = [], []
    for position, (source, path) in enumerate(paths.items()):
        try:
            part = reader(spark, path)
            part.schema  # resolves the path on every kind of session
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(source)
            continue
        found.append(
            part.select(F.lit(source).alias(name), F.lit(position).alias(f"{name}_ord"), "*")
        )
    if len(found) < minimum:
        raise ValueError(f"need {minimum} sources, missing: {missing}")
    return reduce(lambda a, b: a.unionByName(b), found), missing


def read_fold_logits(spark: SparkSession, parent: str) -> DataFrame:
    """Scored logits below ``parent``, with ``model=`` and ``fold=`` folders as columns.

    Without fold folders the parent itself is read as the only fold.  Filters on ``fold`` and
    ``model`` prune folders.  Names of models are strings, however they look.
    """
    types = {"model": "string", "fold": "int"}
    found = spark.read.parquet(parent).schema
    fields = [f"`{f.name}` {types.get(f.name, f.dataType.simpleString())}" for f in found]
    logits = spark.read.schema(", ".join(fields)).parquet(parent)
    if "l0" not in logits.columns or "l1" not in logits.columns:
        raise ValueError(f"no fold outputs found in {parent}")
    if "fold" not in logits.columns:
        logits = logits.withColumn("fold", F.lit(0))
    return logits
