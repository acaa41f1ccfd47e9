import json

import pytest
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from lexgrain.operators.layout import with_positions
from lexgrain.sources import readers, sinks


def write(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_pairs(spark, tmp_path):
    path = write(tmp_path, "pairs.json", [
        {"sentence_pair": ["a", "b"], "label_pair": [0, 1]},
        {"sentence_pair": ["c"], "label_pair": [1]},
        {"sentence_pair": ["d", "e", "f"], "label_pair": [0, 0, 1]},
        {"sentence_pair": [], "label_pair": []},
    ])
    rows = readers.explode_pairs(readers.read_pairs(spark, path)).collect()
    assert sorted((r["sentence"], r["label"]) for r in rows) == [
        ("a", 0), ("b", 1), ("c", 1), ("d", 0), ("e", 0), ("f", 1)
    ]


def test_pair_positions_follow_the_file(spark, tmp_path):
    words = [f"w{i * 37 % 101}" for i in range(101)]
    pairs = [{"sentence_pair": words[i : i + 2], "label_pair": [0] * len(words[i : i + 2])} for i in range(0, 101, 2)]
    path = write(tmp_path, "ordered.json", pairs)
    records = readers.explode_pairs(readers.read_pairs(spark, path), keep=("record",))
    rows = with_positions(records, ["record", "pos"]).orderBy("id").collect()
    assert [(r["id"], r["sentence"]) for r in rows] == list(enumerate(words))


def test_unequal_pairs_are_rejected(spark, tmp_path):
    path = write(tmp_path, "bad.json", [{"sentence_pair": ["a", "b"], "label_pair": [0]}])
    with pytest.raises(Exception, match="differ in length"):
        readers.explode_pairs(readers.read_pairs(spark, path)).collect()


def test_flat_and_test_records(spark, tmp_path):
    path = write(tmp_path, "flat.json", [
        {"sentence": "a", "label": "1", "idx": 7}, {"sentence": "b", "label": 0},
        {"sentence": "c", "label": 1.0},
    ])
    rows = readers.read_flat(spark, path).collect()
    assert [(r["id"], r["sentence"], r["label"]) for r in rows] == [(7, "a", 1), (1, "b", 0), (2, "c", 1)]
    test = write(tmp_path, "test.json", [{"idx": 3, "sentence": "x"}])
    assert [tuple(r) for r in readers.read_test(spark, test).collect()] == [(3, "x")]
    bad = write(tmp_path, "bad.json", [{"sentence": "x"}])
    with pytest.raises(Exception, match="record without idx"):
        readers.read_test(spark, bad).collect()


@pytest.mark.parametrize(
    ("document", "expected"),
    [
        ({"sentences": ["a", "b"]}, [(0, "a"), (1, "b")]),
        ([{"sentence": "a", "idx": 9}, {"sentence": "b"}], [(9, "a"), (1, "b")]),
        (["a", "b"], [(0, "a"), (1, "b")]),
        ([], []),
    ],
)
def test_document_shapes(spark, tmp_path, document, expected):
    rows = readers.read_documents(spark, write(tmp_path, "doc.json", document)).collect()
    assert [tuple(r) for r in rows] == expected


def test_record_without_sentence_is_rejected(spark, tmp_path):
    path = write(tmp_path, "doc.json", [{"sentence": "a"}, {"idx": 4}])
    with pytest.raises(Exception, match="record without sentence"):
        readers.read_documents(spark, path).collect()


def test_scratch_folder_is_the_configured_one(spark, tmp_path):
    from lexgrain.session import CHECKPOINT_KEY, new_scratch_path, scratch_folder

    class Configured:
        class conf:
            @staticmethod
            def get(key, default):
                return "hdfs:///shared/" if key == CHECKPOINT_KEY else default

    assert new_scratch_path(Configured, "x").startswith("hdfs:///shared/x-")

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="all executors share"):
        scratch_folder(Cluster)


@pytest.mark.parametrize("document", [{"texts": ["a"]}, "plain", 3])
def test_unknown_shape_is_rejected(spark, tmp_path, document):
    with pytest.raises(Exception, match="unknown document shape"):
        readers.read_documents(spark, write(tmp_path, "doc.json", document)).collect()


def test_csv_crlf_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(2, 0), (1, 1)], "id long, target int")
    path = str(tmp_path / "out")
    sinks.write_predictions(df.orderBy("id"), path, single_file=True, crlf=True, name="label")
    part = next((tmp_path / "out").glob("part-*.csv")).read_bytes()
    assert part == b"id,label\r\n1,1\r\n2,0\r\n"
    (tmp_path / "given.csv").write_bytes(b"id,label\r\n1,1\r\n2,0\r\n")
    back = readers.read_predictions(spark, str(tmp_path / "given.csv"), "label")
    assert [tuple(r) for r in back.collect()] == [(1, 1), (2, 0)]


def test_oof_roundtrip_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([(2, 0, 0.25), (1, 1, 0.5)], "id long, label int, pred_prob double")
    sinks.write_oof(df, str(tmp_path / "oof"), single_file=True)
    rows = readers.read_oof(spark, str(tmp_path / "oof")).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0.5), (2, 0, 0.25)]


def test_existing_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 1)], "id long, target int")
    paths = {name: str(tmp_path / name) for name in ("a", "gone", "b")}
    for name in ("a", "b"):
        sinks.write_predictions(df, paths[name])
    union, missing = readers.read_existing(spark, paths)
    assert missing == ["gone"]
    assert sorted((r["model"], r["model_ord"]) for r in union.collect()) == [("a", 0), ("b", 2)]
    with pytest.raises(ValueError, match="need 2"):
        readers.read_existing(spark, {"a": paths["a"], "gone": paths["gone"]})


def test_missing_required_input_fails(spark, tmp_path):
    with pytest.raises(AnalysisException):
        readers.read_pairs(spark, str(tmp_path / "nothing.json"))


def test_fold_discovery_and_single_model(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "a", 0, 0.1, 0.2), (1, "a", 1, 0.3, 0.1)], "id long, model string, fold int, l0 double, l1 double"
    )
    sinks.write_fold_logits(df, str(tmp_path / "folds"))
    found = readers.read_fold_logits(spark, str(tmp_path / "folds"))
    assert {(r["model"], r["fold"]) for r in found.collect()} == {("a", 0), ("a", 1)}
    df.select("id", "l0", "l1").write.parquet(str(tmp_path / "single"))
    assert {r["fold"] for r in readers.read_fold_logits(spark, str(tmp_path / "single")).collect()} == {0}
    df.select("id").write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no fold outputs"):
        readers.read_fold_logits(spark, str(tmp_path / "other"))


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k").repartition(5)
    rows = with_positions(df, ["k"], "pos").collect()
    assert sorted((r["pos"], r["k"]) for r in rows) == [(i, i) for i in range(1000)]


def test_positions_with_ties_nulls_and_a_hot_key(spark):
    """A third of the rows share one key, nulls come first, other rows repeat a few keys."""
    key = "case when id % 3 = 0 then 50 when id % 11 = 1 then null else id % 100 end"
    df = spark.range(3000).selectExpr(f"{key} as k", "id as text", "'old' as pos").repartition(9)
    rows = sorted(with_positions(df, ["k"], "pos").collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(3000))
    assert sorted(r["text"] for r in rows) == list(range(3000))
    keys = [-1 if r["k"] is None else r["k"] for r in rows]
    assert keys == sorted(keys) and keys[0] == -1


def test_numbering_moves_texts_only_in_the_last_join(spark):
    df = spark.range(50).selectExpr("id % 50 as k", "repeat('x', 20) as sentence")
    plan = with_positions(df, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Sort" not in plan
    assert plan.count("AS sentence") == 1 and plan.count("Join") == 1


def test_positions_by_expressions(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    rows = with_positions(df, [-F.col("k")], "pos").collect()
    assert {r["pos"]: r["k"] for r in rows} == {i: 19 - i for i in range(20)}


def test_positions_of_nothing(spark):
    assert with_positions(spark.range(0), ["id"], "pos").collect() == []


def test_pairs_of_several_files_keep_file_order(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"sentence_pair": ["first"], "label_pair": [0]}]')
    long = ", ".join(f'{{"sentence_pair": ["later {i}"], "label_pair": [1]}}' for i in range(500))
    (tmp_path / "b.json").write_text(f"[{long}]")
    pairs = readers.explode_pairs(readers.read_pairs(spark, str(tmp_path)), keep=("file", "record"))
    rows = with_positions(pairs, ["file", "record", "pos"]).orderBy("id").collect()
    assert [r["sentence"] for r in rows[:3]] == ["first", "later 0", "later 1"] and len(rows) == 501


def test_model_folders_are_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, "01", 0, 0.0, 1.0)], "id long, model string, fold int, l0 double, l1 double")
    sinks.write_fold_logits(rows, str(tmp_path / "f"))
    read = readers.read_fold_logits(spark, str(tmp_path / "f"))
    assert read.first()["model"] == "01" and dict(read.dtypes)["fold"] == "int"


def test_documents_are_parsed_without_a_size_limit_of_variants(spark):
    df = spark.createDataFrame([('["a"]',)], "value string")
    assert "variant" not in readers.parse_documents(df)._jdf.queryExecution().toString().lower()
