"""Array files cut anywhere give the elements of the whole file."""

import json
import random

import pandas as pd
import pyarrow as pa
import pytest

from lexgrain.session import ship_package
from lexgrain.sources import json_arrays, readers

BITS = ["},{", "\\", '"', '\\"', ",", "[", "]", "{", "}", "é", "日本", " ", "\n", "a", "\\\\", ', "', "null"]


def random_text(pick):
    return "".join(pick.choice(BITS) for _ in range(pick.randrange(12)))


def documents(pick, n):
    records = [
        {"sentence": random_text(pick), "label": pick.choice([1, "0"]), "more": [random_text(pick), {"x": [1, {}]}]}
        for _ in range(n)
    ]
    texts = [random_text(pick) if pick.random() < 0.9 else None for _ in range(n)]
    yield json.dumps(records, ensure_ascii=False), records
    yield json.dumps(texts, indent=pick.choice([None, 1])), texts
    yield json.dumps({"sentences": texts}, ensure_ascii=pick.random() < 0.5), texts


def batches(stretches, cuts, **columns):
    """The stretches dealt to blocks; each block in one or two batches."""
    for block, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(stretches)], strict=True)):
        for part in (stretches[a : (a + b) // 2], stretches[(a + b) // 2 : b]):
            if part:
                fixed = {"file": ["f"] * len(part), "block": [block] * len(part), "value": part}
                more = {k: pa.array([v[block]] * len(part)) for k, v in columns.items()}
                yield pa.RecordBatch.from_pydict(fixed | more)


def elements(text, cuts):
    stretches = text.split(",")
    rows = list(json_arrays._summarise(batches(stretches, cuts)))
    states = json_arrays._composed(pa.Table.from_batches(rows).to_pandas())
    by_block = {k: dict(zip(states["block"], states[k], strict=True)) for k in ("in_string", "depth", "first", "level")}
    found = {}
    for batch in json_arrays._cut(batches(stretches, cuts, **by_block)):
        for row in batch.to_pylist():
            assert not (row["whole"] and row["index"] in found)
            found.setdefault(row["index"], []).append((row["block"], row["element"]))
    joined = {i: "".join(e for _, e in sorted(parts)) for i, parts in found.items()}
    return [json.loads(joined[i]) for i in sorted(joined) if joined[i].strip()], sorted(joined)


def test_any_cuts_give_the_elements_of_the_whole():
    pick = random.Random(4)
    for n in (0, 1, 2, 7, 25):
        for text, expected in [d for _ in range(8) for d in documents(pick, n)]:
            places = range(1, text.count(",") + 1)
            many = [sorted(pick.sample(places, min(len(places), pick.randrange(12)))) for _ in range(3)]
            for cuts in [[], list(places), *many]:
                got, numbers = elements(text, cuts)
                assert got == expected, (text, cuts)
                assert numbers == list(range(max(len(expected), 1)))


def test_unknown_shapes_and_broken_files_are_errors():
    for text in ('"text"', "12", '{"other": []}', "", "[1, 2", '["a, b'):
        with pytest.raises(ValueError, match="unknown document shape|ends inside"):
            elements(text, [])


def test_files_are_cut_among_tasks(spark, tmp_path):
    ship_package(spark)
    pick = random.Random(9)
    expected = {}
    for k, (text, items) in enumerate(documents(pick, 60)):
        (tmp_path / f"{k}.json").write_text(text)
        expected[f"{k}.json"] = items
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = json_arrays.read_array_elements(spark, str(tmp_path))
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 10
        rows = found.collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    for name, items in expected.items():
        mine = sorted((r["index"], r["element"]) for r in rows if r["file"].endswith(name))
        assert [i for i, _ in mine] == list(range(len(items)))
        assert [json.loads(e) for _, e in mine] == items


def test_readers_of_array_files(spark, tmp_path):
    ship_package(spark)
    flat = [{"sentence": "a, b", "label": "1"}, {"sentence": 'c"},{"', "label": 0, "idx": 7}]
    (tmp_path / "flat.json").write_text(json.dumps(flat))
    assert sorted(map(tuple, readers.read_flat(spark, f"{tmp_path}/flat.json").collect())) == [
        (0, "a, b", 1),
        (7, 'c"},{"', 0),
    ]
    pairs = [{"sentence_pair": ["x", "y"], "label_pair": [0, 1]}, {"sentence_pair": ["z"], "label_pair": [1]}]
    (tmp_path / "pairs.json").write_text(json.dumps(pairs))
    got = readers.read_pairs(spark, f"{tmp_path}/pairs.json").orderBy("record").collect()
    assert [(r["sentence_pair"], r["label_pair"]) for r in got] == [(["x", "y"], [0, 1]), (["z"], [1])]
    for name, shape in {"a": {"sentences": ["p", "q"]}, "b": [{"sentence": "p"}, {"sentence": "q"}], "c": ["p", "q"]}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(shape))
        assert sorted(map(tuple, readers.read_documents(spark, f"{tmp_path}/{name}.json").collect())) == [(0, "p"), (1, "q")]
    (tmp_path / "empty.json").write_text(" [ ] ")
    assert readers.read_documents(spark, f"{tmp_path}/empty.json").count() == 0


def test_summaries_are_pandas_groups():
    states = json_arrays._composed(
        pd.DataFrame(
            {"file": ["f"] * 2, "block": [5, 0], "odd": [True, True], "outside": ["[0, []]", "[1, []]"],
             "inside": ["[-1, []]", "[0, []]"], "head": [b"", b"["]}
        )
    )
    assert states[["block", "in_string", "depth"]].values.tolist() == [[0, False, 0], [5, True, 1]]
