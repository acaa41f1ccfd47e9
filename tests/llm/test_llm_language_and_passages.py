import re
import zlib

import brute
import pytest
from conftest import words

import corpus_pipeline
from lexgrain.llm.language_id import keep_known_languages, languages, train
from lexgrain.llm.queries import op8_language_id, op10_near_dedup
from lexgrain.llm.substring_dedup import repeated_passages, without_repeats


@pytest.fixture(scope="module")
def model(spark, tables):
    return train(spark, spark.read.parquet(f"{tables}/documents.parquet"))


def test_language_accuracy_on_held_out_rows(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in documents.select("doc_id", "lang").collect()}
    rows = op8_language_id(spark, tables).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_languages_of_edge_cases(spark, make, edge_rows, model):
    rows = edge_rows + [(50, "12 34 !!"), (51, "½ ² ① Ⅷ")]
    got = {r["doc_id"]: r for r in languages(spark, make(rows), model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (3, 4, 5, 50, 51))
    assert got[6]["lang_pred"] in model.languages and got[None]["held_out"]
    assert languages(spark, make([]), model).count() == 0
    docs = make(rows)
    kept = keep_known_languages(spark, docs, model, 0.0)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in rows} - {3, 4, 5, 50, 51}


def test_training_with_ids_of_two_languages(spark, make):
    rows = [(i, f"{' '.join(['the', 'and', 'of'] if k else ['der', 'und', 'die'])} {i}", "en" if k else "de")
            for i in range(60) for k in (0, 1)]
    names = [train(spark, make(rows, n)) for n in (1, 4)]
    assert names[0].languages == names[1].languages == ["de"]


def test_training_without_labels_or_with_one_language(spark, make):
    assert train(spark, make([(1, "hello", None)])) is None
    undetermined = languages(spark, make([(1, "hello")]), None).collect()
    assert [r["lang_pred"] for r in undetermined] == ["und"]
    single = train(spark, make([(i, f"some text {i}", "en") for i in range(40)]))
    assert languages(spark, make([(1, "hello")]), single).collect()[0]["lang_pred"] == "en"


PASSAGE = ". ".join(" ".join(words(12, 900 + i)) for i in range(5)) + "."


def passage_rows(edge_rows):
    def own(seed):
        return " ".join(words(30, seed)) + "."

    return edge_rows + [
        (100, f"{own(1)}\n{PASSAGE}\n{own(2)}"),
        (101, f"é {own(3)}\n{PASSAGE.upper()}\n{own(4)}"),
        (102, f"{own(5)} {PASSAGE} {own(6)}"),
        (103, f"{own(7)}\n{own(8)}"),
        (104, f"{own(9)}\nShort line of seven words, no more.\n"),
        (105, f"{own(10)}\nShort line of seven words, no more.\n"),
        (106, " ".join(f"{w}!!" for w in words(80, 11))),
        (107, " ".join(f"{w}!!" for w in words(80, 12))),
        (108, f"{own(13)}\n{own(14)}\n{own(13)}"),
        (None, PASSAGE),
    ]


def test_repeated_passages(make, edge_rows):
    rows = passage_rows(edge_rows)
    texts = dict(rows)
    got = [r for r in repeated_passages(make(rows)).collect() if (r["doc_id"] or 100) >= 100]
    by_id = {r["doc_id"]: r for r in got}
    assert set(by_id) == {101, 102, 108, None} and len(got) == 4
    cut = texts[101][by_id[101]["start"] : by_id[101]["end"]]
    assert cut.strip() == PASSAGE.upper() and by_id[101]["first_doc_ids"] == [100]
    cut = texts[102][by_id[102]["start"] : by_id[102]["end"]]
    assert cut.strip() == PASSAGE
    assert by_id[108]["first_doc_ids"] == [108] and by_id[108]["start"] > 100
    assert by_id[None]["n_words"] == 60
    assert repeated_passages(make([])).count() == 0


def test_shorter_passages_on_request(make, edge_rows):
    ids = {r["doc_id"] for r in repeated_passages(make(passage_rows(edge_rows)), 7).collect()}
    assert 105 in ids and 104 not in ids and 106 not in ids


def test_without_repeats(make, edge_rows):
    rows = [r for r in passage_rows(edge_rows) if r[0] is not None and r[0] >= 100]
    docs = make(rows)
    cleaned = {r["doc_id"]: r["text"] for r in without_repeats(docs).collect()}
    texts = dict(rows)
    assert without_repeats(docs).columns == docs.columns
    assert cleaned[100] == texts[100] and cleaned[103] == texts[103]
    assert cleaned[101] == texts[101].replace(PASSAGE.upper() + "\n", "")
    assert PASSAGE not in cleaned[102] and cleaned[102].startswith(texts[102][:60])


def test_pipeline_stages_keep_and_drop_what_they_should(spark, make, tables):
    plain = spark.read.parquet(f"{tables}/documents.parquet").select("text").limit(3).collect()
    a, b, c = (r["text"] + " padding words" for r in plain)
    item = spark.read.parquet(f"{tables}/benchmark.parquet").select("text").first()["text"]
    rows = [
        (1, a, "en"),
        (2, re.sub("[a-z]+", lambda m: m[0].upper(), a), "en"),
        (3, b, "en"),
        (4, b + " one more", "en"),
        (5, c, "en"),
        (6, item, "en"),
        (7, None, "en"),
        (8, "123 !", "en"),
    ]
    docs = make(rows)
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        assert after.columns == docs.columns
        kept.append(sorted(r["doc_id"] for r in after.collect()))
        docs = make([r for r in rows if r[0] in kept[-1]])
    assert kept[0] == [1, 2, 3, 4, 5, 6]
    assert kept[1] == [2, 3, 4, 5, 6]
    assert kept[2] == [2, 3, 5, 6]
    assert kept[3] == [2, 3, 5]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    assert {r["doc_id"] for r in packed.collect()} == {2, 3, 5}


def documents(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


def test_near_query_matches_brute_force(spark, tables):
    expected = brute.components(documents(spark, tables))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_near_dedup(spark, tables).collect()}
    assert got == expected


def test_pipeline_matches_brute_force(spark, tables):
    """All stages but the language model's scores, from its own query, in plain Python."""
    predicted = op8_language_id(spark, tables).collect()
    known = {r["doc_id"] for r in predicted if r["lang_pred"] != "und" and r["score"] >= 0.3}
    rows = [r for r in documents(spark, tables) if r[0] in known]
    stay = {i for i, _, _, kept, _ in brute.exact(rows) if kept}
    rows = [r for r in rows if r[0] in stay]
    named = brute.components(rows)
    rows = [r for r in rows if named[r[0]][1] == r[0]]
    items = spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()
    bad = {i for i, *_, contaminated in brute.contamination(rows, [tuple(r) for r in items]) if contaminated}
    packed = corpus_pipeline.run(spark, tables).collect()
    lengths = {}
    for r in packed:
        lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
    assert bad and set(lengths) == {i for i, _ in rows} - bad
    assert all(lengths[r["doc_id"]] == r["doc_tokens"] for r in packed)
