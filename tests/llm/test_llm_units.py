import brute
import pytest
from conftest import words

from lexgrain.llm.queries import op9_substring_dedup
from lexgrain.llm.substring_dedup import repeated_passages, without_repeats


def sentence(n, seed):
    return " ".join(words(n, seed)) + "."


def test_passages_do_not_depend_on_the_sentence_before(make):
    one, several = sentence(50, 1), " ".join(sentence(n, 10 + n) for n in (30, 1, 8, 9))
    rows = [
        (1, f"{one} {sentence(8, 101)}"),
        (2, f"Yes. {one} {sentence(8, 102)}"),
        (3, f"{sentence(5, 103)} {several} {sentence(8, 104)}"),
        (4, f"{sentence(4, 105)} {several} {sentence(8, 106)}"),
        (5, f"Yes. No. Perhaps. {sentence(30, 107)}"),
        (6, f"Yes. No. Perhaps. {sentence(30, 108)}"),
    ]
    got = {r["doc_id"]: r for r in repeated_passages(make(rows)).collect()}
    assert set(got) == {2, 4}
    for i, passage in ((2, one), (4, several)):
        assert dict(rows)[i][got[i]["start"] : got[i]["end"]].strip() == passage
    assert (got[4]["n_units"], got[4]["n_words"], got[4]["first_doc_ids"]) == (4, 48, [3])


def test_scattered_repeats_are_no_passage(make):
    """Sentences that stand in different documents, or in one but apart, are no copy of anything."""
    parts = [sentence(9, 300 + k) for k in range(4)]
    rows = [(k, f"{sentence(30, 400 + k)} {p} {sentence(30, 500 + k)}") for k, p in enumerate(parts)]
    rows += [(10, " ".join(parts)), (11, f"{parts[1]} {parts[0]} {parts[3]} {parts[2]}")]
    rows += [(12, "THE!! OUANTION!! ANST!! " * 9), (13, f"The. {sentence(9, 600)} Ouantion. Anst.")]
    got = repeated_passages(make(rows)).collect()
    assert {r["doc_id"] for r in got} == {12}  # its own units, again and again
    assert all(r["first_doc_ids"] == [12] for r in got)


def test_parts_with_different_sources_overlap_and_are_cut_once(make):
    a, b, c = sentence(22, 1), sentence(15, 2), sentence(15, 3)
    rows = [(1, f"{a} {b}"), (2, f"{b} {c}"), (3, f"{a} {b} {c} {sentence(25, 4)}")]
    got = [r for r in repeated_passages(make(rows)).collect() if r["doc_id"] == 3]
    assert sorted((r["n_units"], r["first_doc_ids"], r["first_unit"]) for r in got) == [(2, [1], 0), (2, [2], 0)]
    cleaned = {r["doc_id"]: r["text"] for r in without_repeats(make(rows)).collect()}
    assert cleaned[3].strip() == sentence(25, 4) and cleaned[1] == rows[0][1]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force_and_sources_are_real(spark, folder):
    tables = f"/root/testdata/{folder}"
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, op9_substring_dedup(spark, tables).collect()))
    assert got and got == sorted(brute.passages(rows))
    units = {i: brute.units(t or "") for i, t in rows}
    texts = dict(rows)
    for doc_id, start, end, n_units, n_words, (source,), unit in got:
        there = units[source][unit : unit + n_units]
        assert sum((w for *_, w in there), ()) == tuple(brute.WORDS6.findall(brute.low(texts[doc_id][start:end])))
        assert n_words == sum(len(w) for *_, w in there) >= 20 and source <= doc_id
