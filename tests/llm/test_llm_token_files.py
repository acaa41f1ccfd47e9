import zlib
from functools import partial

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrain.llm.bpe import loaded_bpe
from lexgrain.llm.queries import op2_packing, op12_token_files, vocabulary_path
from lexgrain.llm.token_counts import token_counts
from lexgrain.llm.token_files import (
    EliasFano,
    TokenFile,
    read_token_files,
    remove_token_files,
    token_file_places,
    write_token_files,
)

ENCODER = partial(loaded_bpe, vocabulary_path())


def library_ids(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    return [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=1500), st.integers(0, 100_000))
def test_elias_fano_gives_back_its_values(gaps, room):
    values = np.cumsum(gaps)
    stored = EliasFano.from_buffer(EliasFano.of(values, int(values[-1]) + room).to_bytes())
    assert stored.values(0, len(values)).tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1, min(256, len(values) - 1), min(257, len(values) - 1)}:
        assert stored.select(i) == values[i]
        assert stored.values(i, len(values)).tolist() == values[i:].tolist()
    with pytest.raises(IndexError):
        stored.select(len(values))


def test_boundaries_are_near_the_least_size():
    pick = np.random.default_rng(1)
    values = np.cumsum(pick.integers(1, 2000, 100_000))
    size = len(EliasFano.of(values, int(values[-1])).to_bytes())
    assert size * 8 < 100_000 * (3 + np.log2(values[-1] / 100_000))


def test_files_hold_every_document_in_order(spark, make, edge_rows, tmp_path):
    path = f"file://{tmp_path}/ids"
    docs = make(edge_rows, 5)
    write_token_files(docs, path, ENCODER, end_id=0)
    rows = read_token_files(spark, path).collect()
    by_start = sorted(rows, key=lambda r: r["start"])
    texts = [(i, t) for i, t in edge_rows]
    expected = sorted(
        ((i is not None, i or 0, len(ids) + 1, checksum([*ids, 0])) for (i, _), ids in zip(texts, library_ids([t for _, t in texts]), strict=True))
    )
    got = [(r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], zlib.crc32(r["ids"])) for r in by_start]
    assert sorted(got) == expected and [g[:2] for g in got] == [e[:2] for e in expected]
    assert [r["start"] for r in by_start] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    # Single documents, by select on the boundaries.
    for place in token_file_places(spark, path).collect():
        file = TokenFile(f"{path}/{place['file']}")
        assert (file.n_docs, file.n_ids) == (place["n_docs"], place["n_ids"])
        inside = [r for r in by_start if place["base"] <= r["start"] < place["base"] + place["n_ids"]]
        for at, row in enumerate(inside):
            assert file.document(at).astype("<u4").tobytes() == row["ids"]
    remove_token_files(spark, path)
    assert not (tmp_path / "ids").exists()


def test_narrow_ids_and_small_parts(spark, make, edge_rows, tmp_path):
    write_token_files(make(edge_rows, 1).coalesce(1), f"{tmp_path}/ids", ENCODER, end_id=0, width=2)
    assert ENCODER().size <= 1 << 16
    place = token_file_places(spark, f"{tmp_path}/ids").first()
    file = TokenFile(f"{tmp_path}/ids/{place['file']}")
    whole = [x for _, _, ids in file.batches() for x in ids.tolist()]
    parts = list(file.batches(most_bytes=64))
    assert len(parts) > 5 and [x for _, _, ids in parts for x in ids.tolist()] == whole
    assert all(len(docs) == len(starts) - 1 and len(ids) == starts[-1] - starts[0] for docs, starts, ids in parts)


def test_empty_table(spark, make, tmp_path):
    write_token_files(make([]), f"{tmp_path}/ids", ENCODER, end_id=0)
    assert read_token_files(spark, f"{tmp_path}/ids").count() == 0


def test_query_matches_the_library(spark, tables):
    stored = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    start, expected = 0, []
    for row, ids in zip(stored, library_ids([r["text"] for r in stored]), strict=True):
        expected.append((row["doc_id"], start, len(ids) + 1, checksum([*ids, 0])))
        start += len(ids) + 1
    assert sorted(map(tuple, op12_token_files(spark, tables).collect())) == expected


def test_width_follows_the_vocabulary(spark, make, tmp_path):
    for width in (None, 4):
        path = f"{tmp_path}/ids{width}"
        write_token_files(make([(1, "some words")]), path, ENCODER, end_id=0, width=width)
        place = token_file_places(spark, path).first()
        assert TokenFile(f"{path}/{place['file']}").width == (width or 2)


@pytest.mark.parametrize("unit", [" ", "\n", "\t", " \r\n", "\xa0"])
def test_very_long_blanks(spark, make, tmp_path, unit):
    """Runs of blanks that overflow the stack of a pattern engine count as the library counts them."""
    text = "a b" + unit * (5_000_000 // len(unit)) + "c d"
    ids = library_ids([text])[0]
    docs = make([(1, text), (2, "short one")], 1)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts(spark, docs, vocabulary_path()).collect()}
    assert counts == {1: len(ids), 2: 2}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = sorted(op2_packing(spark, str(tmp_path)).where("doc_id = 1").collect(), key=lambda r: r["start"])
    whole = [*ids, 0]
    assert sum(p["length"] for p in pieces) == len(whole)
    for p in (pieces[0], pieces[len(pieces) // 2], pieces[-1]):
        assert p["ids_crc32"] == checksum(whole[p["start"] : p["start"] + p["length"]])
