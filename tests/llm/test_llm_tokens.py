import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexgrain.llm.bpe import ByteBpe
from lexgrain.llm.packing import PackingCosts, best_cuts, cut_candidates, pack
from lexgrain.llm.queries import op2_packing, op4_token_counts, vocabulary_path
from lexgrain.llm.token_counts import token_counts

LIBRARY = Tokenizer.from_file(vocabulary_path())
BPE = ByteBpe(vocabulary_path())


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(" \n\t.'sa1é日“\x85\u2003<|endoftext|>½!"), max_size=30), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_encode_like_whole_texts(texts):
    ids, ends = BPE.encode(pa.array(texts, pa.string()))
    begin = 0
    for text, end in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:end].tolist() == ids_of(text)
        begin = end


def test_characters_below_the_library_limit_are_classed_alike():
    texts = [f"a{c}b1{c}2 {c} {c}{c}!{c} \n{c}" for c in map(chr, range(1, 0x2000))]
    ids, ends = BPE.encode(pa.array(texts))
    parts = np.split(ids, ends[:-1])
    wrong = [t for t, p in zip(texts, parts, strict=True) if p.tolist() != ids_of(t)]
    assert wrong == []


def test_token_counts_match_the_library(spark, make, edge_rows):
    counts = token_counts(spark, make(edge_rows), vocabulary_path())
    expected = [
        (i, len((t or "").encode()), len(ids_of(t)), len(ids_of(t)) > 512) for i, t in edge_rows
    ]
    assert sorted(map(tuple, counts.collect()), key=repr) == sorted(expected, key=repr)
    assert token_counts(spark, make([]), vocabulary_path()).count() == 0


def check_packing(texts, pieces, capacity):
    """Every id in one piece, pieces as claimed, sequences gapless and in document order."""
    covered = {i: [] for i in texts}
    sequences = {}
    for p in pieces:
        ids = np.array([*ids_of(texts[p["doc_id"]]), 0], "<u4")
        part = ids[p["start"] : p["start"] + p["length"]]
        assert len(part) == p["length"] > 0 and p["doc_tokens"] == len(ids)
        assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
        covered[p["doc_id"]].append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, spans in covered.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(ids_of(texts[i])) + 1
    sizes = []
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        sizes.append(at)
    return sizes


def test_packing_of_edge_cases(make, edge_rows):
    texts = {i: t for i, t in edge_rows if i not in (None, 8)}
    docs = make(list(texts.items()))
    costs = PackingCosts(block_tokens=5000)  # blocks end inside the long texts
    result = pack(docs, partial(ByteBpe, vocabulary_path()), 0, costs)
    check_packing(texts, result.collect(), 1024)
    every = pack(make(edge_rows), partial(ByteBpe, vocabulary_path()), 0)
    assert {r["doc_id"] for r in every.collect()} == {i for i, _ in edge_rows}
    assert pack(make([]), partial(ByteBpe, vocabulary_path()), 0).count() == 0


def test_packing_query_pads_little(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    sizes = check_packing(texts, op2_packing(spark, tables).collect(), 1024)
    assert sum(1024 - s for s in sizes) < 0.02 * sum(sizes)


def test_token_count_query(spark, tables):
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    expected = {r["doc_id"]: len(ids_of(r["text"])) for r in documents.collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in op4_token_counts(spark, tables).collect()} == expected


@given(
    st.lists(st.integers(1, 30), min_size=1, max_size=12),
    st.lists(st.integers(1, 60), max_size=12),
    st.booleans(),
)
@settings(max_examples=200, deadline=None)
def test_cuts_are_optimal(lengths, sentences, powers):
    costs = PackingCosts(capacity=16, other_step=5, whole_powers=powers)
    ends = np.cumsum(lengths)
    n = int(ends[-1])
    inner = np.array(sorted({s for s in sentences if s < n}), np.int64)
    positions, penalties = cut_candidates(n, ends, inner, costs)

    def price(cuts):
        total = 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            size = positions[b] - positions[a]
            assert size <= 16
            power = powers and size & (size - 1) == 0
            total += (0 if power else 16 - size) + penalties[b]
        return total

    best = [0] + [None] * (len(positions) - 1)
    for j in range(1, len(positions)):
        best[j] = min(
            best[i] + price([i, j]) for i in range(j) if positions[j] - positions[i] <= 16
        )
    chosen = best_cuts(positions, penalties, costs)
    assert price(np.searchsorted(positions, chosen).tolist()) == best[-1]


def test_unknown_keep_is_an_error():
    from lexgrain.llm.exact_dedup import _better

    with pytest.raises(KeyError):
        _better("newest")
