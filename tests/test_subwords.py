"""Longest-match pieces against a plain search, and padded inputs against plain lists."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from lexgrain.operators import subwords
from lexgrain.operators.subwords import END, PieceTrie, byte_letters, read_pieces, subword_inputs

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


def plain_pieces(word, pieces, unknown, word_ends):
    """Try every length at every place, longest first."""
    rest = word.encode() + (bytes([END]) if word_ends else b"")
    ids = []
    while rest:
        for size in range(len(rest), 0, -1):
            if rest[:size] in pieces and not (word_ends and rest[size:] == bytes([END])):
                ids.append(pieces[rest[:size]])
                rest = rest[size:]
                break
        else:
            return [unknown]
    return ids


def cut(trie, words, unknown=0):
    ids, borders = trie.words([w.encode() for w in words], unknown)
    return [ids[a:b].tolist() for a, b in zip(borders, borders[1:], strict=False)]


@pytest.mark.parametrize("word_ends", [False, True])
def test_words_match_a_plain_search(word_ends):
    draw = random.Random(5)
    for _ in range(60):
        letters = draw.choice(["ab", "abc", "aé漢"])
        listed = {
            "".join(draw.choices(letters, k=draw.randint(1, 4))).encode()
            + (bytes([END]) if word_ends and draw.random() < 0.5 else b"")
            for _ in range(draw.randint(1, 25))
        }
        pieces = {p: i + 1 for i, p in enumerate(sorted(listed, key=lambda p: draw.random()))}
        trie = PieceTrie.of(pieces.items())
        words = ["".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(40)]
        assert cut(trie, words) == [plain_pieces(w, pieces, 0, trie.word_ends) for w in words]


def test_vocabulary_file_matches_a_plain_search():
    pieces = dict(read_pieces(VOCABULARY))
    trie = PieceTrie.of(pieces.items())
    words = ["the", "entionou", "straße", "漢字", "éa", "don't", "a" * 500, "\x00x", "😀😀", "</w>"]
    assert cut(trie, words) == [plain_pieces(w, pieces, 0, True) for w in words]
    assert len(set(byte_letters())) == 256


def test_long_words_and_empty_lists():
    trie = PieceTrie.of([(b"ab", 1), (b"a", 2)])
    ids, borders = trie.words([b"ab" * 20_000, b"abb"], 9)
    assert ids.tolist() == [1] * 20_000 + [9] and borders.tolist() == [0, 20_000, 20_001]
    assert cut(trie, []) == [] and cut(PieceTrie.of([]), ["ab"], 7) == [[7]]
    with pytest.raises(ValueError, match="at most 1"):
        PieceTrie.of([(b"ab", 1), (b"a", 2)], max_pieces=1)


def test_equal_pieces_keep_the_smallest_id():
    assert cut(PieceTrie.of([(b"a", 5), (b"a", 3), (b"", 1)]), ["aa"]) == [[3, 3]]


def test_inputs_are_truncated_and_padded(spark):
    pieces = {b"un": 1, b"happy": 2, b"hap": 3, b"p": 4, b"y": 5, b"s": 6}
    trie = PieceTrie.of(pieces.items())
    texts = [(1, "Unhappy  haps"), (2, None), (3, ""), (4, "zzz happy"), (None, "y y y y y y"), (1, "s")]
    df = spark.createDataFrame(texts, "id long, sentence string").repartition(3)
    got = sorted(map(tuple, subword_inputs(df, trie, 4, unknown=99, pad=-1).collect()), key=repr)
    expected = []
    for key, text in texts:
        ids = [i for w in (text or "").lower().split() for i in plain_pieces(w, pieces, 99, False)]
        kept = ids[:4]
        expected.append(
            (key, kept + [-1] * (4 - len(kept)), [1] * len(kept) + [0] * (4 - len(kept)), len(ids), len(ids) > 4)
        )
    assert got == sorted(expected, key=repr)
    assert subword_inputs(df.limit(0), trie, 4).collect() == []


@pytest.mark.parametrize("bounds", [(1, 1), (3, 7), (1 << 16, 1 << 20)])
def test_stretches_cut_across_rows(monkeypatch, bounds):
    monkeypatch.setattr(subwords, "MOST_WORDS", bounds[0])
    monkeypatch.setattr(subwords, "MOST_BYTES", bounds[1])
    pieces = {b"a": 1, b"ab": 2, b"b": 3, b"ba": 4}
    draw = random.Random(2)
    lists = [["".join(draw.choices("abc", k=draw.randint(1, 6))) for _ in range(draw.choice([0, 0, 1, 4, 9]))] for _ in range(50)]
    column = pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)
    table, sizes = subwords._first_pieces(column, PieceTrie.of(pieces.items()), 5, 9, -1)
    whole = [[i for w in words for i in plain_pieces(w, pieces, 9, False)] for words in lists]
    assert sizes.tolist() == [len(ids) for ids in whole]
    assert table.tolist() == [(ids + [-1] * 5)[:5] for ids in whole]


def test_memory_does_not_grow_with_the_words_of_a_batch(monkeypatch):
    monkeypatch.setattr(subwords, "MOST_WORDS", 1 << 14)
    trie = PieceTrie.of([(b"a", 1), (b"b", 2)])
    draw = random.Random(1)
    words = ["".join(draw.choices("ab", k=8)) for _ in range(50_000)]
    peaks = []
    for times in (1, 8):
        column = pa.array([words * times], pa.list_(pa.string()))
        tracemalloc.start()
        table, sizes = subwords._first_pieces(column, trie, 128, 0, 0)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert sizes.tolist() == [400_000 * times]
    assert peaks[1] < 1.2 * peaks[0]
