import random

import brute
import pyarrow as pa
import pytest
from conftest import words
from hypothesis import given, settings
from hypothesis import strategies as st

from lexgrain.llm.decontaminate import contamination
from lexgrain.llm.exact_dedup import PatriciaTrie, _owner_tries, drop_exact_duplicates, exact_groups
from lexgrain.llm.near_dedup import NearSettings, drop_near_duplicates, near_groups
from lexgrain.llm.substring_dedup import repeated_passages


def found(table):
    return sorted(map(tuple, table.collect()), key=repr)


@given(st.lists(st.binary(max_size=12), max_size=60), st.integers(300, 4000))
@settings(max_examples=200, deadline=None)
def test_trie_counts_strings_whatever_it_spills(strings, limit):
    trie = PatriciaTrie(lambda a, b: (a[0], a[1] + b[1]), limit)
    for s in strings:
        trie.insert(s, (s, 1))
    assert sorted(trie.drain()) == sorted((s, strings.count(s)) for s in set(strings))


def test_trie_spills_subtrees_and_strings_with_a_long_common_start():
    trie = PatriciaTrie(lambda a, b: a + b, 20_000)
    start = b"p" * 3000
    strings = [start + str(i % 500).encode() for i in range(1000)]
    for s in strings:
        trie.insert(s, 1)
    assert trie.spills > 0
    assert sorted(trie.drain()) == [2] * 500


def test_trie_spills_above_a_spilled_subtree():
    trie = PatriciaTrie(lambda a, b: a, 300)
    strings = [b"\x00\x00", b"\x00\x01", b"\x01"]
    for s in strings:
        trie.insert(s, s)
    assert trie.spills > 1 and sorted(trie.drain()) == strings


def test_trie_keeps_strings_while_their_common_start_shrinks():
    trie = PatriciaTrie(lambda a, b: a + b, 2000)
    strings = [b"p" * k + b"%d" % i for k in range(60, -1, -1) for i in range(12)]
    for s in strings + strings[::3]:
        trie.insert(s, 1)
    assert trie.spills > 1
    assert sorted(trie.drain()) == [1] * (len(strings) - len(strings[::3])) + [2] * len(strings[::3])


@pytest.mark.parametrize("order", [1, -1])
def test_trie_of_nested_prefixes_spills(order):
    trie = PatriciaTrie(lambda a, b: a + b, 5000)
    strings = [b"ab" * k for k in range(1000)][::order]
    most = 0
    for s in strings + strings[::5]:
        trie.insert(s, 1)
        most = max(most, trie.size)
    assert trie.spills > 1 and most < 5000 + 3000
    assert sorted(trie.drain()) == [1] * 800 + [2] * 200


def test_owner_fails_when_rows_are_lost(monkeypatch):
    batch = pa.record_batch(
        {"digest": [b"a", b"b"], "n_bytes": [1, 1], "keep_id": [1, 2], "group_size": [1, 1], "body": [b"a", b"b"]}
    )
    assert sum(b.num_rows for b in _owner_tries("smallest", 1 << 20)(iter([batch]))) == 2
    monkeypatch.setattr(PatriciaTrie, "drain", lambda trie: iter([(b"a", 1, 1, 1)]))
    with pytest.raises(ValueError, match="no group"):
        list(_owner_tries("smallest", 1 << 20)(iter([batch])))


def test_exact_groups_match_brute_force(make, edge_rows):
    for keep, pick in (("largest", max), ("smallest", min)):
        expected = sorted(brute.exact(edge_rows, pick), key=repr)
        assert found(exact_groups(make(edge_rows), keep)) == expected


def test_exact_groups_spill_and_empty_table(make, edge_rows):
    expected = sorted(brute.exact(edge_rows), key=repr)
    assert found(exact_groups(make(edge_rows), "largest", trie_bytes=600)) == expected
    assert found(exact_groups(make([]))) == []


def test_drop_exact_duplicates_keeps_all_columns(make, edge_rows):
    docs = make(edge_rows)
    kept = drop_exact_duplicates(docs, "largest")
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [2, 4, 5, 7, 8, 9, 10, 11, 12]


def test_drop_exact_duplicates_with_repeated_ids(make):
    rows = [(1, "a"), (1, "b"), (2, "B"), (2, "B"), (None, "c"), (None, "C"), (3, None), (4, "")]
    kept = [(r["doc_id"], (r["text"] or "").lower()) for r in drop_exact_duplicates(make(rows), "largest").collect()]
    assert sorted(kept, key=repr) == [(1, "a"), (2, "b"), (4, ""), (None, "c")]


def check_near(rows, table):
    expected = brute.components([r for r in rows if r[0] is not None])
    for doc_id, n, component, kept in map(tuple, table.collect()):
        if doc_id is not None:
            assert (n, component, kept) == (*expected[doc_id], doc_id == expected[doc_id][1]), doc_id


def test_near_groups_of_edge_cases(spark, make, edge_rows):
    result = near_groups(spark, make(edge_rows))
    assert result.count() == len(edge_rows)
    check_near(edge_rows, result)
    without_id = {(r["n_shingles"], r["component_id"], r["kept"]) for r in result.where("doc_id is null").collect()}
    assert without_id == {(1, 1, False), (0, None, True), (1, None, True)}
    assert near_groups(spark, make([])).count() == 0


def edited(text, edits, seed):
    pick = random.Random(seed)
    text = list(text)
    for _ in range(edits):
        text[pick.randrange(len(text))] = f"e{pick.randrange(10**6)}"
    return text


def test_near_groups_match_brute_force(spark, make):
    passage = words(60, 99)
    rows = []
    for i in range(160):  # one large group, edited more and more
        rows.append((1000 + i, " ".join(edited(words(150, 5), i // 12, i))))
    for i in range(120):  # a passage that different documents share
        rows.append((2000 + i, " ".join(words(100, 100 + i) + passage)))
    for i in range(60):  # short texts around the limit
        rows.append((3000 + i, " ".join(words(4 + i % 9, i // 3) + words(i % 3, 7))))
    for i in range(20):  # chains: each differs a little from the one before
        base = words(200, 55)
        rows.append((4000 + i, " ".join(base[i * 4 :] + words(i * 4, 56))))
    check_near(rows, near_groups(spark, make(rows, 5)))


def thue_morse(n):
    return ["ab"[bin(i).count("1") % 2] for i in range(n)]


def test_structured_texts_do_not_collide(spark, make):
    """Words and sequences that polynomial hashes modulo a power of two can't tell apart."""
    a = thue_morse(4096)
    b = ["ba"["ab".index(c)] for c in a]
    rows = [(1, "".join(a)), (2, "".join(b)), (3, " ".join(a)), (4, " ".join(b)), (5, "x " + "".join(a))]
    check_near(rows, near_groups(spark, make(rows)))
    items = spark.createDataFrame([(1, "".join(b))], "item_id long, text string")
    hit = {r["doc_id"]: r["n_hit"] for r in contamination(spark, make(rows), items).collect()}
    assert hit == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0}
    texts = [(i, f"{t} {' '.join(words(25, i))}.") for i, t in rows[:4]]
    assert repeated_passages(make([(i, t + "\n" + " ".join(words(30, 50 + i))) for i, t in texts])).count() == 0


def test_near_groups_with_lists_cut_into_blocks(spark, make):
    rows = [(i, " ".join(edited(words(120, 5), 1 + i % 9, i))) for i in range(120)]
    small = NearSettings(block_rows=16, hubs=1, list_values=32)
    check_near(rows, near_groups(spark, make(rows), small))


def test_drop_near_duplicates_keeps_one_of_each_group(spark, make):
    rows = [(i, " ".join(edited(words(150, i // 4), 1, i))) for i in range(40)]
    docs = make(rows)
    kept = drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 4))
