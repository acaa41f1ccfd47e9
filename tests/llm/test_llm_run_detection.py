import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np

from lexgrain.llm.queries import op13_periodic_runs
from lexgrain.llm.run_detection import LEAST_WORDS, find_runs, periodic_runs, repair, strongest

WORDS = re.compile("[^\x20\x09-\x0d]+")


def runs(words):
    """``(start, length, period)`` by trying every period."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(LEAST_WORDS, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, found):
    dropped = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def random_words(pick):
    words = []
    for _ in range(pick.randrange(1, 8)):
        kind = pick.randrange(5)
        if kind == 0:
            words += [pick.randrange(50) for _ in range(pick.randrange(40))]
        elif kind == 1:
            unit = [pick.randrange(pick.choice([2, 3, 50])) for _ in range(pick.randrange(1, pick.choice([3, 10, 40])))]
            many = unit * pick.randrange(1, 30)
            words += many[: pick.randrange(1, len(many) + 1)]
        elif kind == 2:
            words += [pick.randrange(2) for _ in range(pick.randrange(60))]
        elif kind == 3:
            words += [7] * pick.randrange(80)
        else:
            words += ([7] * pick.randrange(30) + [8] * pick.randrange(30) + [pick.randrange(9)]) * pick.randrange(1, 7)
    return words


def derived(grammar):
    out = []
    for symbol in grammar.sequence.tolist():
        stack = [symbol]
        while stack:
            x = stack.pop()
            k = x - grammar.terminals
            if k < 0:
                out.append(x)
            else:
                stack += [int(grammar.right[k]), int(grammar.left[k])]
    return out


def test_runs_of_random_shards_match_brute_force():
    pick = random.Random(3)
    for _ in range(150):
        texts = [random_words(pick) for _ in range(pick.randrange(1, 6))]
        texts += [list(pick.choice(texts)) for _ in range(pick.randrange(3))] + [[]]
        pick.shuffle(texts)
        ids = np.array(sum(texts, []), np.int64)
        rows = np.cumsum([0, *map(len, texts)])
        grammar = repair(ids, rows)
        assert derived(grammar) == ids.tolist()
        start, end, period = (x.tolist() for x in find_runs(ids, rows))
        expected = [(rows[k] + s, rows[k] + s + n, p) for k, t in enumerate(texts) for s, n, p in runs(t)]
        assert list(zip(start, end, period, strict=True)) == sorted(expected)


def test_grammar_is_small_for_repeats_and_equal_for_equal_texts():
    words = np.arange(5000) % 700
    grammar = repair(np.tile(words, 8), np.arange(0, 40_001, 5000))
    assert len(set(grammar.sequence.tolist())) * 8 == len(grammar.sequence) < 8 * 40
    assert len(repair(np.zeros(100_000, np.int64), np.array([0, 100_000])).left) < 40


def test_long_runs_take_no_quadratic_time():
    n = 1_000_000
    for words, period in ((np.zeros(n, np.int64), 1), (np.arange(n) % 1000, 1000), (np.arange(n) % 300_007, 300_007)):
        start, end, found = find_runs(words, np.array([0, n]))
        assert (start.tolist(), end.tolist(), found.tolist()) == ([0], [n], [period])


def test_texts_and_edge_cases(make, edge_rows):
    rows = edge_rows + [
        (200, "x y " * 12),
        (201, "\n".join(["one two  three"] * 8) + "\tfour"),
        (202, "x " * 23),
        (203, "X x " * 20 + "x"),
        (204, " ".join("ab" * 11) + " " + " ".join(["q"] * 24)),
    ]
    got = sorted(map(tuple, periodic_runs(make(rows)).collect()), key=str)
    expected = []
    for i, text in rows:
        words = WORDS.findall(text or "")
        found = [] if len(words) > 10_000 else runs(words)
        expected.append((i, len(words), found, collapsed(words, found)))
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in got] == sorted(expected, key=str)
    by_id = {r[0]: r for r in got}
    assert [tuple(r) for r in by_id[200][2]] == [(0, 24, 2)] and by_id[200][3] == "x y"
    assert by_id[202][2] == [] and periodic_runs(make([])).count() == 0


def test_query_matches_brute_force(spark, tables):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    expected = []
    for i, text in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect():
        words = WORDS.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n > 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        if n > 6000:
            continue
        found = runs(words)
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        assert strongest(found) == best
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        expected.append((i, len(found), *four, sha(lines), sha(collapsed(words, found))))
    got = {r[0]: tuple(r) for r in op13_periodic_runs(spark, tables).collect()}
    assert len(got) >= len(expected) > 150 and sum(e[1] for e in expected) > 5
    assert [got[e[0]] for e in expected] == expected
