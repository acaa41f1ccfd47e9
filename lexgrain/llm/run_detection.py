"""Periodic runs of words by grammar compression.

The words of a shard of texts are numbered and compressed by Re-Pair: pairs of neighbours that occur
more than once are replaced by nonterminals, most frequent ones first, until no pair repeats.  A
run that is repeated lies across the boundary between the two parts of some nonterminal, or across
a boundary of the compressed sequence, so only these places are searched, each nonterminal once at
one of its occurrences.  What is found in a nonterminal is carried to all its positions in the
derivation, and of intervals with one period that contain each other the largest stays.

A run is a stretch of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` smallest periods that no
neighbouring word extends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import mixed, piece_codes, shards, utf8, word_spans

LEAST_WORDS = 24
LEAST_PERIODS = 3
#: Compression holds about 150 bytes for each word of a shard; a longer text is handled alone.
_SHARD_BYTES = 2 << 20
#: Words compared at once when a repetition is measured, before the step doubles.
_FIRST_STEP = 16
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


@dataclass
class Words:
    """Numbered words of a shard: text i has words ``rows[i]`` to ``rows[i + 1]``."""

    flat: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ids: np.ndarray
    rows: np.ndarray


def words_of(texts: pa.Array) -> Words:
    flat, offsets = utf8(texts)
    starts, ends = word_spans(_IS_WORD[flat], offsets)
    ids = piece_codes(flat, starts, ends)[0]
    rows = np.concatenate([[0], np.searchsorted(starts, offsets[1:], side="left")])
    return Words(flat, offsets, starts, ends, ids, rows)


@dataclass
class Grammar:
    """Rules and the compressed sequence.

    Rule k is symbol ``terminals + k``; it derives ``sizes[k]`` words, ``left_sizes[k]`` of them from
    its left symbol, and ``places[k]`` is the word at which one of its occurrences begins.
    ``rounds`` holds the number of rules before each round; a rule uses rules of earlier rounds only.
    """

    terminals: int
    left: np.ndarray
    right: np.ndarray
    left_sizes: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    rounds: list[int]
    sequence: np.ndarray
    starts: np.ndarray
    last: np.ndarray


def _alternate(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Every second of equal neighbouring pairs (``a a a``), so that none overlap."""
    same = np.zeros(len(key), bool)
    same[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
    index = np.arange(len(key))
    begin = np.maximum.accumulate(np.where(same, 0, index))
    return (index - begin) % 2 == 0


def repair(ids: np.ndarray, rows: np.ndarray) -> Grammar:
    """Re-Pair in rounds: in each, every pair that no more frequent neighbour touches is replaced.

    Frequencies count as equal within a power of two and a hash of the pair decides between them,
    so that no chain of neighbours waits for each other.  A pair never crosses a text's end, and
    equal texts get equal derivations.
    """
    n = len(ids)
    sequence, starts = ids.copy(), np.arange(n)
    last = np.zeros(n, bool)
    last[rows[1:][rows[1:] > rows[:-1]] - 1] = True
    sizes_of = np.ones(n, np.int64)  # words of each element of the sequence
    open_ = ~last  # pairs that may occur more than once
    terminals = int(ids.max()) + 1 if n else 0
    symbols = terminals
    parts: list[tuple[np.ndarray, ...]] = []
    rounds = [0]
    while True:
        at = np.flatnonzero(open_)
        if len(at) < 2:
            break
        key = sequence[at] * np.int64(symbols) + sequence[at + 1]
        taken = _alternate(key, at)
        order = np.argsort(key)
        ranked = key[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        group = np.cumsum(first) - 1
        count = np.bincount(group, weights=taken[order]).astype(np.int64)
        group_of = np.empty(len(at), np.int64)
        group_of[order] = group
        repeated = count[group_of] > 1
        if not repeated.any():
            break
        values = ranked[first]
        level = np.frexp(count.astype(np.float64))[1].astype(np.uint64)
        priority = (level << np.uint64(56)) | (mixed(values.view(np.uint64)) >> np.uint64(8))
        full = np.zeros(len(sequence) + 1, np.uint64)  # its last place is the one before the first
        full[at] = np.where(repeated, priority[group_of], np.uint64(0))
        here = full[at]
        wins = repeated & taken & (here >= full[at - 1]) & (here >= full[at + 1])
        # A stretch of equal pairs is replaced whole or not at all: its ends decide.
        same = np.zeros(len(at), bool)
        same[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
        if same.any():
            stretch = np.cumsum(~same) - 1
            lost = (here < full[at - 1]) | (here < full[at + 1])
            wins &= ~(np.bincount(stretch, weights=lost) > 0)[stretch]
        open_[at] = repeated
        chosen, groups = at[wins], group_of[wins]
        apart = np.ones(len(chosen), bool)
        apart[1:] = np.diff(chosen) > 1  # two pairs of one priority may touch
        chosen, groups = chosen[apart], groups[apart]
        used, number = np.unique(groups, return_inverse=True)
        some = np.zeros(len(used), np.int64)
        some[number] = chosen  # one occurrence of each rule
        left, right = sequence[some], sequence[some + 1]
        parts.append((left, right, sizes_of[some], sizes_of[some] + sizes_of[some + 1], starts[some]))
        sequence[chosen] = symbols + number
        sizes_of[chosen] += sizes_of[chosen + 1]
        last[chosen] = last[chosen + 1]
        open_[chosen] = ~last[chosen]
        before = chosen[chosen > 0] - 1
        open_[before] = ~last[before]
        keep = np.ones(len(sequence), bool)
        keep[chosen + 1] = False
        # The element before a pair may itself have been the second part of another pair.
        inner = before[~keep[before]] - 1
        open_[inner] = ~last[inner]
        sequence, starts, last, open_, sizes_of = (x[keep] for x in (sequence, starts, last, open_, sizes_of))
        symbols += len(used)
        rounds.append(symbols - terminals)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    return Grammar(terminals, *columns, rounds, sequence, starts, last)


@dataclass
class _Places:
    """Boundaries to search: word after the boundary, and the words of the window around it."""

    middle: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rule: np.ndarray  # -1 for a boundary of the compressed sequence


def _places(grammar: Grammar, rows: np.ndarray) -> _Places:
    big = np.flatnonzero(grammar.sizes >= LEAST_WORDS)
    low = grammar.places[big]
    inner = np.flatnonzero(~grammar.last[:-1]) if len(grammar.last) else np.zeros(0, np.int64)
    middle = grammar.starts[inner + 1]
    row = np.searchsorted(rows, middle, side="right") - 1
    top_low, top_high = rows[row], rows[row + 1]
    long = top_high - top_low >= LEAST_WORDS
    return _Places(
        np.concatenate([low + grammar.left_sizes[big], middle[long]]),
        np.concatenate([low, top_low[long]]),
        np.concatenate([low + grammar.sizes[big], top_high[long]]),
        np.concatenate([big, np.full(int(long.sum()), -1)]),
    )


def _named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(names, repeated)`` of equal keys."""
    order = np.argsort(key)
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    group = np.cumsum(first) - 1
    names = np.empty(len(key), np.int64)
    names[order] = group
    return names, (np.bincount(group) > 1)[names]


def _grams(ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(length, names)`` for lengths 4, 8, 16...: exact names of stretches of that many words.

    Names are equal where stretches of one text are; -1 marks those that occur once in their text.
    """
    n = len(ids)
    names = np.full(n, -1, np.int64)
    sizes = np.diff(rows)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(sizes[row] >= LEAST_WORDS)
    if not len(at):
        return
    found, repeated = _named(row[at] * (np.int64(ids.max()) + 1) + ids[at])
    names[at[repeated]] = found[repeated]
    length = 1
    while True:
        if length >= 4:
            yield length, names
        at = np.flatnonzero(names >= 0)
        at = at[at + length < n]
        at = at[(names[at + length] >= 0)]
        if not len(at):
            return
        found, repeated = _named(names[at] * np.int64(names.max() + 1) + names[at + length])
        names = np.full(n, -1, np.int64)
        names[at[repeated]] = found[repeated]
        length *= 2


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, index)`` of all indices in each ``[low, high)``."""
    counts = np.maximum(high - low, 0)
    owner = np.repeat(np.arange(len(low)), counts)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, low[owner] + nth


def _matches(ids: np.ndarray, at: np.ndarray, period: np.ndarray, low: np.ndarray, high: np.ndarray, step: int):
    """How many of ``_FIRST_STEP`` words from ``at`` on (step 1) or before it (-1) equal those a period later."""
    offsets = np.arange(_FIRST_STEP) if step > 0 else -1 - np.arange(_FIRST_STEP)
    one = at[:, None] + offsets
    inside = (one >= low[:, None]) & (one + period[:, None] < high[:, None])
    one = np.where(inside, one, 0)
    other = np.where(inside, one + period[:, None], 0)
    differ = ~inside | (ids[one] != ids[other])
    return np.where(differ.any(axis=1), differ.argmax(axis=1), _FIRST_STEP)


def _extent(ids: np.ndarray, at: int, period: int, low: int, high: int) -> tuple[int, int]:
    """The maximal stretch around ``at`` inside the window that repeats with the period."""
    step, end = _FIRST_STEP, at
    while end + period < high:
        stop = min(end + step, high - period)
        differ = np.flatnonzero(ids[end:stop] != ids[end + period : stop + period])
        if len(differ):
            end += int(differ[0])
            break
        end, step = stop, 2 * step
    step, begin = _FIRST_STEP, at
    while begin > low:
        stop = max(begin - step, low)
        differ = np.flatnonzero(ids[stop:begin] != ids[stop + period : begin + period])
        if len(differ):
            begin = stop + int(differ[-1]) + 1
            break
        begin, step = stop, 2 * step
    return begin, end + period


def _crossing(ids: np.ndarray, rows: np.ndarray, places: _Places) -> list[tuple[int, int, int, int]]:
    """``(boundary, start, end, period)``: repetitions inside each boundary's window.

    Half of a run lies on one side of the boundary.  With a period p in ``[2L, 4L)`` the half holds
    p and L words or more (from 24 words on also for p below 16 and L = 4), so the L words next to
    the boundary come again at distance p.  These are looked up among the equal stretches of the
    text.  Places inside a repetition of a period up to L that is known already can only give
    multiples of it, and are left out.
    """
    n = np.int64(len(ids))
    middle, low, high = places.middle, places.low, places.high
    longest = (high - low) // LEAST_PERIODS
    found: list[tuple[int, int, int, int]] = []
    ahead, behind = middle.copy(), middle.copy()  # ends of known repetitions of small period
    waiting: list[tuple[int, int, int, int]] = []
    for length, names in _grams(ids, rows):
        least, most = (1, 16) if length == 4 else (2 * length, 4 * length)
        if not len(middle) or least > int(longest.max()):
            return found
        for b, start, end, period in waiting:
            if period <= length:
                ahead[b], behind[b] = max(ahead[b], end), min(behind[b], start)
        waiting = [w for w in waiting if w[3] > length]
        held = np.flatnonzero(names >= 0)
        keys = np.sort(names[held] * n + held)
        right = np.flatnonzero((longest >= least) & (middle + length <= high))
        right = right[names[np.minimum(middle[right], n - 1)] >= 0]
        m, base = middle[right], names[middle[right]] * n
        from_ = np.maximum(m + least, ahead[right] - length + 1)
        to = np.minimum(np.minimum(m + most - 1, m + longest[right]), high[right] - length)
        owner, index = _expanded(np.searchsorted(keys, base + from_), np.searchsorted(keys, base + to, side="right"))
        boundary, period = right[owner], keys[index] - base[owner] - m[owner]
        anchor = middle[boundary]
        left = np.flatnonzero((longest >= least) & (middle - length >= low))
        left = left[names[middle[left] - length] >= 0]
        m, base = middle[left] - length, names[middle[left] - length] * n
        from_ = np.maximum(np.maximum(m - most + 1, m - longest[left]), low[left])
        to = np.minimum(m - least, behind[left] - 1)
        owner, index = _expanded(np.searchsorted(keys, base + from_), np.searchsorted(keys, base + to, side="right"))
        other = m[owner] - (keys[index] - base[owner])
        boundary, period = np.concatenate([boundary, left[owner]]), np.concatenate([period, other])
        anchor = np.concatenate([anchor, middle[left[owner]] - other])
        if not len(boundary):
            continue
        window = low[boundary], high[boundary]
        after = _matches(ids, anchor, period, *window, 1)
        before = _matches(ids, anchor, period, *window, -1)
        needed = np.maximum(LEAST_WORDS, LEAST_PERIODS * period) - period
        maybe = (after == _FIRST_STEP) | (before == _FIRST_STEP) | (after + before >= needed)
        order = np.flatnonzero(maybe)
        order = order[np.lexsort((anchor[order], period[order], high[boundary[order]], low[boundary[order]]))]
        known, start, end = None, 0, 0
        for k in order.tolist():
            b, p, a = int(boundary[k]), int(period[k]), int(anchor[k])
            if known != (low[b], high[b], p) or not start <= a <= end - p:
                start, end = _extent(ids, a, p, int(low[b]), int(high[b]))
                known = (low[b], high[b], p)
            if end - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
                found.append((b, start, end, p))
                if start <= middle[b] <= end:
                    waiting.append((b, start, end, p))
    return found


def _everywhere(grammar: Grammar, rule: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(index, word)``: where entry i of rule ``rule[i]`` begins, at all positions of the derivation."""
    rules = len(grammar.left)
    own = np.zeros(rules, bool)
    own[rule] = True
    holds = np.zeros(grammar.terminals + rules, bool)
    for begin, end in zip(grammar.rounds, grammar.rounds[1:], strict=False):
        holds[grammar.terminals + begin : grammar.terminals + end] = (
            own[begin:end] | holds[grammar.left[begin:end]] | holds[grammar.right[begin:end]]
        )
    order = np.argsort(rule, kind="stable")
    ranked = rule[order]
    symbol, start = grammar.sequence, grammar.starts
    index, word = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        kept = holds[symbol]
        here, start = symbol[kept] - grammar.terminals, start[kept]
        if not len(here):
            return np.concatenate(index), np.concatenate(word)
        low, high = np.searchsorted(ranked, here), np.searchsorted(ranked, here, side="right")
        owner, at = _expanded(low, high)
        index.append(order[at])
        word.append(start[owner] + offset[order[at]])
        symbol = np.concatenate([grammar.left[here], grammar.right[here]])
        start = np.concatenate([start, start + grammar.left_sizes[here]])


def find_runs(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs in words of the shard, by start, then period."""
    grammar = repair(ids, rows)
    places = _places(grammar, rows)
    found = np.array(_crossing(ids, rows, places), np.int64).reshape(-1, 4)
    boundary, start, end, period = found.T
    rule = places.rule[boundary]
    inner = rule >= 0
    index, word = _everywhere(grammar, rule[inner], (start - places.low[boundary])[inner])
    size = end - start
    start = np.concatenate([start[~inner], word])
    end = start + np.concatenate([size[~inner], size[inner][index]])
    period = np.concatenate([period[~inner], period[inner][index]])
    row = np.searchsorted(rows, start, side="right") - 1
    # Of one period: intervals inside another one go.
    order = np.lexsort((-end, start, period, row))
    row, start, end, period = row[order], start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[True], (row[1:] != row[:-1]) | (period[1:] != period[:-1])])) if len(row) else row
    reach = np.maximum.accumulate(end + group * np.int64(len(ids) + 1)) - group * np.int64(len(ids) + 1)
    outer = np.ones(len(row), bool)
    outer[1:] = (group[1:] != group[:-1]) | (end[1:] > reach[:-1])
    start, end, period = start[outer], end[outer], period[outer]
    # Of one interval: the smallest period.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.ones(len(start), bool)
    smallest[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[smallest], end[smallest], period[smallest]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _collapsed(words: Words, dropped: np.ndarray) -> pa.Array:
    """The words that stay, joined by one space, as a text for each row."""
    n, n_rows = len(words.flat), len(words.offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(words.rows))
    kept = np.flatnonzero(~dropped)
    last = np.ones(len(kept), bool)
    last[:-1] = row[kept[1:]] != row[kept[:-1]]
    edges = np.zeros(n + 2, np.int8)
    np.add.at(edges, words.starts[kept], 1)
    np.add.at(edges, words.ends[kept] + ~last, -1)  # the byte after a word becomes its space
    taken = np.cumsum(edges[:n], dtype=np.int8) > 0
    flat = np.where(_IS_WORD[words.flat], words.flat, 0x20).astype(np.uint8)[taken]
    offsets = np.concatenate([[0], np.cumsum(taken)])[words.offsets].astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes()))
    return texts.cast(pa.string())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in shards(batches, most_bytes=_SHARD_BYTES):
        words = words_of(shard.column("text"))
        start, end, period = find_runs(words.ids, words.rows)
        edges = np.zeros(len(words.ids) + 1, np.int64)
        np.add.at(edges, start + period, 1)
        np.add.at(edges, end, -1)
        row = np.searchsorted(words.rows, start, side="right") - 1
        entries = pa.StructArray.from_arrays(
            [pa.array(start - words.rows[row]), pa.array(end - start), pa.array(period)], fields=list(_RUN)
        )
        borders = pa.array(np.searchsorted(row, np.arange(shard.num_rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                shard.column("doc_id").cast(pa.int64()),
                pa.array(np.diff(words.rows), pa.int64()),
                pa.ListArray.from_arrays(borders, entries),
                _collapsed(words, np.cumsum(edges[:-1]) > 0),
            ],
            names=["doc_id", "n_words", "runs", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` of each row, see ``RUNS``.

    Words are stretches without white space (U+0020, U+0009 to U+000D), compared as they stand, and
    numbered from 0.  ``runs`` are ordered by start, then period; ``collapsed`` holds the words
    that no run contains after its first period, joined by one space.  Null and empty texts have no
    words and an empty ``collapsed``; repeated rows and null ids are searched like others; an empty
    table gives no row.  Nothing is shuffled; a text longer than a shard is searched alone.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_runs, RUNS)


def strongest(runs: list) -> tuple[int, int, int] | None:
    """The run with most periods, compared exactly; ties go to the smallest start, then period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return best and tuple(best)


def strongest_run(runs: Column) -> Column:
    """``strongest`` as an expression; lengths and periods are compared by cross products."""
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")

    def better(best: Column, run: Column) -> Column:
        ahead = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | ahead, run).otherwise(best)

    return F.aggregate(runs, nothing, better)
