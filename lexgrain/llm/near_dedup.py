"""Near duplicates by bottom-k sketches of one hash function.

A document's set is its distinct word shingles, hashed once; its sketch is the k smallest hashes.
Inverted lists are kept for neighbouring retained values, so two documents meet in a list when two
values that follow each other in the union of their sets are in both.  The similarity is at least
3/4, so about 9 in 16 of such neighbours are shared; a pair therefore still meets when every
document leaves out a few of its most frequent keys (the prefix filter for that overlap).  This
removes the lists of passages that many different documents share.

Documents of a list are first compared with hubs of it, which joins large groups in a linear
number of comparisons.  What is still in different components is compared within its list, by sets
or by sketches of the union, and only links leave the task.  Links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.llm.arrow_text import mixed, piece_hashes, shards, utf8, word_spans
from lexgrain.llm.components import Scratch, connected_components

SHINGLE_WORDS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Fixed: bytes between words.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64)) for j in range(SHINGLE_WORDS)]


@dataclass(frozen=True)
class NearSettings:
    """``key_values`` retained values make keys; of them ``spare_share`` may be left out.

    A pair at the limit shares on average 9/16 of its keys, so a sixth is missed by chance about
    once in 100,000 pairs, and never if both sets are retained whole.  Estimates rule a pair out
    when they lie five deviations below the limit for a sketch of their size.
    """

    numerator: int = 75
    denominator: int = 100
    sketch_values: int = 64
    key_values: int = 48
    spare_share: float = 0.17
    hubs: int = 8
    list_values: int = 256
    estimate_pairs: float = 0.48
    list_deviations: float = 5.0
    block_rows: int = 2048


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, offsets = utf8(texts)
    low = _LOWER[flat]
    starts, ends = word_spans(_IS_WORD[low], offsets)
    words = piece_hashes(low, starts, ends)[:, 0]
    rows = np.searchsorted(starts, offsets[1:])
    m = max(len(words) - SHINGLE_WORDS + 1, 0)
    hashes = np.zeros(m, np.uint64)
    for j, factor in enumerate(_FACTORS):
        hashes += words[j : j + m] * factor
    hashes = mixed(hashes)
    sets, begin = [], 0
    for end in rows.tolist():
        if end - begin >= SHINGLE_WORDS:
            sets.append(np.unique(hashes[begin : end - SHINGLE_WORDS + 1]))
        elif end > begin:  # too short for a shingle: the whole sequence is one
            whole = (words[begin:end] * np.array(_FACTORS[: end - begin])).sum(dtype=np.uint64)
            sets.append(mixed(np.array([whole + np.uint64(end - begin)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        begin = end
    return sets


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            sets = shingle_sets(shard.column("text"))
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            low, high = np.frombuffer(digests, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [
                    shard.column("doc_id").cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(low),
                    pa.array(high),
                    pa.array([s[:k].tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "low", "high", "sketch"],
            )

    return run


def _keys(settings: NearSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = [], []
            for sketch in batch.column("sketch").to_pylist():
                v = np.frombuffer(sketch, np.uint64)[: settings.key_values]
                keys.append(mixed(v[:-1] * _FACTORS[0] + v[1:]))
                counts.append(max(len(v) - 1, 0))
            at = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            spare = np.maximum((np.array(counts) * settings.spare_share).astype(np.int64), 1) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(flat.view(np.int64)),
                    batch.column("rep").take(at),
                    batch.column("n").take(at),
                    pa.array(np.repeat(spare, counts)),
                ],
                names=["key", "rep", "n", "spare"],
            )

    return run


def _values(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in column.to_pylist()]


def _estimated(settings: NearSettings):
    """Keep pairs whose sketches of the union say that they may be similar enough."""
    k, least = settings.sketch_values, settings.estimate_pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = []
            for x, y in zip(_values(batch.column("sketch_a")), _values(batch.column("sketch_b")), strict=True):
                both = np.sort(np.concatenate([x, y]))
                same = both[1:] == both[:-1]
                union = both[np.append(True, ~same)][:k] if len(both) else both
                shared = np.searchsorted(both[1:][same], union[-1], side="right") if len(union) else 0
                likely.append(shared >= least * len(union))
            yield batch.select(["a", "b"]).filter(pa.array(likely, pa.bool_()))

    return run


def _confirmed(settings: NearSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for x, y in zip(_values(batch.column("set_a")), _values(batch.column("set_b")), strict=True):
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                links.append(
                    settings.denominator * common >= settings.numerator * (len(x) + len(y) - common)
                )
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    return run


_CROSS = "a bigint, b bigint, sure boolean"


@dataclass
class ListRows:
    """Members of one list or of two of its blocks: ``keys`` are all lists that a member is in."""

    reps: np.ndarray
    sizes: np.ndarray
    comps: np.ndarray
    blocks: np.ndarray
    values: list[np.ndarray]
    keys: list[np.ndarray]


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """Parts as numbers of their distinct values, one row each; the last number is for filling."""
    _, numbers = np.unique(np.concatenate(parts), return_inverse=True)
    fill = int(numbers.max()) + 1
    sizes = np.array([len(p) for p in parts])
    table = np.full((len(parts), sizes.max()), fill, np.int32)
    table[np.arange(sizes.max()) < sizes[:, None]] = numbers
    return table, fill


def compare_list(rows: ListRows, key: int, two_blocks: bool, s: NearSettings) -> Iterator[tuple[int, int, bool]]:
    """Links and likely links between members of different components of one list.

    ``values`` are whole sets or their ``list_values`` smallest elements.  Up to the smaller of the
    two largest retained values both are complete, which makes their part of the union a sketch.
    A pair that meets in several lists is compared in the one with the smallest key only.

    Before values are compared, a bound rules pairs out: with a pivot set P, two sets x and y have at
    most ``min(|x & P|, |y & P|) + min(|x - P|, |y - P|)`` values in common.  The pivot is what more
    than half of the members have, so in a group of near copies it stands for their original.
    """
    reps, sizes, comps, values = rows.reps, rows.sizes, rows.comps, rows.values
    limit = s.numerator / s.denominator

    def least_common(union):
        return limit * union - s.list_deviations * np.sqrt(limit * (1 - limit) * union)

    codes = np.unique(comps, return_inverse=True)[1]
    main = np.bincount(codes).argmax()
    table, fill = _padded(values)
    keys, no_key = _padded(rows.keys)
    this_key = int(np.searchsorted(np.unique(np.concatenate(rows.keys)), key))
    held = np.array([len(v) for v in values])
    whole = held == sizes
    top = np.where(whole, np.iinfo(np.uint64).max, [v[-1] for v in values])
    pivot = np.bincount(table.ravel(), minlength=fill + 1) * 2 > len(values)
    pivot[fill] = False
    central = pivot[table].sum(axis=1)
    has, has_key = np.zeros(fill + 1, bool), np.zeros(no_key + 1, bool)
    for x in np.flatnonzero(codes != main).tolist():
        others = (codes != codes[x]) & (
            s.denominator * np.minimum(sizes, sizes[x]) >= s.numerator * np.maximum(sizes, sizes[x])
        )
        if two_blocks:  # pairs of one block have a group of their own
            others &= rows.blocks != rows.blocks[x]
        sure = whole & whole[x]
        most = np.minimum(central, central[x]) + np.minimum(held - central, held[x] - central[x])
        exact = s.numerator * (sizes + sizes[x]) / (s.numerator + s.denominator)
        others &= most >= np.where(sure, exact - 1e-6, least_common(s.list_values))
        ys = np.flatnonzero(others)
        if not len(ys):
            continue
        mine = keys[x][keys[x] != no_key]
        has_key[mine] = True
        first_met = np.where(has_key[keys[ys]], keys[ys], no_key).min(axis=1)
        has_key[mine] = False
        ys = ys[first_met == this_key]
        if not len(ys):
            continue
        mine = table[x][table[x] != fill]
        has[mine] = True
        common = has[table[ys]].sum(axis=1)
        has[mine] = False
        of_x = np.searchsorted(values[x], np.minimum(top[ys], top[x]), side="right")
        of_y = held[ys].copy()
        for i in np.flatnonzero(top[ys] > top[x]).tolist():
            of_y[i] = np.searchsorted(values[ys[i]], top[x], side="right")
        union = of_x + of_y - common
        linked = sure[ys] & (s.denominator * common >= s.numerator * union)
        likely = ~sure[ys] & (common >= least_common(union))
        # One link to each other component is enough to join it.
        firsts = np.unique(codes[ys[linked]], return_index=True)[1]
        for y in ys[linked][firsts].tolist():
            yield int(reps[x]), int(reps[y]), True
        for y in ys[likely].tolist():
            yield int(reps[x]), int(reps[y]), False


def _cross_links(settings: NearSettings):
    """Compare the rows of each list or block of a list; rows arrive sorted by it."""

    def groups(batches: Iterator[pa.RecordBatch]):
        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                here = tuple(marks[:, begin].tolist())
                if held and here != name:
                    yield name, held
                    held = []
                name = here
                held.append(batch.slice(begin, end - begin))
        if held:
            yield name, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (key, i, j), parts in groups(batches):
            table = pa.Table.from_batches(parts).combine_chunks()
            numbers = [table.column(c).to_numpy() for c in ("rep", "n", "comp", "block")]
            if numbers[2].min() == numbers[2].max():
                continue
            keys = [np.array(k, np.int64) for k in table.column("keys").to_pylist()]
            rows = ListRows(*numbers, _values(table.column("part")), keys)
            out += compare_list(rows, key, i != j, settings)
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return run


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    rows = list({(min(a, b), max(a, b), sure) for a, b, sure in rows})
    a, b, sure = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sure, pa.bool_())],
        names=["a", "b", "sure"],
    )


def _with(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``(a, b)`` with ``column`` of both ends as ``<column>_a`` and ``<column>_b``."""
    for end in ("a", "b"):
        side = table.select(F.col("rep").alias(end), F.col(column).alias(f"{column}_{end}"))
        pairs = pairs.join(side, end)
    return pairs


def near_groups(
    spark: SparkSession,
    docs: DataFrame,
    settings: NearSettings = NearSettings(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of each row.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least 3/4 (by the
    default settings); a component is named by its smallest id and that row is kept.  A text with
    fewer than five words is one shingle; null and empty texts have none and are linked with nothing.
    Repeated rows are in one component, all kept if their id names it; rows that share an id but not
    a text join the links of both.  A row without id takes the component of its equals, and is kept
    only where no row with an id is its equal.  An empty table gives no row.
    """
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    fields = "doc_id bigint, n bigint, low bigint, high bigint, sketch binary"
    sketched = scratch.keep(rows.mapInArrow(_sketches(settings.sketch_values), fields))

    # Equal sets are one class, named by its smallest id.
    classes = scratch.keep(
        sketched.where("n > 0 and doc_id is not null")
        .groupBy("low", "high", "n")
        .agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"))
    )
    lists = _inverted_lists(scratch, classes, settings)
    sets = _sets(scratch, rows, lists)

    hub_pairs = _hub_pairs(lists, settings)
    links = scratch.keep(_confirm(scratch, hub_pairs, classes, sets, settings))
    joined = scratch.keep(connected_components(spark, links, scratch))
    crossing = scratch.keep(_crossing(lists, joined, sets, settings))
    unsure = crossing.where("not sure").select("a", "b").distinct()
    more = _with(unsure, sets, "set").mapInArrow(_confirmed(settings), "a bigint, b bigint")
    every = links.union(crossing.where("sure").select("a", "b")).union(more)
    final = connected_components(spark, every, scratch)

    named = classes.join(final, F.col("rep") == F.col("node"), "left").select(
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
        F.col("n").alias("_n"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    same = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (F.col("n") == F.col("_n"))
    component = F.coalesce("component_id", "doc_id")
    result = sketched.select("doc_id", "n", "low", "high").join(named, same, "left")
    result = result.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
    scratch.drop(lists, sets, links, joined, crossing)
    return result


def _inverted_lists(scratch: Scratch, classes: DataFrame, settings: NearSettings) -> DataFrame:
    """``(key, rep, n)``: keys of more than one document, without each one's most frequent ones."""
    index = classes.select("rep", "n", "sketch").mapInArrow(
        _keys(settings), "key bigint, rep bigint, n bigint, spare bigint"
    )
    frequent = index.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    order = Window.partitionBy("rep", "n").orderBy(F.col("many").desc(), "key")
    met = (
        index.join(frequent, "key")
        .withColumn("_place", F.row_number().over(order))
        .where("_place > spare")
        .select("key", "rep", "n")
    )
    return scratch.keep(met)


def _sets(scratch: Scratch, rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``(rep, set)``: the whole sets of the documents that stand in a list."""
    shared = lists.groupBy("key").agg(F.count("*").alias("_many")).where("_many > 1")
    needed = lists.join(shared, "key").select(F.col("rep").alias("doc_id")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            sets = [s.tobytes() for s in shingle_sets(shard.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [shard.column("doc_id").cast(pa.int64()), pa.array(sets, pa.binary())], names=["rep", "set"]
            )

    return scratch.keep(rows.join(needed, "doc_id").mapInArrow(run, "rep bigint, set binary"))


def _hub_pairs(lists: DataFrame, settings: NearSettings) -> DataFrame:
    """``(a, b)``: every document of a list with the list's hub.

    Hubs are the smallest under one of a few hash orders, which depends on the key, so the many
    lists of a large group share few hubs and each member still meets several.
    """
    turn = F.pmod("key", F.lit(settings.hubs))
    hub = F.min(F.struct(F.xxhash64("rep", turn), F.col("rep"), F.col("n"))).alias("hub")
    hubs = lists.groupBy("key").agg(F.count("*").alias("_many"), hub).where("_many > 1")
    close = (
        settings.denominator * F.least("n", "hub.n") >= settings.numerator * F.greatest("n", "hub.n")
    )
    return (
        lists.join(hubs, "key")
        .where((F.col("rep") != F.col("hub.rep")) & close)
        .select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b"))
        .distinct()
    )


def _confirm(
    scratch: Scratch, pairs: DataFrame, classes: DataFrame, sets: DataFrame, settings: NearSettings
) -> DataFrame:
    likely = _with(pairs, classes, "sketch").mapInArrow(_estimated(settings), "a bigint, b bigint")
    return _with(likely, sets, "set").mapInArrow(_confirmed(settings), "a bigint, b bigint")


def _crossing(lists: DataFrame, joined: DataFrame, sets: DataFrame, settings: NearSettings) -> DataFrame:
    """Links and likely links across the components that hubs have made, list by list.

    A long list is cut into blocks, and each pair of blocks is one group.
    """
    labelled = lists.join(joined, F.col("rep") == F.col("node"), "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("comp")
    )
    mixed_lists = (
        labelled.groupBy("key")
        .agg(F.count("*").alias("many"), F.min("comp").alias("_one"), F.max("comp").alias("_other"))
        .where("_one <> _other")
        .select("key", F.ceil(F.col("many") / settings.block_rows).cast("int").alias("blocks"))
    )
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    block_pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j")),
    )
    part = F.substring("set", 1, 8 * settings.list_values).alias("part")
    keys_of = lists.groupBy("rep").agg(F.collect_set("key").alias("keys"))  # at most key_values
    return (
        labelled.join(mixed_lists, "key")
        .join(sets.select("rep", part), "rep")
        .join(keys_of, "rep")
        .select("key", "rep", "n", "comp", mine.alias("block"), "part", "keys", F.inline(block_pairs))
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .mapInArrow(_cross_links(settings), _CROSS)
    )


def drop_near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    settings: NearSettings = NearSettings(),
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    groups = near_groups(spark, docs, settings, id_column, text_column)
    kept = groups.where("kept").select(F.col("doc_id").alias("__kept_id"))
    return docs.join(kept, docs[id_column].eqNullSafe(kept["__kept_id"]), "left_semi")
