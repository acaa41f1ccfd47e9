"""URL rules as sorted arrays of digests.

Rules are kept as blocks of sorted 64-bit xxhash keys beside the stored strings.  The blocks are
files that Spark hands to every executor and that tasks map into memory, so their size is bounded by
disk.  Urls are cut into the few ``host suffix + path prefix`` strings that can equal a rule, hashed,
looked up by vectorised binary search, and confirmed by comparing the whole string.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_RULES = 1_000_000
VERDICTS = "page_id bigint, host string, path string, rule string, verdict string"
#: Host is what follows the first "://"; path is the rest up to the query or fragment.
_PARTS = r"(?s)^.*?://(?P<host>[^/?#]*)(?P<path>[^?#]*)"


@dataclass(frozen=True)
class RuleFiles:
    """Names of the files of each block, and the shapes that rules have."""

    blocks: tuple[str, ...]
    shapes: tuple[tuple[int, int], ...]  # labels of the host, characters of the path


def _key(rule: bytes) -> int:
    return xxhash.xxh64_intdigest(rule)


def _write_block(folder: str, rules: dict[bytes, tuple[int, bool]]) -> str:
    name = f"rules-{uuid.uuid4().hex}.npz"
    keys = np.array([_key(r) for r in rules], np.uint64)
    order = np.argsort(keys, kind="stable")
    strings = list(rules)
    ordered = [strings[i] for i in order.tolist()]
    labels = np.array([rules[r][0] for r in ordered], np.int64)
    block = np.array([rules[r][1] for r in ordered], np.int64)
    ends = np.cumsum([0] + [len(r) for r in ordered]).astype(np.int64)
    with open(os.path.join(folder, name), "wb") as file:
        for part in (np.array([len(keys)], np.int64), keys[order], labels, block, ends):
            file.write(part.tobytes())
        file.write(b"".join(ordered))
    return name


class RuleBlock:
    """One block, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, mode="r")
        n = int(data[:8].view(np.int64)[0])
        at = 8

        def part(kind, count):
            nonlocal at
            found = data[at : at + 8 * count].view(kind)
            at += 8 * count
            return found

        self.keys, self.labels, self.blocks = part(np.uint64, n), part(np.int64, n), part(np.int64, n)
        self.ends, self.strings = part(np.int64, n + 1), data[at:]

    def string(self, i: int) -> bytes:
        return self.strings[self.ends[i] : self.ends[i + 1]].tobytes()

    def find(self, wanted: list[bytes]) -> np.ndarray:
        """The place of each string, or -1; equal keys of other strings are passed over."""
        keys = np.fromiter(map(_key, wanted), np.uint64, len(wanted))
        places = np.searchsorted(self.keys, keys)
        found = np.full(len(wanted), -1, np.int64)
        inside = np.minimum(places, max(len(self.keys) - 1, 0))
        for i in np.flatnonzero(self.keys[inside] == keys).tolist() if len(self.keys) else ():
            at = int(places[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:
                if self.string(at) == wanted[i]:
                    found[i] = at
                    break
                at += 1
        return found


def rule_files(spark: SparkSession, rules: DataFrame, block_rules: int = BLOCK_RULES) -> RuleFiles:
    """Write ``rules(host, path, verdict)`` as blocks and hand them to the executors.

    One block at a time is held by the driver.  A rule that is both allowed and blocked blocks.
    Rules without host are ignored.
    """
    folder = tempfile.mkdtemp(prefix="lexgrain-rules-")
    names, shapes = [], set()
    block: dict[bytes, tuple[int, bool]] = {}

    def close() -> None:
        name = _write_block(folder, block)
        spark.sparkContext.addFile(os.path.join(folder, name))
        names.append(name)
        block.clear()

    for row in rules.select("host", "path", "verdict").toLocalIterator():
        if not row["host"]:
            continue
        host, path = row["host"].encode().lower(), (row["path"] or "").encode()
        labels = host.count(b".") + 1
        shapes.add((labels, len(row["path"] or "")))
        rule = host + path
        block[rule] = (labels, row["verdict"] == "block" or block.get(rule, (0, False))[1])
        if len(block) >= block_rules:
            close()
    if block:
        close()
    return RuleFiles(tuple(names), tuple(sorted(shapes)))


def _suffixes(hosts: list[str], labels: int) -> list[str | None]:
    parts = [h.split(".") for h in hosts]
    return [".".join(p[-labels:]) if h and len(p) >= labels else None for h, p in zip(hosts, parts, strict=True)]


def judge(urls: pa.Array, blocks: list[RuleBlock], shapes, default: str) -> list[pa.Array]:
    """``[host, path, rule, verdict]`` of each url."""
    parts = pc.extract_regex(pc.fill_null(urls.cast(pa.string()), ""), _PARTS)
    host = pc.ascii_lower(pc.fill_null(pc.struct_field(parts, "host"), ""))
    path = pc.fill_null(pc.struct_field(parts, "path"), "")
    n = len(urls)
    best_size, best_host = np.full(n, -1), np.full(n, -1)
    rule = np.full(n, None, object)
    blocked = np.zeros(n, bool)
    coded = pc.dictionary_encode(host)
    path_size = pc.utf8_length(path).to_numpy(zero_copy_only=False)
    for labels, size in shapes:
        suffix = pa.array(_suffixes(coded.dictionary.to_pylist(), labels), pa.string()).take(coded.indices)
        fits = (path_size >= size) & suffix.is_valid().to_numpy(zero_copy_only=False)
        rows = np.flatnonzero(fits)
        if not len(rows):
            continue
        prefix = pc.utf8_slice_codeunits(path.take(pa.array(rows)), 0, size)
        wanted = pc.binary_join_element_wise(suffix.take(pa.array(rows)), prefix, "")
        distinct = pc.dictionary_encode(wanted)
        strings = [s.encode() for s in distinct.dictionary.to_pylist()]
        codes = distinct.indices.to_numpy(zero_copy_only=False)
        lengths = np.array([len(s) for s in distinct.dictionary.to_pylist()], np.int64)
        for block in blocks:
            found = block.find(strings)
            hit = np.flatnonzero(found[codes] >= 0)
            at, row = codes[hit], rows[hit]
            # Of rules of equal length the one with the longer host wins.
            longer = (lengths[at] > best_size[row]) | (
                (lengths[at] == best_size[row]) & (labels > best_host[row])
            )
            at, row = at[longer], row[longer]
            best_size[row], best_host[row] = lengths[at], labels
            rule[row] = [strings[i].decode() for i in at.tolist()]
            blocked[row] = block.blocks[found[at]] > 0
    verdict = np.where(best_size < 0, default, np.where(blocked, "block", "allow"))
    return [host, path, pa.array(rule, pa.string()), pa.array(verdict.tolist(), pa.string())]


def url_verdicts(
    spark: SparkSession,
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
    block_rules: int = BLOCK_RULES,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each row.

    A rule fits its host and all subdomains where the url's path starts with the rule's path; the
    longest wins, of equally long ones the one with more host labels.  A null url and one without
    ``://`` have an empty host and path, fit no rule and get ``default``.  Null ids and repeated rows
    are judged like others; without rules everything gets ``default``.  Nothing is shuffled.
    """
    files = rule_files(spark, rules, block_rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [RuleBlock(SparkFiles.get(name)) for name in files.blocks]
        for batch in batches:
            columns = judge(batch.column("url"), blocks, files.shapes, default)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), *columns],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"))
    return rows.mapInArrow(run, VERDICTS)
