"""Secrets by a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived that every match must
satisfy.  The index holds postings ``(trigram, document)`` of the trigrams that some query asks for.
Intersecting postings gives candidate documents per rule; only those are scanned with that rule's
expression.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re._parser as regex_tree
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MOST_STRINGS = 64
#: Sizes that are added up at once; blocks of blocks keep long lists of matches linear.
_BLOCK = 128


@dataclass(frozen=True)
class Rule:
    """``pattern`` is valid in Java and Python; a match counts if ``group`` has ``least`` characters.

    Only single characters and classes may repeat without a small bound: a repeated group takes a stack frame of
    Java's pattern engine for each repetition.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    def __post_init__(self):
        if _repeats_group(regex_tree.parse(self.pattern)):
            raise ValueError(f"the pattern of {self.kind} repeats a group: {self.pattern}")

    @property
    def scan(self) -> str:
        """The pattern with its least length where that gives the same matches: one class repeated."""
        if self.group == 0 and re_simple(self.pattern):
            return f"{self.pattern[:-1]}{{{self.least},}}"
        return self.pattern


def _repeats_group(tree) -> bool:
    """Whether something other than a character or class may occur more than once."""
    for kind, value in tree:
        name = str(kind)
        if name == "SUBPATTERN" and _repeats_group(value[-1]):
            return True
        if name == "BRANCH" and any(map(_repeats_group, value[1])):
            return True
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            single = len(value[2]) == 1 and str(value[2][0][0]) in ("LITERAL", "NOT_LITERAL", "IN", "ANY", "CATEGORY")
            if not single and (value[1] > 1 or _repeats_group(value[2])):
                return True
    return False


#: Fixed: the kinds of the contract, in its order, then kinds of this method.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (Rule("private_key", r"-----BEGIN [A-Z ]{0,64}PRIVATE KEY-----"),)


def _strings(tree) -> list[list[set[str]]]:
    """Alternatives of a pattern; each is a list of factors, each factor a set of possible strings.

    A match contains one string of every factor of one alternative.
    """
    factors: list[set[str]] = []
    current = {""}
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            step = {chr(value)}
        elif name == "SUBPATTERN" and (inner := _exact(value[-1])):
            step = inner
        elif name == "BRANCH" and (inner := _exact([(kind, value)])):
            step = inner
        elif name == "MAX_REPEAT" and value[:2] == (0, 1) and (inner := _exact(value[2])):
            step = inner | {""}
        else:
            step = None
        if step is None or len(current) * len(step) > _MOST_STRINGS:
            factors.append(current)
            current = {""}
        if step is not None:
            current = {a + b for a in current for b in step}
    return [[f for f in [*factors, current] if min(map(len, f)) >= 3]]


def _exact(tree) -> set[str] | None:
    """All strings that the tree matches, if they are few and fixed."""
    found = {""}
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            step = {chr(value)}
        elif name == "SUBPATTERN":
            step = _exact(value[-1])
        elif name == "BRANCH":
            parts = [_exact(b) for b in value[1]]
            step = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and value[:2] == (0, 1):
            step = _exact(value[2])
            step = None if step is None else step | {""}
        else:
            return None
        if step is None or len(found) * len(step) > _MOST_STRINGS:
            return None
        found = {a + b for a in found for b in step}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The query as alternatives, each a set of lower-case trigrams that must all occur.

    An empty list means that no trigram is mandatory.
    """
    clauses = [frozenset()]
    for alternative in _strings(regex_tree.parse(pattern)):
        for factor in alternative:
            grams = [frozenset(s.lower()[i : i + 3] for i in range(len(s) - 2)) for s in factor]
            clauses = [c | g for c in clauses for g in grams]
    return sorted(set(clauses), key=sorted) if all(clauses) else []


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """``(gram, doc_id)``: the index over the given trigrams; needs the column ``text``."""
    low = F.lower("text")
    there = [F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]
    return docs.select("doc_id", low.alias("_low")).select(
        "doc_id", F.explode(F.array_compact(F.array(*there))).alias("gram")
    )


def candidates(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """``(doc_id, rules)``: a bit for each rule whose trigram query the document satisfies."""
    clauses = [(r, c) for r, rule in enumerate(rules) for c in trigram_query(rule.pattern)]
    grams = sorted({g for _, c in clauses for g in c})
    if not grams:
        return None
    wanted = [
        (grams.index(g), number, 1 << rule, 1 << bit, (1 << len(clause)) - 1)
        for number, (rule, clause) in enumerate(clauses)
        for bit, g in enumerate(sorted(clause))
    ]
    lookup = spark.createDataFrame(wanted, "gram int, clause int, rule bigint, bit bigint, all bigint")
    met = (
        postings(docs, grams)
        .join(F.broadcast(lookup), "gram")  # as many rows as the rules have trigrams
        .groupBy("doc_id", "clause", "rule", "all")
        .agg(F.bit_or("bit").alias("seen"))
        .where(F.col("seen") == F.col("all"))
    )
    return met.groupBy("doc_id").agg(F.bit_or("rule").alias("rules"))


def _sum_to(sizes: Column, levels: int = 2) -> Column:
    """The sum of the elements before each element.

    Appending copies the list, so sizes are added up in blocks, and the totals of blocks likewise.
    """
    if not levels:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(
            sizes,
            start,
            lambda s, size: F.struct((s["at"] + size).alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
            lambda s: s["out"],
        )

    def of_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, size: s + size))
        inner = F.transform(blocks, lambda b: _sum_to(b, 0))
        moved = F.zip_with(inner, _sum_to(totals, levels - 1), lambda b, at: F.transform(b, lambda x: x + at))
        return F.flatten(moved)

    def cut(sizes: Column) -> Column:
        firsts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), F.lit(_BLOCK))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(firsts, lambda i: F.slice(sizes, i, F.lit(_BLOCK)))

    return _once(sizes, lambda known: _once(cut(known), of_blocks))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often a lambda in it asks for it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of ``(start, order, kind, end)`` of a rule's matches, in code points, end exclusive.

    The pieces between matches and the matches alternate, so a match starts after the lengths of
    all pieces up to it and all matches before it.
    """
    pattern = F.lit(rule.scan)
    pieces = F.transform(F.split(text, rule.scan, -1), F.char_length)
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.char_length)
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.char_length)
    gaps = F.slice(pieces, F.lit(1), F.size(matches))
    before = _sum_to(F.zip_with(gaps, matches, lambda a, b: a + b))
    rows = F.arrays_zip(
        before.alias("before"), gaps.alias("gap"), matches.alias("size"), groups.alias("group")
    )
    kept = F.filter(rows, lambda r: r["group"] >= rule.least)
    return F.transform(
        kept,
        lambda r: F.struct(
            (r["before"] + r["gap"]).alias("start"),
            F.lit(order).alias("order"),
            F.lit(rule.kind).alias("kind"),
            (r["before"] + r["gap"] + r["size"]).alias("end"),
        ),
    )


_NONE = "array<struct<start:int,order:int,kind:string,end:int>>"


def find_secrets(
    spark: SparkSession,
    docs: DataFrame,
    rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, spans)`` of each row, spans as an array of ``(start, order, kind, end)`` in order.

    Null texts count as empty and have no spans.  Documents that share an id are scanned for every
    rule that one of them is a candidate for, which costs time and changes nothing; null ids match
    each other in that sense.  An empty table gives no row.
    """
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    )
    found = candidates(spark, rows, rules)
    if found is None:
        joined = rows.withColumn("_rules", F.lit(0))
    else:
        found = found.select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules"))
        joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    arrays = []
    for order, rule in enumerate(rules):
        open_ = F.lit(True)
        if trigram_query(rule.pattern):
            open_ = F.coalesce(F.col("_rules"), F.lit(0)).bitwiseAND(F.lit(1 << order)) > 0
        else:  # one scan decides whether the spans are worth finding
            open_ = F.col("text").rlike(rule.scan)
        found_spans = F.when(open_, spans(F.col("text"), rule, order))
        arrays.append(F.coalesce(found_spans, F.array().cast(_NONE)))
    return joined.select("doc_id", F.array_sort(F.concat(*arrays)).alias("spans"))


def re_simple(pattern: str) -> bool:
    """Whether the pattern is one character class repeated."""
    return pattern.startswith("[") and pattern.endswith("]+") and pattern.count("[") == 1


def secret_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Counts and digests over the spans of ``find_secrets`` with all rules."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
        return F.array_join(text, ",")

    def of(kinds: list[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(kinds))

    return find_secrets(spark, docs).select(
        "doc_id",
        *(F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
