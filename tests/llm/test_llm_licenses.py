import re
import textwrap

import duckdb
import pytest

from lexgrain.llm.license_texts import complete_texts
from lexgrain.llm.licenses import KNOWN, NO_NOTICE, canonical_digest, known_licenses, license_scan
from lexgrain.llm.oracle import LICENSES

ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""


@pytest.fixture(scope="module")
def known(spark):
    return known_licenses(spark).cache()


def test_lines_that_begin_with_copyright_notice_stay(make, known):
    rows = [(1, ISC), (2, f"Copyright (c) 2020, A\nCopyright \u00a9 B\nCopyright 2021 C\nCopyright The D\n\n{ISC}")]
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan(make(rows), known).collect()}
    assert got == {1: ("ISC", "ISC", 1), 2: ("ISC", "ISC", 1)}


def test_copyright_lines(make):
    gone = ["Copyright (c) Holder Inc.", "Copyright 1999 Owner", "COPYRIGHT A. Person", "Copyright [yyyy] [name]", "(c) 2001 X"]
    stay = [f"copyright {w} x" for w in "notice holder holders owner law laws license treaty".split()]
    rows = make([(i, line) for i, line in enumerate(gone + stay)])
    digests = dict(rows.select("doc_id", canonical_digest(rows["text"])).collect())
    assert [i for i in sorted(digests) if digests[i] is None] == list(range(len(gone)))


def wrapped(text, width):
    """Paragraphs in lines of another width; copyright lines stay lines."""
    notice = re.compile(r".*copyright (\(c\)|\[yyyy\])", re.I)
    out, part = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip() and not notice.match(line):
            part.append(line.strip())
            continue
        out += [*textwrap.wrap(" ".join(part), width, break_long_words=False, break_on_hyphens=False), line]
        part = []
    return "\n".join(out)


def test_whole_licenses_are_found_however_they_are_wrapped(make, known):
    texts = complete_texts()
    assert {n for n, _ in texts} == {
        "MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
        "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense",
    }
    rows = [(1000 * w + i, wrapped(t, w)) for w in (40, 61, 79, 200) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r["whole_license"] for r in license_scan(make(rows), known).collect()}
    assert [(i, texts[i % 1000][0], got[i]) for i, _ in rows if got[i] != texts[i % 1000][0]] == []


def test_a_license_with_a_notice_of_its_own(make, known):
    mit = next(t for n, t in complete_texts() if n == "MIT").strip()
    rows = [(1, f"The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\n{mit}\n"), (2, f"{mit}\n\nMore.")]
    got = {r["doc_id"]: (r["whole_license"], r["licenses"]) for r in license_scan(make(rows), known).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "MIT")}


def test_sql_follows_the_same_rules(make, known):
    """Wrapped licences, notices and sentences about copyright, by SQL and by the operator."""
    texts = complete_texts()
    lines = [f"copyright {w} x" for w in [*NO_NOTICE, "c 2020", "2021 y", "2021y", "c", "someone", "andere", "and\u00e9"]]
    rows = [(1000 * w + i, wrapped(t, w)) for w in (47, 200) for i, (_, t) in enumerate(texts)]
    rows += [(5000 + i, f"{line}\n{notice}") for i, (line, (_, notice)) in enumerate(zip(lines, [*KNOWN] * 20, strict=False))]
    rows += [(6000 + i, f"{notice} {line}") for i, (line, (_, notice)) in enumerate(zip(lines, [*KNOWN] * 20, strict=False))]
    rows += [(7000, None), (7001, ""), (7002, f"(c) 1999 X\nCopr. Y\nAll rights reserved.\n{ISC}")]
    connection = duckdb.connect()
    connection.execute("create table documents (doc_id bigint, text varchar)")
    connection.executemany("insert into documents values (?, ?)", rows)
    expected = sorted(connection.execute(LICENSES).fetchall())
    got = sorted(map(tuple, license_scan(make(rows), known).collect()))
    assert got == expected
    assert sum(row[1] is not None for row in got) > 2 * len(texts)
