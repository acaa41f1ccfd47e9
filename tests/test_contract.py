"""Every registered query against its SQL, and plan checks."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as contract

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(tables):
    return connect(tables)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 2


@pytest.mark.parametrize("name", sorted(n for n in contract.queries() if not n.startswith("op") and n != "pipeline"))
def test_query(spark, duck, tables, name):
    build = contract.queries()[name]
    if name in SQL:
        assert compare(spark, duck, tables, build, SQL[name]) == ""
    else:
        assert build(spark, tables).count() > 0


@pytest.mark.parametrize("name", ["ngrams_1_2", "box_stats", "word_histogram", "vocab_totals", "top_words"])
def test_text_is_not_processed_in_scan_filters(spark, tables, name, capsys):
    contract.queries()[name](spark, tables).explain("formatted")
    conditions = [l for l in capsys.readouterr().out.splitlines() if l.startswith("Condition")]
    assert conditions and not [c for c in conditions if "regexp" in c]


def test_label_queries_do_not_read_text(spark, tables, capsys):
    contract.queries()["stratified_kfold"](spark, tables).explain("formatted")
    out = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint" in out and "text:string" not in out


def test_best_run_is_limited_before_the_shuffle(spark, tables, capsys):
    contract.queries()["rank_runs"](spark, tables).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out
