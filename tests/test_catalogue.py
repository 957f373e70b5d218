"""Every registered search query against its SQL."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle  # noqa: E402

from sparkquill.catalogue import ORACLE_SQL, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, con, name):
    oracle.compare(spark, con, sf, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_is_pruned(spark, sf, capsys):
    """A search reads two columns, and its terms reach the exploded tokens."""
    QUERIES["bm25_all_matches"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "BroadcastHashJoin" in plan
