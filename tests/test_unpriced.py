"""Queries over bars whose last price is zero, next to their SQL twins."""

import duckdb
import pytest

from tests.conftest import SF
from tests.oracle_check import compare, duck


@pytest.fixture(scope="module")
def unpriced(tmp_path_factory):
    """The given events, of which every 37th has the price zero."""
    folder = tmp_path_factory.mktemp("unpriced")
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 37 = 5 THEN 0 ELSE value END AS value)
        FROM read_parquet('{SF}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


def agree(spark, sf_dir, key):
    import __spark_entry__ as entry

    rows, _, _, problems = compare(spark, duck(sf_dir), entry.queries()[key], entry.oracle_sql()[key], sf_dir)
    assert rows and not problems, problems


def test_bar_alerts(spark, unpriced):
    agree(spark, unpriced, "bar_alerts")


def test_bar_close(spark, unpriced):
    agree(spark, unpriced, "bar_close")


@pytest.mark.parametrize("key", ["feat_optional", "model_folds", "model_scores"])
def test_all_bars_count(spark, unpriced, key):
    agree(spark, unpriced, key)


@pytest.fixture(scope="module")
def untrained(tmp_path_factory):
    """The given events with a symbol that never has a price and one that has a single bar."""
    folder = tmp_path_factory.mktemp("untrained")
    duckdb.sql(
        f"""COPY (SELECT * REPLACE (CASE WHEN event_id = 500 THEN 'single' ELSE event_type END AS event_type,
        CASE WHEN event_type = 'signup' THEN 0 ELSE value END AS value)
        FROM read_parquet('{SF}/events.parquet')) TO '{folder}/events.parquet' (FORMAT parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("key", ["model_bundle", "model_scores"])
def test_symbols_without_training_rows_count(spark, untrained, key):
    agree(spark, untrained, key)
