"""The registered queries against their reference SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from check_oracle import TABLES, rows_of
from conftest import SF

CHECKED = ("repo_risk", "spans_url", "synthetic_ids", "resolve_overlaps", "rule_nlp", "rule_date", "redacted_documents",
           "explain_findings", "top_files", "scan_trend", "reports_nested", "dashboard", "release_gate", "scan_accounting",
           "traversal_order", "formatting", "history_append", "spans_long_lines", "spans_whole_keys", "spans_cards_in_groups",
           "spans_secrets_bare", "spans_iban_valid", "spans_ipv6", "repo_files", "masked_logs", "spans_from_table")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, name):
    df = entry_points.queries()[name](spark, SF)
    cursor = db.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_reference_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
