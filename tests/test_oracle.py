"""Every query with an oracle gives DuckDB's rows; the others run and give rows."""

import os

import duckdb
import pytest
from compare import TABLES, oracle, spark_rows

from clinloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    columns, rows = spark_rows(catalogue.QUERIES[name](spark, sf_dir))
    assert sum(rows.values()) > 0
    if name in catalogue.ORACLE_SQL:
        assert (columns, rows) == oracle(catalogue.ORACLE_SQL[name], sf_dir)


def test_undated_admissions_are_not_evaluated(spark, sf_dir, tmp_path):
    """They were before, and took part in E10: an unknown stay or age is not one within the limits."""
    for t in set(TABLES) - {"orders"}:
        os.symlink(f"{sf_dir}/{t}.parquet", tmp_path / f"{t}.parquet")
    dated = "CASE WHEN o_orderkey % 13 <> 5 THEN o_orderdate END AS o_orderdate"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({dated}) FROM '{sf_dir}/orders.parquet') TO '{tmp_path}/orders.parquet'")
    for name in ("cohort_audit_status", "cohort_exclusion_flow", "cohort_selected_audit"):
        assert spark_rows(catalogue.QUERIES[name](spark, str(tmp_path))) == oracle(catalogue.ORACLE_SQL[name], str(tmp_path)), name


def test_oracle_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)


def test_entry(spark):
    import __spark_entry__

    flow = __spark_entry__.entry(spark).collect()
    assert len(flow) == 10
    assert all(r["entering"] - r["excluded"] == r["remaining"] for r in flow)
