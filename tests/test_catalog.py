"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from renewscope.plans import load_catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
CHECKED = (
    "cohort_expiry_events", "renewal_decision", "horizon_features", "trajectory_labels_dense", "cutoff_feature_matrix_dense",
    "late_renewal_day_bins", "official_churn_labels", "churn_robustness", "class_medians", "spearman_correlation",
    "run_splits_all_seeds", "stratified_subsample_sizes", "sequence_coverage", "classification_report", "ranking_scores",
    "best_renewal_threshold", "naive_baselines", "paired_test_table", "bootstrap_intervals", "label_contract_checks", "streamed_usage_rollup",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, con, name):
    df = driver.queries()[name](spark, sf_dir)
    result = con.execute(driver.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    want = result.fetchall()
    assert want
    assert rounded(tuple(r) for r in df.select(*columns).collect()) == rounded(want)


def test_registry():
    queries, sql = driver.queries(), driver.oracle_sql()
    assert set(sql) <= set(queries)
    without = set(load_catalog().QUERIES) - set(sql)
    fitted = {n for n, g in load_catalog().GROUPS.items() if g == "model_queries"}
    assert without <= fitted


def test_every_sql_text_parses(con):
    for name, text in driver.oracle_sql().items():
        con.execute(f"EXPLAIN {text}")


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"expiry_month", "label", "n", "share"}
