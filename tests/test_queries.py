"""Registered panel queries against their SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.sql import functions as F

from panelspark import queries

FOLDER = "/root/testdata/sf0.001"
queries.load()
PICKED = [
    "a2_quantile_premium", "a20_a21_portfolios", "t3_as_of_join", "t17_t18_fiscal_dates", "r1_s3_to_wide", "f1_f4_formulas",
    "a14_group_summary", "a16_top_configs", "a17_vote", "c8_pillar_score", "s26_replace_range", "m9_validation_split",
    "c5_plain_score", "c1_c2_c3_fundamental_score", "c2_clip_by_factor", "a8_decile_table", "m16_metrics", "m23_sign_backtest",
    "m12_j11_expand_configs", "m10_group_split", "s4_consensus_scan", "s8_non_ratio_fields", "s12_factor_panel_filled", "s20_evaluation_results",
    "a28_strongest_partner", "a34_distribution", "a38_rank_errors", "a40_nested_rules", "a41_best_lookback", "c3_exponents",
    "c11_score_deciles", "m1_test_skeleton", "m3_cut_labels", "t16_price_features_job",
]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(rows):
    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.5f}".replace("-0.00000", "0.00000")
        return str(v)[:10] if hasattr(v, "year") else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, FOLDER)
    result = duck.execute(queries.ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert normal(df.select(*names).collect()) == normal(result.fetchall())


@pytest.mark.parametrize("name", ["m5_lasso_signs", "m14_m19_multi_output_forest", "m14_m15_m19_forest_predictions", "m23_lasso_walk_forward", "m23_m25_linear_models", "m24_boosted_configurations"])
def test_models_report_later_or_other_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got
    if "week" in df.columns and name.startswith("m14"):
        assert min(str(r["week"]) for r in got) >= "2000-01-01"
    if name == "m14_m15_m19_forest_predictions":
        last = spark.read.parquet(f"{FOLDER}/embeddings.parquet").agg(F.max("vec_id")).first()[0]
        assert min(r["vec_id"] for r in got) > 0.8 * last
    if name == "m24_boosted_configurations":
        assert {r["part"] for r in got} == {"valid", "test"}


def test_every_query_is_registered_once():
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert len(queries.QUERIES) > 100


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
