"""Registered queries against their SQL at the smallest scale; FRAMESIFT_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = ["S2_standardize_boxes", "P4_usable_boxes", "K3_side_table_chunks", "O1_random_order", "O3_stride_halving_order", "O10_chunk_queues",
          "Q7_discovery_curve", "Q6_result_table", "B1_B2_chunk_counters", "A5_p_matrix", "A16_conditional_histogram", "V2_savings_at_fraction",
          "W2_label_runs", "W4_score_instances", "T2_suppression", "T6_relational_linker", "M2_average_precision", "E5_miss_derivatives", "R9_normalised",
          "S13_coco_annotations"]
names = list(entry.oracle_sql()) if os.environ.get("FRAMESIFT_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), entry.oracle_sql()[name], con) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["category", "nf", "ni"]
