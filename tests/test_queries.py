"""Registered queries against their SQL on the smallest given tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = (
    "indicators_in_blocks", "macd_in_blocks", "price_lookback_in_blocks", "event_alignment_in_blocks", "prior_windows_in_blocks", "buffer_windows", "stream_bars", "stream_moments",
    "table_round_trip", "jsonl_round_trip", "tsv_round_trip", "dated_folders", "first_rows", "word_vectors", "request_parts", "result_cache", "vocabulary", "stock_words", "vocabulary_index", "trajectory_texts", "option_means",
    "chat_texts", "action_aliases", "prompt_surgery", "utility_scores", "masked_tokens", "dataset_kinds", "calibration_error_edges", "calibration_curve_edges", "counterfactual_flips", "trading_day_messages", "dense_batches", "clean_news", "leakage_flags",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, con, name):
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert got and got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


def test_every_numbered_query_is_registered():
    names = list(entry.queries())
    if any(n.startswith("op1_") for n in names):  # the corpus operators may be absent
        assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
