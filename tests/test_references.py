import datetime as dt

import pytest

from docloom import runtime
from docloom.operators.references import encode_key, key_runs, missing_keys, orphan_counts, orphan_references

T = dt.datetime
REFS = "table_name string, record_id string, field_name string, target string, key string, created timestamp, state string, made string"
PARENTS = "target string, key string, deleted boolean, created timestamp, _k string"


def test_runs_compress_integers_and_find_gaps(spark):
    parents = spark.createDataFrame([(f"{i:08x}",) for i in [*range(1, 50), *range(60, 80), 65535, 65536, 65537]] + [("zz",), (None,)], "key string")
    runs = key_runs(parents).collect()
    assert len(runs) == 5  # 1-49, 60-79, 65535 | 65536-65537 of the next block, zz
    refs = spark.createDataFrame([("00000031",), ("00000032",), ("0000003c",), ("00010000",), ("00010002",), ("zz",), ("zy",), ("31",), (None,)], "key string")
    assert {r.key for r in missing_keys(refs, key_runs(parents)).collect()} == {"00000032", "00010002", "zy", "31"}


def test_encoding_is_lossless(spark):
    keys = ["a1", "a01", "0a1", "", "x", "f" * 32, "f" * 31, "1" * 15, "1" * 16]
    got = spark.createDataFrame([(k,) for k in keys], "key string").select(*encode_key(__import__("pyspark.sql.functions", fromlist=["col"]).col("key"))).collect()
    assert len(set(got)) == len(keys)


def test_reasons_periods_and_dirt(spark):
    d = T(2024, 3, 1)
    parents = spark.createDataFrame([("t", "ok", False, d, "x"), ("t", "gone", True, d, "x"), ("t", "later", None, T(2024, 5, 1), "x"), ("t", "ok", True, T(2025, 1, 1), "x"), ("u", "only_u", False, d, "x")], PARENTS)
    rows = [("a", "1", "f", "t", k, T(2024, 4, 2), "s", "m") for k in ("ok", "gone", "later", "none", "", None, "only_u")]
    rows += [("a", "2", "f", "t", "later", T(2024, 6, 1), "s", "m"), ("a", "3", "f", "t", "none", None, "s", "m"), ("a", "1", "f", "t", "none", T(2024, 4, 2), "s", "m")]
    got = {(r.record_id, r.reason, r.period) for r in orphan_references(spark.createDataFrame(rows, REFS), parents).collect()}
    assert got == {("1", "deleted", "2024-04"), ("1", "late", "2024-04"), ("1", "missing", "2024-04"), ("3", "missing", None)}


@pytest.mark.parametrize("hot", [1 << 20, 90])
def test_hot_key_and_empty(spark, monkeypatch, hot):
    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    parents = spark.createDataFrame([], PARENTS)
    refs = spark.createDataFrame([("a", str(i), "f", "t", "hot", T(2024, 1, 1), "s", "m") for i in range(500)], REFS)
    assert orphan_counts(orphan_references(refs, parents)).collect()[0].n_references == 500
    assert orphan_references(spark.createDataFrame([], REFS), parents).count() == 0
