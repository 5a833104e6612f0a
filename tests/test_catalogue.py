"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from conceptlink.plans import catalogue

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    return str(v) if v is not None else None


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = duck.execute(catalogue.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_inverted_file_recall(spark):
    exact = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["knn_l2_top10"](spark, DATA).collect()}
    near = {(r.query_id, r.vec_id) for r in catalogue.QUERIES["knn_inverted_file"](spark, DATA).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_blake2b_ids_and_whole_pipeline(spark):
    from conceptlink.operators.identity import id_from_strings
    from conceptlink.schemas import ID_PARTS

    for r in catalogue.QUERIES["expression_id_blake2b"](spark, DATA).limit(20).collect():
        assert r.expression_id == id_from_strings([r[c] for c in ID_PARTS])
    done = catalogue.QUERIES["full_pipeline_map"](spark, DATA)
    assert done.count() >= 2 and done.columns[0] == "query_id"
