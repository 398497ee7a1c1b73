"""The pN_ queries at the smallest size: columns as stated, no repeats, and the SQL where there is one."""

import glob
import os

import duckdb
import pytest

from millrace.llm import oracle, queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["id", "line_no", "noise_kind"], "p2_found": ["id_a", "id_b"], "p3_found": ["id", "para_no"], "p4_found": ["vertex_id_a", "vertex_id_b"], "p5_found": ["doc_id", "subject_area"],
    "p6_found": ["id_a", "id_b"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "lang_code"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len(got) == len(set(got)) > 0
        assert all(x is not None for r in got for x in r)
    if name in oracle.oracle_sql():
        con = duckdb.connect()
        for path in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        assert sorted(got) == sorted(map(tuple, con.execute(oracle.oracle_sql()[name]).fetchall()))
