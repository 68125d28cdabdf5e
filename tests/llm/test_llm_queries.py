"""The queries of the training-data operators run on the smallest tables, and equal their SQL."""

import glob
import os

import duckdb
import pytest

from verbatrix.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
COLUMNS = {
    "p2_found": ["space", "seq_a", "seq_b"], "p3_found": ["kept_id", "dup_id"], "p4_found": ["group_seq", "seq"], "p5_found": ["entry_id", "piece_no", "start_pos", "end_pos", "piece_topic"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "restored_h"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    got = df.collect()
    if name in queries.SQL:
        c = duckdb.connect()
        c.execute("SET timezone = 'UTC'")
        for p in glob.glob(f"{SF}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        assert sorted(map(tuple, got)) == sorted(c.execute(queries.SQL[name]).fetchall())
