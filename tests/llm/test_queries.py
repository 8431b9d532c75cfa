"""The pN_ queries on the smallest tables, and those with a statement against it."""

import pytest
from harness import connection, difference

from millrace.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
FOUND = {"p1_found": ["record_table", "record_id"], "p3_found": ["record_table", "record_id"], "p5_found": ["doc_id", "seq_len"], "p6_found": ["item_id", "doc_id"], "p7_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(frame, connection(FOLDER), ORACLES[name]) == ""
    if name in FOUND:
        assert frame.columns == FOUND[name]
    assert frame.count() >= 0
