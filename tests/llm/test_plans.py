"""Every registered query of the subpackage runs over sf0.001 and, where it has SQL, agrees with it."""

import pytest
from test_queries import DATA, duck, rows  # noqa: F401

from docloom.llm import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    got = plans.QUERIES[name](spark, DATA).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in plans.SQL:
        assert rows(got) == rows(duck.execute(plans.SQL[name]).df())


def test_found_documents_are_those_whose_chunks_are_fewer(spark):
    """p1_found against p1_chunks: containers of each document beside those of filling in reading order."""
    from pyspark.sql import functions as F

    from docloom.llm.packing import next_fit
    from docloom.llm.plans.p1 import _items

    order: dict = {}
    for r in _items(spark, DATA).where("collection is not null and size between 1 and cap").orderBy("position", "item").collect():
        order.setdefault((r.collection, r.cap), []).append(r["size"])
    reading = {d: next_fit(sizes, cap) for (d, cap), sizes in order.items()}
    chunks = {r.document_id: r.n for r in plans.QUERIES["p1_chunks"](spark, DATA).where("fill <= 1").groupBy("document_id").agg(F.count("*").alias("n")).collect()}
    found = {r.document_id for r in plans.QUERIES["p1_found"](spark, DATA).collect()}
    assert found == {d for d, n in reading.items() if chunks[d] < n}


def test_found_blocks_are_those_cut(spark):
    cut = {r.block_id for r in plans.QUERIES["p4_pieces"](spark, DATA).where("piece_no > 0").collect()}
    assert cut == {r.block_id for r in plans.QUERIES["p4_found"](spark, DATA).collect()}
