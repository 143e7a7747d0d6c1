import pyarrow as pa
import pytest

from bibspark.functions import text
from bibspark.plans import queries

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, 10_000)
    yield spark
    spark.conf.set(ROWS, before)


def test_documents_come_in_small_batches(large_batches):
    queries.normalize_documents(large_batches, "/root/testdata/sf0.001")
    assert int(large_batches.conf.get(ROWS)) <= text.TEXT_ROWS


def test_slices_of_texts(monkeypatch):
    """Each slice calls once for each different string; nulls, empty and long texts keep their places."""
    monkeypatch.setattr(text, "TEXT_BYTES", 10)
    called = []
    values = pa.array(["a", None, "b" * 50, "a", "", "c" * 9, "a", "a", None])
    got = text.once_each(lambda v: called.append(v) or v.upper(), values, pa.string())
    assert got.to_pylist() == [v and v.upper() for v in values.to_pylist()]
    assert len(called) < 7
    assert text.once_each(str.upper, pa.array([], pa.string()), pa.string()).to_pylist() == []
    assert text.once_each(str.split, pa.array([None, "a b", ""]), pa.list_(pa.string())).to_pylist() == [None, ["a", "b"], []]


def test_lists_come_in_small_batches(large_batches):
    queries.split_starts(large_batches, "/root/testdata/sf0.001")
    assert int(large_batches.conf.get(ROWS)) <= text.TEXT_ROWS
