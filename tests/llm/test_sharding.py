import pytest
from bibspark.llm import queries, sharding
from bibspark.staging import shared_dir

SF = "/root/testdata/sf0.001"


def test_stored_map_places_records(spark, tmp_path):
    documents = spark.createDataFrame([(i, "x" * (10 + i * 37 % 900)) for i in range(2000)], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    where = lambda n: {x.doc_id: x.shard for x in sharding.shard(documents, n, 512, path).collect()}
    first = where(8)
    assert where(8) == first and spark.read.parquet(path).count() == 512
    grown = where(10)
    moved = {d for d in first if grown[d] != first[d]}
    assert {grown[d] for d in moved} == {8, 9} and len(moved) < 0.25 * len(first)
    assert {v for v, _, _ in sharding.load_map(spark, path)} == {2} and spark.read.parquet(path).count() == 1024
    edited = [(3, slot, 5 if slot == 7 else shard) for _, slot, shard in sharding.load_map(spark, path)]
    sharding.save_map(spark, edited, path)
    assert {x.shard for x in sharding.shard(documents, 10, 512, path).where("virtual_slot = 7").collect()} == {5}
    with pytest.raises(ValueError):
        sharding.shard(documents, 9, 512, path)
    with pytest.raises(ValueError):
        sharding.shard(documents, 10, 256, path)


def test_query_stores_its_map(spark):
    rows = queries.op8_virtual_slots(spark, SF).collect()
    stored = lambda: spark.read.parquet(f"{shared_dir(spark)}/bibspark/slot-map-*").count()
    assert stored() == 4096
    assert sorted(queries.op8_virtual_slots(spark, SF).collect()) == sorted(rows) and stored() == 4096
