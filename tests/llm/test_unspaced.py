from bibspark.llm import decontaminate

ITEM = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往"


def test_unspaced_items_are_found(spark):
    edited = ITEM.replace("月", "星")
    docs = spark.createDataFrame([(1, f"前言{ITEM}后记"), (2, f"a {edited}"), (3, "天地之间别的话语与此无关"), (4, "plain words only"), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, "ภาษาไทยไม่มีช่องว่างระหว่างคำ"), (3, "天地之间")], "item_id long, text string")
    found = {(x.doc_id, x.item_id, x.distance) for x in decontaminate.contaminated(docs, items).collect()}
    assert found == {(1, 1, 0), (2, 1, 1), (3, 3, 0)}
    assert sorted(x.doc_id for x in decontaminate.cleaned(docs, items).collect()) == [4, 5]
    thai = spark.createDataFrame([(6, "ก่อนภาษาไทยไม่มีช่องว่างระหว่างคำหลัง")], "doc_id long, text string")
    assert decontaminate.cleaned(thai, items).count() == 0
