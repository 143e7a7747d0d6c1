from bibspark.llm import simhash


def test_repeated_and_null_ids(spark):
    words = " ".join(f"x{i}" for i in range(50))
    other, third = words.replace("x", "y"), words.replace("x", "z")
    rows = [(1, words), (2, words), (2, other), (3, other), (2, third), (None, "lone text"), (None, "lone text"), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = [tuple(x) for x in simhash.deduplicated(docs).collect()]
    assert len(left) == 5 and set(left) == {(1, words), (2, other), (2, third), (None, "lone text"), (4, "")}
