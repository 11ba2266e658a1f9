"""Documents without an id are not lost."""

from dispatchlake.llm import dedup


def words(name, n=60):
    return " ".join(f"{name}{k}" for k in range(n))


def test_rows_with_null_ids_stay_unless_they_are_copies(spark):
    rows = [(None, words("a")), (None, words("a") + " end"), (None, words("b")), (7, words("b")), (5, words("c")), (None, words("d")), (None, None), (None, ""), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = dedup.keep_first(docs)
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert {i: t for i, t in got if i is not None} == {5: words("c"), 7: words("b"), 9: None}
    lone = [t for i, t in got if i is None]
    assert len(lone) == 4 and {words("d"), None, ""} < set(lone)
    assert len({words("a"), words("a") + " end"} & set(lone)) == 1


def test_only_null_ids(spark):
    docs = spark.createDataFrame([(None, words("a")), (None, words("b")), (None, words("b"))], "doc_id long, text string")
    assert sorted(r.text for r in dedup.keep_first(docs, width=5).collect()) == [words("a"), words("b")]
