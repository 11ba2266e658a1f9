"""Items with spread substitutions are reported."""

from dispatchlake.llm import decontam


def test_spread_substitutions(spark):
    item = {n: [f"i{n}w{k}" for k in range(n)] for n in (8, 9, 10, 11, 30)}

    def changed(n, places):
        return " ".join("swapped" if k in places else w for k, w in enumerate(item[n]))

    docs = [(30, "well then " + changed(30, range(4, 30, 5)) + " end"), *((n, "a b c " + changed(n, [n // 2])) for n in (8, 9, 10, 11)), (31, changed(30, range(0, 30, 3))), (32, " ".join(item[30][:6]))]
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in item.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(n, n) for n in item}
    assert (got[30, 30].doc_start, got[30, 30].doc_end, got[30, 30].matched) == (2, 31, 24)
    assert all((got[n, n].doc_start, got[n, n].doc_end, got[n, n].matched) == (3, 3 + n, n - 1) for n in (8, 9, 10, 11))
