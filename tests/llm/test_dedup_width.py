"""The pipeline's stage compares shingles of five words."""

import corpus_pipeline
from dispatchlake.llm import dedup


def likeness(a, b, width):
    sets = [{tuple(x[k : k + width]) for k in range(len(x) - width + 1)} for x in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stage_takes_five_words(spark, tmp_path):
    base = [f"w{k}" for k in range(200)]
    far, near = list(base), list(base)
    for k in (20, 60, 100, 140, 180):
        far[k] = f"other{k}"
    near[50] = "other"
    assert likeness(base, far, 4) >= 0.8 > likeness(base, far, 5) and likeness(base, near, 5) >= 0.8
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(far)), (3, " ".join(near))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, str(tmp_path)).collect()) == [1, 2]
    assert [r.doc_id for r in dedup.near_duplicates(docs).filter("kept").collect()] == [1]  # op2 keeps four words
