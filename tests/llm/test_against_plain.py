"""Operators against plain versions of their methods, and pipeline stages on hostile tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dispatchlake.llm import common as C
from dispatchlake.llm import dedup, langid, quality

SF = "/root/testdata/sf0.01"


def shingles(text, width=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.select("doc_id", "text").collect()}
    by_set, posts = {}, {}
    for i, s in sorted(sets.items()):
        if s:
            by_set.setdefault(s, []).append(i)
    classes = list(by_set)
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    def link(a, b):
        a, b = sorted((root(a), root(b)))
        low[b] = a

    links = 0
    for n, s in enumerate(classes):
        for i in by_set[s]:
            link(i, by_set[s][0])
        met = {}
        for g in s:
            for k in posts.get(g, ()):
                met[k] = met.get(k, 0) + 1
            posts.setdefault(g, []).append(n)
        for k, common in met.items():
            if 100 * common >= 80 * (len(s) + len(classes[k]) - common):
                link(by_set[s][0], by_set[classes[k]][0])
                links += 1
    want = {i: (len(sets[i]), root(i)) for i in sets}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(docs).collect()}
    assert links > 5 and got == want  # every link of every text, those of ids divisible by 20 among them: recall 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))
    got = dedup.connected_components(edges).collect()
    assert len(got) == 3000 and {r.root for r in got} == {0}


def test_hot_keys_join_apart(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT_ROWS", 3)
    left = spark.createDataFrame([(k % 4 if k < 40 else k, k) for k in range(60)] + [(None, 99)], "key long, v long")
    right = left.filter("key IS NOT NULL AND key <> 2").groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    for how in ("inner", "left", "left_semi"):
        want = left.join(right.drop("n"), "key", how).select("key", "v", *(["s"] if how != "left_semi" else []))
        assert sorted(map(str, C.join_keyed(left, right, ["key"], 61, how=how).collect())) == sorted(map(str, want.collect()))


def test_language_vectors_are_sums_of_bound_letters(monkeypatch):
    space = langid.letters(langid.DIMENSIONS)
    texts = ["Ab c", "straße über uns", "x", "aaa aaa", "слово и дело", "A" * 50 + "b c" * 30]

    def plain(text):
        s = space.table[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist()
        s = [0, *s, 0]
        s = [c for k, c in enumerate(s) if k == 0 or c or s[k - 1]]
        s += [0] * max(0, 3 - len(s))
        out = np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(s, s[1:], s[2:]):
            v = [np.roll(space.rotated[0][x].astype(int), k) for k, x in ((2, a), (1, b), (0, c))]
            out += v[0] * v[1] * v[2]
        return out

    for block in (langid.BLOCK, 8):  # 8: longer texts go block by block
        monkeypatch.setattr(langid, "BLOCK", block)
        got = [v for group in langid._groups(space.grams(t) for t in texts) for v in langid._vectors(space, group)]
        assert all(np.allclose(v, plain(t)) for v, t in zip(got, texts, strict=True))


def test_language_edges(spark):
    rows = [(k, "the house and the water are here", "en", "p") for k in range(6)] + [(k, "das haus und das wasser sind hier", "de", "q") for k in range(6, 8)] + [(None, "das haus", None, "r"), (3, None, "en", "s"), (3, "the house", "en", "s"), (3, "the house", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = langid.learn(docs, sample=40)
    assert set(profiles) == {"en", "de"} and langid.learn(docs.limit(0)) == {}
    out = langid.identify(docs, profiles).collect()
    assert len(out) == len(rows) and [r.lang_pred for r in out if r.doc_id is None] == ["de"] and {r.lang_pred for r in out if r.doc_id == 3} == {"en", "und"}
    assert langid.identify(docs.limit(0), profiles).count() == 0


def test_trees_by_recursion_and_exhaustive_split():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, (300, 4)).astype(np.float32)
    y = ((x[:, 1] > 11) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.fit(x, y, trees=5, depth=3, bins=64)

    def value(row, node):
        if trees.left[node] == node:
            return trees.value[node]
        return value(row, trees.left[node] if row[trees.feature[node]] <= trees.cut[node] else trees.right[node])

    want = [1 / (1 + np.exp(-(trees.base + sum(value(r, t) for t in trees.roots)))) for r in x]
    assert np.allclose(trees.score(x), want)
    p = y.mean()
    g, w = p - y, np.full(300, p * (1 - p))
    score = lambda m: g[m].sum() ** 2 / (w[m].sum() + 1.0)
    best = max((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(4) for c in np.unique(x[:, j])[:-1] if 10 <= (x[:, j] <= c).sum() <= 290)
    root = trees.roots[0]
    same = lambda j, c: (x[:, j] <= c).tolist()
    assert same(trees.feature[root], trees.cut[root]) == same(best[1], best[2])


def test_quality_sample_is_the_same_in_any_order(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.learn(docs, labels, sample=60)
    b = quality.learn(docs.orderBy(F.desc("doc_id")).repartition(5), labels.union(labels), sample=60)
    assert a.cut.tolist() == b.cut.tolist() and a.value.tolist() == b.value.tolist()
    assert quality.score(docs.limit(0), a).count() == 0


def hostile(spark):
    """Null ids and texts, empty, repeated and very long texts, and columns with the names that operators use."""
    prose = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(60)
    odd = [(9001, None), (9002, ""), (9003, "  \n "), (None, "a text without an id, long enough to be read as one " * 3), (9004, "same text twice in the table"), (9004, "same text twice in the table"), (9005, "long word " * 60_000), (9006, "Mail ann@site.org or ann@site.org")]
    rows = prose.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long"))
    for c in ("__text", "__own", "__h", "__score", "__row", "__kept", "__leak", "body", "own", "score", "row", "h", "leak_id", "version", "fp"):
        rows = rows.withColumn(c, F.lit(c))
    return rows


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_a_hostile_table(spark, tmp_path, empty):
    import corpus_pipeline

    docs = hostile(spark)
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        one = spark.read.parquet(f"{SF}/{t}.parquet")
        (one.limit(0) if empty else one).write.parquet(f"{tmp_path}/{t}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = now.columns
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert kept.columns == names
            kept.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
            assert now.filter("`__text` <> '__text' OR version <> 'version'").isEmpty()
        else:
            assert kept.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    if not empty:
        assert "site.org" not in "".join(r.text or "" for r in now.select("text").collect()) and now.count() > 20
