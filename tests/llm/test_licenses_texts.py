"""Every template is found whole and told apart; matches equal a full alignment; edges."""

import random

import numpy as np
import pytest

from dispatchlake.llm import license_texts, licenses

T = license_texts.TEMPLATES


def scan(text, coverage=licenses.COVERAGE):
    raw = np.frombuffer(text.encode(), np.uint8)
    h = licenses.words(raw, np.array([0, len(raw)]))[3]
    index = licenses.Index(T)
    places, prints = licenses.fingerprints(h, np.array([0, len(h)]))
    hit = np.isin(prints, index.keys)
    return index.scan(h, places[hit], prints[hit], coverage)


@pytest.mark.parametrize("name", list(T))
def test_each_license_is_itself(name):
    got = scan("some words before " + T[name] + " and some after")
    assert [x[0] for x in got] == [name] and got[0][1] == got[0][2]


def words_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return licenses.words(raw, np.array([0, len(raw)]))[3].tolist()


def best_alignment(a, b):
    """Matched words of the best local alignment (2 for a match, -1 for an edit), over the whole matrix."""
    rows = [[(0, 0)] * (len(a) + 1)]
    best = (0, 0)
    for y in b:
        now = [(0, 0)]
        for j, x in enumerate(a, 1):
            s, m = rows[-1][j - 1]
            cell = max(((s + 2, m + 1) if x == y else (s - 1, m)), (rows[-1][j][0] - 1, rows[-1][j][1]), (now[j - 1][0] - 1, now[j - 1][1]), (0, 0), key=lambda z: z[0])
            now.append(cell)
            best = max(best, cell)
        rows.append(now)
    return best[1]


def test_matches_equal_a_full_alignment():
    r = random.Random(8)
    for name in ("MIT-0", "ISC", "MPL-2.0", "EPL-2.0", "CC0-1.0-notice", "Apache-2.0"):
        for _ in range(4):
            w = T[name].split()
            for _ in range(r.randrange(1, 6)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice(([], ["changed"], [w[k], "more"]))
            text = " ".join(["x y z"] + w + ["z y x"])
            got = {x[0]: x[1] for x in scan(text)}
            best = best_alignment(words_of(text), words_of(T[name]))
            assert got.get(name) == (best if best >= licenses.COVERAGE * len(words_of(T[name])) else None)


def test_a_repeated_phrase_stays_cheap():
    text = " ".join(["without restriction, including without limitation the rights to use"] * 3000)
    assert scan(text) == []


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, T["ISC"], "c"), (3, T["ISC"], "d"), (3, T["ISC"], "d"), (4, "w " * 300_000 + T["MIT"] + " w" * 300_000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.find_licenses(docs).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "ISC"), (3, "ISC"), (3, "ISC"), (4, "MIT")]
    assert next(r for r in got if r.doc_id == 4).first_word == 300_000
    assert licenses.find_licenses(docs.limit(0)).count() == 0
