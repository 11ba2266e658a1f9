"""Copies of a notice that stand close together are each found."""

import random

import numpy as np
import pytest

from dispatchlake.llm import licenses

MIT, APACHE = licenses.TEMPLATES["MIT-notice"], licenses.TEMPLATES["Apache-2.0-notice"]


def scan(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    h = licenses.words(raw, np.array([0, len(raw)]))[3]
    index = licenses.Index(licenses.TEMPLATES)
    places, prints = licenses.fingerprints(h, np.array([0, len(h)]))
    hit = np.isin(prints, index.keys)
    return index.scan(h, places[hit], prints[hit], licenses.COVERAGE)


@pytest.mark.parametrize("n", [1, 2, 3, 6, 10, 200])
@pytest.mark.parametrize(("notice", "size"), [(MIT, 5), (APACHE, 8)])
@pytest.mark.parametrize("gap", ["", "two words", "one two three four five six seven eight nine"])
def test_every_copy_is_found(notice, size, gap, n):
    step = size + len(gap.split())
    got = scan(f". {gap} ".join([notice] * n))
    assert [x[1:] for x in got] == [(size, size, k * step, k * step + size) for k in range(n)]


def test_damaged_copies_beside_whole_ones_are_found():
    r = random.Random(5)
    for _ in range(100):
        copies = [r.choice([MIT, MIT.replace("License", "Licence"), MIT.replace("Released", "Issued")]) for _ in range(8)]
        got = scan(" ".join(copies))
        assert len(got) == 8
        assert [(x[3] // 5, x[1]) for x in got] == [(k, 5 if c == MIT else 4) for k, c in enumerate(copies)]


def test_long_headers_in_a_row():
    for name in ("Apache-2.0", "MIT", "BSD-3-Clause", "ISC"):
        assert [x[0] for x in scan("\n".join([licenses.TEMPLATES[name]] * 4))] == [name] * 4
