"""How many substitution patterns the spaced seeds survive: every one of up to three tokens, a fixed draw of larger ones."""

import itertools
import math
import random

from dispatchlake.llm.decontam import MASKS, SPAN


def recall(tokens, replaced):
    met = lambda gone: any(all(a + k not in gone for k in m) for a in range(tokens - SPAN + 1) for m in MASKS)
    if math.comb(tokens, replaced) <= 20_000:
        patterns = list(itertools.combinations(range(tokens), replaced))
    else:
        r = random.Random(1)
        patterns = [tuple(r.sample(range(tokens), replaced)) for _ in range(20_000)]
    return sum(met(set(p)) for p in patterns) / len(patterns)


def test_seeds_meet_substituted_items():
    assert all(recall(n, 1) == 1 for n in range(9, 41))  # from 9 tokens on, no single token hides an item
    assert all(recall(n, 2) == 1 for n in range(14, 41, 2)) and recall(12, 2) > 0.98 and recall(10, 2) > 0.91
    assert all(recall(n, n // 4) > 0.95 for n in range(16, 41, 4)) and all(recall(n, n // 5) > 0.999 for n in range(20, 41, 5))
    assert round(recall(8, 1), 3) == 0.625  # the shortest items: the places that both masks take
