"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from dispatchlake.llm import blocks, common, phrases, repair, scoring

WORDS = "the cat sat on a mat and dog ran far away from our old red house by sea".split()


def prose(seed, n, vocabulary=WORDS):
    r = np.random.default_rng(seed)
    return " ".join(vocabulary[int(len(vocabulary) * x * x)] for x in r.random(n))


# ---------------------------------------------------------------- 11

def plain_model(texts, order):
    counts = {n: Counter() for n in range(1, order + 1)}
    for t in texts:
        w = ["<s>", *t, "</s>"]
        for n in counts:
            counts[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w)))
    return counts


def plain_score(text, counts, order):
    real = {k: v for k, v in counts[1].items() if k != ("<s>",)}
    total, kinds = sum(real.values()), len(real)
    figures = {}
    for n in range(2, order + 1):
        c = list(counts[n].values())
        once, twice = c.count(1), c.count(2)
        d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        contexts = [v for k, v in counts[n - 1].items() if n > 2 or k != ("</s>",)]
        sums = [sum(v**e for v in contexts) for e in scoring.GRID]
        figures[n] = d, float(np.interp(math.log(len(c)), np.log(sums), scoring.GRID))

    def chance(w, h):
        if not h:
            return (real.get((w,), 0) + 0.5) / (total + 0.5 * (kinds + 1))
        context = counts[len(h)][h]
        if not context:
            return chance(w, h[1:])
        d, e = figures[len(h) + 1]
        left = d * context ** (e - 1)
        return (1 - left) * counts[len(h) + 1][(*h, w)] / context + left * chance(w, h[1:])

    w = ["<s>", *text, "</s>"]
    return sum(math.log10(chance(w[i], tuple(w[max(0, i - order + 1) : i]))) for i in range(1, len(w))), sum(math.log10(chance(x, ())) for x in w[1:]), sum((x,) in real for x in w[1:])


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("order,size", [(2, 1 << 20), (3, 300), (1, 300)])
def test_scores_equal_a_plain_model(spark, order, size):
    texts = [prose(k, 5 + 11 * k) for k in range(24)] + [None, "", "  \n", "The CAT \x85 sat É", prose(5, 60), prose(5, 60), "unseen words only", "x" * 700 + " the cat"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(None, "the cat sat", "x"), (3, prose(3, 38), "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, HELD string").repartition(3)
    held = "crc32(cast(doc_id as string)) % 5 = 1"
    got = scoring.score(df, __import__("pyspark").sql.functions.expr(held), order=order, size=size).collect()
    is_held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 5 == 1
    counts = plain_model([split(t) for k, t, _ in rows if not is_held(k)], order)
    total = sum(v for k, v in counts[1].items() if k != ("<s>",))
    expect = defaultdict(list)
    for k, t, _ in rows:
        expect[k].append((is_held(k), len(split(t)) + 1, *plain_score(split(t), counts, order)))
    assert len(got) == len(rows)
    for k, own in expect.items():
        found = sorted((r["held_out"], r["n_tokens"], r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in got if r["doc_id"] == k)
        for (h, n, s, b, known, t), (eh, en, es, eb, eknown) in zip(found, sorted(own), strict=True):
            assert (h, n, known, t) == (eh, en, eknown, total) and math.isclose(s, es, rel_tol=1e-9) and math.isclose(b, eb, rel_tol=1e-9)


def test_probabilities_of_a_state_add_up_to_one():
    texts = [prose(k, 40).split() for k in range(8)]
    counts = plain_model(texts, 2)
    words = [w for (w,) in counts[1] if w != "<s>"] + ["never seen"]
    for h in ("the", "cat", "sea", "never seen"):
        one = [plain_score([h, w], counts, 2)[0] - plain_score([h], counts, 2)[0] for w in words]
        assert len(one) == len(words)  # finite everywhere
    scores = scoring.Automaton._left(np.array([0, 1, 50]), 2, scoring.Model(1, 1, {2: 0.7}, {2: 0.8}))
    assert scores[0] == 1 and scores[1] == 0.7 and scores[2] < 0.7


def test_scoring_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    assert scoring.score(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0


# ---------------------------------------------------------------- 12

def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest (cost, audit, lines) from the end on, state by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, symbols, faults = set(), [], Counter()
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults[fault] += 1
        symbols.append(fault)
    leads = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    free = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
    name = {"u": "user", "a": "assistant"}
    inf = (1 << 60, "", ())

    def inserted(best):
        for _ in range(3):
            for q in range(4):
                letter, to = free[q]
                c, a, lines = best[to]
                best[q] = min(best[q], (c + 2, "I" + a, (f"{name[letter]}:", *lines)))
        return best

    best = inserted({0: (0, "", ()), 1: inf, 2: inf, 3: (0, "", ())})
    for (_, _, role, text), fault in reversed(list(zip(rows, symbols, strict=True))):
        now = {}
        for q in range(4):
            tried = [(best[q][0] + 3, "D" + best[q][1], best[q][2])]
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                letter, to = free[q]
                c, a, lines = best[to]
                tried.append((c + 2 + cut, "R" + a, (f"{name[letter]}:{text}", *lines)))
                if (q, role[:1]) in leads:
                    c, a, lines = best[leads[q, role[:1]]]
                    tried.append((c + cut, "K" + a, (f"{role}:{text}", *lines)))
            now[q] = min(tried)
        best = inserted(now)
    turns = {r[1] for r in rows if r[1] is not None}
    pairs = zip(rows, rows[1:], strict=False)
    c, audit, lines = best[0]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs), c, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def talks(seed, conversations):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(conversations):
        for t in range(int(r.integers(0, 14))):
            role = [None, "user", "assistant", "system", "tool", "", "user", "assistant"][int(r.integers(8))] if c % 2 else ["user", "assistant"][t % 2]
            text = [None, "", "Yes.", "No", "Why? \n", "é!", " \t", f"Word {t}.", f"cut {t}"][int(r.integers(9))]
            rows.append((c if c else None, None if r.random() < 0.1 else int(r.integers(12)), role, text))
    return rows


@pytest.mark.parametrize("chunk", [1024, 3, 1])
def test_repairs_equal_a_plain_search(spark, chunk):
    rows = talks(chunk, 40)
    rows += [(500, t, ["user", "assistant"][t % 2], f"line {t}.") for t in range(60)]  # one in order
    rows += [(501, t % 7, "tool", f"odd {t}") for t in range(40)]  # never agrees by itself
    rows += [(502, t, "user", "same text.") for t in range(50)] + [(502, 90, "assistant", "end.")]
    rows += [(503, None, "user", "same row")] * 30
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Seq", __import__("pyspark").sql.functions.lit(1))
    damaged = repair.damage(df)
    expect = plain_damage(rows)
    assert sorted(map(str, damaged.collect())) == sorted(map(str, damaged.sparkSession.createDataFrame(expect, damaged.schema).collect()))
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(damaged, chunk=chunk).collect()}
    by = defaultdict(list)
    for r in expect:
        by[r[0]].append(r)
    assert got == {c: plain_repair(x) for c, x in by.items()}


def test_vectors_of_two_runs_meet():
    symbols = [2, 4, 2, 4, repair.DROP, 3, 6, 4] * 40
    true = repair.backward(symbols, repair.END_COSTS)
    assert repair.backward(symbols, repair.END_COSTS, repair.backward(symbols, (0, 0, 0, 0))) == true
    matrix = repair.transfer(symbols)
    assert repair.apply(matrix, repair.END_COSTS) == true[0] and repair.agreed([x for v in matrix for x in v]) == list(true[0])


# ---------------------------------------------------------------- 13

def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        named = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rest = []
        for p, a in named.items():
            inside = [q for q in named if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * named[q] >= 80 * a for q in inside):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rest.append((score, a, " ".join(p), left, right))
        rest.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(rest[:top])]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 20, 200])
def test_collocations_equal_plain_counts(spark, size):
    rows = [(prose(k, 30 + 5 * k).replace(" mat ", ", ").replace(" far ", ".\n"), ["en", "fr", None][k % 3]) for k in range(40)]
    rows += [("Same passage, of some words that repeat Word for word", "en")] * 9 + [(None, "en"), ("", None), ("one", "xx"), ("a\tb  c\x85d é", "en")] * 6
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in phrases.collocations(df, least=5, top=25, size=size).collect())
    assert got == plain_collocations(rows, 5, 25)


def test_collocations_of_an_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


# ---------------------------------------------------------------- shared parts

def test_runs_of_hashes_round_trip():
    for h in ([], [5], [1 << 63, (1 << 63) + 1], sorted({int(x) for x in np.random.default_rng(1).integers(1 << 62, 1 << 63, 999)})):
        a = np.array(h, np.uint64)
        base = int(a[0]) if len(a) else 0
        assert blocks.unpack(blocks.pack(a, base), base).tolist() == h
    for c in ([], [0, 3, 255], [1 << 40, 2]):
        assert blocks.expand(blocks.squeeze(np.array(c, np.int64))).tolist() == c
    grams = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 50).astype(np.uint64))
    assert [x for _, a, b in blocks.Buckets(3).slices(grams) for x in grams[a:b]] == grams.tolist()


def test_words_of_structure_do_not_collide():
    for size in (1024, 4096, 65536):
        bits = np.array([bin(i).count("1") & 1 for i in range(size)], np.uint8)
        raw = np.concatenate((bits + 97, [32], 98 - bits)).astype(np.uint8)
        s, e, _ = common.ascii_words(raw, np.array([0, len(raw)]))
        a, b = common.word_hashes(raw, s, e)
        assert a != b
    seen = {common.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in ["a" * k for k in range(1, 200)]}
    assert len(seen) == 199
