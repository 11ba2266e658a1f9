"""Words made to collide in polynomial hashes stay apart in packing and deduplication; long addresses stay whole."""

import gzip

import numpy as np
import pytest

from dispatchlake.llm import dedup, packing, sharding, warc


def thue_morse(size):
    bits = "".join("ab"[bin(i).count("1") & 1] for i in range(size))
    return bits, bits.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [512, 1024, 4096, 16384])
def test_packing_gives_each_word_its_own_ids(size):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    words = packing.WordPieces(packing.default_tokenizer())
    texts = [*thue_morse(size), "x " + " ".join(thue_morse(size))]
    raw = [x.encode() for x in texts]
    got = words.rows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert [x.tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_near_duplicates_need_words_in_common(spark):
    rows = []
    for k, size in enumerate((1024, 4096, 65536)):
        one, two = thue_morse(size)
        rows += [(10 * k, " ".join([one] * 6)), (10 * k + 1, " ".join([two] * 6)), (10 * k + 2, " ".join([one.upper()] * 7))]
    got = {r.doc_id: r.component_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {10 * k + j: 10 * k + (j == 1) for k in range(3) for j in range(3)}


def test_long_addresses_stay_whole(spark, tmp_path):
    body, url = "payload " * 200, "http://a/" + "x" * 6001
    pages = spark.createDataFrame([(1, "http://a/1", body), (2, url, body)], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/raw")
    warc.deduplicate(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/out")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    assert f"WARC-Refers-To-Target-URI: {url}\r\n".encode() in text
    assert {r.url for r in warc.read_archive(spark, f"file://{tmp_path}/out").collect()} == {"http://a/1", url}


@pytest.mark.parametrize("seed", range(6))
def test_growing_a_slot_map_fills_the_new_shard(seed):
    r = np.random.default_rng(seed)
    for slots in (512, 4096):
        weight = {v: int(x) for v, x in enumerate(r.integers(100, 3000, slots) * r.integers(1, 3, slots))}
        spread = lambda m, n: (max(x) - min(x)) / max(x) if (x := [sum(w for v, w in weight.items() if m[v] == s) for s in range(n)]) else 0
        old = sharding.rebalance([v % 24 for v in range(slots)], weight, 24)
        new = sharding.rebalance(old, weight, 25, sharding.TOLERANCE)
        moved = [v for v in range(slots) if old[v] != new[v]]
        assert spread(old, 24) < 0.002 and spread(new, 25) <= 0.0101
        assert 0 < len(moved) < 0.1 * slots and sum(new[v] == 24 for v in moved) >= 0.7 * len(moved)
        assert sharding.rebalance(new, weight, 25, sharding.TOLERANCE) == new
    skewed = sharding.rebalance([v % 8 for v in range(64)], {0: 10**9} | {v: 5 for v in range(1, 64)}, 8)
    assert sorted(set(skewed)) == list(range(8)) and sharding.rebalance([0] * 4, {}, 2) == [0] * 4
