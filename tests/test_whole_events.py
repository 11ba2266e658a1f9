"""Queries that must use every row of events, against plain Python."""

from collections import Counter

from dispatchlake import registry
from dispatchlake.plans import bindings

SF = "/root/testdata/sf0.001"


def test_place_parts_of_every_incident(spark):
    rows = {r.incident_number: r.location for r in bindings.incidents(spark, SF).collect()}
    got = {r.incident_number: r for r in registry.QUERIES["prj_19_place_parts"](spark, SF).collect()}
    assert got.keys() == rows.keys()
    padded = {n: x for n, x in rows.items() if x != x.strip()}
    assert padded
    for n, x in padded.items():  # the town is told by capital letters only, so these stay whole
        block, _, cross = " ".join(x.split()).partition("/")
        assert (got[n].town, got[n].block, got[n].cross_street) == ("", block.strip(), cross.strip())


def test_merges_use_every_incident(spark):
    key = lambda x: " ".join(x.split()).upper()
    rows = [(r.event_id, key(r.location)) for r in bindings.incidents(spark, SF).collect() if key(r.location)]
    cur, new = Counter(k for i, k in rows if i % 3 == 0), Counter(k for i, k in rows if i % 3)
    got = {kind: {r.location_key: r.n for r in registry.QUERIES[f"jn_02_merge_{kind}"](spark, SF).collect()} for kind in ("ignore", "add", "replace")}
    assert got == {"ignore": {**new, **cur}, "add": dict(cur + new), "replace": {**cur, **new}}
    assert sum(got["add"].values()) == len(rows)
