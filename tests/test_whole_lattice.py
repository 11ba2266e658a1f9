"""The road network must cover every customer row."""

import math
from collections import Counter

from dispatchlake import registry
from dispatchlake.plans import bindings

SF = "/root/testdata/sf0.01"


def test_lattice_covers_every_customer(spark):
    keys = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    nodes, edges = bindings.road_network(spark, SF)
    at = {r.node_id: (r.lat, r.lon) for r in nodes.collect()}
    assert at == {k: ((30150000 + k // 20 * 5000) / 1e6, (-92100000 + k % 20 * 5000) / 1e6) for k in keys} and len(keys) > 400
    pairs = {(k, k + 20) for k in keys if k + 20 in keys} | {(k, k + 1) for k in keys if k % 20 != 19 and k + 1 in keys}
    found = edges.collect()
    assert len(found) == len(pairs) and {(r.u, r.v) for r in found} == pairs
    assert all(r.road_class == ("primary" if r.u % 3 == 0 else "residential") for r in found)
    degree = Counter(x for p in pairs for x in p)
    snapped = registry.QUERIES["jn_16_snap_to_node"](spark, SF).collect()
    north = [r for r in snapped if r.latitude > 30.243]  # next to the row of nodes that was the last one
    assert north
    for r in north:
        def metres(e, r=r):
            (ay, ax), (by, bx) = (((at[k][0] - r.latitude) * 111320.0, (at[k][1] - r.longitude) * math.cos(math.radians(r.latitude)) * 111320.0) for k in e)
            t = max(0.0, min(1.0, -(ax * (bx - ax) + ay * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            return round(math.hypot(ax + t * (bx - ax), ay + t * (by - ay)), 3)

        d, u, v = min((metres(e), *e) for e in pairs if abs(at[e[0]][0] - r.latitude) < 0.02)
        assert (r.u, r.v) == (u, v) and abs(r.metres - d) < 0.002
        assert r.node_id == (None if max(degree[u], degree[v]) < 3 else u if degree[u] >= degree[v] else v)
