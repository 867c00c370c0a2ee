import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from ridgeloom.functions import geo, ways
from ridgeloom.operators import graph, routes, searches, spatial
from ridgeloom.plans import catalog, registry


def one(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


def test_known_distances(spark):
    lit = F.lit
    metres, null, east, north = one(
        spark, a=geo.haversine(lit(45.0), lit(6.0), lit(46.0), lit(6.0)), b=geo.haversine(lit(None).cast("double"), lit(6.0), lit(46.0), lit(6.0)),
        c=geo.lambert93(lit(46.5), lit(3.0))[0], d=geo.lambert93(lit(46.5), lit(3.0))[1],
    )
    assert abs(metres - 111_195) < 100 and null is None
    assert abs(east - 700_000) < 1 and abs(north - 6_600_000) < 1


def test_hilbert_neighbours_touch(spark):
    grid = spark.range(256).select((F.col("id") % 16).alias("x"), (F.col("id") / 16).cast("long").alias("y"))
    cells = [r for r in grid.select("x", "y", geo.hilbert_key(F.col("x"), F.col("y"), 4).alias("k")).orderBy("k").collect()]
    assert [r.k for r in cells] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(cells, cells[1:]))


def test_climb_ignores_wobble(spark):
    heights = [30.0 * k / 10 + (0.5 if k % 2 else -0.5) for k in range(11)]
    (up,) = one(spark, up=routes.climb(F.array(*[F.lit(z) for z in heights])))
    assert abs(up - 30) <= 3


def test_distance_tiers(spark):
    tier = lambda km: routes.distance_tier(F.lit(abs(km - 10) / 10))
    assert one(spark, a=tier(10.9), b=tier(7.6), c=tier(13.4), d=tier(13.6)) == ("match", "suggestion", "wide", "none")


def test_components_and_costs_match_brute_force(spark):
    pairs = [(k, k + 1, 1.0 + k % 3) for k in range(20) if k % 7] + [(3, 9, 30.0), (1, 1, 0.0)]
    edges = spark.createDataFrame(pairs, "a int, b int, cost double")
    top = {}
    for a, b, _ in pairs:
        if a != b:
            old, new = max(top.get(a, a), top.get(b, b)), min(top.get(a, a), top.get(b, b))
            top[a] = top[b] = new
            top = {n: new if t == old else t for n, t in top.items()}
    assert {r.node: r.component for r in graph.components(edges).collect()} == top
    best = {1: 0.0}
    for _ in range(30):
        for a, b, c in pairs:
            if a in best:
                best[b] = min(best.get(b, math.inf), best[a] + c)
    found = searches.distances(edges, spark.createDataFrame([(1,)], "id int"))
    assert {r.node: r.cost for r in found.collect()} == pytest.approx(best)


def united(pairs):
    """(component, size) of each node by union-find."""
    up = {}

    def top(n):
        up.setdefault(n, n)
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        up[high] = low
    tops = {n: top(n) for n in up}
    return {n: (t, list(tops.values()).count(t)) for n, t in tops.items()}


def test_components_of_all_edges_match_union_find(spark):
    import __spark_entry__

    base = "/root/testdata/sf0.001"
    pairs = [(r.a, r.b) for r in catalog.edges(spark, base).select("a", "b").collect()]
    found = __spark_entry__.queries()["components_all"](spark, base).collect()
    assert {r.node: (r.component, r.size) for r in found} == united(pairs) and len(found) == len(united(pairs))
    rng = random.Random(8)
    pairs = [(10 * k + rng.randrange(10), 10 * k + rng.randrange(10)) for k in range(12) for _ in range(14)] + [(3, 45), (45, 99)]
    pairs = [(a, b) for a, b in pairs if a != b]
    found = graph.components(spark.createDataFrame(pairs, "a int, b int")).collect()
    assert {r.node: (r.component, r.size) for r in found} == united(pairs) and len(found) == len(united(pairs))
    assert len({r.component for r in found}) > 3


def cheapest(pairs, source):
    best, heap, near = {}, [(0.0, source)], {}
    for a, b, c in pairs:
        near.setdefault(a, []).append((b, c))
    while heap:
        cost, node = heapq.heappop(heap)
        if node not in best:
            best[node] = cost
            for b, c in near.get(node, ()):
                heapq.heappush(heap, (cost + c, b))
    return best


def test_costs_reach_the_end_of_long_paths(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(k, k + 1, 1.0) for k in range(200)] + [(rng.randrange(200), rng.randrange(200), rng.uniform(5, 60)) for _ in range(60)] + [(500, 501, 1.0)]
    edges = spark.createDataFrame([*pairs, (0, 7, None), (None, 8, 1.0)], "a int, b int, cost double")
    sources = spark.createDataFrame([(0,), (150,), (900,), (None,), (0,)], "id int")
    want = {(s, n): c for s in (0, 150, 900) for n, c in cheapest(pairs, s).items()}
    for size in (searches.BLOCK_EDGES, 40):
        monkeypatch.setattr(searches, "BLOCK_EDGES", size)
        rows = searches.distances(edges, sources).collect()
        assert {(r.source, r.node): r.cost for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert searches.distances(edges.limit(0), sources).count() == 3
    with pytest.raises(ValueError):
        searches.distances(spark.createDataFrame([(1, 2, -1.0)], "a int, b int, cost double"), sources)


def test_path_costs_match_brute_force_over_the_lattice(spark):
    base = "/root/testdata/sf0.001"
    rows = ways.priced(catalog.edges(spark, base)).where("profile = 'any'").select("a", "b", "cost", "dz").collect()
    pairs = [(r.a, r.b, r.cost) for r in rows] + [(r.b, r.a, r.cost - 8 * max(r.dz, 0) + 8 * max(-r.dz, 0)) for r in rows]
    sources = {r.source for r in catalog.path_costs(spark, base).select("source").distinct().collect()}
    assert sources == {0}
    assert {r.node: r.cost for r in catalog.path_costs(spark, base).collect()} == pytest.approx(cheapest(pairs, 0), abs=0.001)


def test_within_matches_brute_force(spark):
    nodes = [(i, 45 + (i * 37 % 100) / 5000, 6 + (i * 53 % 100) / 4000) for i in range(100)]
    points = [(i, 45.001 + i / 3000, 6.002 + i / 2500) for i in range(10)]
    schema = "id int, lat double, lon double"
    got = {(r.point, r.node) for r in spatial.within(spark.createDataFrame(points, schema), spark.createDataFrame(nodes, schema), 700.0).collect()}

    def far(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH * math.asin(math.sqrt(h))

    assert got == {(p[0], n[0]) for p in points for n in nodes if far(p, n) <= 700}


def test_every_multiplier_is_at_least_one():
    assert all(m >= 1 for row in [*ways.KINDS.values(), *ways.SURFACES.values()] for m in row)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_walks_number_references_before_nodes_are_missed(spark, tmp_path):
    """Two shuffles of references, and the rows of SQL where ids repeat, are missing or null, with equal lines of an order."""
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, 5), (2, 6), (2, 9), (41, 7), (3, None)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(7, 1, 1), (7, 2, 99), (7, 3, 2), (7, 3, 2), (7, 4, 41), (8, 1, 99), (8, 2, 3), (9, 1, 2), (None, 1, 1), (None, 2, 41)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.walk(spark, str(tmp_path), "elev_dm")
    for name in ("part", "lineitem"):
        duckdb.sql(f"create or replace view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.sql(f"with lat_nodes as ({catalog.NODES}), refs as ({catalog.REFS}) {catalog._WALK} select route, pos, lat, lon, elev_dm from walk").fetchall()
    key = lambda r: [(v is None, v) for v in r]
    assert sorted((tuple(r) for r in got.select("route", "pos", "lat", "lon", "elev_dm").collect()), key=key) == sorted(want, key=key) and len(want) == 11
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in ("route_markers", "route_profile", "route_marker_positions"):  # of nodes once and of references twice
            plan = registry.queries()[query](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3, query
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
