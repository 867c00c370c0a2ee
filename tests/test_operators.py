"""Operators without an oracle, and format readers on odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from ridgeloom.operators import graph, ranking, raster
from ridgeloom.sources import grids, tiles, tracks


def greedy(rows, limit=8, fill=3):
    """(id, place) by plain loops over rows (id, score, tier, direct, cells) in order of score and id."""
    rows = sorted(rows, key=lambda r: (r[1], r[0]))

    def shares(chosen, e):
        for p in chosen:
            a, b = set(p[4]), set(e[4])
            of = (max if p[3] or e[3] else min)(len(a), len(b))
            if of and len(a & b) / of > 0.5:
                return True
        return False

    chosen = []
    for tier, size in ((0, limit), (1, fill), (2, fill)):
        for e in rows:
            if e[2] == tier and len(chosen) < size and not shares(chosen, e):
                chosen.append(e)
    loop = next((e for e in rows if e[3]), None)
    if loop and not any(p[3] for p in chosen) and not shares(chosen, loop):
        chosen = chosen[: limit - 1] + [loop]
    return [(e[0], k) for k, e in enumerate(sorted(chosen, key=lambda e: (e[2], e[1], e[0])), 1)]


def test_pick_matches_plain_loops(spark):
    rng = random.Random(7)
    rows = []
    for request in range(40):
        for i in range(rng.randrange(1, 30)):
            rows.append((request, i, rng.randrange(20) / 10, rng.choice([0, 0, 1, 2]), i == 3, rng.sample(range(15), rng.randrange(0, 6))))
    df = spark.createDataFrame(rows, "request bigint, id bigint, score double, tier int, direct boolean, cells array<int>")
    got = {}
    for r in ranking.picked(df).collect():
        got.setdefault(r.request, []).append((r.id, r.place))
    for request in range(40):
        assert sorted(got.get(request, []), key=lambda x: x[1]) == greedy([r[1:] for r in rows if r[0] == request])


def test_running_sums_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("id * 7 % 1000 as k", "id % 5 as v")
    got = {r.k: (r.v, r.s) for r in graph.running_sums(rows, ["k"], "v", "s").collect()}
    before = 0
    for k in range(1000):
        assert got[k][1] == before
        before += got[k][0]


def test_components_of_nothing_and_loops(spark):
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
    assert graph.labels(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).collect() == []


def test_samples_need_four_heights(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, 3.0), (1, 1, 4.0), (2, 0, None), (2, 1, 9.0)], "gi bigint, gj bigint, z double")
    points = spark.createDataFrame([(1, 25.0, 25.0), (2, 50.0, 25.0), (3, -999.0, 0.0)], "id bigint, x double, y double")
    assert {r.id: r.z for r in raster.sampled(points, cells, 0.0, 0.0, 25.0).collect()} == {1: 2.5, 2: None, 3: None}


def test_grid_files(spark, tmp_path):
    (tmp_path / "a.asc").write_text("NCOLS 2\nnrows 2\nXLLCORNER 0\nyllcorner 0\ncellsize 25\nnodata_value -9\n1 2\n-9 4\n")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.ASC").write_text("ncols 1\nnrows 1\nxllcorner 50\nyllcorner 25\ncellsize 25\n7\n")
    found = grids.cells(grids.grids(grids.files(spark, str(tmp_path)))).select("gi", "gj", "z").collect()
    assert {(r.gi, r.gj): r.z for r in found} == {(0, 0): None, (0, 1): 1.0, (1, 0): 4.0, (1, 1): 2.0, (2, 1): 7.0}
    bad = spark.createDataFrame([("x", "ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 25\n1 2 3\n")], "path string, body string")
    with pytest.raises(Exception, match="another number of values"):
        grids.grids(bad).collect()


def test_tracks(spark):
    bodies = ['<gpx><trkpt lat="45.5" lon="6"><ele>1</ele></trkpt><trkpt lon="7" lat="46"/></gpx>', '<rtept lat="1" lon="2"></rtept>', '<trkpt lat="x" lon="2"/>', "", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", tracks.points(F.col("body")).alias("p")).collect()
    got = {r.id: r.p and [tuple(p) for p in r.p] for r in rows}
    assert got == {0: [(6.0, 45.5, None), (7.0, 46.0, None)], 1: [(2.0, 1.0, None)], 2: None, 3: None, 4: None}


def test_malformed_bodies(spark):
    bodies = ['{"cells":[[0,0,1,1]]}', '{"cells":[[0,0,1,1],[1,1,0,2]]}', '{"cells":[[0,0,1]]}', "{", None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "id int, body string").select("id", tiles.coverage(F.col("body")).alias("c"), tiles.points(F.col("body")).alias("p")).collect()
    assert [r.c is not None for r in sorted(rows)] == [True, False, False, False, False] and all(r.p is None for r in rows)


def test_items_of_a_tile_are_judged_one_by_one(spark):
    body = '{"pois":[{"category":"water","position":[6,45.5],"name":"a"},7,null,"x",[1],{"category":"water","position":["6",45]},{"category":"toilets","position":[1,2,3]},{"category":"bench","position":[1,2]},{"category":"viewpoint","position":[1e0,-2],"seasonal":"true","name":""}]}'
    (row,) = spark.createDataFrame([(body,)], "body string").select(tiles.points(F.col("body")).alias("p")).collect()
    assert [tuple(p) for p in row.p] == [("water", 6.0, 45.5, False, "a"), ("viewpoint", 1.0, -2.0, False, None)]


def test_laps_of_nearly_equal_scores_are_those_of_sql(spark):
    """Weight, gap and scale are multiplied and divided in the order of the SQL, or these would go the other way."""
    rows = [(1, 25, 8.0, 20.0, 0.2, 3), (2, 30, 10.8, 30.0, 0.5, 4), (3, 27, 16.2, 50.0, 0.2, 2), (4, 30, 22.4, 20.0, 1.0, 2), (5, 15, 11.2, 20.0, 0.4, 1)]
    loops = [(i, km, gain, float(target), target * 8.0, "unpaved", unpaved, 0.0, False) for i, target, km, gain, unpaved, _ in rows]
    df = spark.createDataFrame(loops, "loop int, km double, gain double, target_km double, target_gain double, surface string, unpaved double, retrace double, direct boolean")
    assert {r.loop: r.laps for r in ranking.best_laps(df).collect()} == {r[0]: r[5] for r in rows}
