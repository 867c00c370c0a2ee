"""Climbs by blocks against one fold, and request windows on a stream."""

import random

from pyspark.sql import functions as F

from ridgeloom.operators import folds
from ridgeloom.streaming import windows


def plain(heights, band=2.0):
    up = down = 0.0
    ref, out = heights[0], []
    for z in heights:
        if abs(z - ref) >= band:
            up, down, ref = up + max(0.0, z - ref), down + max(0.0, ref - z), z
        out.append((round(up, 6), round(down, 6)))
    return out


def test_blocks_count_what_one_fold_counts(spark):
    rng = random.Random(13)
    routes = {r: [round(100 + rng.gauss(0, s), 1) for _ in range(n)] for r, (n, s) in enumerate([(1, 1), (2, 3), (300, 0.5), (300, 1.2), (300, 5), (50, 0.1)])}
    walk, z = [], 50.0
    for _ in range(3000):  # most of all points are one route
        z = round(z + rng.choice([-0.6, -0.1, 0.0, 0.1, 0.6]), 1)
        walk.append(z)
    routes[9] = walk
    rows = [(r, k, z) for r, v in routes.items() for k, z in enumerate(v)]
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (9, None, 1.0), (9, 99999, None)], "route int, pos int, z double").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.route, r.pos): (round(r.up, 6), round(r.down, 6)) for r in folds.climbs(df).collect()}
        totals = {r.route: (round(r.up, 6), round(r.down, 6)) for r in folds.totals(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {(r, k): x for r, v in routes.items() for k, x in enumerate(plain(v))}
    assert totals == {r: (plain(v)[-1][0], plain(v[::-1])[-1][0]) for r, v in routes.items()}
    assert folds.climbs(df.limit(0)).collect() == []


def test_pieces_cover_every_state_once():
    rng = random.Random(3)
    for _ in range(200):
        z = [round(10 + rng.gauss(0, 1), 1) for _ in range(rng.randint(1, 12))]
        found = folds.pieces(folds.np.array(z), 2.0)
        for state in [x / 20 for x in range(0, 400)]:
            want = next((k for k, h in enumerate(z) if abs(h - state) >= 2.0 - 1e-12), None)
            got = [k for low, high, k in found if low <= state <= high]
            assert (not got and want is None) or want in got or abs(min(abs(abs(h - state) - 2.0) for h in z)) < 1e-9


def test_a_stream_of_files_counts_what_the_table_counts(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"2026-01-01 {h:02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}", rng.randrange(5)) for h in range(6) for _ in range(40)]
    df = spark.createDataFrame(rows, "at string, user_id int").select(F.to_timestamp("at").alias("ts"), "user_id")
    whole = {(r.start, r.user_id): r.n for r in windows.window_counts(df, "user_id").collect()}
    source, late = tmp_path / "in", spark.createDataFrame([("2026-01-01 00:00:30", 1)], "at string, user_id int").select(F.to_timestamp("at").alias("ts"), "user_id")
    for h in range(6):  # a file for each hour, and a row that comes hours late at the end
        df.where(F.hour("ts") == h).coalesce(1).write.mode("append").parquet(str(source))
        if h == 5:
            late.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(df.schema).parquet(str(source))
        counted = windows.window_counts(stream, "user_id").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        counted.awaitTermination(120)
    got = {(r.start, r.user_id): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    closed = {k: n for k, n in whole.items() if k in got}
    assert got == closed and len(got) > len(whole) / 2 and max(k[0] for k in got) < max(k[0] for k in whole)  # windows that may still grow are not out
