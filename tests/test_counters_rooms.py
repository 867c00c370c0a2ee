"""Random numbers by counter, components under masks."""

import random

from pyspark.sql import functions as F

from ridgeloom.functions import counters
from ridgeloom.operators import rooms

FULL = (1 << 64) - 1


def plain(seed, stream, count):
    """The numbers in a row, on whole numbers."""
    state, out = (seed * counters.STEP ^ stream * counters.STREAM ^ counters.MASK) & FULL, []
    for _ in range(count):
        state = (state + counters.STEP) & FULL
        z = state
        for shift, factor in counters.MIXES:
            z = (z ^ z >> shift) * factor & FULL
        out.append(z ^ z >> 31)
    return out


def test_numbers_are_bit_equal_to_whole_number_arithmetic(spark):
    seeds = [(0, 0), (1, 0), (-1, 5), (2**62, -7), (123456789, 42)]
    df = spark.createDataFrame(seeds, "seed long, stream long").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(20_000).cast("long"))))
    z = counters.drawn(F.col("seed"), F.col("stream"), F.col("k"))
    rows = df.select("seed", "stream", "k", z.alias("z")).select("*", counters.unit(F.col("z")).alias("u"), counters.below(F.col("z"), 12).alias("b")).collect()
    want = {(s, t): plain(s, t, 20_000) for s, t in seeds}
    assert len(rows) == 100_000
    for r in rows:
        n = want[r.seed, r.stream][r.k - 1]
        assert (r.z & FULL, r.u, r.b) == (n, (n >> 11) / 2**53, n % 12)


def sizes(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    groups = {}
    for n in list(top):
        groups.setdefault(find(n), set()).add(n)
    return {n: (g, len(v)) for g, v in groups.items() for n in v}


def test_rooms_and_small_components_by_mask(spark, monkeypatch):
    monkeypatch.setattr(rooms, "ROOM", 6)
    rng = random.Random(2)
    edges = [(rng.randrange(120), rng.randrange(120), rng.randint(0, 3), rng.randint(0, 3)) for _ in range(150)] + [(200, 200, 1, 0), (201, 202, 1, 1)]
    df = spark.createDataFrame([*edges, (None, 3, 1, 0)], "a int, b int, modes int, flags int")
    masks = [(7, 1, 1), (8, 2, 2), (9, 1, 0)]
    got = {(r.mask, r.node): r.room for r in rooms.has_room(df, spark.createDataFrame(masks, "mask int, mode int, skip int")).collect()}
    want = {}
    for mask, mode, skip in masks:
        open_edges = [(a, b) for a, b, m, f in edges if m & mode and not f & skip]
        strict, whole = sizes(open_edges), sizes([(a, b) for a, b, m, _ in edges if m & mode])
        want |= {(mask, n): strict[n][1] >= 6 or whole[n][1] < 6 for e in open_edges for n in e}
    assert got == want
    small = {(r.mode, r.node): r.size for r in rooms.small_nodes(df, spark.createDataFrame([(1,), (2,)], "mode int"), 10).collect()}
    plain_small = {(m, n): s for m in (1, 2) for n, (_, s) in sizes([(a, b) for a, b, k, _ in edges if k & m and a != b]).items() if s < 10}
    assert small == plain_small
