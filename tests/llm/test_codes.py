import hashlib
import math

import numpy as np

from ridgeloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, id int, x string, code string"


def _brute(rows, parts=16, entries=64, rounds=2):
    """Lloyd with full sums, in plain loops; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v], label) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    starts = sorted((i, x) for i, x, _ in kept if i is not None)[:entries]
    books = [[x[p * width : (p + 1) * width] for _, x in starts] for p in range(parts)]

    def assign():
        out = []
        for _, x, _ in kept:
            gaps = [[sum((a - b) ** 2 for a, b in zip(x[p * width : (p + 1) * width], e, strict=True)) for e in books[p]] for p in range(parts)]
            out.append([(g.index(min(g)), min(g)) for g in gaps])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p * width : (p + 1) * width] for (_, x, _), a in zip(kept, found, strict=True) if a[p][0] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = assign()
    errors = [sum(g for _, g in a) for a in found]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted(
        ((i, "".join(f"{e:02x}" for e, _ in a), err, sum(e for (_, _, k), e in zip(kept, errors, strict=True) if k == label), digest) for (i, _, label), a, err in zip(kept, found, errors, strict=True)),
        key=repr,
    )


def _result(df):
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect()), key=repr)


def _vectors(n, dim, seed):
    return np.random.default_rng(seed).normal(0, 0.3, (n, dim)).astype(np.float32).tolist()


def test_codes_equal_full_lloyd_rounds_with_odd_rows(spark):
    vectors = _vectors(150, 32, 5)
    rows = [(i, v, None if i % 5 == 0 else i % 3) for i, v in enumerate(vectors)]
    rows += [(7, vectors[7], 1), (7, vectors[8], 1), (None, vectors[9], 2), (900, None, 1), (901, [], 1), (902, [0.1] * 31, 1), (903, [0.1] * 48, 1)]
    rows += [(904, [math.nan] + [0.0] * 31, 1), (905, [math.inf] + [0.0] * 31, 1), (906, [None] + [0.0] * 31, 1)]
    rows += [(1000 + i, vectors[3], 1) for i in range(60)]  # one vector very often
    df = spark.createDataFrame([(i, v, k, 1, "x", "c") for i, v, k in rows], SCHEMA).repartition(5)
    fit = [(i, v, k) for i, v, k in rows if v is None or len(v) == 32]
    assert _result(codes.digests(df)) == _brute(fit)


def test_few_vectors_ties_and_empty_tables(spark):
    few = [(i, [0.5, -0.5] * 16, None) for i in range(5)]
    df = spark.createDataFrame([(i, v, k, 1, "x", "c") for i, v, k in few], SCHEMA)
    got = _result(codes.digests(df))
    assert got == _brute(few) and {r[1] for r in got} == {"00" * 16}
    assert codes.digests(df.limit(0)).collect() == []
    assert codes.digests(df.withColumn("embedding", df.embedding.getItem(0)).selectExpr("vec_id", "array(cast(null as float)) as embedding", "label")).collect() == []


def test_whole_numbers_too_large_for_floats_stay_exact():
    x = np.array([[[1 << 26, 3], [5, 5]], [[(1 << 26) + 1, 3], [0, 0]]], np.int64)
    books = np.array([[[1 << 26, 2], [(1 << 26) + 1, 3]], [[4, 5], [6, 5]]], np.int64)
    code, gap = codes._nearest(x, books)
    assert code.tolist() == [[0, 0], [1, 0]] and gap.tolist() == [[1, 1], [0, 41]]


def test_changes_hold_only_parts_that_moved(spark):
    rows = spark.createDataFrame(
        [([1, 2, 3, 4], [0, 1], [0, 0]), ([5, 6, 7, 8], [1, 1], [1, 1]), ([9, 9, 9, 9], [1, 0], [-1, -1])],
        "x array<bigint>, code array<smallint>, before array<smallint>",
    ).coalesce(1)
    got = sorted(tuple(r) for r in codes.changes(rows, 2, 2, 2).collect())
    want = [(0, 1, 0, 9), (0, 1, 1, 9), (0, 1, 2, 1), (1, 0, 0, 6), (1, 0, 1, 5), (1, 1, 0, 3), (1, 1, 1, 4), (1, 1, 2, 1)]
    assert got == want  # part 1 entry 0: minus (3, 4), plus (9, 9), one out and one in
