import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ridgeloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, d int, id string, chars string"


def _brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, role, text))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole = turns.get(base, [])[:h] + mine[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    kids = defaultdict(list)
    for key in members:
        if key:
            kids[key[:-1]].append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
        saved[key] = sum(saved[k] for k in kids[key]) + (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
    return sorted(
        (
            (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest())
            for k, m in members.items()
        ),
        key=repr,
    )


def _result(spark, rows, parts=7):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in tries.prefix_trie(df).collect()), key=repr)


def _rows(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hé", "yes", "no", ""])))
    return rows


@pytest.mark.parametrize("block", [64, 3])
def test_trie_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(tries, "BLOCK", block)
    rows = _rows(1, [*range(95, 125), *range(200, 212), 305, 306, -5, -120], 12)
    rows += [(310 + k, t, "user", "same") for k in range(25) for t in range(4)]  # copies
    rows += [(350 + k, t, "user", f"long {t % 9}" if t < 150 + k else f"end {k}") for k in range(3) for t in range(160)]
    rows += [(400, None, None, None), (400, None, "user", "late"), (400, 0, "user", "x"), (400, 0, "bot", "x"), (400, 0, "bot", "x"), (None, 0, "user", "x"), (None, None, None, None)]
    rows += [(501, 0, "user", "a"), (502, 0, "user", "a")]  # base 500 is absent: turnless where h > 0
    assert _result(spark, rows) == _brute(rows)


def test_one_conversation_over_many_ranges(spark):
    rows = [(700, t, "user", str(t % 5)) for t in range(700)] + [(701, t, "user", str(t % 5)) for t in range(300)] + _rows(3, range(702, 712), 5)
    assert _result(spark, rows, 20) == _brute(rows)


def test_empty_and_turnless_tables(spark):
    assert _result(spark, []) == []
    assert _result(spark, [(None, 1, "user", "x")]) == []
    only = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert _result(spark, [(only, 0, "user", "x")]) == [(only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest())]


def test_running_values_over_stretches_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(tries, "BLOCK", 2)
    monkeypatch.setattr(tries, "STRETCH", 3)
    rows = [(800 + k, t, "user", f"{t}" if t < 40 else f"{t} {k}") for k in range(3) for t in range(45)]
    assert _result(spark, rows) == _brute(rows)
