import random
import re

import pytest

from ridgeloom.llm import neardup
from ridgeloom.operators.graph import labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_force(rows, n):
    sets = {i: shingles(t, n) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = top(a), top(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def corpus():
    """Chains of edited copies around the threshold, exact copies and short texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two  Words", "two words", "é É", "é é"]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            words = list(words)
            for _ in range(rng.randrange(0, 1 + len(words) // 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    texts += [" ".join(vocabulary * 60), " ".join(vocabulary * 59)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("n, sift, block", [(2, True, 256), (5, False, 2)])
def test_classes_match_brute_force(spark, n, sift, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 as kept", "'x' as rep")
    got = {r.doc_id: tuple(r)[1:] for r in neardup.classes(docs, n, sift=sift).collect()}
    assert got == brute_force(rows, n)


@pytest.mark.parametrize("block", [3])
def test_links_that_miss_the_smallest_member(spark, block, monkeypatch):
    """A bucket's members similar to each other, but not to its smallest, still get linked, in whatever blocks they lie."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = [f"a{i}" for i in range(100)]
    texts = [" ".join(base)]
    for k in range(1, 30):
        base = base[:]
        for j in range(3):
            base[(3 * k + j) % 100] = f"n{k}_{j}"
        texts.append(" ".join(base))
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: tuple(r)[1:] for r in neardup.classes(docs, 2).collect()} == brute_force(rows, 2)


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "x y z"), (5, "p q r s"), (5, "t u v w"), (7, "t u v w")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "1", False), ("None", "None", True)]


def test_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id bigint, text string"), 2).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id * 7 % 301 a", "(id + 1) * 7 % 301 b")
    assert {r.component for r in labels(edges).collect()} == {0}


def test_sketch_estimates_are_close():
    rng = random.Random(1)
    a = [str(rng.random()) for _ in range(1000)]
    h, s = neardup.shingle_sets([" ".join(a), " ".join(a[:900] + a[:1])], 1)
    sk = neardup.odd_sketches(neardup.signatures(h, s)).view("u8")
    bits = sum(int(x).bit_count() for x in sk[0] ^ sk[1])
    assert abs(bits - neardup.most_differing_bits(0.9)) < 25


def test_parity_bitmaps_never_rule_out_a_similar_pair():
    """Below PARITY_SET shingles the bound is exact; above it the hashed part keeps similar pairs, far ones go."""
    rng = random.Random(5)
    kept = far = 0
    for size in [3, 40, 300, 830, 1000, 1100, 1900, 2100, 5000] * 6:
        a = [str(rng.random()) for _ in range(size)]
        for share in (0.6, 0.84, 0.9, 1):
            b = [w if rng.random() < share else str(rng.random()) for w in a] + ["x"] * (rng.random() < 0.5)
            hashes, sizes = neardup.shingle_sets([" ".join(a), " ".join(b)], 1)
            texts, levels, words = neardup.parity_bitmaps(hashes, sizes, 80)
            maps = {(t, l): w for t, l, w in zip(texts.tolist(), levels.tolist(), words, strict=True)}
            level = max(min(l for t, l in maps if t == k) for k in (0, 1))
            both = len(set(a) & set(b))
            similar = 100 * both >= 80 * (len(set(a)) + len(set(b)) - both)
            if (0, level) not in maps or (1, level) not in maps:
                assert not similar
                continue
            bits = sum(int(x).bit_count() for x in (maps[0, level] ^ maps[1, level]).view("u8"))
            most = sum(sizes.tolist()) * 20 / 180
            allowed = bits <= most if level == 0 else bits <= most / 2**level + neardup.PARITY_SIGMAS * (most / 2**level) ** 0.5
            assert allowed or not similar
            kept += similar
            far += not allowed
    assert kept > 80 and far > 50
