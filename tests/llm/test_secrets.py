"""Secret scans: base spans and random spans against brute force, power of the battery, odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from ridgeloom.llm import secrets


def base_brute_force(text):
    spans = []
    words = re.compile(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    spans += [(m.start(), 0, m.end()) for m in words.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_base_secrets_match_brute_force(spark):
    rng = random.Random(4)
    bits = ["token = \"", "PassWord:'", "api_key=", "apikey : ", "ſecret=abcdefghijklmnop", "AKIA", "0123456789abcdef", "deadbeef", "é😀", " ", "\n", "ABCDEFGH12345678", "x+/_.=-", "==", "secret"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "f" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 as spans", "2 as base")
    got = {r.doc_id: r for r in secrets.find(docs).collect()}
    for i, t in enumerate(texts):
        want = base_brute_force(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert {s for s in want.split(",") if s} <= set(got[i].spans.split(","))


ALPHABETS = dict(secrets.ENCODINGS)


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def plain_chance(token):
    """The statistic's chance, symbol by symbol with plain loops."""
    token = token.rstrip("=")
    alphabet = next(a for _, a in secrets.ENCODINGS if set(token) <= set(a))
    n, k, at = len(token), len(alphabet), [alphabet.index(c) for c in token]
    seen = Counter(at)
    chi = sum((seen[i] - n / k) ** 2 / (n / k) for i in range(k))
    p_even = tail(((chi / (k - 1)) ** (1 / 3) - 1 + 2 / (9 * (k - 1))) / math.sqrt(2 / (9 * (k - 1))))
    up = [x >= k / 2 for x in at]
    a, b = up.count(True), up.count(False)
    runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
    centre = 1 + 2 * a * b / n
    p_runs = 2 * tail(abs(runs - centre) / math.sqrt(max(1e-9, (centre - 1) * (centre - 2) / (n - 1)))) if a and b else 2.0 ** (1 - n)
    mean = sum(at) / n
    square = sum((x - mean) ** 2 for x in at)
    p_serial = 2 * tail(abs(sum((x - mean) * (y - mean) for x, y in zip(at, at[1:])) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    product = max(p_even * p_runs * p_serial, 1e-300)
    log = -math.log(product)
    ratios = []
    for main, weights in zip((str.islower, str.isupper, str.isdigit), secrets.SPELLINGS):
        if any(map(main, alphabet)):
            kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
            size = lambda c: secrets.LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1.0
            total = [sum(size(c) for c in alphabet if kind(c) == i) for i in range(4)]
            live = sum(w for w, t in zip(weights, total) if t)
            ratios.append(sum(math.log(1 / k / (weights[kind(c)] * size(c) / total[kind(c)] / live)) for c in token))
    return math.exp(-max(0.0, min(700.0, min(ratios) + math.log(min(1.0, product * (1 + log + log * log / 2))))))


def spans_by_brute_force(texts, fdr=secrets.FDR):
    """All spans of each text: plain scans, and Benjamini-Hochberg on chances rounded up to the bins, by length class."""
    found = []
    for i, text in enumerate(texts):
        base = [s.split(":") for s in base_brute_force(text or "").split(",") if s]
        taken = [(int(a), int(b)) for _, a, b in base]
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}={0,2}", text or ""):
            if all(b <= m.start() or m.end() <= a for a, b in taken):
                size = m.end() - m.start()
                bin_ = math.ceil((math.log10(max(plain_chance(m.group()), 1e-30)) + 30) * 10)
                found.append((max(k for k, least in enumerate(secrets.LENGTH_CLASSES) if size >= least), 10 ** (bin_ / 10 - 30), i, m.start(), m.end()))
    spans = [[(int(a), ("assign", "access", "hex").index(k), int(b)) for k, a, b in (s.split(":") for s in base_brute_force(t or "").split(",") if s)] for t in texts]
    for k in {f[0] for f in found}:
        rows = sorted(f for f in found if f[0] == k)
        last = max((p for at, (_, p, *_) in enumerate(rows, 1) if p * len(rows) <= fdr * sum(q <= p for _, q, *_ in rows)), default=-1.0)
        for _, p, i, a, b in rows:
            if p <= last:
                spans[i].append((a, 3, b))
    return [",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s)) for s in spans]


def mixed_texts():
    rng = random.Random(12)
    some = lambda alphabet, n: "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(n))
    texts = [f"see {some(kind, n)} end" for kind in ("base32", "base36", "base64", "base64url", "mixed", "HEX", "decimal") for n in (20, 21, 32, 50, 130)]
    texts += ["internationalization" + "antidisestablishmentarianism"[i:] + "interconnectedness" for i in range(8)]
    texts += [f"token={some('base62', 30)} {some('base62', 30)} é {some('base62', 40)}== AKIA{some('BASE36', 20)}", "x" * 5000, "ab" * 600 + "/" + some("base64", 600), None, ""]
    return texts


def test_all_spans_match_brute_force(spark):
    texts = mixed_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in secrets.find(docs).collect()}
    want = spans_by_brute_force(texts)
    assert [got[i] for i in range(len(texts))] == want and sum("random" in s for s in want) > 15


@pytest.mark.parametrize("kind", ["base32", "base36", "base64"])
def test_power_at_32_symbols(spark, kind):
    rng = random.Random(9)
    rows = [(i, "see " + "".join(rng.choice(ALPHABETS[kind]) for _ in range(32)) + " end") for i in range(200)]
    rows += [(1000 + i, "internationalization" + "antidisestablishmentarianism"[i % 8 :] + "interconnectedness"[: i // 8]) for i in range(100)]
    got = {r.doc_id: r.n_random for r in secrets.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(got[i] for i in range(200)) >= 180 and not any(got[i] for i in got if i >= 1000)


def test_odd_rows(spark):
    """Empty tables, repeated rows, null ids and texts; many spans in one long text stay linear."""
    schema = "doc_id bigint, text string"
    assert secrets.find(spark.createDataFrame([], schema)).collect() == []
    secret = "a token = deadbeefdeadbeef1 b "
    rows = [(1, secret), (1, secret), (None, secret), (2, None), (3, ""), (4, (secret + "x" * 30 + " ") * 20_000)]
    got = sorted((str(r.doc_id), r.n_assign, r.n_hex, r.n_random) for r in secrets.find(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", 1, 1, 0), ("1", 1, 1, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("4", 20_000, 20_000, 0), ("None", 1, 1, 0)]


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "a token = deadbeefdeadbeef1 b", 9), (2, None, None), (3, "clean", 5)], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: (r.text, r.n_chars) for r in secrets.redacted(docs).collect()}
    assert got == {1: ("a [secret] b", 12), 2: (None, None), 3: ("clean", 5)}
