import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from ridgeloom.llm import lm
from ridgeloom.llm.shared import Ragged

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, word string, n int, row int, ids string"


def _tokens(text):
    return [*WORD.findall((text or "").translate(FOLD)), None]


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def _rows():
    rng = random.Random(8)
    words = ["the", "Café", "run", "run-1", "ÀB", "x" * 70, "é" * 40, " ", "hill", "path", "under", "over"]
    rows = [(i, rng.choice(["\n", " ", "\t"]).join(rng.choice(words[:4] + words[rng.randrange(12) :]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " \n "), (None, "the hill alone"), (None, None), (7, "the same id"), (7, "the same id"), (103, "new" + "q" * 90), (104, "word " * 3000)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, 2, "z") for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("frequent", [1 << 17, 3])
def test_base_scores_and_counts_equal_plain_loops(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = _rows()
    c = collections.Counter(w for i, t in rows if not _held(i) for w in _tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(_tokens(t)), _held(i), sum(c[w] > 0 for w in _tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in _tokens(t)), 6)) for i, t in rows)
    got = lm.score(_frame(spark, rows), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    same = {r.score for r in got if r.doc_id == 7 and r.n_tokens == 4}
    assert len(same) == 1  # equal texts have equal scores


def test_tables_without_training_documents(spark):
    assert lm.score(_frame(spark, [(1, "x")]).limit(0), PATH, PATTERN).collect() == []
    only = next(i for i in range(99) if _held(i))
    (row,) = lm.score(_frame(spark, [(only, "a b")]), PATH, PATTERN).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0) and row.base_score == pytest.approx(0.0) and math.isfinite(row.score)


@pytest.fixture(scope="module")
def fitted():
    encode, end = lm.word_ids(PATH, PATTERN), lm.tokenizer(PATH, PATTERN).n_vocab
    rng = np.random.default_rng(3)
    words = ["walking", "mountains", "the", "rivers", "snowfield", "glacier", "over", "unbelievable"]
    ids = encode(words)
    n = rng.integers(1, 50, len(words)).astype(float)
    single = np.bincount(ids.flat, np.repeat(n, ids.size), end + 1)
    known = lm.Subwords(single, lm._starts(PATH, PATTERN))
    a, b = known.pair_cells()
    known.with_pairs(rng.integers(0, 3, a).astype(float), rng.integers(0, 9, lm.KNOWN).astype(float), rng.integers(0, 3, b).astype(float), rng.integers(1, 9, known.classes).astype(float))
    return known, lm.Attention(known.next_class), encode(words), end


def test_probabilities_sum_to_one(fitted):
    known, model, ids, end = fitted
    before = np.concatenate([[end], ids.flat[: lm.WINDOW - 1]])
    x = np.zeros((1, lm.WINDOW), np.int64)
    x[0, : len(before)] = known.input[before]
    wanted = np.zeros(x.shape, bool)
    wanted[0, len(before) - 1] = True
    by_class = np.array([model.log_probs(x, np.full(x.shape, k), wanted)[0] for k in range(known.classes)])
    every = np.arange(end + 1)
    whole = by_class[known.klass] + known.members(np.full(end + 1, before[-1]), every)
    assert np.exp(by_class).sum() == pytest.approx(1, abs=1e-4) and np.exp(whole).sum() == pytest.approx(1, abs=1e-3)


def test_scores_equal_plain_attention_over_overlapping_windows(fitted):
    known, model, ids, end = fitted
    p = {n: v.astype(np.float64) for n, v in model.p.items()}
    rng = np.random.default_rng(9)
    texts = [rng.choice(ids.flat, n) for n in (0, 1, lm.WINDOW - 1, lm.WINDOW, 3 * lm.STRIDE + 7)]
    seqs = Ragged(np.concatenate(texts).astype(np.int64), np.array([*map(len, texts)]))
    got = lm.text_scores(seqs, model, known, end)
    for text, score in zip(texts, got, strict=True):
        inputs, targets, total = [end, *text.tolist()], [*text.tolist(), end], 0.0
        for t, target in enumerate(targets):
            k = max(0, -(-(t - lm.WINDOW + 1) // lm.STRIDE))  # the first window that holds the place
            low = k * lm.STRIDE
            h = np.array([p["embed"][known.input[i]] + p["place"][j] for j, i in enumerate(inputs[low : t + 1])])
            weights = (h @ p["key"]) @ (h[-1] @ p["query"]) / lm.WIDTH**0.5
            share = np.exp(weights - weights.max())
            o = h[-1] + share @ (h @ p["value"]) / share.sum()
            z = np.maximum(o @ p["inner"], 0) @ p["outer"] + p["bias"] + known.next_class[known.input[inputs[t]]]
            total += z[known.klass[target]] - z.max() - math.log(np.exp(z - z.max()).sum()) + known.members(np.array([inputs[t]]), np.array([target]))[0]
        assert score == pytest.approx(total / math.log(10), rel=1e-4)


def test_gradients_equal_differences_and_large_logits_stay_finite(fitted):
    known, _, ids, _ = fitted
    model = lm.Attention(known.next_class)
    rng = np.random.default_rng(4)
    x, y = known.input[rng.choice(ids.flat, (6, lm.WINDOW))], rng.integers(0, known.classes, (6, lm.WINDOW))
    live = rng.random(x.shape) < 0.8
    model.p["outer"] = rng.normal(0, 0.3, model.p["outer"].shape).astype(np.float32)
    g = model.gradients(x, y, live)
    for name, grad in g.items():
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        values = []
        for step in (0.01, -0.01):
            model.p[name][at] += step
            values.append(-model.log_probs(x, y, live).astype(np.float64).mean())
            model.p[name][at] -= step
        assert (values[0] - values[1]) / 0.02 == pytest.approx(grad[at], rel=0.05, abs=2e-4), name
    model.p["outer"] *= 2000
    model.p["query"] *= 2000
    assert np.isfinite(model.log_probs(x, y, live)).all()


def test_training_helps_on_held_out_texts(spark):
    """Texts of two vocabularies that never mix: only the context tells which words come next."""
    rng = random.Random(5)
    kinds = [["river", "stone", "meadow", "valley", "forest", "lake"], ["engine", "piston", "wheel", "brake", "gear", "motor"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(120))) for i in range(600)]
    df = _frame(spark, rows)
    trained = lm.score(df, PATH, PATTERN).where("held_out").selectExpr("sum(score) / sum(n_tokens) as s").first().s
    assert trained > math.log10(1 / 12)  # better than any model that does not look back


def test_training_sees_every_subword_once(spark):
    """The pieces of all rounds hold every word of every training text and its end, each once and behind its own context."""
    rows = [(i, t) for i, t in _rows() if not _held(i)]
    learnt = lm.training_table(_frame(spark, rows), PATH, PATTERN).where("ids is not null").collect()
    encode, end = lm.tokenizer(PATH, PATTERN).encode_ordinary, lm.tokenizer(PATH, PATTERN).n_vocab
    want = collections.Counter()
    for _, t in rows:
        ids = [end, *(x for w in _tokens(t)[:-1] for x in encode(" " + w)), end]
        want.update(zip(ids, ids[1:]))
    assert collections.Counter(p for r in learnt for p in zip(r.ids, r.ids[1:])) == want
    assert {r.round for r in learnt} == set(range(lm.ROUNDS))
