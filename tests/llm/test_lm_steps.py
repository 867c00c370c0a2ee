"""What makes op13's passes cheaper leaves their results as they are."""

import collections

import numpy as np
import public_tokenizers
import pyarrow as pa

from ridgeloom.llm import lm

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Counted:
    """A tokenizer that counts its calls."""

    def __init__(self, known):
        self.known, self.calls = known, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.known.encode_ordinary(text)

    def encode_to_numpy(self, text, **more):
        self.calls += 1
        return self.known.encode_to_numpy(text, **more)


def test_words_go_to_the_library_together(monkeypatch):
    known = lm.tokenizer(PATH, PATTERN)
    lm._starts(PATH, PATTERN)
    words = [f"word{i}'s" for i in range(2000)] + ["é", "don't", "a-b", "12ab", "東京", "'s", "x" * 300, "\U0001f642", "​"]
    odd = ["a b", " ", " ", "x　", "\x1c", "a\x85"]
    for case, most in ((words, 1), (words[:3] + odd + words[3:], 1 + len(odd)), (odd, len(odd)), ([], 0)):
        counted = Counted(known)
        monkeypatch.setattr(lm, "tokenizer", lambda *_, counted=counted: counted)
        got = lm.word_ids(PATH, PATTERN)(case)
        assert [got[i].tolist() for i in range(len(case))] == [known.encode_ordinary(" " + w) for w in case]
        assert counted.calls <= most


def _model(rng):
    table = rng.normal(0, 1, (lm.KNOWN, 40)).astype(np.float32)
    x, y = rng.integers(0, 300, (5, lm.WINDOW)), rng.integers(0, 40, (5, lm.WINDOW))
    return table, x, y, rng.random(x.shape) < 0.9


def test_steps_are_those_of_plain_adam():
    table, x, y, live = _model(np.random.default_rng(2))
    mine, plain = lm.Attention(table), lm.Attention(table)
    adam, mean, square = lm.Adam(mine), 0.0, 0.0
    for t in range(1, 151):  # beyond where the factors are folded back
        k = slice(t % 4, t % 4 + 2)  # some embeddings are not seen in each step
        g = plain.gradients(x[k], y[k], live[k])
        g = np.concatenate([g[n].ravel() for n in plain.shapes]).astype(np.float64)
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        plain.load(plain.flat() - 0.003 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-6))
        adam.step(x[k], y[k], live[k], 0.003)
        mine.share(adam.flat)
    # an embedding whose gradients cancel moves by what is left of their rounding
    assert np.quantile(np.abs(mine.flat() - plain.flat()), 0.999) < 5e-3
    assert np.abs(mine.log_probs(x, y, live) - plain.log_probs(x, y, live)).max() < 0.05


def test_places_that_are_not_live_weigh_nothing():
    table, x, y, live = _model(np.random.default_rng(7))
    model = lm.Attention(table)
    once = {n: g.copy() for n, g in model.gradients(x, y, live).items()}
    again = model.gradients(x, np.where(live, y, (y + 7) % 40), live)
    assert all(np.allclose(once[n], again[n], atol=1e-7) for n in once)


def test_packed_pieces_and_words_of_many_slices(spark):
    """Packed pieces are those of the lists, and a task hands on each word once, not once for each slice."""
    text = "the hill over the river under the path " * 30_000
    docs = spark.createDataFrame([(f"{text}{i}",) for i in range(6)], "text string").coalesce(1)
    packed = lm.training_table(docs, PATH, PATTERN, packed=True).collect()
    plain = lm.training_table(docs, PATH, PATTERN).where("ids is not null").collect()
    unit = lm._unit(lm.tokenizer(PATH, PATTERN).n_vocab)
    assert collections.Counter((tuple(r.ids), r.round) for r in plain) == collections.Counter((tuple(np.frombuffer(r.ids, unit).tolist()), r.round) for r in packed if r.ids is not None)
    words = collections.Counter(r.word for r in packed if r.n is not None)
    assert words == {w: 1 for w in ["the", "hill", "over", "river", "under", "path", None, *"012345"]}
    assert {r.word: r.n for r in packed if r.n is not None}["the"] == 6 * 90_000


def test_long_words_stand_as_digests():
    words = pa.array(["é" * 33, "x" * 64, "x" * 65], pa.large_string())
    keys = lm._keys(words).to_pylist()
    assert keys[1] == "x" * 64 and [k[:1] for k in keys] == [" ", "x", " "] and {len(k) for k in (keys[0], keys[2])} == {65}
    assert lm._keys(words[1:2]).equals(words[1:2]) and len(lm._keys(words[:0])) == 0


def test_frequent_words_bring_their_subwords():
    """A task asks the library only for words that are not frequent, and for those whose key is a digest."""
    asked, encode = [], lm.word_ids(PATH, PATTERN)

    def noted(words):
        asked.extend(words)
        return encode(words)

    frequent = lm.Frequent(lm._keys(pa.array(["hill", "x" * 70, "path"], pa.large_string())).cast(pa.string()), np.array([9, 8, 7]), encode)
    for some in (["path", "new", "x" * 70, "hill", "y" * 70], ["new"], ["hill"], []):
        words = pa.array(some, pa.large_string())
        n, ids = frequent.find(words, lm._keys(words), noted)
        assert n.tolist() == [{"hill": 9, "x" * 70: 8, "path": 7}.get(w, -1) for w in some]
        assert [ids[i].tolist() for i in range(len(some))] == [encode([w]).flat.tolist() for w in some]
    assert asked == ["new", "x" * 70, "y" * 70, "new"]
    none = lm.Frequent(pa.array([], pa.string()), np.empty(0, np.int64), encode)
    assert none.find(pa.array(["a"], pa.large_string()), pa.array(["a"], pa.large_string()), encode)[0].tolist() == [-1]


def test_frequent_words_are_all_from_a_count_on(spark, monkeypatch):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 2), ("e", 2), ("f", 1)], "word string, n long")
    for most, want in ((1, "a"), (2, "a"), (3, "abc"), (4, "abc"), (5, "abcde"), (6, "abcdef"), (9, "abcdef"), (0, "")):
        monkeypatch.setattr(lm, "FREQUENT", most)
        assert sorted(lm.frequent_words(counts).column("word").to_pylist()) == [*want]


def test_subwords_of_long_words_are_counted(spark, monkeypatch):
    """What the corpus says of subwords is the same whether a word stands as itself or as a digest."""
    texts = ["the hill " + "é" * 40, "y" * 70 + " path " + "é" * 40 + " " + "snowfield" * 9, "The path"]
    words = collections.Counter(w for t in texts for w in t.lower().split())
    found, train = [], lm.Attention
    monkeypatch.setattr(lm, "train", lambda windows, known: found.append(known) or train(known.next_class))
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(2)
    assert lm.score(docs, PATH, PATTERN).count() == 3
    want = lm.subword_statistics(spark.createDataFrame(list(words.items()), "word string, n long"), 3, PATH, PATTERN)
    for name in ("rank", "klass", "member", "next_class", "next_member"):
        assert np.array_equal(getattr(found[0], name), getattr(want, name)), name
