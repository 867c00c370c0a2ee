"""Held-out accuracy, round trips and brute force for the operators that SQL cannot express."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ridgeloom.llm import leaks, quality, shards, tokenfiles

BASE = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "hello world", None), (3, "word " * 60000, 1), (4, "z" * 30000, 1)]


def odd_documents(spark, *clash):
    return spark.createDataFrame(ODD, "doc_id bigint, text string, extra int").selectExpr("*", *[f"7 as {c}" for c in clash])


def test_quality_on_held_out_rows(spark):
    from ridgeloom.llm.queries import QUERIES

    base = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{base}/labels.parquet").collect()}
    rows = QUERIES["op2_quality_ranking"](spark, base).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    good = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in rows if r.held_out and labels.get(r.doc_id) == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97
    assert np.mean([g >= 0.3 for g in good]) > 0.97 and np.mean([b < 0.3 for b in bad]) > 0.9


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    docs = odd_documents(spark, "score", "predicted")
    assert quality.judge(docs, labels).count() == len(ODD)
    assert {r.predicted for r in quality.judge(docs, labels.limit(0)).collect()} == {1}
    assert quality.judge(docs.limit(0), labels).collect() == []


def test_bradley_terry_orders_pairs():
    rng = np.random.default_rng(1)
    better, worse = rng.normal(1, 1, (80, 3)), rng.normal(-1, 1, (50, 3))
    w = quality.bradley_terry(better, worse)
    assert ((better @ w)[:, None] > (worse @ w)[None]).mean() > 0.97


def test_all_pairs_fit_equals_plain_descent():
    """The sums by row give the weights that gradient descent over every single pair finds."""
    rng = np.random.default_rng(3)
    better, worse = rng.normal(0.4, 1, (37, 3)), rng.normal(-0.4, 1, (23, 3))
    gaps, w = (better[:, None] - worse[None]).reshape(-1, 3), np.zeros(3)
    for _ in range(4000):
        w -= 0.5 * (-gaps.T @ (1 / (1 + np.exp(gaps @ w))) / len(gaps) + quality._RIDGE * w)
    assert np.abs(quality.bradley_terry(better, worse) - w).max() < 1e-4


def test_more_labels_than_the_bound(spark):
    rng = random.Random(2)
    texts = [("!!! $$$ " if k % 2 else "plain words here. ") * rng.randrange(1, 9) for k in range(60)]
    docs = spark.createDataFrame([(k // 2 * 2 + k % 2, t) for k, t in enumerate(texts)] * 2, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(60)], "doc_id bigint, quality int")
    few, all_ = quality.fit(docs, labels, 12), quality.fit(docs, labels)
    for ranking in (few, all_):
        assert all((s >= 0.3) == (k % 2 == 0) for k, s in enumerate(ranking.score(texts)))
    assert [tuple(r) for r in quality.judge(docs, labels, 12).where("doc_id = 4").collect()] == [tuple(r) for r in quality.judge(docs, labels, 12).where("doc_id = 4").collect()]
    assert quality.kept(docs.selectExpr("*", "-5.0 as score"), all_).where("score <> -5").count() == 0


def test_fit_takes_every_label(spark):
    """The weights and the cut are those of all pairs of labelled rows, however few rows are taken at once."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["plain", "words", "here.", "!!!", "$$$", "A1", "and\nso"][k % 2 :]) for _ in range(rng.randrange(1, 30))) for k in range(150)]
    labels = {k: 1 - k % 2 for k in range(150) if k % 7}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = quality.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int"), 12)
    used = [k for k in labels if zlib.crc32(str(k).encode()) % 5]
    x, y = quality.features([texts[k] for k in used]).astype(np.float32).astype(float), np.array([labels[k] for k in used])
    p = 1 / (1 + np.exp((x[y == 1] @ got.weights)[:, None] - x[y == 0] @ got.weights))
    slope = quality._RIDGE * got.weights - ((x[y == 1].T @ p.sum(1)) - x[y == 0].T @ p.sum(0)) / p.size
    assert np.abs(slope).max() < 1e-6
    strengths = np.sort(x @ got.weights)
    assert got.cut == pytest.approx(strengths[(y == 0).sum() - 1 :][:2].mean(), abs=1e-9)


def test_strengths_by_rank(spark):
    values = [3.0, -1.5, 3.0, 3.0, 1e-9, 2e-9, 7e8, -1.5]
    z = spark.createDataFrame([(v,) for v in values], "z double")
    assert [quality.ranked(z, k) for k in range(len(values))] == sorted(values)


def test_token_files_round_trip(spark):
    docs = odd_documents(spark, "start", "n_tokens")
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.round_trip(docs, JSON, public_tokenizers.PATTERN, 2).collect())
    tokenizer, want, start = tokenfiles.load(JSON), [], 0
    for doc_id, text, _ in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenfiles.round_trip(docs.limit(0), JSON, public_tokenizers.PATTERN, 2).collect() == []


def test_added_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    mark = "<|endoftext|>"
    texts = ["a" + mark + "b", mark, None, "", "plain text, no mark", f"  two {mark}\n\n{mark} é\U0001f600 ", "<|endoftext |>", mark * 3]
    found = tokenfiles.encoder(JSON, public_tokenizers.PATTERN)(texts)
    plain = Tokenizer.from_file(JSON)
    got = [found.flat[a : a + n].tolist() for a, n in zip(found.start, found.size, strict=True)]
    assert got == [plain.encode(t or "", add_special_tokens=False).ids for t in texts] and got[0] == [64, 50256, 65]


def test_token_file_reads_only_wanted_frames(tmp_path):
    path = f"file://{tmp_path}/a.tokens.zst"
    rng, out = np.random.default_rng(2), tokenfiles.TokenFileWriter(path, 2, frame_bytes=1000)
    docs = [rng.integers(0, 50_000, n) for n in (5, 0, 3000, 700, 1)]
    for i, d in enumerate(docs):
        out.append(i, d.astype("<u2").tobytes())
    out.close()
    found = tokenfiles.TokenFile(path)
    assert (found.ids(4) == docs[4]).all() and found.frames_read == 1
    assert all((found.ids(i) == d).all() for i, d in enumerate(docs))
    import zstandard

    plain = zstandard.ZstdDecompressor().stream_reader((tmp_path / "a.tokens.zst").open("rb"), read_across_frames=True).read()
    assert plain == np.concatenate(docs).astype("<u2").tobytes()


def test_damaged_frame_is_noticed(tmp_path):
    path = f"file://{tmp_path}/b.tokens.zst"
    out = tokenfiles.TokenFileWriter(path, 2)
    out.append(1, np.arange(5000).astype("<u2").tobytes())
    out.close()
    found = tokenfiles.TokenFile(path)
    found.sums = found.sums + 1
    try:
        found.ids(0)
    except ValueError as e:
        assert "damaged" in str(e)
    else:
        raise AssertionError


def test_shards(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store")
    for k in range(5):
        store.append(spark.range(k * 100, k * 100 + 100).coalesce(1))
    assert store.versions() == [1, 2, 3, 4, 5] and store.manifest().count() == 5 and store.read(2).count() == 200
    assert store.compact() == 6 and store.manifest().count() == 1 and store.compact() == 6
    assert store.read().agg(F.count("*"), F.sum("id")).first() == (500, sum(range(500)))
    store.vacuum()
    assert store.versions() == [6] and store.read().count() == 500


def test_shards_of_odd_rows(spark, tmp_path):
    assert shards.round_trip([spark.range(0)], f"file://{tmp_path}/empty").count() == 0
    odd = odd_documents(spark, "_metadata", "run", "tier")
    back = shards.round_trip(shards.dealt(odd, 5), f"file://{tmp_path}/odd")
    assert back.columns == odd.columns and back.count() == len(ODD) and back.exceptAll(odd).count() == 0


def test_shards_are_merged_to_their_target(spark, tmp_path):
    """Many small shards become files near the target, whatever the session's scan packs together."""
    rows = spark.range(200_000).selectExpr("id", "md5(cast(id as string)) as text")
    store = shards.ShardStore(spark, f"file://{tmp_path}/target", target_bytes=2 << 20)
    for part in shards.dealt(rows, 6):
        store.append(part, shard_rows=1000)
    files = store.manifest().agg(F.sum("files")).first()[0]
    while store.compact() != store.compact():
        pass
    after = store.manifest().agg(F.sum("files"), F.sum("bytes"), F.sum("rows")).first()
    assert after[2] == 200_000 == store.read().count() and files > 150 and after[0] <= 2 * (after[1] // (2 << 20) + 1)


def test_two_writers(spark, tmp_path):
    """A commit that finds its version taken starts over on top of it; a merge of runs that are gone fails whole."""
    root = f"file://{tmp_path}/two"
    one, two = shards.ShardStore(spark, root), shards.ShardStore(spark, root)
    for k in range(4):
        one.append(spark.range(k * 10, k * 10 + 10).coalesce(1))
    added = one._written(spark.range(40, 50).coalesce(1))

    def change(now):
        if two is not None and two.versions()[-1] == 4:
            two.append(spark.range(50, 60).coalesce(1))  # takes version 5 between reading and renaming
        return now.unionByName(added)

    assert one._commit(change) == 6 and sorted(r.id for r in one.read().collect()) == list(range(60))
    old = [r.run for r in one.manifest(4).collect()]
    two.compact()
    with pytest.raises(RuntimeError):
        one._commit(lambda latest: one._replaced(latest, old, added))
    assert one.read().count() == 60


def test_leaks_and_paraphrases(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(12)]
    benchmark = spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)] + [(90, None), (91, "")], "item_id bigint, text string")
    noise = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for i, w in enumerate(items):
        rows.append((i, f"{noise(40)} {' '.join(w)} {noise(70)}"))
        changed = [x if k % 8 else word() for k, x in enumerate(w)]
        rows.append((50 + i, f"{noise(33)} {' '.join(changed).upper()}, {noise(20)}"))
        want |= {(i, i), (50 + i, i)}
    rows += [(200 + i, noise(90)) for i in range(20)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as item_id", "2 as lcs")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, benchmark).collect()} == want
    assert {r.doc_id for r in leaks.decontaminated(docs, benchmark).collect()} == {i for i, _ in rows} - {d for d, _ in want}
    assert leaks.leaks(docs, benchmark.limit(0)).collect() == []


def confirmed_by_brute_force(texts, items):
    """(text, item) of every pair that the confirmation accepts anywhere, without windows' vectors or gates."""
    cut = [leaks.words_of(t) for t in texts]
    idf = lambda w: np.log((1 + len(texts)) / (1 + sum(w in c for c in map(set, cut)))) + 0.1
    weights = {w: idf(w) for w in {w for t in items for w in leaks.words_of(t)}}
    number = {w: i for i, w in enumerate({w for c in cut for w in c} | set(weights))}
    out = set()
    for d, words in enumerate(cut):
        for i, t in enumerate(items):
            item, answer = leaks.words_of(t), set(leaks.answer_of(t))
            for at in range(0, len(words), leaks.STRIDE):
                region = words[max(0, at - len(item) - leaks.STRIDE) : at + leaks.WINDOW + len(item) + leaks.STRIDE]
                share = leaks.lcs([number[w] for w in item], [number[w] for w in region]) / len(item)
                said = sum(weights[w] for w in answer & set(region)) / sum(weights[w] for w in answer)
                if share >= 0.75 or (share >= 0.5 and said >= 0.7):
                    out.add((d, i))
    return out


def test_paraphrases_among_the_items_own_words_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(800)]
    common = [1 / (k + 3) for k in range(len(vocabulary))]
    some = lambda n: rng.choices(vocabulary, common, k=n)
    items = [[some(rng.randrange(10, 45)), some(rng.randrange(5, 12))] for _ in range(30)]
    texts, planted = [], set()
    for i, (body, answer) in enumerate(items):
        for percent in (50, 55, 60, 75):
            n = -(-percent * (len(body) + len(answer)) // 100) - len(answer)
            kept = set(rng.sample(range(len(body)), max(0, n)))
            changed = [w if k in kept else some(1)[0] for k, w in enumerate(body)]
            planted.add((len(texts), i))
            texts.append(" ".join(some(rng.randrange(150)) + changed + answer + some(rng.randrange(150))))
    texts += [" ".join(some(200)) for _ in range(40)]
    written = [f"{' '.join(body)}. {' '.join(answer)}." for body, answer in items]
    want = confirmed_by_brute_force(texts, written)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(written)), "item_id bigint, text string")
    assert planted <= want
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, benchmark).collect()} == want


def test_whole_table_matches_brute_force(spark):
    """Every region of every sf0.01 document against every item; regions with fewer than half an item's words cannot pass."""
    from ridgeloom.llm.queries import QUERIES

    base = "/root/testdata/sf0.01"
    items = {r.item_id: r.text for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()}
    docs = {r.doc_id: leaks.words_of(r.text or "") for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    holders: dict = {}
    for words in docs.values():
        for w in set(words):
            holders[w] = holders.get(w, 0) + 1
    idf = lambda w: np.log((1 + len(docs)) / (1 + holders.get(w, 0))) + 0.1
    want = set()
    for i, text in items.items():
        item, answer = leaks.words_of(text), set(leaks.answer_of(text))
        need, number, weight = 0.5 * len(item), {w: k for k, w in enumerate(dict.fromkeys(item))}, sum(map(idf, set(leaks.answer_of(text))))
        codes = [number[w] for w in item]
        for d, words in docs.items():
            held = np.cumsum([0] + [w in number for w in words])
            for at in range(0, len(words), leaks.STRIDE):
                lo, hi = max(0, at - len(item) - leaks.STRIDE), min(len(words), at + leaks.WINDOW + len(item) + leaks.STRIDE)
                if held[hi] - held[lo] < need or (d, i) in want:
                    continue
                region = [w for w in words[lo:hi] if w in number]
                share = leaks.lcs(codes, [number[w] for w in region]) / len(item)
                if share >= 0.75 or (share >= 0.5 and sum(map(idf, answer & set(region))) >= 0.7 * weight):
                    want.add((d, i))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, base).collect()} == want and len(want) > 20


def test_blocks_do_not_change_the_pairs(spark, monkeypatch):
    """Many blocks in several searches, empty and repeated rows, very long texts and items."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    items = [" ".join(word() for _ in range(rng.choice([5, 30, 400]))) + "." for _ in range(24)]
    rows = [(i, " ".join([word() for _ in range(50)] + t.split() + [word() for _ in range(50)])) for i, t in enumerate(items)]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (99, " ".join(word() for _ in range(60_000)) + " " + items[7]), (100, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    found = lambda: sorted(map(str, leaks.leaks(docs, benchmark).select("doc_id", "item_id").collect()))
    whole = found()
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 300)
    monkeypatch.setattr(leaks, "PASS_BLOCKS", 3)
    assert found() == whole and len(whole) == 27
    assert leaks.leaks(docs.limit(0), benchmark).collect() == [] and leaks.decontaminated(docs.limit(0), benchmark).collect() == []


def test_lcs():
    assert leaks.lcs([1, 2, 3, 4], [2, 9, 4, 1, 3, 4]) == 3 and leaks.lcs([1, 1, 2], [1, 2, 1]) == 2


def test_pipeline_keeps_what_it_should(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, BASE)
    before = {r.doc_id for r in spark.read.parquet(f"{BASE}/documents.parquet").collect()}
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= before and len(ids) > len(before) / 2
