import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ridgeloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def brute_force(library, text):
    ids = library.encode_ordinary(text or "")
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256((text or "").encode()).hexdigest(),
    )


def test_random_texts_match_the_library(library):
    rng = random.Random(5)
    alphabet = "aab 'stz  \n\n\té中文1239٣!?-_  \x1c\x85 \r\U0001f600ſ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "\n", " a", "a ", "a" * 3000, "ab" * 4000, "the" * 900, "x\n\n y", "<|endoftext|> hi", "it's we'll"]
    found = bpe.load(PATH, public_tokenizers.PATTERN).encode(texts)
    assert [found[i].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_long_matches_equal_the_library(library):
    """Matches of hundreds to many thousands of bytes, of random letters, repeats and overlapping pairs."""
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (255, 256, 257, 700, 5000, 40_000) for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "eéтhи中", "!?-=")]
    found = bpe.load(PATH, public_tokenizers.PATTERN).encode(texts)
    assert [found[i].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_other_patterns_and_high_ids():
    """Another pattern cuts whole texts by itself; ids may lie above 2**17; a vocabulary out of order merges one by one."""
    rng = random.Random(4)
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 200_000, b"abc": 300_000, b"cd": 150_000, b"12": 400_000, b"  ": 500_000}
    for extra in ({}, {b"abcd": 260, b"abab": 270}):
        pattern = r"\p{N}{1,3}|\s+|[^\s\p{N}]+"
        own = bpe.ByteBpe(ranks | extra, pattern)
        plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks | extra, special_tokens={})
        texts = ["".join(rng.choice("abcd12 \n") for _ in range(rng.randrange(80))) for _ in range(300)] + ["abcd" * 300 + "ab" * 300, "12 " * 300]
        found = own.encode(texts)
        assert [found[i].tolist() for i in range(len(texts))] == [plain.encode_ordinary(t) for t in texts]


def test_edge_rows(spark, library):
    """Nulls, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, None, 5), (2, "", 5), (2, "", 5), (None, "hello world", None), (3, "word " * 60000, 1), (4, "z" * 30000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    want = [(i, *brute_force(library, t)) for i, t, _ in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect() == []


def test_ids_on_request(spark, library):
    docs = spark.createDataFrame([(1, "Hello, wörld!\n")], "doc_id bigint, text string")
    row = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN, with_ids=True).first()
    assert row.ids == library.encode_ordinary("Hello, wörld!\n")


def test_query_on_the_whole_table(spark, library):
    from ridgeloom.llm.queries import QUERIES

    base = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = QUERIES["op1_byte_bpe"](spark, base).collect()
    assert len(got) == len(texts)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute_force(library, texts[r.doc_id]) for r in got)
