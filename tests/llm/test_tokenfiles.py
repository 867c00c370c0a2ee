import random

import numpy as np
import public_tokenizers

from ridgeloom.llm import tokenfiles
from ridgeloom.llm.shared import Ragged, Remembered

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


class Counted:
    """The library's tokenizer, counting the texts that it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, 0

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.texts += len(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _texts():
    rng = random.Random(4)
    odd = ["it's", "don''t", "x9y", "é́", "日本語", "٣٤", " ", "a b", "a ", "　b", "\x1c", "\x1db", "a\x85", "​", "🙂🙂", "...", "'", "\t", "\n", "\r\n", "<|endoftext|>", "<|endoftext", "|>", "\0", "ǅ", "Ⅷ", "½"]
    words = odd + ["under", "over", "Hill", "path", "snowfield"]
    return [rng.choice([" ", "\n", " ", "  "]).join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "\n", " a", "a ", "a  b", "w" * 5000]


def test_ids_of_odd_texts_equal_those_of_whole_texts():
    library, encode = tokenfiles.load(PATH), tokenfiles.encoder(PATH, PATTERN)
    for part in (_texts(), _texts()[::-1]):  # units that are new, and units seen before
        found = encode(part)
        assert [found[i].tolist() for i in range(len(part))] == [library.encode(t, add_special_tokens=False).ids for t in part]


def test_new_units_go_to_the_library_together_and_seen_ones_not_at_all(monkeypatch):
    counted = Counted(tokenfiles.load(PATH, special_as_text=True))
    monkeypatch.setattr(tokenfiles, "load", lambda path, special_as_text=False: counted)
    encode = tokenfiles.encoder.__wrapped__(PATH, PATTERN)
    text = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(500))
    encode([text])
    assert counted.texts <= 4  # before: one text for each of 500 matches
    encode([text])
    assert counted.texts <= 4


def test_units_go_alone_where_bytes_do_not_agree(monkeypatch):
    class Off(Counted):
        def get_vocab(self):
            return {token + "x": i for token, i in self.tokenizer.get_vocab().items()}

    library = tokenfiles.load(PATH)
    monkeypatch.setattr(tokenfiles, "load", lambda path, special_as_text=False: Off(library))
    found = tokenfiles.encoder.__wrapped__(PATH, PATTERN)(["under the hill", "over it"])
    assert [found[i].tolist() for i in range(2)] == [library.encode(t, add_special_tokens=False).ids for t in ("under the hill", "over it")]


def test_a_full_memory_keeps_what_is_asked_for_most():
    asked = []

    def encode(parts):
        asked.extend(parts)
        return Ragged(np.array([int(p) for p in parts], np.uint32), np.ones(len(parts), np.int64))

    known = Remembered(encode, 8)
    for k in range(40):
        parts = ["1", "2", str(100 + k), "2"]
        assert known(parts).flat.tolist() == [1, 2, 100 + k, 2] and len(known.place) <= 8
    assert asked.count("1") == asked.count("2") == 1  # before: once each time the memory was emptied
    assert Remembered(encode, 1)(["5", "6", "5"]).flat.tolist() == [5, 6, 5]
