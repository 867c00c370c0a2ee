"""Scores of texts by a word unigram and by a causal self-attention model on subword ids, both learnt from training documents.

1. One pass over the training texts counts every word and cuts the subwords of each whole text, its end included, into
   pieces. Each piece is dealt to one round, so that gradients see every subword of all training documents once.
2. From the table of word counts come the counts of subwords, and then of pairs of subwords: of a subword's successor within
   words, and of first subwords after a word's last. Subwords are dealt into CLASSES classes, those that start a word apart
   from others. The pairs give log p(class | subword before) and log p(subword | class, class before), smoothed.
3. The model adds to the first of these what causal self-attention over the window says: embeddings of subwords and places,
   one head, a residual, a rectified layer. It is trained in numpy: in each of ROUNDS rounds every task runs Adam over its
   windows of that round's pieces from the same parameters, and the next round starts from the mean of theirs by windows
   (a sum for each parameter; there are some 70,000 whatever the corpus).
4. One pass over all texts scores them. A text is cut into windows of WINDOW subwords that overlap, and each subword is
   scored once, in the window where it has the most before it. The same pass adds up the unigram score of the FREQUENT most
   frequent words; a document's other words go, counted by document, to a join with the table of counts. A word beyond
   those holds less than 1 / FREQUENT of the training tokens, so that no key of that join is hot.

The driver holds parameters, classes, pair tables and the frequent words: all of sizes set by the constants below.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import CUT_PATTERN, Ragged, Remembered, drop_staged, map_texts, slices, staged, texts_of, word_codes

#: Rounds of training, by their step sizes.
STEPS = (0.01, 0.006, 0.003)
ROUNDS = len(STEPS)
#: Subwords of a window, those between the starts of windows, windows of a training batch.
WINDOW, STRIDE, BATCH = 32, 26, 32
#: Windows that are scored at once: their rows of classes should stay in a core's cache.
SCORED = 64
#: Subwords of a piece of training at most, and the fewest windows that a task should take in a round.
PIECE, TASK_WINDOWS = 8 * WINDOW, 8192
#: Subwords with an embedding of their own (rarer ones share one), classes at most, sizes of the layers.
KNOWN, CLASSES, WIDTH, HIDDEN = 4096, 128, 16, 32
#: Weights of what a smoothed distribution falls back on.
CLASS_PRIOR, MEMBER_PRIOR = 20.0, 10.0
#: Words that every task counts for itself; longer ones than LONGEST bytes go by a digest.
FREQUENT, LONGEST = 1 << 18, 64
#: Counts of words of slices that a task puts together before it hands them on, and words that it encodes at a time.
COUNTED, ENCODED = 1 << 20, 1 << 16


#: White space that may stand within a word.
_BLANK = re.compile(r"\s")


@cache
def tokenizer(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def word_ids(path: str, pattern: str, limit: int = 1 << 19) -> Callable[[list[str]], Ragged]:
    """An encoder of words, each with a space in front. Where a space starts a match whatever stands before it, words without
    other white space go to the library in one text: ids that begin with a space are then the first of each word, and to
    remember them would cost more. Others go one by one, and are remembered."""
    known, starts = tokenizer(path, pattern), _starts(path, pattern)

    def one_by_one(words: list[str]) -> Ragged:
        ids = [known.encode_ordinary(" " + w) for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return Ragged(np.fromiter((i for x in ids for i in x), np.int64, int(size.sum())), size)

    each = Remembered(one_by_one, limit)

    def together(words: list[str]) -> Ragged:
        ids = known.encode_to_numpy(" " + " ".join(words), disallowed_special=()).astype(np.int64)
        return Ragged(ids, np.diff(np.flatnonzero(starts[ids]), append=len(ids)))

    def encode(words: list[str]) -> Ragged:
        if pattern != CUT_PATTERN or not words:
            return each(words)
        if not _BLANK.search("".join(words)):
            return together(words)
        odd = np.fromiter((_BLANK.search(w) is not None for w in words), bool, len(words))
        even = [w for w, o in zip(words, odd, strict=True) if not o]
        parts = [each([w for w, o in zip(words, odd, strict=True) if o]), *([together(even)] if even else [])]
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(odd), np.flatnonzero(~odd)])] = np.arange(len(words))
        return Ragged(np.concatenate([p.flat for p in parts]), np.concatenate([p.size for p in parts])).take(place)

    return encode


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def _keys(words: pa.Array) -> pa.Array:
    """The words, but a digest, with a space in front (no word has one), for each long one."""
    long = pc.greater(pc.binary_length(words), LONGEST)
    if not pc.any(long).as_py():
        return words
    digests = [" " + hashlib.sha256(w.encode()).hexdigest() for w in _strings(words.filter(long))]
    return pc.replace_with_mask(words, long, pa.array(digests, words.type))


class Frequent:
    """The most frequent words, by their keys: how often each occurs, and its subwords unless its key is a digest."""

    def __init__(self, keys: pa.Array, n: np.ndarray, encode: Callable[[list[str]], Ragged]):
        names = _strings(keys)
        self.at, self.n = dict(zip(names, range(len(names)), strict=True)), n
        self.told = np.fromiter((w[:1] != " " for w in names), bool, len(names))
        self.ids = encode([w for w, t in zip(names, self.told.tolist(), strict=True) if t])
        self.place = np.cumsum(self.told) - 1

    def find(self, words: pa.Array, keys: pa.Array, encode: Callable[[list[str]], Ragged]) -> tuple[np.ndarray, Ragged]:
        """How often each word occurs, -1 where it is none of these, and the subwords of all words."""
        at = np.fromiter(map(self.at.get, _strings(keys), itertools.repeat(-1)), np.int64, len(keys))
        n, seen = np.full(len(at), -1, np.int64), at >= 0
        n[seen] = self.n[at[seen]]
        told = seen.copy()
        told[seen] = self.told[at[seen]]
        others = encode(_strings(words.filter(pa.array(~told))))
        order = np.empty(len(at), np.int64)
        order[told] = self.place[at[told]]
        order[~told] = len(self.ids.size) + np.arange(len(others.size))
        return n, Ragged(np.concatenate([self.ids.flat, others.flat]), np.concatenate([self.ids.size, others.size])).take(order)


def held(doc_id, modulus: int = 5, out: int = 1):
    """Whether a document is held out of training; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == out, F.lit(False))


def pieces(ids: Ragged, sums: np.ndarray, end: int) -> tuple[Ragged, np.ndarray]:
    """(pieces, the round of each) of texts of subwords, by a checksum of each text. A piece begins with the subword before
    it, as context; all behind their first, joined, are the text and its end."""
    n = ids.size + 1
    whole = np.full(int((n + 1).sum()), end, np.int64)  # an end, the text, an end
    start = np.cumsum(n + 1) - n - 1
    whole[np.repeat(start + 1 - ids.start, ids.size) + np.arange(len(ids.flat))] = ids.flat
    many = -(-n // PIECE)
    owner = np.repeat(np.arange(len(n)), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    size = np.minimum(PIECE, n[owner] - number * PIECE) + 1
    at = np.repeat(start[owner] + number * PIECE - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return Ragged(whole[at], size), (sums[owner] + number) % ROUNDS


def _unit(end: int) -> str:
    """The type of an id in packed pieces."""
    return "<u2" if end < 1 << 16 else "<u4"


def training_table(docs: DataFrame, path: str, pattern: str, text_col: str = "text", packed: bool = False) -> DataFrame:
    """Rows of (word, n) of training texts, word null for their ends, rows of (ids, round): all their pieces, and rows of
    (long, n): the subwords of words that stand as digests, which tell no subwords. With ``packed`` ids are bytes, one value
    to write and read."""
    end = tokenizer(path, pattern).n_vocab
    ids_type, unit = (pa.binary() if packed else pa.list_(pa.int32())), _unit(end)

    def batch_of(words: pa.Array, n: pa.Array, ids: pa.Array, rounds: pa.Array, long: pa.Array | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words, n, ids, rounds, pa.nulls(len(n), ids_type) if long is None else long], ["word", "n", "ids", "round", "long"])

    def column_of(cut: Ragged) -> pa.Array:
        if not packed:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cut.size)).astype(np.int32)), pa.array(cut.flat.astype(np.int32)))
        flat, start = cut.flat.astype(unit).tobytes(), int(unit[2])
        return pa.array([flat[a * start : (a + k) * start] for a, k in zip(cut.start.tolist(), cut.size.tolist(), strict=True)], ids_type)

    def counted(counts: list[pa.RecordBatch], ends: int) -> Iterator[pa.RecordBatch]:
        for b in pa.Table.from_batches(counts).group_by("word", use_threads=False).aggregate([("n", "sum")]).combine_chunks().to_batches():
            yield batch_of(b.column("word"), b.column("n_sum"), pa.nulls(b.num_rows, ids_type), pa.nulls(b.num_rows, pa.int32()))
        yield batch_of(pa.nulls(1, pa.string()), pa.array([ends]), pa.nulls(1, ids_type), pa.nulls(1, pa.int32()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path, pattern)
        counts, rows, ends = [], 0, 0
        for batch in slices(batches, text_col):
            texts = texts_of(batch, text_col)
            codes, owner, words = word_codes(texts, fold=True)
            times = np.bincount(codes, minlength=len(words))
            counts.append(pa.RecordBatch.from_arrays([_keys(words).cast(pa.string()), pa.array(times)], ["word", "n"]))
            rows, ends = rows + len(words), ends + len(texts)
            sums = np.fromiter((zlib.crc32(t.encode()) for t in texts), np.int64, len(texts))
            subwords = encode(_strings(words))
            cut, rounds = pieces(subwords.take(codes).grouped(owner, len(texts)), sums, end)
            m = len(rounds)
            yield batch_of(pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), column_of(cut), pa.array(rounds.astype(np.int32)))
            if m := len(long := np.flatnonzero(pc.greater(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False))):
                yield batch_of(pa.nulls(m, pa.string()), pa.array(times[long]), pa.nulls(m, ids_type), pa.nulls(m, pa.int32()), column_of(subwords.take(long)))
            if rows >= COUNTED:
                yield from counted(counts, ends)
                counts, rows, ends = [], 0, 0
        if counts:
            yield from counted(counts, ends)

    return map_texts(docs.select(text_col), work, "word string, n bigint, ids {0}, round int, long {0}".format("binary" if packed else "array<int>"))


class Subwords:
    """What the corpus says of subwords: ranks, classes and the tables of pairs."""

    def __init__(self, count: np.ndarray, starts: np.ndarray):
        mass = count + 0.5
        order = np.lexsort((np.arange(len(count)), -count))
        self.rank = np.empty(len(count), np.int64)
        self.rank[order] = np.arange(len(count))
        self.starts = starts
        self.input = np.minimum(self.rank, KNOWN - 1)
        self.klass, made = np.empty(len(count), np.int64), 0
        for side in (True, False):
            mine = order[starts[order] == side]
            top, rest = mine[self.rank[mine] < KNOWN - 1], mine[self.rank[mine] >= KNOWN - 1]
            share = np.cumsum(mass[top] ** 0.75)
            bins = np.minimum((share / share[-1] * (CLASSES // 2 - 1)).astype(np.int64), CLASSES // 2 - 2) if len(top) else np.empty(0, np.int64)
            _, bins = np.unique(bins, return_inverse=True)
            self.klass[top] = made + bins
            made += int(bins.max(initial=-1)) + 1
            self.klass[rest] = made
            made += 1
        self.classes = made
        of_class = np.bincount(self.klass, mass, made)
        self.prior = of_class / of_class.sum()
        self.member = mass / of_class[self.klass]

    def pair_cells(self) -> tuple[int, int]:
        """Sizes of the two tables of pairs: (subword, class) and (class, subword)."""
        return KNOWN * self.classes, self.classes * KNOWN

    def with_pairs(self, to_class: np.ndarray, finals: np.ndarray, of_class: np.ndarray, firsts: np.ndarray) -> Subwords:
        """Takes the counts of (subword, class after it within words), of a word's last subwords, of (class before, subword
        within words), and of the classes of first subwords and ends."""
        total = to_class.reshape(KNOWN, self.classes) + finals[:, None] * (firsts / max(firsts.sum(), 1))
        self.next_class = np.log((total + CLASS_PRIOR * self.prior) / (total.sum(1, keepdims=True) + CLASS_PRIOR)).astype(np.float32)
        ids = np.empty(KNOWN, np.int64)
        known = self.rank < KNOWN - 1
        ids[self.rank[known]] = np.flatnonzero(known)
        ids[KNOWN - 1 :] = ids[0]  # rarer ones are told apart by their share of the class alone
        pairs = np.where(self.starts[ids], 0, of_class.reshape(self.classes, KNOWN))
        pairs[:, KNOWN - 1] = 0
        sums = np.zeros((self.classes, self.classes))
        np.add.at(sums.T, self.klass[ids], pairs.T)
        of = np.where(self.starts[ids], 0, sums[:, self.klass[ids]])
        self.next_member = np.log((pairs + MEMBER_PRIOR * self.member[ids]) / (of + MEMBER_PRIOR)).astype(np.float32)
        self.log_member = np.log(self.member)
        return self

    def members(self, before: np.ndarray, now: np.ndarray) -> np.ndarray:
        """log p(subword | its class, the class before)."""
        return np.where(self.rank[now] < KNOWN - 1, self.next_member[self.klass[before], self.input[now]], self.log_member[now])


@cache
def _starts(path: str, pattern: str) -> np.ndarray:
    """Which ids start a word: those with a space in front, and the end."""
    known = tokenizer(path, pattern)
    return np.array([known.decode_single_token_bytes(i)[:1] == b" " for i in range(known.n_vocab)] + [True])


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sums of (cell, total) rows as an array of ``size`` cells, which the constants above bound."""
    found = rows.groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(size)
    out[found.column("cell").to_numpy()] = found.column("total").to_numpy()
    return out


def _cells(total: np.ndarray) -> pa.RecordBatch:
    cell = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell].astype(np.float64))], ["cell", "total"])


def _unpacked(packed: pa.Array, unit: str) -> Ragged:
    """The ids of packed pieces."""
    return Ragged(np.frombuffer(b"".join(packed.to_pylist()), unit), pc.binary_length(packed).to_numpy().astype(np.int64) // int(unit[2]))


def subword_statistics(counts: DataFrame, ends: int, path: str, pattern: str, long: DataFrame | None = None) -> Subwords:
    """Counts of subwords and their pairs, of the table (word, n) of all training words. Those of words that stand as
    digests come from ``long``, packed rows of (long, n), a row or more for each."""
    n_ids = tokenizer(path, pattern).n_vocab + 1
    words, unit = counts.where("word not like ' %'").select("word", "n"), _unit(n_ids - 1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Ragged, np.ndarray]]:
        encode, held_back, rows = word_ids(path, pattern), [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held_back.append(batch)
                rows += batch.num_rows
            if rows >= ENCODED or (rows and batch is None):
                whole = pa.Table.from_batches(held_back)
                yield encode(whole.column("word").to_numpy().tolist()), whole.column("n").to_numpy().astype(np.float64)
                held_back, rows = [], 0

    def each_long(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Ragged, np.ndarray]]:
        for batch in batches:
            ids = _unpacked(batch.column("long"), unit)
            yield Ragged(ids.flat.astype(np.int64), ids.size), batch.column("n").to_numpy().astype(np.float64)

    def summed(count: Callable, size: int) -> np.ndarray:
        found = words.mapInArrow(lambda batches: count(each(batches)), "cell bigint, total double")
        if long is not None:
            found = found.union(long.select("long", "n").mapInArrow(lambda batches: count(each_long(batches)), "cell bigint, total double"))
        return _summed(found, size)

    def singles(parts: Iterator[tuple[Ragged, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids)
        for ids, n in parts:
            total += np.bincount(ids.flat, np.repeat(n, ids.size), n_ids)
        yield _cells(total)

    single = summed(singles, n_ids)
    single[-1] += ends
    known = Subwords(single, _starts(path, pattern))
    a, b = known.pair_cells()
    cells = a + b + KNOWN + known.classes

    def pairs(parts: Iterator[tuple[Ragged, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for ids, n in parts:
            last = ids.start + ids.size - 1
            inner = np.ones(len(ids.flat), bool)
            inner[last] = False
            left = np.flatnonzero(inner)
            before, now, weight = ids.flat[left], ids.flat[left + 1], np.repeat(n, ids.size)[left]
            total[:a] += np.bincount(known.input[before] * known.classes + known.klass[now], weight, a)
            total[a : a + b] += np.bincount(known.klass[before] * KNOWN + known.input[now], weight, b)
            total[a + b : a + b + KNOWN] += np.bincount(known.input[ids.flat[last]], n, KNOWN)
            total[a + b + KNOWN :] += np.bincount(known.klass[ids.flat[ids.start]], n, known.classes)
        yield _cells(total)

    found = summed(pairs, cells)
    to_class, of_class, finals, firsts = np.split(found, [a, a + b, a + b + KNOWN])
    finals[known.input[-1]] += ends  # a text's end stands before its first word
    firsts[known.klass[-1]] += ends
    return known.with_pairs(to_class, finals, of_class, firsts)


#: Of class logits in powers of two, which numpy takes in half the time of powers of e.
LOG2E = np.float32(math.log2(math.e))


def _exp_sums(z: np.ndarray, again: Callable[[], np.ndarray], hit: np.ndarray | None = None, exp: np.ufunc = np.exp) -> np.ndarray:
    """Makes ``z`` its exponentials and gives the sums of its rows. Where one leaves the range of floats, rows are taken
    ``again`` and shifted by their maximum, as is ``hit``; to look for the maxima each time would cost as much as all else."""
    ones = np.ones(z.shape[-1], np.float32)
    with np.errstate(over="ignore", under="ignore"):
        total = exp(z, out=z) @ ones
    if total.size and not (total.min() > 1e-25 and total.max() < 1e25):
        z[...] = again()
        top = z.max(-1)
        z -= top[..., None]
        if hit is not None:
            hit -= top
        total = exp(z, out=z) @ ones
    return total


class Room:
    """Arrays that are used again: to ask the system for fresh ones at each step costs as much as the sums that go there."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, np.float32)
        return self.kept[name][:size].reshape(shape)


def _thirds(qkv: np.ndarray) -> list[np.ndarray]:
    """Queries, keys and values by window."""
    return [qkv.reshape(-1, WINDOW, 3 * WIDTH)[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3)]


class Attention:
    """One head of causal self-attention over windows of subwords, with its gradients, in numpy."""

    SHAPES = {"embed": (KNOWN, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "inner": (WIDTH, HIDDEN)}

    def __init__(self, next_class: np.ndarray):
        self.table, self.room = next_class * LOG2E, Room()
        self.shapes = {**self.SHAPES, "outer": (HIDDEN, next_class.shape[1]), "bias": (next_class.shape[1],)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        draw = np.random.default_rng(20240517)
        scale = {"embed": 0.3, "place": 0.1, "value": 0.5 / WIDTH**0.5, "outer": 0.02, "bias": 0.0}
        self.p = {n: (draw.normal(0, 1, s) * scale.get(n, WIDTH**-0.5)).astype(np.float32) for n, s in self.shapes.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.shapes])

    def load(self, flat: np.ndarray) -> Attention:
        return self.share(flat.astype(np.float32))

    def share(self, flat: np.ndarray) -> Attention:
        """Takes parts of ``flat`` as parameters, which change with it."""
        at = 0
        for n, s in self.shapes.items():
            self.p[n] = flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        return self

    def heads(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all places of windows (n, WINDOW) of input numbers, and their queries, keys and values side by side."""
        h = np.take(self.p["embed"], x.ravel(), 0, out=self.room("h", x.size, WIDTH), mode="clip")
        by_window = h.reshape(len(x), -1)
        by_window += self.p["place"].ravel()
        return h, np.matmul(h, self.mixers(), out=self.room("qkv", x.size, 3 * WIDTH))

    def mixers(self) -> np.ndarray:
        return np.concatenate([self.p["query"] * np.float32(WIDTH**-0.5), self.p["key"], self.p["value"]], 1)

    def attended(self, qkv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights of the places up to each (masked places get none), one over their sums, and what they mix."""
        q, k, v = _thirds(qkv)
        a = self.room("a", len(q), WINDOW, WINDOW)

        def weights() -> np.ndarray:
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            return np.add(a, self.mask, out=a)

        share = 1 / _exp_sums(weights(), weights)[..., None]
        mixed = np.matmul(a, v, out=self.room("mixed", *q.shape))
        mixed *= share
        return a, share, mixed

    def logits(self, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of values after attention and their input numbers, times LOG2E; and the rectified values that they come from."""
        g = np.matmul(rows, self.p["inner"], out=self.room("g", len(rows), HIDDEN))
        np.maximum(g, 0, out=g)
        z = np.take(self.table, x, 0, out=self.room("z", len(x), self.table.shape[1]), mode="clip")
        z += np.matmul(g, self.p["outer"] * LOG2E, out=self.room("w", *z.shape))
        z += self.p["bias"] * LOG2E
        return z, g

    def log_probs(self, x: np.ndarray, y: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """log p(class y | window) of the places where ``wanted``, in order."""
        h, qkv = self.heads(x)
        h += self.attended(qkv)[2].reshape(h.shape)
        at = np.flatnonzero(wanted)
        rows, x, y = np.take(h, at, 0, out=self.room("rows", len(at), WIDTH), mode="clip"), x.ravel()[at], y.ravel()[at]
        z = self.logits(rows, x)[0]
        hit = z[np.arange(len(z)), y]
        total = _exp_sums(z, lambda: self.logits(rows, x)[0], hit, np.exp2)
        return (hit - np.log2(total)) / LOG2E

    def gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability of the classes y where ``live``."""
        rest, seen, of_seen = self.parted_gradients(x, y, live)
        rest["embed"] = np.zeros(self.p["embed"].shape, np.float32)
        rest["embed"][seen] = of_seen
        return rest

    def parted_gradients(self, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """The gradients of all but the embeddings, the inputs seen, and the gradients of their embeddings. Sums that
        normalise go into the narrow factor of each product, so that no pass over weights or classes is for them."""
        room, mix = self.room, self.mixers()
        h, qkv = self.heads(x)
        a, share, mixed = self.attended(qkv)
        q, k, v = _thirds(qkv)
        rows, inputs = np.add(h, mixed.reshape(h.shape), out=room("rows", *h.shape)), x.ravel()
        d, g = self.logits(rows, inputs)
        total = _exp_sums(d, lambda: self.logits(rows, inputs)[0], exp=np.exp2)
        d[np.arange(len(d)), y.ravel()] -= total
        total *= np.float32(max(np.count_nonzero(live), 1))
        scale = (live.ravel() / total).astype(np.float32)
        out = {"outer": np.multiply(g, scale[:, None], out=room("scaled", *g.shape)).T @ d, "bias": scale @ d}
        dg = np.matmul(d, self.p["outer"].T, out=room("dg", *g.shape))
        dg *= scale[:, None]
        dg *= (g > 0).astype(np.float32)
        out["inner"] = rows.T @ dg
        do = np.matmul(dg, self.p["inner"].T, out=room("do", *h.shape))
        by_window = do.reshape(q.shape)
        even = np.multiply(by_window, share, out=room("even", *q.shape))
        ds = np.matmul(even, v.transpose(0, 2, 1), out=room("ds", *a.shape))
        ds -= np.einsum("nij,nij->ni", even, mixed)[..., None]  # as much as the sum of its products with the shares
        ds *= a
        d_qkv = room("d_qkv", *qkv.shape)
        for out_part, left, right in zip(_thirds(d_qkv), (ds, ds.transpose(0, 2, 1), a.transpose(0, 2, 1)), (k, q, even), strict=True):
            np.matmul(left, right, out=out_part)
        d_mix = h.T @ d_qkv
        out["query"], out["key"], out["value"] = d_mix[:, :WIDTH] * np.float32(WIDTH**-0.5), d_mix[:, WIDTH : 2 * WIDTH], d_mix[:, 2 * WIDTH :]
        dh = np.matmul(d_qkv, mix.T, out=room("dh", *h.shape))
        dh += do
        out["place"] = dh.reshape(len(x), -1).sum(0).reshape(WINDOW, WIDTH)
        numbers = x.ravel().astype(np.uint16)
        order = np.argsort(numbers, kind="stable")
        numbers = numbers[order]
        heads = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        return out, numbers[heads].astype(np.int64), np.add.reduceat(np.take(dh, order, 0, out=room("sorted", *h.shape), mode="clip"), heads, 0)


class Adam:
    """Steps of Adam over all parameters of a model as one array. Means and squares are kept without their decay, which is
    one factor for all of them, so that a step writes only those of the embeddings that it saw."""

    def __init__(self, model: Attention):
        self.model, self.flat, self.t, self.since = model, model.flat(), 0, 0
        self.mean, self.square, self.root, self.move = (np.zeros(len(self.flat), np.float32) for _ in range(4))
        model.share(self.flat)

    def step(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, rate: float) -> None:
        rest, seen, of_seen = self.model.parted_gradients(x, y, live)
        if self.since == 64:  # the factors stay within the range of floats
            self.mean *= np.float32(0.9**self.since)
            self.square *= np.float32(0.99**self.since)
            self.root *= np.float32(0.99 ** (self.since / 2))
            self.since = 0
        self.t, self.since = self.t + 1, self.since + 1
        one, two, grown = 1 - 0.9**self.t, 1 - 0.99**self.t, 0.99 ** (self.since / 2)
        wide = KNOWN * WIDTH
        tail = np.concatenate([rest[n].ravel() for n in self.model.shapes if n != "embed"])
        self._take(slice(None), tail, self.mean[wide:], self.square[wide:], self.root[wide:])
        self._take(seen, of_seen, *(v[:wide].reshape(KNOWN, WIDTH) for v in (self.mean, self.square, self.root)))
        np.add(self.root, np.float32(1e-6 * two**0.5 / grown), out=self.move)
        np.divide(self.mean, self.move, out=self.move)
        self.move *= np.float32(rate / one * 0.9**self.since * two**0.5 / grown)
        self.flat -= self.move

    def _take(self, at, g: np.ndarray, mean: np.ndarray, square: np.ndarray, root: np.ndarray) -> None:
        mean[at] += g * np.float32(0.1 / 0.9**self.since)
        g *= g
        g *= np.float32(0.01 / 0.99**self.since)
        g += square[at]
        square[at] = g
        root[at] = np.sqrt(g, out=g)


def _windows(seqs: Ragged, known: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, classes to come, live) in windows of pieces of ids whose first is only context; a longer piece takes several."""
    targets = seqs.size - 1
    pieces = -(-targets // WINDOW)
    owner = np.repeat(np.arange(len(targets)), pieces)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    place = piece[:, None] * WINDOW + np.arange(WINDOW)
    live = place < targets[owner][:, None]
    at = seqs.start[owner][:, None] + np.where(live, place, 0)
    return known.input[seqs.flat[at]], known.klass[seqs.flat[at + 1]], live


def train(windows: DataFrame, known: Subwords) -> Attention:
    """Rounds over packed (ids, round), each from the mean of what tasks made of the parameters before, weighted by windows. Tasks
    are those that read the written table, put together where they would take less than TASK_WINDOWS windows, so that a
    mean is one of models that have all taken steps enough to be worth it."""
    model, unit = Attention(known.next_class), _unit(len(known.rank) - 1)
    width = int(unit[2])
    for k, rate in enumerate(STEPS):
        start = model.flat()

        def work(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            mine, seen = Attention(known.next_class).load(start), 0
            adam = Adam(mine)
            for batch in batches:
                x, y, live = _windows(_unpacked(batch.column("ids"), unit), known)
                for at in range(0, len(x), BATCH):
                    part = slice(at, at + BATCH)
                    adam.step(x[part], y[part], live[part], rate)
                seen += len(x)
            flat = mine.flat().astype(np.float64) * seen
            cell = np.arange(len(flat) + 1 if seen else 0)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(flat, seen)[: len(cell)])], ["cell", "total"])

        mine = windows.where(F.col("round") == k).select("ids")
        taken = mine.agg(F.sum(F.ceil((F.octet_length("ids") / width - 1) / WINDOW))).first()[0] or 0
        dealt = mine.coalesce(max(1, round(taken / TASK_WINDOWS)))
        total = _summed(dealt.mapInArrow(work, "cell bigint, total double"), len(start) + 1)
        if total[-1]:
            model.load(total[:-1] / total[-1])
    return model


def text_scores(ids: Ragged, model: Attention, known: Subwords, end: int) -> np.ndarray:
    """log10 of the model's probability of each text's subwords and its end."""
    n = ids.size + 1
    first = np.cumsum(n) - n
    now = np.full(int(n.sum()), end, np.int64)
    before = now.copy()
    inside = np.ones(len(now), bool)
    inside[first + n - 1] = False
    now[inside] = ids.flat
    inside[:] = True
    inside[first] = False
    before[inside] = ids.flat
    x, y = known.input[before], known.klass[now]
    more = -(-np.maximum(n - WINDOW, 0) // STRIDE)
    owner = np.repeat(np.arange(len(n)), more + 1)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    total = np.empty(len(owner))
    for at in range(0, len(owner), SCORED):
        doc, k = owner[at : at + SCORED], number[at : at + SCORED]
        place = k[:, None] * STRIDE + np.arange(WINDOW)
        live = place < n[doc][:, None]
        cell = first[doc][:, None] + np.where(live, place, 0)
        live &= (k[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - STRIDE)
        found = model.log_probs(x[cell], y[cell], live)
        many = np.count_nonzero(live, 1)  # each window has a place that no other scores
        total[at : at + SCORED] = np.add.reduceat(found, np.cumsum(many) - many, dtype=np.float64)
    out = np.bincount(owner, total, len(n)) + np.bincount(np.repeat(np.arange(len(n)), n), known.members(before, now), len(n))
    return out / math.log(10)


def frequent_words(counts: DataFrame) -> pa.Table:
    """The rows of the words that occur oftest, FREQUENT at most: all from the lowest count on at which they are no more. No
    task reads more than its own part of the table, as one that put candidates of all parts in order would."""
    words = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(FREQUENT).toArrow()  # a count has a word at least
    n, many = words.column("n").to_numpy(), np.cumsum(words.column("words").to_numpy())
    fit = n[many <= FREQUENT]
    return counts.where(F.col("n") >= int(fit[-1])).toArrow() if len(fit) else counts.limit(0).toArrow()


def score(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are words (A-Z lower-cased) and one end. Documents with crc32(id) mod 5 = 1 are held out of all that is learnt.
    A null or empty text has its end alone; rows without an id take part in training; rows that repeat an id or a text
    are documents of their own. Without training documents every count is 0. Other columns are not read, whatever their
    names, and an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    learnt = staged(training_table(rows.where(~held(F.col("doc_id"))), path, pattern, packed=True), "learnt")
    counts = staged(learnt.where("n is not null and word is not null").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = learnt.where("n is not null and word is null and long is null").agg(F.sum("n")).first()[0] or 0
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    known = subword_statistics(counts, ends, path, pattern, learnt.where("long is not null"))
    model = train(learnt.where("ids is not null"), known)
    drop_staged(learnt)
    top = frequent_words(counts)
    frequent = spark.sparkContext.broadcast(Frequent(top.column("word").combine_chunks(), top.column("n").to_numpy(), word_ids(path, pattern)))
    end, below = len(known.rank) - 1, math.log10(total + 0.5 * (distinct + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known_words = word_ids(path, pattern), frequent.value
        for batch in slices(batches, limit=4 << 20):
            texts = texts_of(batch)
            codes, owner, words = word_codes(texts, fold=True)
            keys = _keys(words)
            n, subwords = known_words.find(words, keys, encode)
            seen, size = n >= 0, len(texts)
            weight = np.log10(np.maximum(n, 0) + 0.5) - below
            near = seen[codes] if len(codes) else np.empty(0, bool)
            cell, times = np.unique(owner[~near] * len(keys) + codes[~near], return_counts=True)
            offsets = np.searchsorted(cell, np.arange(size + 1) * len(keys)).astype(np.int32)
            ids = subwords.take(codes).grouped(owner, size)
            rare = pa.StructArray.from_arrays([keys.cast(pa.string()).take(pa.array(cell % max(len(keys), 1))), pa.array(times.astype(np.int64))], ["word", "times"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(owner, minlength=size) + 1), pa.array(np.bincount(owner[near], minlength=size)), pa.array(np.bincount(owner[near], weight[codes[near]], size).astype(np.float64)),
                 pa.array(text_scores(ids, model, known, end)), pa.ListArray.from_arrays(pa.array(offsets), rare)],
                ["doc_id", "n_tokens", "n_near", "near", "score", "rare"],
            )

    kind = dict(rows.dtypes)["doc_id"]
    parts = map_texts(rows, work, f"doc_id {kind}, n_tokens bigint, n_near bigint, near double, score double, rare array<struct<word: string, times: bigint>>")
    scored = staged(parts.withColumn("row", F.monotonically_increasing_id()), "scored")
    others = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = others.hint("merge").join(counts, "word", "left")
    seen, one = F.coalesce("n", F.lit(0)), F.log10(F.coalesce("n", F.lit(0)) + 0.5) - below
    rest = found.groupBy("row").agg(F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("n_far"), F.sum(F.col("times") * one).alias("far"))
    last = math.log10(ends + 0.5) - below
    both = scored.select("row", "doc_id", "n_tokens", "n_near", "near", "score").join(rest, "row", "left")
    out = staged(both.select(
        F.col("doc_id").alias(id_col), held(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_near") + F.coalesce("n_far", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("near") + F.coalesce("far", F.lit(0.0)) + last).alias("base_score"), "score",
    ), "scores")
    drop_staged(counts, scored)
    return out
