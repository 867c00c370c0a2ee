"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are cut into passages of WINDOW words. Their TF-IDF matrix (document frequencies counted over
   all documents) gets a randomised SVD: a Gaussian test matrix is multiplied by the passages' Gram matrix a few
   times, each product summed over the partitions of the passage table, and orthonormalised in between.
2. Every document is cut into overlapping windows. A window's latent vector is the sum of its words' rows of the
   term table, its cosine with each benchmark passage one matrix product. Windows at or above COSINE, and not
   much shorter than the passage along it, are candidates, all of them.
3. A candidate region is compared with the whole item: the longest common subsequence of words, and how much of
   the item's answer (its last sentence, weighted by IDF) stands there. Much of the subsequence suffices; half of
   it needs the answer too, which is what a paraphrase keeps.

Documents are only scanned: one pass for the frequencies of all items' words, one for the search of all blocks, no
shuffle of text. Items are dealt into blocks of about BLOCK_WORDS words, each with an SVD of its own, and a task holds
the blocks of one search at most: PASS_BLOCKS of them, some 4,000 items. A larger benchmark takes a further search
for each PASS_BLOCKS blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeloom.llm.shared import map_texts, slices, texts_of

STRIDE = 12
WINDOW = 2 * STRIDE
RANK, OVERSAMPLE, POWERS = 320, 16, 2
#: A window is a candidate for a passage at this cosine, if it also holds this share of the passage's own length.
#: The share is far under the half that a paraphrase keeps: its kept words may be the light ones, and the best window
#: may lie STRIDE / 2 words off. Shares of 0.5 and cosines of 0.6 lost paraphrases that step 3 confirms.
COSINE, MASS = 0.5, 0.12
_GROUP, _CHUNK = 32, 1024
#: Shares of an item's words: enough by itself, enough with the answer; share of the answer's weight.
LCS_COPY, LCS_PARAPHRASE, ANSWER = 0.75, 0.5, 0.7
BLOCK_WORDS, PASS_BLOCKS = 1 << 14, 16
_TERMS, _PARTITIONS = 512, 8
#: Columns of the matrix that one product sends out and gets back.
COLUMNS = 84

_EDGES = ".,;:!?\"'()[]{}|*#$%&-"
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str) -> list[str]:
    """Words without punctuation at their ends, A-Z lower-cased."""
    return [w for w in (x.strip(_EDGES) for x in _SPLIT.findall(text.translate(_FOLD))) if w]


def answer_of(text: str) -> list[str]:
    """The words of the last sentence."""
    return words_of(_SENTENCE.split(text.strip())[-1])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & at.get(y, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _passages(n: int) -> list[tuple[int, int]]:
    """Windows over n words, the last one ending with them."""
    if n <= WINDOW:
        return [(0, n)]
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


@dataclass
class Block:
    """One block of items: ids, words as term numbers, answers, terms, and later the latent tables."""

    items: list[int]
    words: list[list[int]]
    answers: list[list[int]]
    terms: pa.Array
    idf: np.ndarray | None = None
    table: np.ndarray | None = None  # (terms, rank): a word's share of a latent vector
    targets: np.ndarray | None = None  # (rank, passages), unit columns
    norms: np.ndarray | None = None  # lengths of the passages' vectors
    owner: np.ndarray | None = None  # item number of each passage
    counts: list[Counter] | None = None  # words of each item

    def aim(self, cuts: list[tuple[int, list[int]]]) -> None:
        """Vectors of all passages, in ascending length."""
        vectors = np.stack([self.table[c].sum(0) for _, c in cuts])
        norms = np.maximum(1e-6, np.linalg.norm(vectors, axis=1)).astype(np.float32)
        owner = np.array([k for k, _ in cuts])
        order = np.argsort(norms, kind="stable")
        self.norms, self.owner = norms[order], owner[order]
        self.targets = np.ascontiguousarray((vectors[order] / norms[order, None]).T, np.float32)
        self.counts = [Counter(w) for w in self.words]

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        terms: dict[str, int] = {}
        number = lambda found: [terms.setdefault(w, len(terms)) for w in found]
        rows = [(i, t) for i, t in rows if t and words_of(t)]
        words = [number(words_of(t)) for _, t in rows]
        return cls([i for i, _ in rows], words, [number(answer_of(t)) for _, t in rows], pa.array(list(terms), pa.large_string()))


def _codes(texts: list[str], terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term number or -1, text) of every word that is not punctuation alone."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    words = pc.ascii_trim(cut.flatten(), characters=_EDGES)
    found = pc.fill_null(pc.index_in(words, value_set=terms), -1).to_numpy().astype(np.int64)
    real = found >= 0
    real |= pc.binary_length(words).to_numpy() > 0
    return found[real], owner[real]


def document_frequencies(docs: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """(documents, documents with each term) over the whole table; summed by task before anything is sent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0, np.zeros(len(terms), np.int64)
        for batch in slices(batches):
            total += batch.num_rows
            found, owner = _codes(texts_of(batch), terms)
            known = found >= 0
            pairs = np.unique(owner[known] * len(terms) + found[known])
            seen += np.bincount(pairs % len(terms), minlength=len(terms))
        live = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(live, -1)), pa.array(np.append(seen[live], total))], ["term", "n"])

    sums = map_texts(docs.select("text"), work, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out, total = np.zeros(len(terms), np.int64), 0
    for term, n in zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True):
        if term < 0:
            total = n
        else:
            out[term] = n
    return total, out


def _gram_product(passages: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'Ax for the TF-IDF matrix A of a passage table (terms: array of term numbers), by COLUMNS columns of x at a time.

    The driver's JVM holds what is sent out and what comes back of so many columns, and lets go of it before the next.
    """
    return np.concatenate([_of_columns(passages, idf, np.ascontiguousarray(x[:, k : k + COLUMNS])) for k in range(0, x.shape[1], COLUMNS)], axis=1)


def _of_columns(passages: DataFrame, idf: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same of a few columns, summed over the partitions of the passages."""
    width = x.shape[1]
    sent = passages.sparkSession.sparkContext.broadcast((idf, x))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, x = sent.value
        out = np.zeros_like(x)
        for batch in batches:
            for found in batch.column("terms").to_pylist():
                t = np.array(found, np.int64)
                row = _row(t, idf)
                np.add.at(out, t, (row[:, None] * (row @ x[t])[None, :]))
        for k in range(0, len(out), _TERMS):
            part = out[k : k + _TERMS]
            if part.any():
                yield pa.RecordBatch.from_pydict({"part": [k // _TERMS], "sums": [part.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
        return pa.Table.from_pydict({"part": [table.column("part")[0].as_py()], "sums": [total.tobytes()]})

    # A group holds one slab of _TERMS rows from each of the few partitions.
    slabs = passages.mapInArrow(work, "part bigint, sums binary").groupBy("part").applyInArrow(add, "part bigint, sums binary").toArrow()
    sent.destroy()
    out = np.zeros_like(x)
    for k, sums in zip(slabs.column("part").to_pylist(), slabs.column("sums").to_pylist(), strict=True):
        out[k * _TERMS : (k + 1) * _TERMS] = np.frombuffer(sums).reshape(-1, width)
    return out


def _row(terms: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights of a passage's words, one entry for each occurrence, the passage at unit length."""
    _, inverse, count = np.unique(terms, return_inverse=True, return_counts=True)
    return idf[terms] / max(1e-12, math.sqrt(float((count[inverse] * idf[terms] ** 2).sum())))


def latent_terms(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """(terms, at most rank) right singular vectors of the passages' TF-IDF matrix, by randomised subspace iteration."""
    n = len(idf)
    width = min(n, rank + OVERSAMPLE)
    basis = np.random.default_rng(seed).standard_normal((n, width))
    for _ in range(POWERS):
        basis, _ = np.linalg.qr(_gram_product(passages, idf, basis))
    small = basis.T @ _gram_product(passages, idf, basis)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    # Directions that no passage has would add a document's length and lower its cosines.
    keep = [k for k in np.argsort(-values)[:rank] if values[k] > 1e-9 * values.max()]
    return basis @ vectors[:, keep]


def prepared(spark: SparkSession, block: Block, total: int, seen: np.ndarray) -> Block:
    """The block with the frequencies of its terms among ``total`` documents, SVD and passage vectors."""
    block.idf = np.log((1 + total) / (1 + seen)) + 0.1
    cuts = [(k, w[a:b]) for k, w in enumerate(block.words) for a, b in _passages(len(w))]
    schema = pa.schema([("terms", pa.list_(pa.int64()))])
    passages = spark.createDataFrame(pa.Table.from_pydict({"terms": [c for _, c in cuts]}, schema)).repartition(_PARTITIONS)
    basis = latent_terms(passages, block.idf)
    block.table = (block.idf[:, None] * basis).astype(np.float32)
    block.aim(cuts)
    return block


def _live_windows(term: np.ndarray, at: np.ndarray, of_block: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(windows by their first block, whether a second follows) whose vectors may be long enough for some passage.

    Projection shortens, so a window's vector is at most as long as the weights of its two blocks added up. Most
    windows end here, and exactly.
    """
    entry, count = np.unique(at * len(block.idf) + term, return_counts=True)
    square = (count * block.idf[entry % len(block.idf)]) ** 2
    length = np.sqrt(np.bincount(entry // len(block.idf), square, len(of_block)))
    follows = np.append(of_block[:-1] == of_block[1:], False)
    both = length.copy()
    pair = np.flatnonzero(follows)
    both[pair] += length[pair + 1]
    live = np.flatnonzero(both >= MASS * float(block.norms[0]) * 0.999)
    return live, follows[live]


def _row_sums(table: np.ndarray, term: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, rank) sums of the table rows of each block's terms; ``row`` ascends. The j-th terms of all blocks at once."""
    count = np.bincount(row, minlength=n)
    order = np.argsort(-count, kind="stable")
    first = (np.cumsum(count) - count)[order]
    full = np.searchsorted(-count[order], -np.arange(count.max(initial=0)), "left")
    total = np.zeros((n, table.shape[1]), np.float32)
    for j, m in enumerate(full.tolist()):
        total[:m] += table[term[first[:m] + j]]
    out = np.empty_like(total)
    out[order] = total
    return out


def search(texts: list[str], block: Block) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, cosine, LCS share, answer share) of all confirmed pairs, the best region of each."""
    found, owner = _codes(texts, block.terms)
    sizes = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(sizes) - sizes
    blocks = -(-sizes // STRIDE)
    first = np.cumsum(blocks) - blocks
    at = first[owner] + (np.arange(len(found)) - starts[owner]) // STRIDE
    of_block = np.repeat(np.arange(len(texts)), blocks)
    known = np.flatnonzero(found >= 0)
    term, at = found[known], at[known]
    live, follows = _live_windows(term, at, of_block, block)
    need = np.zeros(len(of_block) + 1, bool)
    need[live] = True
    need[live[follows] + 1] = True
    row_of = np.cumsum(need) - 1
    wanted = need[at]
    term, at = term[wanted], row_of[at[wanted]]
    pairs: list[np.ndarray] = []
    for k in range(0, len(live), _CHUNK):
        own, next_ = live[k : k + _CHUNK], follows[k : k + _CHUNK]
        lo, hi = row_of[own[0]], row_of[own[-1]] + 2
        a, b = np.searchsorted(at, [lo, hi])
        sums = _row_sums(block.table, term[a:b], at[a:b] - lo, hi - lo)
        v = sums[row_of[own] - lo]
        v[next_] += sums[row_of[own[next_] + 1] - lo]
        long = np.linalg.norm(v, axis=1)
        for p0 in range(0, len(block.norms), _GROUP):
            norms = block.norms[p0 : p0 + _GROUP]
            able = np.flatnonzero(long >= MASS * norms[0])  # a shorter vector cannot hold enough of these passages
            if not len(able):
                break
            along = v[able] @ block.targets[:, p0 : p0 + _GROUP]
            i, p = np.nonzero((along >= np.float32(COSINE) * long[able, None]) & (along >= np.float32(MASS) * norms))
            if len(i):
                pairs.append(np.stack([of_block[own[able[i]]], block.owner[p0 + p], own[able[i]], (along[i, p] / long[able[i]] * 1e6).astype(np.int64)]))
    near = np.concatenate(pairs, axis=1) if pairs else np.empty((4, 0), np.int64)
    near = near[:, np.lexsort((near[2], near[1], near[0]))]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    before, done = (-1, -1), -1
    for d, item, k, cosine in near.T.tolist():
        key, words = (d, item), block.words[item]
        k -= int(first[d])
        reach = len(words) + STRIDE
        lo, hi = max(0, k * STRIDE - reach), min(int(sizes[d]), k * STRIDE + WINDOW + reach)
        if key == before and hi <= done:
            continue  # the region before has covered this one
        before, done = key, hi - STRIDE
        counts = block.counts[item]
        region = [t for t in found[starts[d] + lo : starts[d] + hi].tolist() if t in counts]
        here = set(region)
        if sum(counts[t] for t in here) < LCS_PARAPHRASE * len(words):
            continue  # no subsequence can be longer than the words in common
        share = lcs(words, region) / len(words)
        answer = set(block.answers[item])
        weight = sum(block.idf[t] for t in answer)
        said = sum(block.idf[t] for t in answer & here) / weight if weight else 1.0
        if share >= LCS_COPY or (share >= LCS_PARAPHRASE and said >= ANSWER):
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (share, said, cosine / 1e6))
    return [(d, item, cosine, share, said) for (d, item), (share, said, cosine) in best.items()]


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Block]]:
    """Prepared blocks of the benchmark, those of one search at a time; items without an id or a word are left out."""
    usable = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    words = usable.agg(F.sum(F.size(F.split("text", r"[\x20\x09-\x0D]+")))).first()[0] or 0
    n = -(-words // BLOCK_WORDS)
    rest = [Block.of(sorted((r["item_id"], r["text"]) for r in usable.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())) for k in range(n)]
    rest = [block for block in rest if block.items]
    if not rest:
        return
    terms = pc.unique(pa.concat_arrays([block.terms for block in rest]))
    total, seen = document_frequencies(docs, terms)
    for at in range(0, len(rest), PASS_BLOCKS):
        yield [prepared(docs.sparkSession, block, total, seen[pc.index_in(block.terms, value_set=terms).to_numpy()]) for block in rest[at : at + PASS_BLOCKS]]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs and answer of every pair of a document and a benchmark item it contains.

    A null, empty or wordless text contains nothing. Rows that repeat an id are searched one by one and may
    repeat a pair; a row without an id gives pairs without one. Items of one text count each. An empty table on
    either side gives an empty one. Columns other than ids and texts are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, cosine double, lcs double, answer double"
    out = docs.sparkSession.createDataFrame([], schema)
    for blocks in _passes(plain, benchmark):

        def work(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                texts = texts_of(batch)
                for block in blocks:
                    rows = search(texts, block)
                    ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                    items = pa.array([block.items[r[1]] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, items, *(pa.array([r[k] for r in rows], pa.float64()) for k in (2, 3, 4))], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        out = out.unionByName(map_texts(plain, work, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text contains no benchmark item."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs
    for blocks in _passes(docs.select("text"), benchmark):

        def work(batches: Iterator[pa.RecordBatch], blocks: list[Block] = blocks) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                keep, texts = np.ones(batch.num_rows, bool), texts_of(batch)
                for block in blocks:
                    keep[[r[0] for r in search(texts, block)]] = False
                yield batch.filter(pa.array(keep))

        out = map_texts(out, work, fields)
    return out
