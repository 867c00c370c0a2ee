"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, cut at a score quantile.

A document's strength is a linear function of what its text looks like: how often one class of character
follows another, and how much of it repeats. The weights minimise the logistic loss on feature differences of
(better, worse) pairs of labelled documents, all of them. The cut is the quantile of the labelled strengths at the
share of worse documents; strengths are shifted so that it falls on THRESHOLD.

Every labelled row that is not held out takes part. Features are joined with labels by a shuffle and written once; a
Newton step is two passes over them. What a pair adds depends on its two strengths alone, so a pass gives each row to the
points of a fixed grid of strengths around its own, by interpolation weights, and sums of rows at points stand for all
pairs. The driver gets these sums, of a size that the range of strengths and the number of features bound. Scoring is one
narrow stage over whole texts: no shuffle, a few hundred weights in the closure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import dense, drop_staged, map_texts, slices, staged, texts_of, windows, word_codes

#: Labelled rows whose products are taken at once.
BLOCK_ROWS = 4096
#: Distance of the grid's points, and how many of them interpolate a strength: sums over pairs are right to some 1e-9.
_STEP, _POINTS = 0.125, 8
#: Ranges into which a search for a strength by its rank cuts at a time.
_RANGES = 4096
THRESHOLD = 0.3
#: Bytes of text whose features are taken at once: a few dozen bytes of arrays for each of them.
SLICE = 1 << 20
_RIDGE, _STEPS = 1e-3, 25

#: Classes of UTF-8 bytes: 0 stands between texts.
_CLASSES = ("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "#*$%&", "|<>{}[]\\^~", "\"'`()-/_=+@")
_N = len(_CLASSES) + 2
_CLASS_OF = np.full(256, _N - 2, np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members.encode())] = _k
_CLASS_OF[0x80:] = _N - 1
N_FEATURES = _N * _N + 4


def features(texts: list[str]) -> np.ndarray:
    """(texts, N_FEATURES): root shares of character-class bigrams, then length, distinct words, repeated windows and lines."""
    rows = len(texts)
    raw = [b"\0" + t.encode().replace(b"\0", b"\x01") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, rows)
    kinds = _CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)].astype(np.int64)
    kinds[np.cumsum(sizes) - sizes] = 0
    pair = kinds[:-1] * _N + kinds[1:] + np.repeat(np.arange(rows), sizes)[:-1] * (_N * _N)
    pair = pair[kinds[1:] != 0]
    out = np.zeros((rows, N_FEATURES))
    shares = np.bincount(pair, minlength=rows * _N * _N).reshape(rows, _N * _N)
    out[:, : _N * _N] = np.sqrt(shares / np.maximum(1, sizes - 1)[:, None])
    codes, owner, _ = word_codes(texts)
    n = np.bincount(owner, minlength=rows)
    some = np.maximum(1, n)
    base = codes.max(initial=0) + 1
    first = np.unique(owner * base + codes)
    number, place = windows(codes, owner, 3)
    base3 = number.max(initial=0) + 1
    in_text, count = dense(owner[place] * base3 + number)
    out[:, -4] = np.log1p(n) / 10
    out[:, -3] = np.bincount(first // base, minlength=rows) / some
    out[:, -2] = np.bincount(owner[place], count[in_text] > 1 if len(place) else None, rows) / some
    for i, t in enumerate(texts):
        lines = t.split("\n")
        out[i, -1] = 1 - len(set(lines)) / len(lines)
    return out


def _spread(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first grid point, weights) by which each strength is interpolated from _POINTS points."""
    first = np.floor(z / _STEP).astype(np.int64) - (_POINTS // 2 - 1)
    u = z / _STEP - first
    weights = np.ones((len(z), _POINTS))
    for k in range(_POINTS):
        for j in range(_POINTS):
            if j != k:
                weights[:, k] *= (u - j) / (k - j)
    return first, weights


def _point_sums(x: np.ndarray, quality: np.ndarray, w: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, sums) of the rows by quality and grid point: 2 * point + quality; the weights and the weighted features."""
    for c in (0, 1):
        mine = x[quality == c]
        if len(mine):
            first, weights = _spread(mine @ w)
            low = first.min()
            at = np.zeros((len(mine), int(first.max() - low) + _POINTS))
            np.put_along_axis(at, (first - low)[:, None] + np.arange(_POINTS), weights, 1)
            yield (low + np.arange(at.shape[1])) * 2 + c, np.column_stack([at.sum(0), at.T @ mine])


class Pairs:
    """What all (better, worse) pairs add up to at some weights, by sums of rows at grid points."""

    def __init__(self, keys: np.ndarray, sums: np.ndarray):
        (g0, m0, x0), (g1, m1, x1) = [(keys[keys % 2 == c] // 2, sums[keys % 2 == c, 0], sums[keys % 2 == c, 1:]) for c in (0, 1)]
        self.worse, self.better = round(m0.sum()), round(m1.sum())
        self.total = max(1, self.worse * self.better)
        gap = (g1[:, None] - g0) * _STEP
        p = np.exp(-np.logaddexp(0, gap))
        self.loss = m1 @ np.logaddexp(0, -gap) @ m0 / self.total
        self.slope = (x0.T @ (m1 @ p) - x1.T @ (p @ m0)) / self.total
        cross = x1.T @ ((p - p * p) @ x0) / self.total
        self.cross = cross + cross.T
        self.points = [(g0, m1, g1), (g1, m0, g0)]

    def bends(self) -> list[tuple[int, np.ndarray]]:
        """For each quality (lowest point, curvature of the loss in the strength of a row there) at all points of its range."""
        out = []
        for mine, mass, others in self.points:
            at = np.arange(mine.min(), mine.max() + 1)
            p = np.exp(-np.logaddexp(0, (at[:, None] - others) * _STEP))
            out.append((int(at[0]), (p - p * p) @ mass / self.total))
        return out


def _curve(x: np.ndarray, quality: np.ndarray, w: np.ndarray, bends: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, sums): the rows of the products of features, each row of ``x`` by its curvature."""
    for c, (low, bend) in enumerate(bends):
        mine = x[quality == c]
        if len(mine):
            first, weights = _spread(mine @ w)
            of_row = (bend[(first - low)[:, None] + np.arange(_POINTS)] * weights).sum(1)
            yield np.arange(x.shape[1]), (mine.T * of_row) @ mine


#: Gives the sums by key, in the order of keys, of what a function yields for all rows (features, quality).
Passes = Callable[[Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]], tuple[np.ndarray, np.ndarray]]


def descend(over_rows: Passes, width: int) -> tuple[np.ndarray, Pairs]:
    """Weights that minimise the mean of log(1 + exp(-w(x - y))) over all pairs, plus a ridge, by damped Newton steps."""

    def at(v: np.ndarray) -> Pairs:
        return Pairs(*over_rows(lambda x, quality: _point_sums(x, quality, v)))

    def loss(pairs: Pairs, v: np.ndarray) -> float:
        return pairs.loss + _RIDGE / 2 * v @ v

    w = np.zeros(width)
    now = at(w)
    for _ in range(_STEPS if now.better and now.worse else 0):
        bends = now.bends()
        _, curve = over_rows(lambda x, quality, w=w, bends=bends: _curve(x, quality, w, bends))
        slope = now.slope + _RIDGE * w
        step, size = np.linalg.solve(curve - now.cross + _RIDGE * np.eye(width), slope), 1.0
        if slope @ step < 1e-12:
            break
        after = at(w - step)
        while size > 1e-6 and loss(after, w - size * step) > loss(now, w) + 1e-9:
            size /= 2
            after = at(w - size * step)
        if size <= 1e-6:
            break
        gained = loss(now, w) - loss(after, w - size * step)
        w, now = w - size * step, after
        if gained < 1e-9:
            break
    return w, now


def _added(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    total: dict[int, np.ndarray] = {}
    for keys, sums in parts:
        for key, row in zip(keys.tolist(), sums, strict=True):
            total[key] = total[key] + row if key in total else row
    return total


def bradley_terry(better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """The weights of ``descend`` for rows that are at hand."""
    x, quality = np.concatenate([better, worse]), np.repeat([1, 0], [len(better), len(worse)])

    def over_rows(f):
        total = _added(f(x, quality))
        keys = np.array(sorted(total), np.int64)
        return keys, np.array([total[k] for k in keys.tolist()]).reshape(len(keys), -1)

    return descend(over_rows, x.shape[1])[0]


class Ranking:
    """Weights and the strength at which the cut falls."""

    def __init__(self, weights: np.ndarray, cut: float):
        self.weights, self.cut = weights, cut

    def score(self, texts: list[str]) -> np.ndarray:
        """Between 0 and 1, THRESHOLD at the cut."""
        z = features(texts) @ self.weights - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), x.shape[1]).cast(pa.list_(kind))


def _matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists, all of one length, as the rows of a matrix."""
    flat = lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()
    return np.asarray(flat, np.float64).reshape(len(lists), -1) if len(lists) else np.empty((0, N_FEATURES + 1))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """quality and x (features) of every row of ``docs`` and each quality that its id is labelled with, held-out ids left aside.

    Features are made before the join, so that it shuffles them and not the texts, which are larger.
    """
    usable = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out("doc_id"))
    known = usable.select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(features(texts_of(batch)).astype(np.float32), pa.float32())], ["doc_id", "x"])

    ours = docs.select("doc_id", "text").where("doc_id is not null").where(~held_out("doc_id"))
    rows = map_texts(ours, work, "doc_id bigint, x array<float>").join(known, "doc_id")
    # In this order a fit to the same rows adds the same numbers up in the same way.
    return rows.sortWithinPartitions("doc_id", "quality", "x").select("quality", "x")


def _of_blocks(batches: Iterator[pa.RecordBatch], block_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(0, batch.num_rows, block_rows):
            part = batch.slice(k, block_rows)
            yield _matrix(part.column("x")), part.column("quality").to_numpy()


def _passes(rows: DataFrame, block_rows: int) -> Passes:
    """Sums over a written table of rows: by task, then by key."""

    def over_rows(f):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _added(part for x, quality in _of_blocks(batches, block_rows) for part in f(x, quality))
            if total:
                part = [TaskContext.get().partitionId()] * len(total)
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(part, pa.int32()), _lists(np.array(list(total.values())), pa.float64())], ["key", "part", "sums"])

        def add(group: pa.Table) -> pa.Table:
            one = _matrix(group.sort_by("part").column("sums")).sum(0, keepdims=True)
            return pa.table({"key": group.column("key").slice(0, 1), "sums": _lists(one, pa.float64())})

        parts = rows.mapInArrow(work, "key bigint, part int, sums array<double>")
        found = parts.groupBy("key").applyInArrow(add, "key bigint, sums array<double>").toArrow().sort_by("key")
        return found.column("key").to_numpy(), _matrix(found.column("sums"))

    return over_rows


def ranked(values: DataFrame, rank: int) -> float:
    """The value of the column ``z`` that has ``rank`` rows before it in order: ranges are cut finer around it."""
    low, high = values.agg(F.min("z"), F.max("z")).first()
    while low < high:
        mine = values.where(F.col("z").between(low, high))
        number = F.least(F.floor((F.col("z") - low) * (_RANGES / (high - low))), F.lit(_RANGES - 1))
        for row in sorted(mine.groupBy(number.alias("k")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).collect()):
            if rank < row.n:
                break
            rank -= row.n
        if rank in (0, row.n - 1):
            return row.low if rank == 0 else row.high
        low, high = row.low, row.high
    return low


def fit(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> Ranking:
    """A ranking of ``docs`` (doc_id, text) from ``labels`` (doc_id, quality 0 or 1), held-out ids left aside.

    Rows of labels without an id or a quality are not used. Without both qualities the weights are 0, every
    score is then above THRESHOLD. All other labelled rows are used, in products of ``block_rows`` rows.
    """
    rows = staged(labelled(docs, labels), "labelled")
    w, pairs = descend(_passes(rows, block_rows), N_FEATURES)
    if not pairs.better or not pairs.worse:
        drop_staged(rows)
        return Ranking(w, -1.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _of_blocks(batches, block_rows):
            yield pa.RecordBatch.from_arrays([pa.array(x @ w)], ["z"])

    strengths = staged(rows.mapInArrow(work, "z double"), "strengths")
    cut = (ranked(strengths, pairs.worse - 1) + ranked(strengths, pairs.worse)) / 2
    drop_staged(rows, strengths)
    return Ranking(w, cut)


def kept(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is THRESHOLD or more."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            yield batch.filter(pa.array(ranking.score(texts_of(batch)) >= THRESHOLD))

    return map_texts(docs, work, fields)


def judge(docs: DataFrame, labels: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row.

    A null or empty text has all features at 0 and gets a score like any other. Rows that repeat are scored
    alike, rows without an id are scored and never held out, an empty table gives an empty one, and columns other
    than doc_id and text are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranking = fit(plain, labels, block_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            score = ranking.score(texts_of(batch))
            predicted = pa.array((score >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted], ["doc_id", "held_out", "score", "predicted"])

    marked = plain.withColumn("held_out", F.coalesce(held_out("doc_id"), F.lit(False)))
    return map_texts(marked, work, "doc_id bigint, held_out boolean, score double, predicted int")
