"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Patterns give the base spans. Every other long run of encoding characters is a candidate. Its encoding is the
smallest alphabet that spells it, and the battery looks at its symbols there: chi-squared uniformity over the alphabet,
the runs test about the median, and serial correlation of neighbours, combined by Fisher's method into the chance that
random symbols look as regular. Against it stands language: the likelihood ratio of uniform symbols over the likeliest
of some plain spellings (small letters, capitals, numbers), which grows with length, so that a short word cannot count
as a discovery. The two make one statistic: the ratio times the battery's chance. Its inverse bounds
the chance that such spellings reach it (Markov's inequality, as the ratio's mean under each is at most 1).
Benjamini-Hochberg thresholds over all candidates, one for each class of length, then bound the share of false
discoveries over the whole corpus.

One pass over the texts leaves spans and candidate statistics, written once. The thresholds come from counts of
a fixed number of (length class, log-chance bin) cells, so any number of candidates is summed before it is sent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeloom.llm.shared import drop_staged, map_texts, slices, staged, texts_of

#: Base kinds in their listed order: pattern, group that is measured, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
KINDS = ("assign", "access", "hex", "random")
MIN_ASSIGN, MIN_HEX, MIN_CANDIDATE = 12, 16, 20

_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings by size of alphabet.
ENCODINGS = (
    ("decimal", _DIGITS), ("hex", _DIGITS + "abcdef"), ("HEX", _DIGITS + "ABCDEF"), ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER), ("base62", _DIGITS + _UPPER + _LOWER),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"), ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
#: English letter frequencies in per cent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)

FDR = 0.01
#: Plain spellings: weights of small letters, capitals, digits and other symbols.
SPELLINGS = ((0.9, 0.06, 0.02, 0.02), (0.06, 0.9, 0.02, 0.02), (0.12, 0.08, 0.7, 0.1))
#: Length classes begin here; bins of the decimal logarithm of the chance.
LENGTH_CLASSES = (20, 24, 32, 48, 64, 128, 512)
_BINS_PER_DECADE, _DECADES = 10, 30

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % MIN_CANDIDATE)
_HEX_CLASS = np.zeros(256, bool)
_HEX_CLASS[list(b"0123456789abcdef")] = True


def _spelling(alphabet: str, weights: tuple[float, ...]) -> np.ndarray:
    """How a spelling spreads over an alphabet: each class by its weight, letters within it by frequency."""
    of = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in alphabet]
    share = np.array([LETTERS[ord(c.lower()) - 97] if c.isalpha() else 1.0 for c in alphabet])
    for k, weight in enumerate(weights):
        own = np.array(of) == k
        share[own] *= weight / max(1e-12, share[own].sum())
    return share / share.sum()


_PLACES, _RATIOS = [], []
for _, _alphabet in ENCODINGS:
    _at = np.full(128, -1, np.int16)
    _at[[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _PLACES.append(_at)
    # Log of uniform over each spelling, by symbol; a spelling takes part where the alphabet has its main class.
    _able = [w for w, sample in zip(SPELLINGS, (_LOWER, _UPPER, _DIGITS), strict=True) if set(sample) & set(_alphabet)]
    _RATIOS.append(np.stack([-np.log(len(_alphabet) * _spelling(_alphabet, w)) for w in _able]))


def _upper(z: float) -> float:
    """Chance of a standard normal above z."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_squared_upper(statistic: float, freedom: int) -> float:
    """Chance of a chi-squared value above the statistic, by the cube-root normal approximation."""
    spread = 2 / (9 * freedom)
    return _upper(((statistic / freedom) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def battery(token: str) -> float:
    """The chance that plain spelling has a statistic as high as the token's."""
    raw = np.frombuffer(token.rstrip("=").encode(), np.uint8)
    x, encoding = next((x, k) for k, at in enumerate(_PLACES) if (x := at[raw]).min() >= 0)
    n, k = len(x), len(ENCODINGS[encoding][1])
    counts = np.bincount(x, minlength=k)
    p_even = _chi_squared_upper(float(((counts - n / k) ** 2).sum() * k / n), k - 1)
    # Runs about the median of the alphabet.
    high = x >= k / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        centre = 1 + 2 * a * b / n
        variance = max(1e-9, (centre - 1) * (centre - 2) / (n - 1))
        p_runs = 2 * _upper(abs(runs - centre) / math.sqrt(variance))
    else:
        p_runs = 2.0 ** (1 - n) if n < 1000 else 0.0
    y = x - x.mean()
    square = float((y * y).sum())
    p_serial = 2 * _upper(abs(float((y[1:] * y[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    product = max(p_even * p_runs * p_serial, 1e-300)
    log = -math.log(product)
    regular = min(1.0, product * (1 + log + log * log / 2))  # Fisher's method for three
    ratio = float((_RATIOS[encoding] @ counts).min())
    return math.exp(-max(0.0, min(700.0, ratio + math.log(regular))))


def _hex_runs(raw: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans of maximal lower-case hex runs of MIN_HEX or more."""
    edge = np.flatnonzero(np.diff(_HEX_CLASS[raw].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= MIN_HEX
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kinds count as in KINDS."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    raw = text.encode()
    for a, b in _hex_runs(np.frombuffer(raw, np.uint8)):
        at = a if len(raw) == len(text) else len(raw[:a].decode())
        found.append((at, 2, at + b - a))
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, chance under plain spelling) of runs that touch no span of ``taken``, which is sorted."""
    out, k, reach = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(taken) and taken[k][0] < m.end():
            reach, k = max(reach, taken[k][2]), k + 1
        if reach <= m.start():
            out.append((m.start(), m.end(), battery(m.group())))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_CANDIDATES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("even", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (start, kind, end) and candidates (start, end, even) of each whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, more = [], []
            for text in texts_of(batch):
                spans = base_spans(text)
                base.append([{"start": a, "kind": k, "end": b} for a, k, b in spans])
                more.append([{"start": a, "end": b, "even": p} for a, b, p in candidates(text, spans)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPANS), pa.array(more, _CANDIDATES)], ["doc_id", "base", "candidates"])

    return map_texts(
        docs.select("doc_id", "text"), work, "doc_id bigint, base array<struct<start: bigint, kind: int, end: bigint>>, candidates array<struct<start: bigint, end: bigint, even: double>>"
    )


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTH_CLASSES[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def chance_bin(even: Column) -> Column:
    """Bins of equal width in the logarithm, the first for the smallest chances."""
    decade = F.log10(F.greatest(even, F.lit(10.0**-_DECADES)))
    return F.ceil((decade + _DECADES) * _BINS_PER_DECADE).cast("int")


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """For each length class the last bin within Benjamini-Hochberg's line, -1 where there is none.

    A bin's chance is its upper end, which only makes the bound safer. At most 7 x 301 counts reach the driver.
    """
    each = scanned.select(F.explode("candidates").alias("c")).select(length_class(F.col("c.end") - F.col("c.start")).alias("k"), chance_bin(F.col("c.even")).alias("bin"))
    cells = each.groupBy("k", "bin").count().collect()
    out = {}
    for k in range(len(LENGTH_CLASSES)):
        bins = sorted((r["bin"], r["count"]) for r in cells if r["k"] == k)
        total, seen, last = sum(c for _, c in bins), 0, -1
        for b, c in bins:
            seen += c
            if 10 ** (b / _BINS_PER_DECADE - _DECADES) * total <= fdr * seen:
                last = b
        out[k] = last
    return out


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans and found (spans as structs) of every row.

    A null or empty text has no spans. Spans of one start are ordered by kind as in KINDS. Rows that repeat are
    scanned alike and count as often as they occur in the thresholds; rows without an id are kept; an empty
    table gives an empty one; columns other than doc_id and text are not read.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _decided(staged(scan(plain), "secrets"), fdr)


def _decided(scanned: DataFrame, fdr: float) -> DataFrame:
    last = F.array(*[F.lit(b) for _, b in sorted(thresholds(scanned, fdr).items())])
    random = F.filter("candidates", lambda c: chance_bin(c["even"]) <= F.element_at(last, length_class(c["end"] - c["start"]) + 1))
    extra = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(len(KINDS) - 1).alias("kind"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.size(random).cast("long").alias("n_random"),
        F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.array_sort(F.concat("base", extra)).alias("found"),
    ).select("*", _digest(F.col("found")).alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """``docs`` with every found span of text replaced; n_chars, where there is such a column, follows the text.

    Candidates are scanned once for the thresholds; the texts are then rewritten by the same scan, row by row, so
    nothing has to be joined back by id.
    """
    fields = docs.schema.fields
    names = [f.name for f in fields]
    scanned = staged(scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("candidates"), "secrets")
    last = thresholds(scanned, fdr)
    drop_staged(scanned)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            for i, text in enumerate(texts):
                if text:
                    texts[i] = redact(text, last, mark)
            columns = dict(zip(names, batch.columns, strict=True))
            columns["text"] = pa.array(texts, batch.column("text").type)
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return map_texts(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))


def redact(text: str, last: dict[int, int], mark: str = "[secret]") -> str:
    """The text with base spans, and candidates within the thresholds, replaced by a mark."""
    spans = base_spans(text)
    cut = [(a, b) for a, _, b in spans]
    for a, b, even in candidates(text, spans):
        k = sum(b - a >= x for x in LENGTH_CLASSES[1:])
        if math.ceil((math.log10(max(even, 10.0**-_DECADES)) + _DECADES) * _BINS_PER_DECADE) <= last[k]:
            cut.append((a, b))
    out, at = [], 0
    for a, b in sorted(cut):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if cut else text
