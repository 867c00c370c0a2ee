"""What several corpus operators share: table reading, written intermediate tables, word and text units."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

#: A word: a run of anything but the space, tab, newline, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_JAVA = r"[^\x20\x09-\x0D]+"
SPACE_JAVA = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_scratch() -> str:
    return f"file://{tempfile.mkdtemp(prefix='ridgeloom-')}"


def _set_folder(context) -> str | None:
    folder = context._jsc.sc().getCheckpointDir()
    return folder.get() if folder.isDefined() else None


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or of ``setCheckpointDir``; one of our own only where none is set and
    the session is local, as in tests. Everything written lies in one folder named after the application."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or _set_folder(context)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(named or _own_scratch()).rstrip('/')}/ridgeloom-{context.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    This cuts lineage, survives lost executors, and lets several consumers read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, key: str, label: str) -> tuple[DataFrame, str]:
    """The same, dealt into as many buckets by ``key`` as the session has shuffle partitions, and the table's name. Joins
    by the key read each bucket where the other side's partition goes, and shuffle only that side."""
    spark = df.sparkSession
    name = f"ridgeloom_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}").saveAsTable(name)
    return spark.table(name), name


def drop_staged(*tables: DataFrame) -> None:
    """Removes written tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/ridgeloom-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch of texts, where the session leaves Spark's own number.
TEXT_ROWS, _DEFAULT_ROWS = "1000", "10000"


def map_texts(docs: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``docs.mapInArrow`` in batches of TEXT_ROWS rows: an executor and its Python worker each hold a batch, and Spark's
    own number of rows may be many texts. The number holds for the session; one that it has set itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if docs.sparkSession.conf.get(name, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        docs.sparkSession.conf.set(name, TEXT_ROWS)
    return docs.mapInArrow(work, schema)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about ``limit`` bytes of text at most (one longer text goes alone)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size) - size) // limit if len(size) else size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for at, end in itertools.pairwise(cuts):
            if end > at:
                yield batch.slice(at, end - at)
    pa.default_memory_pool().release_unused()  # workers are used again, by other stages


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


class Ragged:
    """Many short arrays in one: ``flat`` holds their items, ``size`` their lengths, ``start`` their places."""

    def __init__(self, flat: np.ndarray, size: np.ndarray):
        self.flat, self.size = flat, size
        self.start = np.cumsum(size) - size

    @classmethod
    def of_bytes(cls, items: list[bytes]) -> Ragged:
        return cls(np.frombuffer(b"".join(items), np.uint8), np.fromiter(map(len, items), np.int64, len(items)))

    def take(self, index: np.ndarray) -> Ragged:
        """The arrays at ``index``, in that order, repeats included."""
        size = self.size[index]
        place = np.repeat(self.start[index] - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        return Ragged(self.flat[place], size)

    def grouped(self, groups: np.ndarray, n: int) -> Ragged:
        """Neighbouring arrays joined: array i belongs to the result's array ``groups[i]`` (ascending)."""
        return Ragged(self.flat, np.bincount(groups, self.size, n).astype(np.int64))

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.start[i] : self.start[i] + self.size[i]]


#: Fixed value: the only pattern whose matches are known to start where ``encode_units`` cuts and to span letters.
CUT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_TWO_SPACES = re.compile(r"\s\s")
_UNIT_START = re.compile(r"(?<=\S)(?= \S)")


def encode_units(texts: list[str], encode) -> Ragged:
    """The ids of each whole text, where ``encode`` maps distinct short units to the Ragged of their ids.

    A text without white space at its ends or two white-space characters in a row is cut before each space
    and around each newline; any other text only before spaces between two other characters. Both cuts are
    places where a pattern like `` ?letters| ?digits| ?others|white space`` always starts a new match, so the
    ids of the units joined are those of the whole text. By Zipf's law distinct units are far fewer than units.
    """
    plain, flat, owner = [], [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        if t[0].isspace() or t[-1].isspace() or _TWO_SPACES.search(t):
            cut = _UNIT_START.split(t)
            flat += cut
            owner.append((i, len(cut)))
        else:
            plain.append(i)
    # In a plain text a newline is a unit's first character, and so is the space that cutting took away.
    spaced = pc.replace_substring(pa.array([texts[i] for i in plain], pa.large_string()), "\n", " \n")
    cut = pc.split_pattern(spaced, " ")
    sizes = np.diff(cut.offsets.to_numpy())
    pieces = cut.flatten()
    firsts = np.cumsum(sizes) - sizes
    codes = pieces.dictionary_encode()
    distinct = codes.dictionary
    index = codes.indices.to_numpy()
    lead = pc.if_else(pc.starts_with(distinct, "\n"), distinct, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct, pa.scalar(" ", pa.large_string()))).to_numpy(zero_copy_only=False).tolist()
    heads = [pieces[j].as_py() for j in firsts.tolist()]  # the first piece of a text has no space in front
    extra = list(dict.fromkeys(heads + flat))
    place = {u: len(lead) + k for k, u in enumerate(extra)}
    index = index.astype(np.int64)
    index[firsts] = [place[h] for h in heads]
    ids = encode(lead + extra)
    order = np.concatenate([index, np.array([place[u] for u in flat], np.int64)])
    group = np.concatenate([np.repeat(np.array(plain, np.int64), sizes), np.repeat(np.array([o for o, _ in owner], np.int64), [n for _, n in owner])]).astype(np.int64)
    if owner:
        by_text = np.argsort(group, kind="stable")
        order, group = order[by_text], group[by_text]
    return ids.take(order).grouped(group, len(texts))


class Remembered:
    """An encoder of distinct matches that keeps the ids of those it has seen, at most about ``limit`` of them: where it is
    full, the half that was asked for most often stays."""

    def __init__(self, encode: Callable[[list[str]], Ragged], limit: int = 1 << 17):
        self.encode, self.limit = encode, limit
        self.place: dict[str, int] = {}
        self.known = Ragged(np.empty(0, np.uint32), np.empty(0, np.int64))
        self.asked = np.empty(0, np.int64)

    def _places(self, parts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.place.get, parts, itertools.repeat(-1)), np.int64, len(parts))

    def _halve(self) -> None:
        keep = np.sort(np.argsort(-self.asked, kind="stable")[: self.limit // 2])
        names = list(self.place)
        self.place = {names[k]: i for i, k in enumerate(keep.tolist())}
        self.known, self.asked = self.known.take(keep), self.asked[keep] // 2

    def __call__(self, parts: list[str]) -> Ragged:
        found = self._places(parts)
        missing = np.flatnonzero(found < 0)
        if len(missing) and len(self.place) and len(self.place) + len(missing) > self.limit:
            self._halve()
            found = self._places(parts)
            missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(map(parts.__getitem__, missing.tolist())))
            ids = self.encode(new)
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.known = Ragged(np.concatenate([self.known.flat, ids.flat]), np.concatenate([self.known.size, ids.size]))
            self.asked = np.concatenate([self.asked, np.zeros(len(new), np.int64)])
            found[missing] = self._places(list(map(parts.__getitem__, missing.tolist())))
        self.asked[found] += 1
        return self.known.take(found)


def encode_matches(units: list[str], pattern: regex.Pattern, encode: Callable[[list[str]], Ragged]) -> Ragged:
    """The ids of each unit: its pattern matches, every distinct one encoded once, joined."""
    parts, sizes = [], []
    letters_match = pattern.pattern == CUT_PATTERN
    for u in units:
        if letters_match and (u[1:] if u[:1] == " " else u).isalpha():  # letters only: one match of the pattern
            parts.append(u)
            sizes.append(1)
        else:
            cut = pattern.findall(u) if not pattern.groups else [m.group() for m in pattern.finditer(u)]
            parts += cut
            sizes.append(len(cut))
    distinct = dict.fromkeys(parts)
    place = dict(zip(distinct, range(len(distinct)), strict=True))
    order = np.fromiter(map(place.__getitem__, parts), np.int64, len(parts))
    return encode(list(distinct)).take(order).grouped(np.repeat(np.arange(len(units)), sizes), len(units))


def encode_by(pattern: regex.Pattern, texts: list[str], encode: Callable[[list[str]], Ragged]) -> Ragged:
    """The ids of each whole text whose matches of the pattern are encoded separately; another pattern than CUT_PATTERN
    cuts whole texts, as nothing is known of its matches."""
    if pattern.pattern != CUT_PATTERN:
        return encode_matches(texts, pattern, encode)
    return encode_units(texts, lambda units: encode_matches(units, pattern, encode))


def word_codes(texts: list[str], fold: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of the texts: (code of each word, text it stands in, words by code).

    Words are runs between the six ASCII white-space characters; with ``fold`` A-Z are lower-cased first.
    """
    column = pa.array(texts, pa.large_string())
    if fold:
        column = pc.ascii_lower(column)
    cut = pc.ascii_split_whitespace(column)
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    pieces = cut.flatten()
    real = pc.greater(pc.binary_length(pieces), 0)
    owner, pieces = owner[real.to_numpy(zero_copy_only=False)], pieces.filter(real)
    codes = pieces.dictionary_encode()
    return codes.indices.to_numpy().astype(np.int64), owner, codes.dictionary


def dense(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number from 0 for each key, how often each number occurs)"""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number.astype(np.int64), count


def windows(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each n-word window, place of its first word): windows lie in one text; equal ones have equal numbers."""
    if len(codes) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    number = codes[place]
    for k in range(1, n):
        right = codes[place + k]
        number, _ = dense(number * (right.max(initial=0) + 1) + right)
    return number, place
