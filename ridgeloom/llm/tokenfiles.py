"""Token-id files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is the ids of its documents in ascending id order, as little-endian unsigned integers of 2 or 4 bytes,
cut into frames of FRAME_BYTES that decompress on their own. Two skippable frames follow: an index (an Arrow
stream of document id and token count) and the seek table of the seekable zstandard format, last in the file:
for each frame its compressed size, its size and the low 32 bits of the XXH64 of its content, then the number of
frames, a descriptor byte and the format's magic number. Any zstandard decoder reads such a file from start to
end; ``TokenFile`` reads the table first and then only the frames that hold a wanted document.

Each file holds a range of document ids. The bounds of the ranges come from a sample of the ids alone, so that texts
are encoded once, go through one shuffle and are written by the task that holds their range, under a name of the
attempt's own. What the written manifest names is what counts, so a task that is run again leaves at most a file
nobody reads.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeloom.llm.shared import CUT_PATTERN, Ragged, Remembered, encode_by, encode_units, map_texts, scratch_dir, slices, staged, texts_of

FRAME_BYTES = 1 << 20
LEVEL = 3
#: Documents of a file, about; ids sampled for each file to find the bounds (any bounds give the same ids and starts).
FILE_DOCS, SAMPLED = 1 << 15, 64
#: Units whose ids a worker keeps, about; units that go to the library as one text.
KEPT_UNITS, JOINED = 1 << 20, 256
#: Fixed values of the zstandard formats: skippable frames, the seek table's footer, its checksum flag.
_INDEX_MAGIC, _SEEK_MAGIC, _FOOTER_MAGIC, _CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _checksum(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) & 0xFFFFFFFF


class TokenFileWriter:
    """Appends documents to a file; nothing but the open frame and the index stays in memory."""

    def __init__(self, path: str, width: int, frame_bytes: int = FRAME_BYTES):
        where, name = _open(path)
        where.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = where.open_output_stream(name, compression=None)  # the name would else choose one
        self.kind, self.width, self.frame_bytes = f"<u{width}", width, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        self.open, self.frames, self.written = bytearray(), [], 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self._put(packed)
        self.frames.append((len(packed), len(content), _checksum(content)))

    def append(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // self.width)
        self.open += ids
        at = 0
        while len(self.open) - at >= self.frame_bytes:
            self._frame(bytes(self.open[at : at + self.frame_bytes]))
            at += self.frame_bytes
        del self.open[:at]

    def close(self) -> None:
        if self.open:
            self._frame(bytes(self.open))
        batch = pa.record_batch({"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.counts, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema.with_metadata({"width": str(self.width)})) as stream:
            stream.write_batch(batch)
        index = self.compressor.compress(sink.getvalue().to_pybytes())
        # The last number repeats the index's size, so that it is found from the end.
        self._put(struct.pack("<II", _INDEX_MAGIC, len(index) + 4) + index + struct.pack("<I", len(index)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), _CHECKSUMS, _FOOTER_MAGIC)
        self._put(struct.pack("<II", _SEEK_MAGIC, len(table)) + table)
        self.out.close()


class TokenFile:
    """Random access to the documents of one file."""

    def __init__(self, path: str):
        where, name = _open(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _FOOTER_MAGIC:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * n
        table = np.frombuffer(self.file.read_at(12 * n, at), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.packed_start, self.start = np.cumsum(self.packed) - self.packed, np.cumsum(self.sizes) - self.sizes
        (length,) = struct.unpack("<I", self.file.read_at(4, at - 12))
        index = zstandard.ZstdDecompressor().decompress(self.file.read_at(length, at - 12 - length))
        found = pa.ipc.open_stream(index).read_all()
        self.width = int(found.schema.metadata[b"width"])
        self.doc_ids, self.counts = found.column("doc_id"), found.column("n_tokens").to_numpy()
        self.places = (np.cumsum(self.counts) - self.counts) * self.width
        self.frames_read, self._kept = 0, (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            content = zstandard.ZstdDecompressor().decompress(self.file.read_at(int(self.packed[k]), int(self.packed_start[k])), max_output_size=int(self.sizes[k]))
            if _checksum(content) != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._kept = (k, content)
        return self._kept[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the file's i-th document; reads only the frames that hold them."""
        at, end = int(self.places[i]), int(self.places[i] + self.counts[i] * self.width)
        parts = []
        k = int(np.searchsorted(self.start, at, "right")) - 1
        while at < end:
            content, off = self._frame(k), at - int(self.start[k])
            parts.append(content[off : off + end - at])
            at += len(parts[-1])
            k += 1
        return np.frombuffer(b"".join(parts), f"<u{self.width}").astype(np.uint32)


@lru_cache(maxsize=4)
def load(path: str, special_as_text: bool = False):
    """The tokenizer of a JSON file, once per Python process and on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


def joined_units(tokenizer, alone: Callable[[list[str]], Ragged]) -> Callable[[list[str]], Ragged]:
    """An encoder of units that joins many into one text of the library's, and cuts its ids by the bytes they stand for.

    A unit can be joined if white space is its first character and neither its second nor its last: a match then starts
    with it behind any other such unit. All other units go ``alone``, as do all where ids and units end at different bytes.
    """
    n_bytes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab().items():
        n_bytes[i] = len(token)  # a byte-level token has a character for each byte

    def encode(units: list[str]) -> Ragged:
        fit = np.fromiter((len(u) > 1 and u[0] in " \n" and not u[1].isspace() and not u[-1].isspace() for u in units), bool, len(units))
        if not fit.any():
            return alone(units)
        ours = list(itertools.compress(units, fit))
        texts = ["".join(ours[k : k + JOINED]) for k in range(0, len(ours), JOINED)]
        lists = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, sum(map(len, lists)))
        ends, wanted = np.cumsum(n_bytes[flat]), np.cumsum(pc.binary_length(pa.array(ours, pa.large_string())).to_numpy())
        last = np.searchsorted(ends, wanted)
        if len(flat) != last[-1] + 1 or not np.array_equal(ends[last], wanted):
            return alone(units)
        joined = Ragged(flat, np.diff(last, prepend=-1))
        if len(ours) == len(units):
            return joined
        rest = alone(list(itertools.compress(units, ~fit)))
        both = Ragged(np.concatenate([joined.flat, rest.flat]), np.concatenate([joined.size, rest.size]))
        place = np.where(fit, np.cumsum(fit) - 1, len(ours) + np.cumsum(~fit) - 1)
        return both.take(place)

    return encode


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Callable[[list[str]], Ragged]:
    """Encodes texts with a byte-level tokenizer that cuts by ``pattern``; what a worker has seen is not encoded again.

    With CUT_PATTERN that holds of units, which the library cuts into matches by itself, and else of matches. A text
    that holds an added token's string goes to the library whole, as that string is no match of the pattern.
    """
    tokenizer, matcher = load(path), load(path, special_as_text=True)
    added = [a.content for a in tokenizer.get_added_tokens_decoder().values()]

    def distinct(parts: list[str]) -> Ragged:
        lists = [e.ids for e in matcher.encode_batch_fast(parts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return Ragged(np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes)

    if pattern == CUT_PATTERN and tokenizer.normalizer is None:
        together = joined_units(matcher, distinct)
        by = partial(encode_units, encode=Remembered(together, KEPT_UNITS))
    else:
        by = partial(encode_by, regex.compile(pattern), encode=Remembered(distinct, KEPT_UNITS))

    def encode(texts: list[str]) -> Ragged:
        marked = {i for i, t in enumerate(texts) if t and any(a in t for a in added)}
        found = by(texts=["" if i in marked else t for i, t in enumerate(texts)] if marked else texts)
        if not marked:
            return found
        cuts = zip(found.start.tolist(), (found.start + found.size).tolist(), strict=True)
        lists = [np.array(tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in marked else found.flat[a:b] for i, (a, b) in enumerate(cuts)]
        return Ragged(np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists)))

    return encode


def bounds(docs: DataFrame, file_docs: int) -> np.ndarray:
    """Document ids that cut the table into ranges of about ``file_docs`` rows, by a sample of SAMPLED ids a range."""
    rows = docs.count()
    files = -(-rows // file_docs)
    if files < 2:
        return np.empty(0, np.int64)
    every = max(1, rows // (files * SAMPLED))
    found = docs.select("doc_id").where(f"doc_id is not null and pmod(xxhash64(doc_id), {every}) = 0").toArrow().column("doc_id").to_numpy()
    return np.unique(np.sort(found)[[k * len(found) // files for k in range(1, files)]]) if len(found) else found


def encoded(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, width: int, cuts: np.ndarray) -> DataFrame:
    """shard (number of the id's range), doc_id and the little-endian ids of each whole text, the end id last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, pattern)
        end = np.array([end_id], f"<u{width}").tobytes()
        for batch in slices(batches):
            found = encode(texts_of(batch))
            flat = found.flat.astype(f"<u{width}").tobytes()
            places = ((found.start * width).tolist(), ((found.start + found.size) * width).tolist())
            ids = pa.array([flat[a:b] + end for a, b in zip(*places, strict=True)], pa.binary())
            keys = batch.column("doc_id")
            shard = np.searchsorted(cuts, keys.fill_null(-(1 << 63)).to_numpy(), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), keys, ids], ["shard", "doc_id", "ids"])

    return map_texts(docs, work, "shard int, doc_id bigint, ids binary")


def write(docs: DataFrame, folder: str, tokenizer_path: str, pattern: str, end_id: int, n_ids: int = 50_257, file_docs: int = FILE_DOCS) -> DataFrame:
    """Writes the files and returns their manifest: shard, file, docs, tokens, start (tokens in earlier shards).

    Shards follow one another in ascending document id, rows without an id first; rows that share an id stand in
    one shard, in the order of their ids' bytes. A null or empty text is its end id alone. An empty table makes
    no file. ``folder`` is a URI that every executor can write to.
    """
    width = 2 if n_ids <= 1 << 16 else 4
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = bounds(plain, file_docs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, name = None, None, ""

        def closed() -> pa.RecordBatch:
            out.close()
            row = {"shard": [shard], "file": [name], "docs": [len(out.counts)], "tokens": [sum(out.counts)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("shard", pa.int64()), ("file", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

        for batch in batches:
            for of, doc_id, ids in zip(batch.column("shard").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if of != shard:
                    if out is not None:
                        yield closed()
                    shard, name = of, f"{folder}/{of:06d}-{uuid.uuid4().hex}.tokens.zst"
                    out = TokenFileWriter(name, width)
                out.append(doc_id, ids.as_py())
        if out is not None:
            yield closed()

    dealt = encoded(plain, tokenizer_path, pattern, end_id, width, cuts).repartitionById(len(cuts) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", "doc_id", "ids")
    manifest = staged(map_texts(ordered, work, "shard bigint, file string, docs bigint, tokens bigint"), "manifest")
    # One row per file, so this window is small however many documents there are.
    before = F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of a manifest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                tokens = TokenFile(file)
                starts = start + np.cumsum(tokens.counts) - tokens.counts
                for at in range(0, len(starts), 4096):
                    rows = range(at, min(at + 4096, len(starts)))
                    crc = [zlib.crc32(tokens.ids(i).astype("<u4").tobytes()) for i in rows]
                    cut = slice(rows.start, rows.stop)
                    yield pa.RecordBatch.from_arrays(
                        [tokens.doc_ids.slice(at, len(rows)).combine_chunks(), pa.array(starts[cut]), pa.array(tokens.counts[cut]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    # One task for each file; a number asked for is kept, where a small table would be read by one task.
    spread = manifest.select("shard", "file", "start").repartitionById(max(1, manifest.count()), F.col("shard").cast("int")).drop("shard")
    return spread.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int) -> DataFrame:
    """Writes token files of ``docs`` to the shared folder and reads every document back from them."""
    folder = f"{scratch_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read(write(docs, folder, tokenizer_path, pattern, end_id))
