"""Map extracts in the public PBF format, as a Spark data source that reads and writes.

    extracts.register(spark)
    spark.read.format("mapextract").load(path)                      # kind, id, lat, lon, tags, refs
    spark.read.format("mapextract").option("kinds", "way").load(path)
    rows.write.format("mapextract").mode("append").save(folder)

A file is a row of blobs, each compressed on its own, so a partition is a run of blobs: the driver walks over the blobs'
headers and reads no data. A task reads one blob at a time. Groups of kinds that are not asked for, by the option or by a
filter on ``kind`` that Spark pushes down, are not decoded. Dense nodes, references and tags are decoded as arrays. A
folder is read as all its extracts, and written as one for each task, named when the job is done.
"""

from __future__ import annotations

import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>"
KINDS = ("node", "way")
SUFFIX = ".osm.pbf"
#: Bytes of a blob's header and of a blob at most, entities of a written blob, nanodegrees of a unit.
MOST_HEADER, MOST_BLOB, BLOB_ROWS, GRANULARITY = 64 << 10, 32 << 20, 8000, 100
#: Field numbers of the format.
HEADER = {"type": 1, "datasize": 3}
BLOB = {"raw": 1, "raw_size": 2, "zlib": 3}
BLOCK = {"strings": 1, "groups": 2, "granularity": 17, "lat_offset": 19, "lon_offset": 20}
GROUP = {"nodes": 1, "dense": 2, "ways": 3}
NODE = {"id": 1, "keys": 2, "vals": 3, "lat": 8, "lon": 9}
DENSE = {"id": 1, "lat": 8, "lon": 9, "keys_vals": 10}
WAY = {"id": 1, "keys": 2, "vals": 3, "refs": 8}


class BadExtract(ValueError):
    """A file that is not in the format."""


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadExtract("a number runs on beyond its field")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields: numbers as they are, others as their bytes."""
    at, end = 0, len(data)
    while at < end:
        key, at = (key, at + 1) if (key := data[at]) < 0x80 else _varint(data, at)  # most have one byte
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield key >> 3, value
            continue
        if kind == 2:
            size, at = (size, at + 1) if at < end and (size := data[at]) < 0x80 else _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise BadExtract(f"a field of unknown type {kind}")
        if at + size > end:
            raise BadExtract("a field runs on beyond its message")
        yield key >> 3, data[at : at + size]
        at += size


def unpack(data: memoryview) -> np.ndarray:
    """The unsigned numbers of a packed field."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(raw):
        return np.empty(0, np.uint64)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise BadExtract("a number runs on beyond its field")
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    if size.max() > 10:
        raise BadExtract("a number of more than 64 bits")
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(size.max())):
        live = size > k
        out[live] |= (raw[starts[live] + k] & np.uint8(0x7F)).astype(np.uint64) << np.uint64(7 * k)
    return out


def unpack_all(parts: list[memoryview]) -> tuple[np.ndarray, np.ndarray]:
    """(unsigned numbers of all packed fields, how many each has), in one pass over them together."""
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    whole, end = b"".join(parts), np.cumsum(size)
    last = np.frombuffer(whole, np.uint8) < 0x80
    if not last[end[size > 0] - 1].all():
        raise BadExtract("a number runs on beyond its field")
    return unpack(memoryview(whole)), np.diff(np.concatenate([[0], np.cumsum(last)])[end], prepend=0)


def unsign(values: np.ndarray) -> np.ndarray:
    """Signed numbers of the zigzag form."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """The packed form of unsigned numbers."""
    rest = values.astype(np.uint64)
    if not len(rest):
        return b""
    digits = np.stack([(rest >> np.uint64(7 * k)) & np.uint64(0x7F) for k in range(10)], 1).astype(np.uint8)
    size = np.maximum(10 - (digits[:, ::-1] != 0).argmax(1), 1)
    size[rest == 0] = 1
    place = np.arange(10)
    digits |= np.where(place < (size - 1)[:, None], 0x80, 0).astype(np.uint8)
    return digits[place < size[:, None]].tobytes()


def pack_all(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The packed forms of runs of so many unsigned numbers each, in one pass over them together."""
    whole, values = pack(values), values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    cut = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [whole[a:b] for a, b in itertools.pairwise(cut)]


def zigzag(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int64)
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def deltas(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=0)


def _number(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _header(source, at: int, size: int) -> tuple[str, int, int]:
    """(type, bytes of the blob, place of the blob) of the header at a place."""
    if at + 4 > size:
        raise BadExtract("a file ends within a header")
    source.seek(at)
    (long,) = struct.unpack(">I", source.read(4))
    if long > MOST_HEADER or at + 4 + long > size:
        raise BadExtract("a blob's header is too long")
    found = dict(fields(memoryview(source.read(long))))
    kind, data = found.get(HEADER["type"]), found.get(HEADER["datasize"])
    if kind is None or not isinstance(data, int) or data > MOST_BLOB or at + 4 + long + data > size:
        raise BadExtract("a blob's header has no type, or a size that cannot be")
    return bytes(kind).decode(), data, at + 4 + long


def _data(blob: memoryview) -> memoryview:
    found = dict(fields(blob))
    if BLOB["zlib"] in found:
        return memoryview(zlib.decompress(found[BLOB["zlib"]]))
    if BLOB["raw"] in found:
        return found[BLOB["raw"]]
    raise BadExtract("a blob is compressed in a way that is not supported")


def _columns(kind: str, ids, lat, lon, tag_sizes, keys, values, ref_sizes, refs, strings: pa.Array) -> pa.RecordBatch:
    n = len(ids)
    offsets = lambda s: pa.array(np.concatenate([[0], np.cumsum(s)]).astype(np.int32))
    tags = pa.MapArray.from_arrays(offsets(tag_sizes), strings.take(pa.array(keys)), strings.take(pa.array(values)))
    node = kind == "node"
    places = [pa.array(c) if node else pa.nulls(n, pa.float64()) for c in (lat, lon)]
    held = pa.nulls(n, pa.list_(pa.int64())) if node else pa.ListArray.from_arrays(offsets(ref_sizes), pa.array(refs))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), pa.array(np.asarray(ids, np.int64)), *places, tags, held], ["kind", "id", "lat", "lon", "tags", "refs"])


_NONE = np.empty(0, np.int64)


def _dense(data: memoryview, scale, strings: pa.Array) -> pa.RecordBatch:
    found = dict(fields(data))
    signed = lambda name: unsign(unpack(found.get(DENSE[name], memoryview(b""))))
    ids, lat, lon = (np.cumsum(signed(n)) for n in ("id", "lat", "lon"))
    if not len(ids) == len(lat) == len(lon):
        raise BadExtract("dense nodes of different numbers of ids and positions")
    codes = unpack(found.get(DENSE["keys_vals"], memoryview(b""))).astype(np.int64)
    sizes = np.zeros(len(ids), np.int64)
    keys = values = _NONE
    if len(codes):  # key, value, key, value, 0 for each node; a value may be the string 0, a key never is
        at, cuts = 0, []
        for k in range(len(ids)):
            first = at
            while at < len(codes) and codes[at]:
                at += 2
            sizes[k] = (at - first) // 2
            cuts.append(at)
            at += 1
        keep = np.ones(len(codes), bool)
        keep[[c for c in cuts if c < len(codes)]] = False
        pairs = codes[keep]
        if len(pairs) % 2:
            raise BadExtract("a key without a value")
        keys, values = pairs[::2], pairs[1::2]
    return _columns("node", ids, scale(lat, 0), scale(lon, 1), sizes, keys, values, _NONE, _NONE, strings)


def _plain(kind: str, rows: list[memoryview], scale, strings: pa.Array) -> pa.RecordBatch:
    number = NODE if kind == "node" else WAY
    none, ids, lat, lon = memoryview(b""), [], [], []
    packed: dict[str, list[memoryview]] = {n: [] for n in ("keys", "vals", "refs")}
    for row in rows:
        found = dict(fields(row))
        if number["id"] not in found:
            raise BadExtract(f"a {kind} without an id")
        for n, parts in packed.items():
            parts.append(found.get(number.get(n), none))
        ids.append(found[number["id"]])
        if kind == "node":
            lat.append(found.get(NODE["lat"], 0))
            lon.append(found.get(NODE["lon"], 0))
    (keys, tags), (values, others), (steps, refs) = map(unpack_all, packed.values())
    if not np.array_equal(tags, others):
        raise BadExtract("a key without a value")
    steps = np.cumsum(unsign(steps))
    first = np.cumsum(refs) - refs
    steps -= np.repeat(np.concatenate([[0], steps])[first], refs)  # each way's begin anew
    signed = lambda v: unsign(np.array(v, np.uint64))
    ids = signed(ids) if kind == "node" else np.array(ids, np.uint64).astype(np.int64)
    return _columns(kind, ids, scale(signed(lat), 0), scale(signed(lon), 1), tags, keys.astype(np.int64), values.astype(np.int64), refs, steps, strings)


def decode(block: memoryview, kinds: tuple[str, ...] = KINDS) -> Iterator[pa.RecordBatch]:
    """The entities of a block, as rows."""
    strings, groups, scalar = [], [], {"granularity": GRANULARITY, "lat_offset": 0, "lon_offset": 0}
    names = {v: k for k, v in BLOCK.items()}
    for number, value in fields(block):
        if number == BLOCK["strings"]:
            strings = [bytes(s).decode("utf-8", "replace") for n, s in fields(value) if n == 1]
        elif number == BLOCK["groups"]:
            groups.append(value)
        elif number in names:
            scalar[names[number]] = int(np.uint64(value).astype(np.int64))
    words = pa.array(strings, pa.string())
    scale = lambda v, k: (scalar["lon_offset" if k else "lat_offset"] + scalar["granularity"] * v) / 1e9
    for group in groups:
        rows: dict[str, list[memoryview]] = {k: [] for k in kinds}
        for number, value in fields(group):
            if number == GROUP["dense"] and "node" in kinds:
                yield _dense(value, scale, words)
            elif number == GROUP["nodes"] and "node" in kinds:
                rows["node"].append(value)
            elif number == GROUP["ways"] and "way" in kinds:
                rows["way"].append(value)
        for kind, found in rows.items():
            if found:
                yield _plain(kind, found, scale, words)


@dataclass
class Run(InputPartition):
    """Blobs of a file, by their places and sizes."""

    path: str
    blobs: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kinds: tuple[str, ...], run_bytes: int):
        self.path, self.kinds, self.run_bytes = path, kinds, run_bytes

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        info = store.get_file_info(path)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(SUFFIX)), key=lambda f: f.path)
        runs: list[InputPartition] = []
        for file in files:
            at, held, blobs = 0, 0, []
            with store.open_input_file(file.path) as source:
                while at < file.size:
                    kind, size, place = _header(source, at, file.size)
                    at = place + size
                    if kind == "OSMData":
                        blobs.append((place, size))
                        held += size
                    if held >= self.run_bytes:
                        runs.append(Run(file.path, blobs))
                        held, blobs = 0, []
            if blobs:
                runs.append(Run(file.path, blobs))
        return runs or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.blobs or not self.kinds:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_file(partition.path) as source:
            for place, size in partition.blobs:
                source.seek(place)
                yield from decode(_data(memoryview(source.read(size))), self.kinds)


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes the kinds that are asked for; Spark still checks every filter."""
        for f in filters:
            wanted = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("kind",):
                self.kinds = tuple(k for k in self.kinds if k in wanted)
            yield f


@dataclass
class Written(WriterCommitMessage):
    path: str
    final: str


def encode(rows: list[dict], kind: str) -> bytes:
    """A block of nodes or ways."""
    words: dict[str, int] = {"": 0}
    code = lambda s: words.setdefault(s, len(words))
    ids = np.array([r["id"] for r in rows], np.int64)
    if kind == "node":
        flat = []
        for r in rows:
            for k, v in sorted(r["tags"] or ()):
                flat += [code(k), code(v or "")]
            flat.append(0)
        units = [np.rint(np.array([r[c] for r in rows], np.float64) * 1e9 / GRANULARITY).astype(np.int64) for c in ("lat", "lon")]
        body = _field(DENSE["id"], pack(zigzag(deltas(ids)))) + b"".join(_field(DENSE[n], pack(zigzag(deltas(u)))) for n, u in zip(("lat", "lon"), units, strict=True))
        group = _field(GROUP["dense"], body + _field(DENSE["keys_vals"], pack(np.array(flat))))
    else:
        keys, values, tags = [], [], []
        for r in rows:
            mine = sorted(r["tags"] or ())
            tags.append(len(mine))
            for k, _ in mine:
                keys.append(code(k))
            for _, v in mine:
                values.append(code(v or ""))
        many = np.array([len(r["refs"] or ()) for r in rows])
        steps = deltas(flat := np.array([n for r in rows for n in r["refs"] or ()], np.int64))
        first = (np.cumsum(many) - many)[many > 0]
        steps[first] = flat[first]  # each way's begin anew
        columns = zip(ids.astype(np.uint64).tolist(), pack_all(np.array(keys, np.uint64), tags), pack_all(np.array(values, np.uint64), tags), pack_all(zigzag(steps), many), strict=True)
        group = b"".join(_field(GROUP["ways"], _field(WAY["id"], i) + _field(WAY["keys"], k) + _field(WAY["vals"], v) + _field(WAY["refs"], n)) for i, k, v, n in columns)
    table = b"".join(_field(1, w.encode()) for w in words)
    return _field(BLOCK["strings"], table) + _field(BLOCK["groups"], group)


def blob(kind: str, data: bytes) -> bytes:
    body = _field(BLOB["raw_size"], len(data)) + _field(BLOB["zlib"], zlib.compress(data))
    head = _field(HEADER["type"], kind.encode()) + _field(HEADER["datasize"], len(body))
    return struct.pack(">I", len(head)) + head + body


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, path = self._store()
        store.create_dir(path, recursive=True)
        name = f"{path}/_{self.job}-{uuid.uuid4().hex}"
        with store.open_output_stream(name) as out:
            required = b"".join(_field(4, f.encode()) for f in ("OsmSchema-V0.6", "DenseNodes"))
            out.write(blob("OSMHeader", required))
            held: dict[str, list[dict]] = {k: [] for k in KINDS}
            for batch in iterator:
                for row in batch.to_pylist():
                    if row["kind"] not in held or row["id"] is None:
                        raise BadExtract("a row without a known kind or an id")
                    mine = held[row["kind"]]
                    mine.append(row)
                    if len(mine) == BLOB_ROWS:
                        out.write(blob("OSMData", encode(mine, row["kind"])))
                        mine.clear()
            for kind, mine in held.items():
                if mine:
                    out.write(blob("OSMData", encode(mine, kind)))
        return Written(name, f"{path}/part-{uuid.uuid4().hex}{SUFFIX}")

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = self._store()
        for m in messages:
            if m is not None:
                store.move(m.path, m.final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = self._store()
        for m in messages:
            if m is not None:
                store.delete_file(m.path)


class MapExtract(DataSource):
    """The source ``mapextract``; options: path, kinds (comma-joined), runBytes (compressed bytes of a partition), pushdown
    (true takes filters on ``kind`` from Spark, in sessions with spark.sql.python.filterPushdown.enabled; Spark refuses a
    reader that could take them in others)."""

    @classmethod
    def name(cls) -> str:
        return "mapextract"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kinds = tuple(k for k in KINDS if k in self.options.get("kinds", ",".join(KINDS)).split(","))
        reader = _Pushing if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return reader(self.options["path"], kinds, int(self.options.get("runBytes", 8 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("an extract is appended to a folder, not written over one")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    spark.dataSource.register(MapExtract)
