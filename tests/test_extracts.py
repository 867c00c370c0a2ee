"""The map extract source: what is written is read, kinds apart, broken files named."""

import random
import struct
import uuid

import numpy as np
import pytest

from ridgeloom.functions import tags
from ridgeloom.operators import extracts as graph_of
from ridgeloom.sources import extracts

ROWS = [
    ("node", 1, 45.0, 6.0, {"name": "Col é", "natural": "peak"}, None), ("node", 5, 45.1, -6.1, None, None), ("node", 3, -45.0000001, 179.9999999, {}, None), ("node", 9, 45.2, 6.2, {"empty": ""}, None),
    ("way", 10, None, None, {"highway": "path"}, [1, 5, 5, 3, 77, 9]), ("way", 11, None, None, {"highway": "track"}, [9]), ("way", 12, None, None, None, [1, 5]), ("way", -13, None, None, {"highway": "footway"}, [3, 1]),
]


def written(spark, tmp_path, rows, parts=1):
    extracts.register(spark)
    path = str(tmp_path / uuid.uuid4().hex)
    spark.createDataFrame(rows, extracts.SCHEMA).repartition(parts).write.format("mapextract").mode("append").save(path)
    return path


def as_rows(df):
    return sorted((r.kind, r.id, r.lat, r.lon, tuple(sorted((r.tags or {}).items())), tuple(r.refs) if r.refs is not None else None) for r in df.collect())


WANT = sorted((k, i, a, b, tuple(sorted((t or {}).items())), tuple(r) if r is not None else None) for k, i, a, b, t, r in ROWS)


@pytest.mark.parametrize("parts", [1, 3])
def test_rows_come_back_whole_and_by_kind(spark, tmp_path, parts):
    path = written(spark, tmp_path, ROWS, parts)
    read = spark.read.format("mapextract")
    assert as_rows(read.load(path)) == WANT
    assert as_rows(read.option("kinds", "way").load(path)) == [r for r in WANT if r[0] == "way"]
    assert as_rows(read.option("kinds", "node").option("runBytes", 1).load(path)) == [r for r in WANT if r[0] == "node"]


def test_filters_on_the_kind_reach_the_source(spark, tmp_path):
    path = written(spark, tmp_path, ROWS)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df = spark.read.format("mapextract").option("pushdown", "true").load(path)
        assert as_rows(df.where("kind = 'way'")) == [r for r in WANT if r[0] == "way"]
        assert df.where("kind in ('node') and id > 3").count() == 2
    finally:
        spark.conf.set(name, before)
    reader = extracts._Pushing(path, extracts.KINDS, 1)
    list(reader.pushFilters([extracts.EqualTo(("kind",), "way")]))
    assert reader.kinds == ("way",)


def test_plain_nodes_offsets_and_other_fields_are_read():
    node = extracts._field(1, int(extracts.zigzag(np.array([-7]))[0])) + extracts._field(8, int(extracts.zigzag(np.array([450000000]))[0])) + extracts._field(9, int(extracts.zigzag(np.array([60000000]))[0]))
    node += extracts._field(2, extracts.pack(np.array([1]))) + extracts._field(3, extracts.pack(np.array([2]))) + extracts._field(4, b"\x08\x01")  # with info
    strings = extracts._field(1, b"") + extracts._field(1, b"k") + extracts._field(1, b"v")
    block = extracts._field(1, strings) + extracts._field(2, extracts._field(1, node)) + extracts._field(17, 1000) + extracts._field(19, 5) + extracts._field(2, extracts._field(4, b"\x08\x01"))  # a relation
    (batch,) = extracts.decode(memoryview(block))
    assert batch.to_pylist() == [{"kind": "node", "id": -7, "lat": (450000000000 + 5) / 1e9, "lon": 60.0, "tags": [("k", "v")], "refs": None}]


def test_broken_files_are_named(spark, tmp_path):
    extracts.register(spark)
    for k, body in enumerate((b"\x00\x00", struct.pack(">I", 1 << 20) + b"x" * 100, struct.pack(">I", 3) + b"\x0a\x05x" + b"zzz")):
        path = tmp_path / f"broken{k}.osm.pbf"
        path.write_bytes(body)
        with pytest.raises(Exception, match="BadExtract|ends within|too long|runs on"):
            spark.read.format("mapextract").load(str(path)).collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert spark.read.format("mapextract").load(str(empty)).count() == 0


def test_missing_nodes_break_ways_and_nodes_without_an_edge_have_no_place(spark, tmp_path):
    df = spark.read.format("mapextract").load(written(spark, tmp_path, ROWS))
    refs = graph_of.walkable(df, tags.classify_way)
    assert {r.way for r in refs.collect()} == {10, -13}  # one has a single reference, one no tag
    steps = graph_of.steps_between_known(refs, df)
    assert sorted((r.way, r.pos, r.a, r.b) for r in steps.collect()) == [(-13, 1, 3, 1), (10, 1, 1, 5), (10, 3, 5, 3)]
    assert sorted((r.a_id, r.a, r.b_id, r.b) for r in graph_of.placed(steps).collect()) == [(1, 0, 5, 2), (3, 1, 1, 0), (5, 2, 3, 1)]


def test_ways_of_a_block_are_packed_together(monkeypatch):
    """Numbers of all ways go through numpy at once, and come back as they were, those of ways without tags or references too."""
    rng, calls = random.Random(4), []
    refs = [None, [], [5], [2**62, -(2**62)], [3, 3, 10**12, 0]]
    rows = [{"kind": "way", "id": rng.choice([0, -1, 127, 128, 2**40, -(2**63)]), "tags": rng.choice([None, [], [("é", "x"), ("b", None)]]), "refs": rng.choice(refs)} for _ in range(300)]
    for name in ("pack", "unpack"):
        plain = getattr(extracts, name)
        monkeypatch.setattr(extracts, name, lambda data, plain=plain: calls.append(1) or plain(data))
    (got,) = extracts.decode(memoryview(extracts.encode(rows, "way")))
    assert [(r["id"], dict(r["tags"]), r["refs"]) for r in got.to_pylist()] == [(r["id"], {k: v or "" for k, v in r["tags"] or ()}, r["refs"] or []) for r in rows]
    assert len(calls) <= 10
    with pytest.raises(extracts.BadExtract, match="runs on"):
        extracts.unpack_all([memoryview(b"\x01"), memoryview(b"\x80"), memoryview(b"\x01")])
