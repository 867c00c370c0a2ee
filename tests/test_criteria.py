"""Request bodies: criteria as they are read, or the first field at fault."""

import json

import pytest
from pyspark.sql import functions as F

from ridgeloom.sources import criteria

BASE = {"start": [6.1294, 45.8992], "target": {"distance": 10}, "surface": "any", "pace": 6}
AREA = {"center": [6.15, 45.9], "radius": 400}


def without(*names):
    return {k: v for k, v in BASE.items() if k not in names}


#: (what is sent beside or instead of the base, the field at fault or what the criteria have)
CASES = [
    ({"elevationGain": 300}, {"gain": 300.0, "level": None}), ({"target": {"duration": 90}, "elevationGain": "hilly"}, {"level": "hilly", "duration": 90.0, "distance": None}), ({"elevationGain": "flat"}, {"level": "flat"}),
    ({"name": "x"}, {"km": 10.0}), ({}, {"gain": None, "level": None, "repeats": False, "technical": False}), ({"start": [6.1294]}, "start"), ({"start": [6.1294, 91]}, "start"), ({"start": [181, 45]}, "start"), ({"start": ["6", 45]}, "start"),
    ({"target": {}}, "target"), ({"target": {"distance": 10, "duration": 60}}, "target"), ({"target": {"distance": 1.9}}, "target"), ({"target": {"distance": 51}}, "target"), ({"target": {"duration": 14}}, "target"),
    ({"target": {"duration": 361}}, "target"), ({"target": {"distance": None}}, "target"), ({"target": [10]}, "target"), ({"target": {"laps": 3}}, "target"), ({"elevationGain": -1}, "elevationGain"), ({"elevationGain": 2501}, "elevationGain"),
    ({"elevationGain": "steep"}, "elevationGain"), ({"elevationGain": None}, "elevationGain"), ({"elevationGain": True}, "elevationGain"), ({"elevationGain": "300"}, "elevationGain"), ({"surface": "sand"}, "surface"), ({"surface": 3}, "surface"),
    ({"pace": 0}, "pace"), ({"pace": 2.98333}, "pace"), ({"pace": 3}, {"pace": 3.0}), ({"pace": 12}, {"pace": 12.0}), ({"pace": 12.01666}, "pace"), ({"pace": 1e308}, "pace"), ({"pace": "6"}, "pace"), ({"pace": [6]}, "pace"),
    ({"target": {"distance": 50}, "elevationGain": 2500}, {"km": 50.0, "gain": 2500.0}), ({"target": {"duration": 360}, "pace": 7.2}, {"km": 50.0}), ({"target": {"duration": 30}, "elevationGain": 2000}, "target"), ({"target": {"duration": 360}}, "target"),
    ({"target": {"duration": 360}, "pace": 9}, {"km": 40.0}), ({"surface": "paved", "includeTechnical": True}, {"technical": True, "surface": "paved"}), ({"waypoints": [[6.14, 45.9], [6.13, 45.91]]}, {"waypoints": [(6.14, 45.9), (6.13, 45.91)]}),
    ({"waypoints": [[6.1, 45.9]] * 5}, {"waypoints": [(6.1, 45.9)] * 5}), ({"waypoints": []}, {"waypoints": []}), ({"waypoints": [[6.1, 45.9]] * 6}, "waypoints"), ({"waypoints": {"lon": 6.1}}, "waypoints"), ({"waypoints": [[6.1]]}, "waypoints"),
    ({"waypoints": [[6.1, 91]]}, "waypoints"), ({"waypoints": None}, "waypoints"), ({"avoidedAreas": [AREA]}, {"areas": [(6.15, 45.9, 400.0)]}), ({"avoidedAreas": [AREA] * 4}, ("avoidedAreas", 0)), ({"avoidedAreas": [AREA, {**AREA, "radius": 5000}]}, ("avoidedAreas", 2)),
    ({"avoidedAreas": [{**AREA, "radius": 10}]}, ("avoidedAreas", 1)), ({"avoidedAreas": [{"radius": 400}]}, ("avoidedAreas", 1)), ({"avoidedAreas": [AREA, {"center": [6.1296, 45.8993], "radius": 400}]}, ("avoidedAreas", 2)),
    ({"waypoints": [[6.15, 45.9]], "avoidedAreas": [AREA]}, ("avoidedAreas", 1)), ({"repeats": True}, {"repeats": True}), ({"repeats": False}, {"repeats": False}), ({"repeats": "yes"}, "repeats"), ({"repeats": None}, "repeats"), ({"includeTechnical": "yes"}, "includeTechnical"),
    ({"pace": 0, "surface": "sand"}, "surface"), ({"target": {"duration": 360}, "avoidedAreas": [{}]}, ("avoidedAreas", 1)),
]


@pytest.fixture(scope="module")
def read(spark):
    bodies = [json.dumps({**BASE, **more}) for more, _ in CASES] + ["null", "7", "{", "", json.dumps(without("start")), json.dumps(without("target")), json.dumps(without("surface", "pace")), json.dumps([BASE]), None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    return {r.id: r for r in criteria.read(df).collect()}


def test_each_case_gives_its_criteria_or_its_field(read):
    for k, (more, want) in enumerate(CASES):
        row = read[k]
        if isinstance(want, dict):
            assert row.field is None and row.area == 0, more
            for name, value in want.items():
                got = row.criteria[name]
                assert ([tuple(x) for x in got] if isinstance(value, list) else got) == value, more
        else:
            field, area = want if isinstance(want, tuple) else (want, 0)
            assert (row.field, row.area, row.criteria) == (field, area, None), more


def test_bodies_that_are_no_object_fail_at_the_start(read):
    n = len(CASES)
    assert [read[n + k].field for k in range(9)] == ["start", "start", "start", "start", "start", "target", "surface", "start", "start"]


def test_a_climb_that_is_not_counted_is_checked_and_dropped(spark):
    bodies = [{**BASE, "target": {"duration": 30}, "elevationGain": 2000}, {**BASE, "elevationGain": 2501}]
    rows = criteria.read(spark.createDataFrame([(json.dumps(b),) for b in bodies], "body string"), count_gain=False).collect()
    assert rows[0].field is None and rows[0].criteria.gain is None and rows[0].criteria.km == 5.0 and rows[1].field == "elevationGain"


def test_a_climb_is_written_as_a_word_or_a_number(spark):
    df = spark.createDataFrame([("hilly", None), (None, 250.5), (None, None)], "level string, gain double")
    assert [r.j for r in df.select(F.to_json(F.struct(criteria.gain_union(F.col("level"), F.col("gain")).alias("elevationGain"))).alias("j")).collect()] == ['{"elevationGain":"hilly"}', '{"elevationGain":250.5}', "{}"]
