"""Readers of raw service answers on odd and on very long answers."""

import json
import random
import time

from pyspark.sql import functions as F

from loadaudit.functions import text
from loadaudit.sources import readings


def answer(spark, payload):
    content = json.dumps({"output": {"message": {"content": [{"toolUse": {"name": readings.VERDICT_TOOL, "input": payload}}]}}})
    return readings.vision_verdicts(spark.createDataFrame([("d", content)], "doc string, content string")).first()


def test_notes_that_are_no_text_are_spelled_as_json(spark):
    draw = random.Random(3)

    def value(depth):
        kinds = [lambda: draw.randrange(100), lambda: "".join(draw.choice('a"\\,: é🙂\n') for _ in range(draw.randrange(9))), lambda: draw.random() < 0.5, lambda: None]
        if depth:
            kinds += [lambda: [value(depth - 1) for _ in range(draw.randrange(4))], lambda: {f"k{i}\"\\": value(depth - 1) for i in range(draw.randrange(4))}]
        return draw.choice(kinds)()

    values = [[value(3) for _ in range(4)] for _ in range(60)]
    rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for i, v in enumerate(values)], "i int, c string")
    got = {r.i: (r.whole, r.cut) for r in rows.select("i", text.spaced_json(F.col("c")).alias("whole"), text.spaced_json(F.col("c"), 40).alias("cut")).collect()}
    for i, v in enumerate(values):
        assert got[i] == (json.dumps(v), json.dumps(v)[:40])


def test_a_megabyte_of_notes(spark):
    notes = [["x", {"a": 'q"\\'}, "é"]] * 45_000
    assert len(json.dumps(notes)) > 1_000_000
    began = time.time()
    row = answer(spark, {"cleared": True, "load_type": "silt", "confidence": 1, "notes": notes})
    assert row.notes == json.dumps(notes)[:500] and row.problems == ["notes_not_a_string"]
    assert time.time() - began < 60
    deep = "x"
    for _ in range(400):
        deep = [deep]
    assert answer(spark, {"cleared": True, "load_type": "silt", "confidence": 1, "notes": deep}).notes == json.dumps(deep)[:500]
    flat = list("a" * 2000)
    assert answer(spark, {"cleared": True, "load_type": "silt", "confidence": 1, "notes": flat}).notes == json.dumps(flat)[:500]


def test_the_last_block_of_an_id_and_the_last_query_of_an_alias(spark):
    def query(name, alias, *ids):
        return {"BlockType": "QUERY", "Id": name, "Query": {"Alias": alias}, "Relationships": [{"Type": "ANSWER", "Ids": list(ids)}, {"Type": "CHILD", "Ids": ["r9"]}]}

    def result(name, words, sure):
        return {"BlockType": "QUERY_RESULT", "Id": name, "Text": words, "Confidence": sure}

    blocks = [
        query("q1", "SITE", "r1", "r2"), result("r1", "old", 99), result("r2", "second", 50), result("r1", "", 99),
        query("q2", "NET_WEIGHT", "r3", "r4"), result("r3", "first", 70), result("r4", "tie", 70), query("q3", "TICKET_NO", "r3"), query("q4", "TICKET_NO", "none"),
        query("q5", "", "r3"), {"BlockType": "PAGE", "Id": "p"}, result("r9", "child", 100),
    ]
    frame = spark.createDataFrame([("d", json.dumps({"Blocks": blocks})), ("e", "{}"), ("f", None), ("g", '{"Blocks":[]}')], "doc string, content string")
    got = {(r.doc, r.alias): (r.text, r.confidence) for r in readings.ocr_answers(frame).collect()}
    assert got == {("d", "SITE"): ("second", 50.0), ("d", "NET_WEIGHT"): ("first", 70.0), ("d", "TICKET_NO"): (None, None)}


def test_route_geometry_at_any_depth(spark):
    line = [[72.8, 19.0], [72.81, 19.0], [72.81, 19.0]]
    docs = {
        "legs": {"Routes": [{"Legs": [{"Geometry": {"LineString": line}}, {"Geometry": {"LineString": [[72.81, 19.0], [72.9, 19.1], [1]]}}]}]},
        "route": {"Routes": [{"Geometry": {"LineString": line}, "Summary": {"Distance": 5, "Duration": 6}}]},
        "deep": {"Routes": [{"Legs": [{"Steps": [{"Part": {"Geometry": {"LineString": line}}}, {"x": [[{"Geometry": {"LineString": [[73, 19.2]]}}]]}]}]}]},
        "other": {"Routes": [{"Legs": [{"Geometry": {"Polyline": "abc"}, "LineString": line}]}, {"Geometry": {"LineString": line}}]},
        "none": {"Routes": []},
    }
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("bad", "{"), ("null", None)], "doc string, content string")
    got = {r.doc: r for r in readings.route_points(frame).collect()}
    points = {k: [(p.lon, p.lat) for p in r.points or []] for k, r in got.items()}
    a, b = (72.8, 19.0), (72.81, 19.0)
    assert points == {"legs": [a, b, (72.9, 19.1)], "route": [a, b], "deep": [a, b, (73.0, 19.2)], "other": [], "none": [], "bad": [], "null": []}
    assert (got["route"].distance_m, got["route"].duration_s, got["deep"].ok, got["other"].ok) == (5.0, 6.0, True, False)
