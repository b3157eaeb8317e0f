"""Observed reads, outputs that fail apart, templates."""

import json
import logging

import pytest
from pyspark.sql import functions as F

from tideway.functions import templates
from tideway.sources import observed, outputs


def _logs(folder):
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"plate": "x", "speed": 1.5}, {"plate": "y", "speed": None}]))
    (folder / "b.json").write_text('[{"plate": "x", "speed": 2}, {"plate"')
    (folder / "c.json").write_text('{"message": "too many requests"}')
    (folder / "d.json").write_text("[]")
    (folder / "e.json").write_text("")
    return str(folder)


def test_reports_say_what_could_not_be_read(spark, tmp_path, caplog):
    path = _logs(tmp_path / "logs")
    df, watch = observed.reports(spark, path, "plate string, speed double")
    assert sorted((r.plate, r.speed, r.src_pos) for r in df.collect()) == [("x", 1.5, 0), ("y", None, 1)]
    with caplog.at_level(logging.WARNING):
        found = watch.report()
    empty = observed.undecodable(spark, path).where("problem = 'empty'").count()  # whether the reader gives a row for an empty file
    assert (found["files"], found["undecodable"]) == (4 + empty, 2 + empty) and "could not be read" in caplog.text and "b.json" in found["first_undecodable"]
    assert sorted((r.src_file[-6:], r.problem) for r in observed.undecodable(spark, path).where("problem <> 'empty'").collect()) == [("b.json", "not JSON"), ("c.json", "not an array")]


def test_limit_is_warned_of(spark, caplog):
    for limit, hit in ((5, True), (11, False)):
        caplog.clear()
        df, watch = observed.limited(spark.range(10), limit, "trips")
        assert len(df.collect()) == min(10, limit)
        with caplog.at_level(logging.WARNING):
            assert watch.report() == {"rows": min(10, limit)}
        assert ("limit hit (5 trips)" in caplog.text) is hit


def test_progress_is_throttled():
    now, got = [0.0], []
    listener = observed.Throttled(got.append, 10.0, lambda: now[0])
    for t in (0, 1, 9.9, 10, 12, 25):
        now[0] = t
        listener.offer("q", {"t": t})
    listener.offer("other", {"t": "other"})
    assert [p["t"] for p in got] == [0, 10, 25, "other"]
    now[0] = 26
    listener.offer("q", {"t": 26})
    listener.onQueryTerminated(type("E", (), {"runId": "q"}))
    assert got[-1] == {"t": 26}
    failing = observed.Throttled(lambda p: 1 / 0, 1.0)
    assert failing.offer("q", {})


def test_progress_of_a_stream(spark, tmp_path):
    got = []
    listener = observed.Throttled(got.append, 3600.0)
    spark.streams.addListener(listener)
    try:
        for i in range(3):
            spark.range(4).withColumn("i", F.lit(i)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long, i int").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert 1 <= len(got) <= 2 and got[0]["rows"] == 4  # the first, and at the end the last


def test_outputs_fail_apart(spark, tmp_path):
    path = str(tmp_path / "out")
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (1, "a"), (None, "n")], "id long, text string")
    plain = lambda df: df.select("id", F.to_json(F.struct("id", "text")).alias("content"))
    shout = lambda df: df.select("id", F.upper("text").alias("content"))
    broken = lambda df: df.select("id", F.raise_error(F.lit("no pen")).cast("string").alias("content"))
    said = outputs.write_outputs(results, "id", {"picture": broken, "json": plain, "shout": shout, "odd": lambda df: df.select("nothing")}, path)
    assert "no pen" in said["picture"] and said["json"] is None and said["shout"] == "1 results without output" and said["odd"]
    assert sorted(r.key for r in outputs.outputs(spark, path, "json").collect()) == ["1", "2", "3"]
    assert outputs.outputs(spark, path, "picture").collect() == []
    seen = []

    def noted(df):
        seen.append(sorted(r.id for r in df.collect()))
        return df.select("id", F.coalesce("text", F.lit("none")).alias("content"))

    assert outputs.write_outputs(results, "id", {"json": noted, "shout": noted, "picture": noted}, path) == {"json": None, "shout": None, "picture": None}
    assert seen == [[], [3], [1, 2, 3]]
    assert sorted(tuple(r) for r in outputs.outputs(spark, path, "shout").collect()) == [("1", "A"), ("2", "B"), ("3", "none")]
    assert outputs.outputs(spark, path, "never").collect() == []


def test_templates(spark):
    row = {"Id": 7, "Pos": {"lat": 1.0, "lon": 2.0}, "Stops": [{"name": {"en": "A"}, "at": {"lat": 3.0, "lon": 4.0}}, {"name": None, "at": None}], "tags": {"k": "v"}}
    df = spark.createDataFrame([row, {"Id": None}], "Id long, Pos struct<lat: double, lon: double>, Stops array<struct<name: struct<en: string>, at: struct<lat: double, lon: double>>>, tags map<string, string>")
    cases = [
        ("Id", 7, None),
        ({"Pos": "lat"}, 1.0, None),
        ({"Pos": ("lat", "lon")}, (1.0, 2.0), None),
        ({"Pos": ["lon", "lat"]}, [2.0, 1.0], [None, None]),
        (("Id", {"Pos": "lon"}), (7, 2.0), (None, None)),
        ({"Stops": {"at": ("lat", "lon")}}, [(3.0, 4.0), None], None),
        ({"Stops": ({"name": "en"}, {"at": "lat"})}, [("A", 3.0), (None, None)], None),
        ({"tags": "k"}, "v", None),
        (({"Pos": "lat"}, {"Pos": "lat"}), (1.0, 1.0), (None, None)),
    ]
    for template, full, empty in cases:
        out = df.select("Id", templates.extract(template, df.schema).alias("x"))
        assert out.schema["x"].dataType.simpleString() == templates.extracted(template, df.schema).simpleString()
        got = {r.Id: r.x for r in out.collect()}
        assert (got[7], got[None]) == (full, empty), template
    for wrong in ("nothing", {"Pos": "north"}, {"Pos": "lat", "Id": "x"}, {"Stops": {"at": "x"}}, (), ["Id", {"Pos": "lat"}], {"Id": "x"}):
        with pytest.raises(ValueError):
            templates.extract(wrong, df.schema)
