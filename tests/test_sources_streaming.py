"""Sources and streams."""

import json

from pyspark.sql import functions as F

from tidemark.sources import captions as P
from tidemark.sources import logs as L
from tidemark.sources import sinks as K
from tidemark.streaming import windows as W

VTT = "WEBVTT\r\n\r\n00:00:01.000 --> 00:00:02,500 align:start\r\n<c>Hello</c> &amp; bye\r\nthere\r\n\r\n1\r\n00:00:03.000 --> 00:00:04.000\r\n<b></b>\r\n\r\n00:00:05.000 --> 00:00:06.000\r\nlast"


def test_captions(spark):
    f = spark.createDataFrame([("a", VTT.encode()), ("b", b""), ("c", b"nope"), ("d", b"WEBVTT\xff")], "k string, content binary")
    d = P.decoded(f)
    assert {r.k: r.fault for r in d.collect()} == {"a": None, "b": "empty_response", "c": "malformed_response", "d": "malformed_response"}
    got = [(r.start, r.end, r.text) for r in P.cues(d, ["k"]).orderBy("pos").collect()]
    assert got == [(1.0, 2.5, "Hello & bye there"), (5.0, 6.0, "last")]
    n = P.numbered(spark.createDataFrame([("v", 0, 5.0, 6.0, "b"), ("v", 1, 1.0, 2.0, "a")], "k string, pos int, start double, end double, text string"), ["k"])
    assert [(r.seg_id, r.text, r.reordered) for r in n.orderBy("seg_id").collect()] == [("seg_0000", "a", True), ("seg_0001", "b", True)]


def test_series_keeps_nan_and_skips_unpaired(spark):
    lines = ["pts_time:1.0", "x=0.5", "x=0.6", "pts_time:2.0", "pts_time:3.0", "x=nan", "junk"]
    df = spark.createDataFrame([("v", i, x) for i, x in enumerate(lines)], "k string, line_no int, line string")
    got = [(r.t, r.value) for r in L.metadata_series(df, ["k"], "x").orderBy("t").collect()]
    assert got[0] == (1.0, 0.5) and got[1][0] == 3.0 and got[1][1] != got[1][1] and len(got) == 2


def test_operation_log(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text(json.dumps({"at": 1.0, "operation": "asr", "cache_hit": True, "secret": "x"}) + "\nnot json\n")
    rows = L.read_operations(spark, str(tmp_path / "log.jsonl"))
    assert rows.columns == [f.name for f in L.OPERATION.fields] and rows.count() == 1


def test_speech_rejects(spark):
    body = json.dumps({"segments": [{"start": 0, "end": 1, "text": " hi "}, {"start": 2, "end": 2, "text": "x"}, {"start": 900, "end": 901, "text": "y"}, {"start": 3, "end": 4, "text": " "}]})
    kept, rejects = L.speech_segments(spark.createDataFrame([("v", 100.0, 600.0, body)], "k string, offset double, duration double, body string"), ["k"])
    assert [(r.start, r.end, r.text) for r in kept.collect()] == [(100.0, 101.0, "hi")] and rejects.count() == 2


def test_sinks(spark, tmp_path):
    seg = spark.createDataFrame([("v", 0, "seg_0000", 0.0, 65.0, "a"), ("v", 1, "seg_0001", 65.0, 70.0, "b")], "k string, pos int, seg_id string, start double, end double, text string")
    assert [r.value for r in K.transcript_lines(seg, ["k"]).orderBy("pos").collect()] == ["seg_0000 [00:00-01:05] a", "seg_0001 [01:05-01:10] b"]
    assert [s["text"] for s in json.loads(K.manifest(seg, ["k"], "segments").first().document)["segments"]] == ["a", "b"]
    K.write_table(seg, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert K.empty_manifest(spark, seg.schema).columns == seg.columns


def _stream(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "k string, s double, v double").select("k", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_stream_windows_and_sessions(spark, tmp_path):
    rows = [("a", float(t), float(t)) for t in (0, 5, 25, 200)]
    s = _stream(spark, tmp_path, rows)
    got = {r.n for r in _run(W.tumbling(s, ["k"], "ts", "v", 20, "10 seconds"), "w1")}
    assert got >= {2, 1}
    assert {r.n for r in _run(W.sessions(s, ["k"], "ts", "30 seconds", "10 seconds"), "w2")} >= {3}
    assert len(_run(W.first_within(s, ["k"], "ts", "10 seconds"), "w3")) == 1


def test_stream_runs(spark, tmp_path):
    rows = [("a", float(t), v) for t, v in ((0, 1.0), (1, 1.5), (2, 9.0), (3, 9.1), (4, 1.0))]
    got = _run(W.anchored_runs(_stream(spark, tmp_path, rows), "k", "ts", "v", 2.0, 2.0, "1 second", 1000), "w4")
    assert [(r.start, r.end, r.n) for r in got][:2] == [(1000.0, 1001.0, 2), (1002.0, 1003.0, 2)]
