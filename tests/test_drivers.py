import json

from pyspark.sql import functions as F

from tessera.__main__ import main
from tessera.operators import ports
from tessera.plans import drivers
from tessera.streaming.sessions import review_stream

SEG = "series string, recording string, seq int, id string, start_s double, end_s double, text string"
ROWS = [("S", "R", 0, "a", 0.0, 5.0, "قال الكتاب الكبير في الدرس"), ("S", "R", 1, "b", 5.0, 9.0, "nothing here"), ("S", "R", 2, None, 9.0, 12.0, None)]


def test_correction_keeps_what_cannot_be_corrected(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "bad"), (3, None), (4, "down"), (5, "same words")], "k int, text string")

    def model(t):
        if t == "down":
            raise TimeoutError("slow")
        return "<think>x</think> {\"text\": \"%s\"}" % {"one two three": "one, two three", "bad": "far too long a reply for that", "same words": "same words"}[t]

    got = {r.k: (r.text, r.changed, r.fallback, r.reason) for r in ports.correct(df, "text", model).collect()}
    assert got[1] == ("one, two three", True, False, None) and got[5] == ("same words", False, False, None) and got[3] == (None, False, False, None)
    assert got[2][:3] == ("bad", False, True) and got[4][:3] == ("down", False, True) and "TimeoutError" in got[4][3]


def test_stages(spark, tmp_path):
    v0 = spark.createDataFrame(ROWS, SEG)
    detail = drivers.run_v0_v1(spark, v0, lambda t: json.dumps({"text": t}), str(tmp_path / "a"))
    assert detail == {"total": "3", "changed": "0", "fallback": "0"}
    v1 = spark.read.parquet(str(tmp_path / "a/v1")).select(*[c.split()[0] for c in SEG.split(", ")])
    corpus = spark.createDataFrame([("ayah", "CH001_V002", "الْكِتَابُ الْكَبِيرُ"), ("ayah", "CH009_V001", "غير هذا كله"), ("dua", "D1", "x y z")], "kind string, canon_key string, text string")
    reply = lambda t: json.dumps({"ayat": [{"text": "الكتاب الكبير", "surah_number": 1, "ayah_number": 2, "usage": "quotation"}], "topics": [{"name": "N"}]}) if "قال" in t else "no reply"
    detail = drivers.run_e1_v2(spark, v1, reply, corpus, str(tmp_path / "b"))
    assert detail == {"candidates": "2", "verified": "1", "replaced": "1", "segments_without_reply": "1"}
    e1 = {r.etype: r for r in spark.read.parquet(str(tmp_path / "b/e1")).collect()}
    assert e1["ayah"].outcome == "confirmed" and e1["ayah"].best_key == "CH001_V002" and e1["topic"].verdict is None
    v2 = {r.seq: r.text for r in spark.read.parquet(str(tmp_path / "b/v2")).collect()}
    assert v2 == {0: "قال الْكِتَابُ الْكَبِيرُ في الدرس", 1: "nothing here", 2: None}
    stages = {r.stage: r.status for r in spark.read.parquet(str(tmp_path / "b/provenance")).collect()}
    assert stages == {"V2": "ok"}


def test_verses_go_before_duas(spark):
    s = spark.createDataFrame(ROWS[:1], SEG)
    e = spark.createDataFrame([(1, "R", "dua", "الكتاب الكبير", None, None), (2, "R", "ayah", "الكتاب الكبير", "1", "2")], "entity_id long, recording string, etype string, text string, surah_number string, ayah_number string")
    corpus = spark.createDataFrame([("ayah", "CH001_V002", "الْكِتَابُ الْكَبِيرُ"), ("dua", "D1", "الكتاب الكبير")], "kind string, canon_key string, text string")
    judged, out = drivers.validate(e, s, corpus)
    assert {r.entity_id: r.outcome for r in judged.collect()} == {1: "alternative_reference_selected", 2: "confirmed"}
    assert out.first().n_replaced == 2 and out.where(F.contains("text", F.lit("الكتاب الكبير"))).count() == 1


def test_review_stream(spark, tmp_path):
    acts = [{"op": "open", "segments": [{"start": 0, "end": 1, "text": "t"}]}, {"op": "finalize"}, {"op": "seg.accept", "uid": "s0"}]
    rows = [("x", i, json.dumps(a)) for i, a in enumerate(acts)]
    spark.createDataFrame(rows, "session string, n int, action string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = review_stream(spark.readStream.schema("session string, n int, action string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("reviews_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("reviews_seen").collect()] == [("x", 2, 1, 1, 0, True)]


def test_command_line(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "p4_found" in capsys.readouterr().out
    assert main(["run", "recording_catalogue", data, str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).count() > 0
    assert main(["explain", "recording_catalogue", data]) == 0
