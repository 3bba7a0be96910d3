import datetime
import json

import pytest

from tessera.sources import files
from tessera.streaming.sessions import activity


def test_segment_files(spark, tmp_path):
    seg = [{"id": "a", "start": 0, "end": 1.5, "text": "x"}, {"start": 2, "end": 3, "text": "y"}]
    (tmp_path / "a.json").write_text(json.dumps(seg), encoding="utf-8-sig")
    (tmp_path / "b.json").write_text(json.dumps({"segments": seg[:1]}, indent=1))
    (tmp_path / "c.json").write_text("{}")
    got = files.read_segments(spark, str(tmp_path))
    assert sorted((r.path[-6:], r.seq, r.id, r.end) for r in got.collect()) == [("a.json", 0, "a", 1.5), ("a.json", 1, None, 3.0), ("b.json", 0, "a", 1.5)]
    with pytest.raises(Exception):  # noqa: B017
        files.read_segments(spark, str(tmp_path), strict=True).collect()


def test_canon_and_blocks(spark, tmp_path):
    (tmp_path / "q.csv").write_text("﻿sura,aya,text\n1,2,abc\n1,3, \n")
    assert [tuple(r) for r in files.read_canon(spark, str(tmp_path / "q.csv"), "ayah").collect()] == [("CH001_V002", "abc")]
    (tmp_path / "d.ttl").write_text(":x1 a :B .\n:x2 a :B ;\n  :t 1 .\n:y a :C .\n")
    ids = spark.createDataFrame([("x2",), ("x9",)], "id string")
    got = {r.id: r.block for r in files.read_blocks(spark, str(tmp_path / "d.ttl"), ids, r"^:(x\d+)\s").collect()}
    assert got["x9"] is None and got["x2"].startswith(":x2 a :B ;")


def test_ntriples_round_trip(spark, tmp_path):
    g = spark.createDataFrame([("s", "p", "o", "iri"), ("s", "q", 'a "b" \\ c\nd', "literal")], "s string, p string, o string, kind string")
    files.write_ntriples(g, str(tmp_path / "g"))
    assert sorted(map(tuple, files.read_ntriples(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, g.collect()))


def test_index_scope(spark, tmp_path):
    c = spark.createDataFrame([("a", "r1", "t"), ("b", "r2", "u")], "series string, recording string, text string")
    files.write_index(c, str(tmp_path / "i"))
    assert files.load_index(spark, str(tmp_path / "i"), series="b").count() == 1 == files.load_index(spark, str(tmp_path / "i"), recording="r1").count()


def test_stream_gives_the_sessions_of_the_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(u, t0 + datetime.timedelta(minutes=m)) for u, ms in ((1, (0, 5, 40, 300)), (2, (3, 12, 21))) for m in ms]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = activity(spark.read.parquet(str(tmp_path / "in")))
    stream = activity(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("acts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = {(r.user_id, r.n_events) for r in spark.table("acts").collect()}
    assert {(r.user_id, r.n_events) for r in batch.collect()} == {(1, 2), (1, 1), (2, 3)} and closed <= {(1, 2), (1, 1), (2, 3)} and (2, 3) in closed
